"""Tables that are replaced by whole videos, and violations that follow a stream."""

import os

import pytest
from pyspark.sql import functions as F

from roadtrace.operators import changes as C
from roadtrace.operators import rules as R
from roadtrace.sources.video_table import PART, VideoTable, analysed
from roadtrace.streaming.incremental import ExtractionLog
from test_rules import STOP, crossing, make

ROW = "id int, video_id int, name string"


def held(spark, path, parts=4):
    rows = [(k, k % 6, f"old{k}") for k in range(24)] + [(99, None, "nobody's")]
    return VideoTable(spark, str(path), spark.createDataFrame([], ROW).schema, parts).create(spark.createDataFrame(rows, ROW)), rows


def ids(spark, *videos):
    return spark.createDataFrame([(v,) for v in videos], "video_id int")


def test_replacement_by_whole_videos(spark, tmp_path):
    table, rows = held(spark, tmp_path / "t")
    new = spark.createDataFrame([(100, 2, "new"), (101, 3, "not asked for")], ROW)
    assert table.replace(ids(spark, 2, 0, 77), new) == []
    want = [r for r in rows if r[1] not in (0, 2)] + [(100, 2, "new")]
    assert sorted(map(tuple, table.read().collect())) == sorted(want)
    again = table.replace(ids(spark, 2, 0, 77), new)
    assert again == [] and table.read().count() == len(want)


def test_emptied_partitions_go(spark, tmp_path):
    table, rows = held(spark, tmp_path / "t", 64)
    assert table.replace(ids(spark, 1, 2), spark.createDataFrame([], ROW)) == [1, 2]
    assert not os.path.exists(tmp_path / "t" / f"{PART}=1") and os.path.exists(tmp_path / "t" / f"{PART}=3")
    assert sorted(r.id for r in table.read().collect()) == sorted(r[0] for r in rows if r[1] not in (1, 2))
    table.replace(ids(spark, *range(6)), spark.createDataFrame([], ROW))
    assert [r.name for r in table.read().collect()] == ["nobody's"]
    assert table.replace(ids(spark), spark.createDataFrame([], ROW)) == []


def test_a_failed_replacement_leaves_the_old_rows(spark, tmp_path):
    table, rows = held(spark, tmp_path / "t")
    bad = spark.createDataFrame([(1, 1, "x")], ROW).withColumn("name", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken|TASK_WRITE_FAILED"):
        table.replace(ids(spark, 1), bad)
    assert table.read().count() == len(rows)


def test_status_after_an_analysis(spark):
    videos = spark.createDataFrame([(1, "imported"), (2, "reviewed")], "id int, status string")
    assert {tuple(r) for r in analysed(videos, ids(spark, 1, 1, 7)).collect()} == {(1, "prelabeled"), (2, "reviewed")}


def log_of(spark, path):
    x = make(spark, crossing(), STOP)
    votes = spark.createDataFrame([(1, 1, "ABC 12", 0.8)], "video_id int, track_id int, text string, confidence double")
    return x, votes, ExtractionLog(spark, str(path), x, votes)


OLD = "id int, video_id int, source string, license_plate string, plate_conf double"


def shown(rows):
    return sorted((r.video_id, r.source, r.violation_type or "", r.license_plate or "") for r in rows.select("video_id", "source", "violation_type", "license_plate").collect())


def test_stream_of_batches_equals_one_extraction(spark, tmp_path):
    x, votes, log = log_of(spark, tmp_path / "log")
    for k, low in enumerate((0, 1, 2)):  # the crossing needs rows of several batches
        x.detections.filter(F.col("frame_no") == low).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for k in range(3):
        for f in os.listdir(tmp_path / "in" / str(k)):
            if f.endswith(".parquet"):
                os.makedirs(tmp_path / "files", exist_ok=True)
                os.rename(tmp_path / "in" / str(k) / f, tmp_path / "files" / f"{k}.parquet")
    old = spark.createDataFrame([(1, 1, "auto", "a", 0.1), (2, 1, "manual", "b", 0.2), (3, 2, "auto", "c", 0.3)], OLD)
    videos = spark.createDataFrame([(1, "imported"), (2, "imported")], "id int, status string")
    assert shown(old.withColumn("violation_type", F.lit("x"))) == shown(log.state(old.withColumn("violation_type", F.lit("x")), videos)[0])
    log.follow(str(tmp_path / "files"), str(tmp_path / "state"), files=1).awaitTermination()
    assert sorted(os.listdir(tmp_path / "log" / "judged")) == ["batch=0", "batch=1", "batch=2"]
    rows, after = log.state(old, videos)
    want, want_after = C.extract(x, old, videos, votes)
    assert shown(rows) == shown(want) and len(shown(rows)) == 3
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in want_after.collect()}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    x, votes, log = log_of(spark, tmp_path / "log")
    old = spark.createDataFrame([], OLD)
    videos = spark.createDataFrame([(1, "imported")], "id int, status string")
    parts = [x.detections.filter("frame_no < 2"), x.detections.filter("frame_no >= 2"), x.detections.limit(0)]
    for k, part in enumerate(parts):
        log.run_batch(part, k)
    once = shown(log.state(old, videos)[0])
    for k in (1, 0, 1):
        log.run_batch(parts[k], k)
    assert shown(log.state(old, videos)[0]) == once == [(1, "auto", "red_light_running", "ABC 12")]
    assert log.judged().first().batch == 1


def test_a_batch_that_broke_off_is_not_read(spark, tmp_path, monkeypatch):
    x, votes, log = log_of(spark, tmp_path / "log")
    old, videos = spark.createDataFrame([(1, 1, "auto", "a", 0.1)], OLD), spark.createDataFrame([(1, "imported")], "id int, status string")
    write = ExtractionLog._write

    def breaking(self, rows, part, batch_id):
        if part == "judged":
            raise OSError("lost")
        write(self, rows, part, batch_id)

    monkeypatch.setattr(ExtractionLog, "_write", breaking)
    with pytest.raises(OSError):
        log.run_batch(x.detections, 0)
    monkeypatch.undo()
    assert shown(log.state(old.withColumn("violation_type", F.lit("speeding")), videos)[0]) == [(1, "auto", "speeding", "a")]
    log.run_batch(x.detections, 0)
    assert shown(log.state(old, videos)[0]) == [(1, "auto", "red_light_running", "ABC 12")]


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    from types import SimpleNamespace as Made

    from roadtrace.session import shared_dir

    context = Made(master=master, applicationId="app")
    unset, named = ({"get": lambda key, default=None, v=v: v} for v in (None, "hdfs://x/shared/"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Made(conf=Made(**unset), sparkContext=context))
    assert shared_dir(Made(conf=Made(**named), sparkContext=context)) == "hdfs://x/shared"
