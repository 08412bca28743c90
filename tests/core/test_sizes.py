"""Tasks that do not grow with the tables."""

import pytest

from roadtrace import session
from roadtrace.operators import rules as R
from roadtrace.operators import tracks as T
from roadtrace.plans import registry
from roadtrace.schemas import DETECTION
from test_rules import STOP, crossing, make


@pytest.mark.parametrize("rows", [2_000, 8_000])
def test_tracks_are_ordered_in_more_tasks_where_there_are_more_rows(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(session, "TASK_BYTES", 4 << 10)
    cells = [(i, i // 10 % 97, i % 10, 0, "vehicle", 0.9, i * 1.37 % 11, 0.0, i * 2.71 % 13, 1.0, i % 3) for i in range(rows)]
    spark.createDataFrame(cells, DETECTION).write.parquet(f"{tmp_path}/d")
    seen = spark.read.parquet(f"{tmp_path}/d")
    got = T.track_rows(seen)
    sizes = [n for n in got.select("video_id").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert len(sizes) > 4 and max(sizes) < 1_000 and sum(sizes) == rows
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.track_rows(seen).collect()))


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_rules_broadcast_nothing(spark):
    # written detections are small files, whatever their rows
    frames = spark.createDataFrame([], "video_id int, frame_no int, height int, width int, bgr binary")
    rows = R.run_rules(make(spark, crossing(), STOP, mpp=0.2, frames=frames))
    assert "Broadcast" not in plan_of(rows)
    assert sorted(r.violation_type for r in rows.collect()) == ["red_light_running", "speeding"]


def test_pictures_do_not_stand_in_plans(spark):
    boxes = [(f, "vehicle", (10 * v, 40, 10 * v + 60, 90), 1) for v, f in enumerate((0, 1, 5, 10))]
    frames = registry.frames_of(make(spark, boxes).detections.withColumn("video_id", (4 * (registry.F.floor("id") % 2)).cast("int") + registry.F.lit(3)))
    assert len(plan_of(frames)) < 100_000
    for r in frames.collect():
        assert len(r.bgr) == 3 * r.height * r.width
