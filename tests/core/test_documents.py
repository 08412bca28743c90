"""Studies, annotation files, audit trails, zone files and batches, written and read back."""

import hashlib
import hmac
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from roadtrace.operators import annotations as N
from roadtrace.operators import audit as AU
from roadtrace.operators import study as S
from roadtrace.schemas import DETECTION, DETECTION_CLASSES
from roadtrace.sources import ingest as I
from roadtrace.sources import zone_files as Z
from roadtrace.sources.video_table import VideoTable

VIOLATION = "id int, video_id int, violation_type string, start_ms int, end_ms int, confidence double, license_plate string, review_status string, source string"
VIDEO = "id int, filename string, source_type string, width int, height int, recorded_at timestamp_ntz"
DAY = datetime(2024, 1, 1, 10, 30)


def violations(spark):
    rows = [(1, 1, "speeding", 1500, 3000, 0.5, "ABC 1", "pending", None), (2, 1, "speeding", 0, 10, 0.6, "ABC 1", None, "auto"), (3, 2, "odd_code", 0, 10, 0.7, "", "pending", "manual"), (4, 9, "speeding", 0, 1, 0.1, None, "pending", "auto")]
    return spark.createDataFrame(rows, VIOLATION)


def videos(spark):
    return spark.createDataFrame([(1, "a.mp4", "cctv", 640, 480, DAY), (2, 'b"\n.mp4', None, 640, 480, None), (3, "c.mp4", None, None, 480, None)], VIDEO)


def test_study_is_written_in_parts_and_read_back(spark, tmp_path):
    lines = S.study_lines(violations(spark), videos(spark))
    S.write_study(S.anonymize_study(lines, "key"), str(tmp_path))
    back = S.read_study(spark, str(tmp_path))
    assert sorted(back.columns) == sorted(lines.columns) and back.filter("not anonymized").count() == 0
    assert {r.part: r["count"] for r in back.groupBy("part").count().collect()} == {"study": 1, "kpis": 1, "violations": 3, "by_type": 2, "by_hour": 1, "by_weekday": 1, "by_review_status": 2}
    secret = "PLATE-" + hmac.new(b"key", b"ABC 1", hashlib.sha256).hexdigest()[:10].upper()
    listed = {r.id: r for r in back.filter("part = 'violations'").select("violation.*").collect()}
    assert {k: r.license_plate for k, r in listed.items()} == {1: secret, 2: secret, 3: None}
    assert (listed[3].video.filename, listed[3].type.name, listed[1].interval.end_ms) == ('b"\n.mp4', "odd_code", 3000)
    assert [tuple(r) for r in back.filter("part = 'kpis'").select("figures.*").collect()] == [(3, 4, 4 / 3)]
    assert lines.filter("violation.license_plate = 'ABC 1' and not anonymized").count() == 2
    assert "ABC" not in "".join(r.value for r in spark.read.text(f"{tmp_path}/part=violations").collect())


def test_study_of_nothing(spark, tmp_path):
    S.write_study(S.study_lines(violations(spark).limit(0), videos(spark).limit(0)), str(tmp_path))
    assert {r.part for r in S.read_study(spark, str(tmp_path)).collect()} == {"study", "kpis"}


def test_annotations_round_trip(spark, tmp_path):
    boxes = [(5, 1, 30, 0, "vehicle", 0.9, 1.234, 2.0, 3.5, 4.0, 1), (2, 1, 30, 0, "a<b>&\"c\"", 0.9, 0.0, 0.005, 1.0, 1.0, None), (3, 1, 7, 0, "person", 0.9, -1.0, 2.0, 3.0, 4.0, 2), (4, 3, 1, 0, "person", 0.9, 0.0, 0.0, 1.0, 1.0, 2), (6, 8, 1, 0, "person", 0.9, 0.0, 0.0, 1.0, 1.0, 2)]
    d = spark.createDataFrame(boxes, DETECTION)
    images, refused = N.annotation_images(d, videos(spark))
    N.write_annotations(images, N.annotation_tasks(d, videos(spark)), str(tmp_path))
    got, tasks = N.read_annotations(spark, str(tmp_path))
    rows = sorted((r.video_id, r.image, r.frame_no, r.place, r.class_name, r.bbox_x1, r.bbox_y1, r.bbox_x2, r.bbox_y2, r.width, r.height) for r in got.collect())
    assert rows == [(1, 0, 7, 0, "person", -1.0, 2.0, 3.0, 4.0, 640, 480), (1, 1, 30, 0, 'a<b>&"c"', 0.0, 0.01, 1.0, 1.0, 640, 480), (1, 1, 30, 1, "vehicle", 1.23, 2.0, 3.5, 4.0, 640, 480)]
    heads = {r.video_id: r for r in tasks.collect()}
    assert {k: (r.name, r.size, r.mode) for k, r in heads.items()} == {1: ("video_1", 2, "annotation"), 2: ("video_2", 0, "annotation")}
    assert heads[1].labels == list(DETECTION_CLASSES.values())
    assert {tuple(r) for r in refused.collect()} == {(3, "unknown size"), (8, "unknown video")}


def test_annotations_of_many_videos_share_files(spark, tmp_path):
    from pyspark.sql import functions as F

    wide = spark.range(1, 41).select(F.col("id").cast("int").alias("id"), F.lit(64).alias("width"), F.lit(48).alias("height"))
    d = spark.createDataFrame([(10 * v + f, v, f, 0, "person", 0.9, 0.0, 1.0, 2.0, 3.0, 1) for v in range(1, 41) for f in (4, 2)], DETECTION)
    images, _ = N.annotation_images(d, wide)
    found = []
    for folder, by_video in ((tmp_path / "a", False), (tmp_path / "b", True)):
        N.write_annotations(images, N.annotation_tasks(d, wide), str(folder), by_video)
        files = list((folder / "images").rglob("*.xml"))
        assert len(files) == 40 if by_video else len(files) < 10
        got, tasks = N.read_annotations(spark, str(folder))
        found.append((sorted((r.video_id, r.image, r.frame_no) for r in got.collect()), sorted((r.video_id, r.name, r.size) for r in tasks.collect())))
    assert found[0] == found[1] == ([(v, k, 2 + 2 * k) for v in range(1, 41) for k in (0, 1)], [(v, f"video_{v}", 2) for v in range(1, 41)])


CHANGE = "change_id long, op string, violation_id int, violation_type string, video_id int, review_status string, actor string, changed_at timestamp_ntz"


def log(spark, *rows):
    return spark.createDataFrame([(k, op, v, kind, 1, review, f"u{k}", datetime(2024, 2, day)) for k, op, v, kind, review, day in rows], CHANGE)


def trail(df):
    return [tuple(r)[1:6] for r in df.orderBy("occurred_at", "actor").collect()]


def test_audit_follows_the_log(spark):
    changes = log(
        spark,
        (1, "review", 1, None, "confirmed", 1),
        (2, "review", 1, None, "uncertain", 3),
        (3, "U", 1, "no_helmet", None, 2),
        (4, "U", 1, "lane_keeping", None, 4),
        (5, "D", 1, None, None, 5),
        (6, "review", 1, None, "confirmed", 6),
        (7, "D", 1, None, None, 7),
        (8, "review", 2, None, "confirmed", 8),
        (9, "U", 77, "speeding", None, 9),
        (10, "review", 77, None, "confirmed", 10),
        (11, "I", 1, "speeding", None, 11),
        (12, "I", None, "no_helmet", None, 12),
    )
    got = trail(AU.violation_audit(violations(spark), changes))
    assert got == [
        (1, "review_status", "pending", "confirmed", "u1"),
        (1, "edit", "speeding (source=auto)", "no_helmet (source=manual)", "u3"),
        (1, "review_status", "confirmed", "uncertain", "u2"),
        (1, "edit", "no_helmet (source=manual)", "lane_keeping (source=manual)", "u4"),
        (1, "delete", "lane_keeping (source=manual)", None, "u5"),
        (1, "review_status", None, "confirmed", "u6"),  # it is gone
        (1, "delete", None, None, "u7"),
        (2, "review_status", None, "confirmed", "u8"),  # it had none
        (77, "edit", None, "speeding (source=manual)", "u9"),
        (77, "review_status", None, "confirmed", "u10"),
        (16, "create_manual", None, "speeding @ video 1", "u11"),
        (17, "create_manual", None, "no_helmet @ video 1", "u12"),
    ]
    again = AU.violation_audit(violations(spark).repartition(5), changes.repartition(7))
    assert trail(again) == got
    assert AU.violation_audit(violations(spark), changes.limit(0)).count() == 0
    ids = [r.id for r in AU.new_ids(violations(spark), changes).collect()]
    assert len(set(ids)) == 2 and min(ids) > 4


def test_recording_times_are_audited(spark):
    rows = [(1, datetime(2024, 3, 1), "a", datetime(2024, 2, 2), 1), (1, datetime(2024, 3, 2, 1, 2, 3), "b", datetime(2024, 2, 3), 2), (1, None, "c", datetime(2024, 2, 1), 3), (2, DAY, "d", datetime(2024, 2, 4), 4), (9, DAY, "e", datetime(2024, 2, 5), 5), (9, DAY, "f", datetime(2024, 2, 6), 6)]
    changes = spark.createDataFrame(rows, "id int, recorded_at timestamp_ntz, actor string, changed_at timestamp_ntz, change_id long")
    assert trail(AU.video_audit(videos(spark), changes)) == [
        (1, "set_recorded_at", "2024-01-01T10:30:00", "2024-03-01T00:00:00", "a"),
        (1, "set_recorded_at", "2024-03-01T00:00:00", "2024-03-02T01:02:03", "b"),
        (2, "set_recorded_at", None, "2024-01-01T10:30:00", "d"),
        (9, "set_recorded_at", None, "2024-01-01T10:30:00", "e"),
        (9, "set_recorded_at", None, "2024-01-01T10:30:00", "f"),
    ]


def test_a_failing_audit_spares_the_write(spark, tmp_path):
    rows, audit = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x",)], "entity string")
    assert AU.write_audited(rows, f"{tmp_path}/rows", audit, f"{tmp_path}/audit") is None
    assert AU.write_audited(rows, f"{tmp_path}/rows", audit, "/proc/nowhere") is not None
    assert spark.read.parquet(f"{tmp_path}/rows").count() == spark.read.parquet(f"{tmp_path}/audit").count() == 1
    with pytest.raises(Exception):
        AU.write_audited(rows.select(F.raise_error(F.lit("no")).cast("int").alias("a")), f"{tmp_path}/rows", audit, f"{tmp_path}/audit")
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 1


def test_zone_files(spark, tmp_path):
    files = {
        "zones_1.json": '[\n{"zone_type": "stop_line", "polygon": [[0, 1],\n [2, 3]], "metadata": {"lane": "left"}},\n{"zone_type": "no_parking", "polygon": [[0,0],[1,1]]}, {"zone_type": "island", "polygon": [[0,0],[1,1]]}]',
        "zones_2.json": '[{"zone_type": "stop_line", "polyg',
        "zones_3.json": '{"zone_type": "lane_line_solid", "polygon": [[0, 1], [2, "x"], [4, 5]]}',
        "zones_4.json": '[{"zone_type": "stop_line"}]',
        "plan.json": '[{"zone_type": "stop_line", "polygon": [[0, 1], [2, 3]]}]',
        "zones_5.json": "[]",
    }
    (tmp_path / "files").mkdir()
    for name, text in files.items():
        (tmp_path / "files" / name).write_text(text)
    good, refused = Z.read_zone_files(spark, f"{tmp_path}/files")
    assert sorted((r.video_id, r.zone_type) for r in good.collect()) == [(1, "stop_line"), (3, "lane_line_solid")]
    assert sorted((r.file, r.reason) for r in refused.collect()) == [("plan.json", "no video"), ("zones_1.json", "too few points"), ("zones_1.json", "unknown type"), ("zones_2.json", "no JSON"), ("zones_4.json", "too few points")]
    old = spark.createDataFrame([(1, 1, "lane_line_solid", "[[9,9],[8,8]]", None), (2, 2, "stop_line", "[[1,1],[2,2]]", None), (3, 4, "stop_line", "[[1,1],[2,2]]", None)], Z.ZONE)
    table = VideoTable(spark, f"{tmp_path}/table", Z.ZONE).create(old)
    Z.replace_zones(table, good)
    left = I.zones_parse(table.read()).collect()
    assert sorted((r.video_id, r.zone_type, len(r.points)) for r in left) == [(1, "stop_line", 2), (2, "stop_line", 2), (3, "lane_line_solid", 2), (4, "stop_line", 2)]
    assert len({r.id for r in left}) == 4 and [r.metadata for r in left if r.video_id == 1] == [{"lane": "left"}]


def test_batches_leave_failing_videos_out_with_their_reasons(spark):
    box = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, 0, 2, [box, box], [0.5, 0.6], [0, 99], [1, None]),
        (1, 1, 2, [], [], [], []),
        (2, 0, 2, [box], [0.5], [0], [1]),
        (2, 1, 2, [box], [0.5, 0.5], [0], [1]),
        (2, 3, 2, None, [0.5], [0], [1]),
        (3, None, 2, [box], [0.5], [0], [1]),
        (4, 0, 2, [[1.0]], [0.5], [0], [1]),
        (None, 0, None, [box], [0.5], [0], [1]),
        (None, 1, 2, [box], [0.5], [0], [1]),
    ]
    df = spark.createDataFrame(rows, "video_id int, kept_idx int, stride int, xyxy array<array<double>>, conf array<double>, cls array<int>, ids array<int>")
    good, bad = I.analyze_batch(df, spark.createDataFrame([(1, 10.0)], "video_id int, fps double"))
    assert [(r.video_id, r.frame_no, r.class_name) for r in good.orderBy("k").collect()] == [(1, 0, "vehicle"), (1, 0, "99")]
    assert {tuple(r) for r in bad.collect()} == {(2, 2, "conf and xyxy differ in length"), (3, 1, "no frame index"), (4, 1, "a box without four corners"), (None, 1, "no stride")}
    good, bad = I.analyze_batch(df.limit(0), spark.createDataFrame([], "video_id int, fps double"))
    assert good.count() == bad.count() == 0


def test_results_are_scanned_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "video_id int, kept_idx int, stride int, xyxy array<array<double>>, conf array<double>, cls array<int>, ids array<int>"
    df = spark.createDataFrame([(k % 3, k, 1, [[0.0] * 4], [0.5], [0] * (k != 4), [1]) for k in range(30)], schema).mapInArrow(count, schema)
    good, bad = I.analyze_batch(df, spark.createDataFrame([(1, 10.0)], "video_id int, fps double"))
    assert (good.count(), bad.count(), seen.value) == (20, 1, 30)
