import numpy as np
import pytest

from roadtrace.operators import changes as C
from roadtrace.operators import datasets as D
from roadtrace.operators import duplicates as U
from roadtrace.operators import export as E
from roadtrace.operators import glare as H
from roadtrace.operators import isolation as L
from roadtrace.operators import rules as R
from roadtrace.operators import tracks as T
from roadtrace.schemas import DETECTION
from roadtrace.sources import ingest as I

STOP = [("stop_line", "[[0,50],[200,50]]")]


def make(spark, rows, zones=(), mpp=None, fps=10.0, frames=None, stride=1):
    """rows: (frame, class, (x1, y1, x2, y2), track)."""
    data = [(i, 1, f * stride, int(f * stride * 1000 / fps), c, 0.9, *map(float, b), t) for i, (f, c, b, t) in enumerate(rows)]
    d = spark.createDataFrame(data, DETECTION)
    z = spark.createDataFrame([(i, 1, k, p, None) for i, (k, p) in enumerate(zones)], "id int, video_id int, zone_type string, polygon string, metadata string")
    cal = spark.createDataFrame([(1, mpp)] if mpp else [], "video_id int, meters_per_px double")
    v = spark.createDataFrame([(1, fps)], "id int, fps double")
    return R.RuleInput(d, I.zones_parse(z), cal, v, frames)


def crossing(red=True):
    rows = [(f, "vehicle", (40, y, 60, y + 10), 1) for f, y in enumerate((0, 40, 60))]
    return rows + ([(2, "traffic_light_red", (0, 0, 5, 5), None)] if red else [])


def test_red_light(spark):
    got = R.red_light(make(spark, crossing(), STOP)).collect()
    assert [(r.track_id, r.start_ms, r.end_ms, r.evidence) for r in got] == [(1, 0, 200, [0, 1, 2])]
    assert R.red_light(make(spark, crossing(False), STOP)).collect() == []
    assert R.red_light(make(spark, crossing())).collect() == []
    assert [r.evidence for r in R.illegal_overtaking(make(spark, crossing(), [("lane_line_solid", "[[0,50],[200,50]]")])).collect()] == [[2]]


def test_wrong_direction(spark):
    up = [(f, "vehicle", (100 * t, 500 - 10 * f, 100 * t + 20, 520 - 10 * f), t) for t in (1, 2, 3) for f in range(30)]
    down = [(f, "vehicle", (400, 10 * f, 420, 10 * f + 20), 4) for f in range(30)]
    assert [r.track_id for r in R.wrong_direction(make(spark, up + down)).collect()] == [4]
    assert R.wrong_direction(make(spark, up[:30] + down)).collect() == []


def riders(frames, helmet=False):
    rows = []
    for f in frames:
        rows += [(f, "motorcycle", (0, 50, 40, 90), 1), (f, "person", (10, 30, 30, 60), None)]
        rows += [(f, "helmet", (10, 45, 40, 85), None)] if helmet else []
    return rows


def test_helmet(spark):
    assert [(r.start_ms, r.end_ms, r.evidence) for r in R.no_helmet(make(spark, riders(range(25)))).collect()] == [(0, 2400, [0, 1, 2, 3, 4])]
    assert R.no_helmet(make(spark, riders(range(25), True))).collect() == []
    assert R.no_helmet(make(spark, riders(range(0, 400, 10)))).collect() == []  # scattered frames are no run


def test_parking(spark):
    area = [("no_parking", "[[0,0],[100,0],[100,100],[0,100]]")]
    stand = lambda x, step=0: [(f, "vehicle", (x + step * f, 40, x + step * f + 20, 60), 1) for f in range(0, 620, 20)]
    assert len(R.illegal_parking(make(spark, stand(40), area)).collect()) == 1
    assert R.illegal_parking(make(spark, stand(400), area)).collect() == []
    assert R.illegal_parking(make(spark, stand(0, 1), area)).collect() == []


@pytest.mark.parametrize("stride", [1, 2, 3, 5, 10])
def test_speed_ignores_the_stride(spark, stride):
    x = make(spark, [(f, "vehicle", (10 * f * stride, 0, 10 * f * stride + 40, 20), 1) for f in range(60 // stride)], mpp=0.05, fps=30.0, stride=stride)
    assert abs(R.track_speeds(x).first().kmh - 54) < 0.5
    assert R.speeding(x).collect() == [] and len(R.speeding(x, 50).collect()) == 1


def test_following(spark):
    def pair(dx=0, gap=5, n=120, step=3):
        return [r for f in range(n) for r in ((f, "vehicle", (100, 100 + step * f, 140, 130 + step * f), 1), (f, "vehicle", (100 + dx, 130 + gap + step * f, 140 + dx, 160 + gap + step * f), 2))]

    run = lambda *a, **k: R.unsafe_following(make(spark, pair(*a, **k), mpp=0.2, fps=30.0)).collect()
    assert [(r.track_id, r.evidence) for r in run()] == [(2, [0, 60, 119])]
    assert run(dx=150) == [] and run(step=0) == [] and run(gap=900) == [] and run(n=20) == []
    assert R.unsafe_following(make(spark, pair())).collect() == []


def test_lane_keeping(spark):
    car = lambda n, c="vehicle": [(f, c, (80, 40, 140, 90), 1) for f in range(n)]
    line = lambda n, x=105: [(f, "lane_line_solid", (x, 0, x + 4, 200), None) for f in range(n)]
    assert [(r.end_ms, r.evidence) for r in R.lane_keeping(make(spark, car(30) + line(30))).collect()] == [(2900, [0, 14, 29])]
    assert R.lane_keeping(make(spark, car(10) + line(10))).collect() == []
    assert R.lane_keeping(make(spark, car(30) + line(30, 500))).collect() == []
    assert R.lane_keeping(make(spark, car(30, "person") + line(30))).collect() == []
    assert len(R.lane_keeping(make(spark, car(30), [("lane_line_dashed", "[[0,60],[500,60]]")])).collect()) == 1


def picture(day=False, lamps=2):
    image = np.full((120, 120, 3), 200 if day else 10, np.uint8)
    for k in range(lamps):
        image[80:92, 20 + 40 * k : 32 + 40 * k] = 250
    return image


def test_high_beam(spark):
    def run(n=30, **k):
        rows = [(f, "vehicle", (0, 0, 100, 100), 1) for f in range(n)]
        shots = spark.createDataFrame([(1, f, 120, 120, bytearray(picture(**k).tobytes())) for f in range(n)], "video_id int, frame_no int, height int, width int, bgr binary")
        return R.high_beam(make(spark, rows, frames=shots)).collect()

    assert [r.evidence for r in run()] == [[0, 5, 10, 15, 20]]
    assert run(day=True) == [] and run(lamps=0) == [] and run(n=8) == [] and run(lamps=1) == []
    assert R.high_beam(make(spark, [(0, "vehicle", (0, 0, 9, 9), 1)])).collect() == []


def test_no_pixels_are_shuffled(spark):
    """Pixels go through no exchange, even where nothing may be broadcast."""
    shots = spark.createDataFrame([(1, f, 120, 120, bytearray(picture().tobytes())) for f in range(30)], "video_id int, frame_no int, height int, width int, bgr binary")
    x = make(spark, [(f, "vehicle", (0, 0, 100, 100), 1) for f in range(30)], frames=shots)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = R.high_beam(x)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert [r.evidence for r in found.collect()] == [[0, 5, 10, 15, 20]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    # going up from the scan of the pixels, the mask is taken before any exchange or join
    lines = plan.splitlines()
    at = max(k for k, line in enumerate(lines) if "bgr" in line)
    up = next(line for line in reversed(lines[:at]) if "MapInArrow" in line or "Exchange" in line or "Join" in line)
    assert "MapInArrow" in up and "lit_frames" in up


def test_boxes_cut_the_mask_of_a_frame_as_its_pixels():
    rng = np.random.default_rng(5)
    for _ in range(40):
        image = rng.choice(np.array([5, 250], np.uint8), (60, 50), p=[0.6, 0.4])[..., None].repeat(3, 2)
        image[rng.random((60, 50)) < 0.1, 0] = 10  # coloured
        image[: rng.integers(0, 30)] = 0
        found = H.shining(image)
        box = rng.integers(-10, 80, 4)
        x1, y1, x2, y2 = max(0, box[0]), max(0, box[1]), min(50, box[2]), min(60, box[3])
        crop = image[y1 + 2 * (y2 - y1) // 3 : y2, x1:x2].astype(int) if x2 > x1 and y2 > y1 else np.zeros((0, 0, 3), int)
        want = int(((crop.max(axis=2) >= 240) & (255 * (crop.max(axis=2) - crop.min(axis=2)) // np.maximum(crop.max(axis=2), 1) <= 40)).sum()) if crop.size else 0
        mask = H.bright(*found, 60, tuple(box)) if found else None
        assert (0 if mask is None else int(mask.sum())) == (want if want >= H.AREA else 0)


def test_blob_areas():
    mask = np.zeros((20, 30), bool)
    mask[2:8, 2:8] = True  # six by six pixels enclose five by five
    mask[4, 4] = False  # a hole counts
    mask[8, 8] = mask[9, 9] = True  # hangs on by corners
    mask[12:14, 20:29] = True
    mask[15, 1:10] = True  # a line encloses nothing
    area, row = H.blob_areas(mask)
    assert sorted(zip(area.tolist(), row.tolist())) == [(0.0, 15), (8.0, 12), (25.0, 2)]
    assert H.blob_areas(np.zeros((4, 4), bool))[0].tolist() == []
    rng = np.random.default_rng(3)
    for _ in range(50):
        m = rng.random((12, 12)) < 0.4
        seen, n = np.zeros_like(m), 0
        for y, x in zip(*np.nonzero(m)):
            if not seen[y, x]:
                n += 1
                todo = [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < 12 and 0 <= b < 12 and m[a, b] and not seen[a, b]:
                        seen[a, b] = True
                        todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        label = H.labels(m, corners=True)
        assert len(np.unique(label[m])) == n and (label > 0).sum() == m.sum()


def test_whole_extraction(spark):
    x = make(spark, crossing(), STOP)
    old = spark.createDataFrame([(1, 1, "auto", "a", 0.1), (2, 1, "manual", "b", 0.2), (3, 2, "auto", "c", 0.3)], "id int, video_id int, source string, license_plate string, plate_conf double")
    videos = spark.createDataFrame([(1, "imported", 10.0), (2, "imported", 10.0)], "id int, status string, fps double")
    votes = spark.createDataFrame([(1, 1, "ABC 12", 0.8), (1, 9, "ZZZ", 0.9)], "video_id int, track_id int, text string, confidence double")
    rows, after = C.extract(x, old, videos, votes)
    got = {(r.video_id, r.source, r.violation_type, r.license_plate) for r in rows.collect()}
    assert got == {(1, "manual", None, "b"), (2, "auto", None, "c"), (1, "auto", "red_light_running", "ABC 12")}
    assert {(r.id, r.status) for r in after.collect()} == {(1, "analyzed"), (2, "imported")}


def test_masks_of_a_block_are_judged_alone(monkeypatch):
    rng = np.random.default_rng(4)
    masks = [rng.random((rng.integers(1, 40), rng.integers(1, 60))) < rng.choice([0.3, 0.7, 0.95]) for _ in range(60)]

    def plain(m):
        area = H.blob_areas(m)[0]
        big = area[area >= H.AREA]
        return len(big) >= 2 or len(big) == 1 and big[0] >= H.BIG * H.AREA

    want = [plain(m) for m in masks]
    assert any(want) and not all(want)
    for block in (1 << 22, 5000, 1):
        monkeypatch.setattr(H, "BLOCK", block)
        assert H.glaring(masks).tolist() == want
    assert H.glaring([]).tolist() == []


def test_night_is_the_mean_of_the_brightest_channels():
    image = np.zeros((10, 10, 3), np.uint8)
    image[..., 1] = 70
    assert H.is_night(image)
    image[0, 0, 2] = 71
    assert not H.is_night(image)
    rng = np.random.default_rng(2)
    for most in (30, 90, 130, 255):
        image = rng.integers(0, most, (7, 9, 3), dtype=np.uint8)
        assert H.is_night(image) == (image.max(axis=2).mean() <= 70)


def test_failing_rules_are_reported(spark, tmp_path):
    def broken(x):
        raise ValueError("no such thing")

    failing = lambda x: R.red_light(x).withColumn("confidence", R.F.raise_error(R.F.lit("bad row")).cast("double"))
    rules = {"broken": broken, "unplanned": lambda x: x.rows.select("lamp"), "failing": failing, "red_light_running": R.red_light, "speeding": R.speeding}
    rows, report = L.run_isolated(make(spark, crossing(), STOP), rules, str(tmp_path))
    got = {r.rule: r for r in report.collect()}
    assert [(n, got[n].status, got[n].violations) for n in rules] == [("broken", "failed", 0), ("unplanned", "failed", 0), ("failing", "failed", 0), ("red_light_running", "ok", 1), ("speeding", "ok", 0)]
    assert (got["broken"].condition, got["broken"].error) == (None, "no such thing")
    assert got["unplanned"].condition == "UNRESOLVED_COLUMN.WITH_SUGGESTION" and "lamp" in got["unplanned"].error
    assert got["failing"].condition == "USER_RAISED_EXCEPTION" and "bad row" in got["failing"].error
    assert [r.violation_type for r in rows.collect()] == ["red_light_running"]
    none, report = L.run_isolated(make(spark, crossing(), STOP), {"broken": broken})
    assert none.count() == 0 and report.count() == 1


def test_tracks_runs_and_strides(spark):
    x = make(spark, [(f, "vehicle" if f else "person", (0, 0, 1, 1), 1) for f in (0, 3, 6, 9, 12)] + [(0, "person", (0, 0, 1, 1), None)])
    assert [r.frame_no for r in T.stride_sample(x.rows).orderBy("frame_no").collect()] == [0, 6, 12]
    s = T.track_summary(x.detections).first()
    assert (s.class_name, s.n, s.start_frame, s.end_frame) == ("vehicle", 5, 0, 12)
    runs = T.consecutive_runs(spark.createDataFrame([(1, f) for f in (1, 2, 4, 9, 9)], "k int, frame_no int"), ["k"], 1).orderBy("run_start").collect()
    assert [(r.run_start, r.run_end) for r in runs] == [(1, 4), (9, 9)]


def test_near_duplicates_are_greedy(spark):
    flip = lambda n: f"{int('0' * 64, 16) ^ ((1 << n) - 1):064x}"
    rows = [(1, flip(0)), (2, flip(8)), (3, flip(16)), (4, flip(24)), (5, "zz"), (6, None), (7, flip(100)), (8, flip(100))]
    df = spark.createDataFrame([(i, p, f"h{i}") for i, p in rows], "id int, phash string, file_hash string")
    assert {(r.representative, r.duplicate) for r in U.near_duplicates(df).collect()} == {(1, 2), (3, 4), (7, 8)}
    both = spark.createDataFrame([(1, flip(0), "h"), (2, flip(0), "h"), (3, flip(1), "x")], "id int, phash string, file_hash string")
    assert [(r.representative, r.duplicates, r.match_type) for r in U.as_groups(U.duplicate_groups(both)).collect()] == [(1, [2], "exact")]


def test_near_duplicates_of_one_large_group(spark):
    """Near but unequal hashes: each differs from the first in two bits at most, so one id takes all."""
    flips = [0] + [(1 << a) | (1 << b) for a in range(0, 256, 8) for b in range(a + 1, 256, 12)][:250]
    df = spark.createDataFrame([(i + 1, f"f{i}", f"{x:064x}") for i, x in enumerate(flips)], "id int, file_hash string, phash string")
    assert len(set(flips)) > 200
    assert [(r.representative, r.duplicates) for r in U.as_groups(U.near_duplicates(df)).collect()] == [(1, list(range(2, len(flips) + 1)))]


def test_split_is_exact_and_stable(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(103)], "stem string")
    a = {r.stem: r.split for r in D.split_dataset(df).collect()}
    assert a == {r.stem: r.split for r in D.split_dataset(df.repartition(7)).collect()}
    assert [sum(v == s for v in a.values()) for s in ("train", "val", "test")] == [72, 20, 11]
    with pytest.raises(ValueError):
        D.split_dataset(df, train=0.9)


def test_replacing_keeps_manual_rows_and_untouched_videos(spark):
    old = spark.createDataFrame([(1, 1, "auto"), (2, 1, "manual"), (3, 2, "auto"), (4, 3, None)], "id int, video_id int, source string")
    found = spark.createDataFrame([(1, "speeding"), (2, "speeding")], "video_id int, violation_type string")
    seen = spark.createDataFrame([(1,), (3,)], "video_id int")
    got = sorted((r.id or 0, r.video_id, r.source) for r in C.extract_violations(old, found, seen).collect())
    assert got == [(0, 1, "auto"), (2, 1, "manual"), (3, 2, "auto")]


def test_exports(spark, tmp_path):
    v = spark.createDataFrame([(1, 1, "speeding", 1500, 3000, 0.5, "ABC 1", "pending")], "id int, video_id int, violation_type string, start_ms int, end_ms int, confidence double, license_plate string, review_status string")
    w = spark.createDataFrame([(1, "=clip.mp4", "cctv", 640, 480), (2, "b.mp4", None, None, None)], "id int, filename string, source_type string, width int, height int")
    rows = E.export_rows(v, w, "key")
    r = rows.first()
    assert rows.columns == E.CELLS and r.filename == "'=clip.mp4" and r.license_plate.startswith("PLATE-") and r.anonymized and r.start_sec == 1.5
    assert E.export_rows(v, w, None).first().license_plate == "ABC 1"
    E.export_csv(rows, f"{tmp_path}/csv")
    E.export_json(rows, f"{tmp_path}/json")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == E.CELLS and spark.read.json(f"{tmp_path}/json").count() == 1
    x = make(spark, crossing())
    frames, refused = E.label_export(x.detections, w)
    E.label_export_xml(frames, f"{tmp_path}/xml")
    back = spark.read.format("xml").option("rowTag", "image").load(f"{tmp_path}/xml")
    assert back.count() == 3 and [q.video_id for q in refused.collect()] == [2]
    assert C.append_audit(spark.createDataFrame([(1,)], "a int"), f"{tmp_path}/audit") is None and C.append_audit(rows, "/proc/nowhere") is not None


def test_stream_hands_over_touched_videos(spark, tmp_path):
    from roadtrace.streaming.incremental import watch_detections

    make(spark, crossing()).detections.write.parquet(f"{tmp_path}/in")
    seen = []
    q = watch_detections(spark, f"{tmp_path}/in", f"{tmp_path}/state", lambda ids, batch: seen.append(sorted(r.video_id for r in ids.collect())))
    q.awaitTermination(60)
    assert seen == [[1]]


def test_stream_extracts_touched_videos(spark, tmp_path):
    from roadtrace.streaming.incremental import extract_touched, watch_detections

    x = make(spark, crossing(), STOP)
    x.detections.write.parquet(f"{tmp_path}/in")
    old = spark.createDataFrame([(1, 1, "auto"), (2, 2, "auto")], "id int, video_id int, source string").withColumn("license_plate", R.F.lit(None).cast("string")).withColumn("plate_conf", R.F.lit(None).cast("double"))
    videos = spark.createDataFrame([(1, "imported"), (2, "imported")], "id int, status string")
    votes = spark.createDataFrame([], "video_id int, track_id int, text string, confidence double")

    def run(ids, batch):
        rows, after = extract_touched(x, ids, old, videos, votes)
        rows.select("video_id", "source", "violation_type").write.mode("overwrite").parquet(f"{tmp_path}/rows")
        after.write.mode("overwrite").parquet(f"{tmp_path}/videos")

    watch_detections(spark, f"{tmp_path}/in", f"{tmp_path}/state", run).awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/rows").collect()} == {(1, "auto", "red_light_running"), (2, "auto", None)}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/videos").collect()} == {(1, "analyzed"), (2, "imported")}


def test_registry_names_have_checks():
    from roadtrace.plans import registry

    have, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(have)
    assert set(have) == set(sql)
