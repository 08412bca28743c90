import hashlib
import hmac
import math

from pyspark.sql import functions as F

from roadtrace.functions import geometry as G
from roadtrace.functions import text as X
from roadtrace.sources import ingest as I


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def lits(*values):
    return G.Box(*(F.lit(float(v)) for v in values))


def test_boxes(spark):
    r = one(
        spark,
        iou=G.iou(lits(0, 0, 10, 10), lits(5, 0, 15, 10)),
        apart=G.iou(lits(0, 0, 1, 1), lits(5, 5, 6, 6)),
        area=G.area(lits(0, 0, -5, 10)),
        edge=G.contains(lits(0, 0, 10, 10), F.lit(10.0), F.lit(0.0)),
        above=G.above(lits(2, 0, 4, 2), lits(0, 5, 10, 15)),
        beside=G.above(lits(20, 0, 24, 2), lits(0, 5, 10, 15)),
    )
    assert round(r.iou, 6) == round(1 / 3, 6) and r.apart == 0 and r.area == 0 and r.edge and r.above and not r.beside


def test_segments_polygons_and_clips(spark):
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    square = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))))
    none = F.array().cast("array<struct<x:double,y:double>>")
    r = one(
        spark,
        cross=G.segments_intersect(p(0, 0), p(10, 10), p(0, 10), p(10, 0)),
        touch=G.segments_intersect(p(0, 0), p(10, 0), p(5, 0), p(5, 5)),
        inside=G.point_in_polygon(*p(5, 5), square),
        outside=G.point_in_polygon(*p(15, 5), square),
        line=G.point_in_polygon(*p(5, 5), F.slice(square, 1, 2)),
        nowhere=G.point_in_polygon(*p(5, 5), none),
        mean=G.polygon_centroid(square),
        zero=G.polygon_centroid(none),
        through=G.clip_length(*p(-5, 5), *p(15, 5), lits(0, 0, 10, 10)),
        missed=G.clip_length(*p(-5, 50), *p(15, 50), lits(0, 0, 10, 10)),
        within=G.clip_length(*p(2, 2), *p(5, 6), lits(0, 0, 10, 10)),
        corner=G.clip_length(*p(-5, 5), *p(5, 15), lits(0, 0, 10, 10)),
        length=G.path_length(square),
        moved=G.displacement(square),
        still=G.is_stationary(square, 7.1),
        turned=G.angle_diff(F.lit(math.pi - 0.1), F.lit(-math.pi + 0.1)),
        speed=G.speed_kmh(F.lit(300.0), F.lit(1000), F.lit(0.05)),
        no_time=G.speed_kmh(F.lit(300.0), F.lit(0), F.lit(0.05)),
    )
    assert r.cross and not r.touch and r.inside and not r.outside and not r.line and not r.nowhere
    assert tuple(r.mean) == (5, 5) and tuple(r.zero) == (0, 0)
    assert r.through == 10 and r.missed == 0 and r.within == 5 and abs(r.corner) < 1e-9
    assert r.length == 30 and r.moved == 10 and r.still and abs(r.turned - 0.2) < 1e-9 and abs(r.speed - 54) < 1e-9 and r.no_time == 0


def test_plates_and_arabic(spark):
    r = one(
        spark,
        marks=X.normalize_arabic(F.lit("  مُحَمَّد ـ ١٢٣  أإآ ة ")),
        none=X.normalize_arabic(F.lit(None).cast("string")),
        plate=X.normalize_plate(F.lit("أ ب ح-١٢٣٤")),
        latin=X.normalize_plate(F.lit("abd 12.34!")),
        looks=X.looks_like_plate(F.lit("ABD 1234")),
        short=X.looks_like_plate(F.lit("A 12")),
    )
    assert r.marks == "محمد 123 ااا ه" and r.none == "" and r.plate == "ا ب ح1234" and r.latin == "ABD 1234" and r.looks and not r.short


def test_hashes_cells_and_moments(spark):
    a, b = "0" * 63 + "f", "0" * 64
    at = F.lit("2026-03-01 22:30:00").cast("timestamp_ntz")
    r = one(
        spark,
        d=X.phash_distance(F.lit(a), F.lit(b)),
        bad=X.phash_distance(F.lit("zz"), F.lit(b)),
        name=X.pseudonymize_plate(F.lit("ABC 123"), "k" * 80),
        empty=X.pseudonymize_plate(F.lit(""), "k"),
        cell=X.sanitize_cell(F.lit("=1+1")),
        plain=X.sanitize_cell(F.lit("a=1")),
        shown=X.display_name(F.lit("x"), {"a": "A"}),
        half=X.violation_moment(at, F.lit(1500)),
        even=X.violation_moment(at, F.lit(500)),
        night=F.hour(X.violation_moment(at, F.lit(7_200_000))),
        day=F.weekday(X.violation_moment(at, F.lit(7_200_000))),
        fps=X.fps_or_default(F.lit(0.0)),
    )
    want = hmac.new(("k" * 80).encode(), b"ABC 123", hashlib.sha256).hexdigest()[:10].upper()
    assert r.d == 4 and r.bad is None and r.name == f"PLATE-{want}" and r.empty is None
    assert r.cell == "'=1+1" and r.plain == "a=1" and r.shown == "x" and (r.half.second, r.even.second) == (2, 0) and (r.night, r.day) == (0, 0) and r.fps == 30


def test_corrupt_json(spark):
    r = one(spark, bad=I.parse_points(F.lit("{not")), null=I.parse_points(F.lit(None).cast("string")), part=I.parse_points(F.lit('[[1,2],["x",3],[4],[5,"6"],7]')), frames=I.evidence_decode(F.lit('[1,"x",3]')), none=I.evidence_decode(F.lit("broken")))
    assert r.bad == [] and r.null == [] and [tuple(p) for p in r.part] == [(1, 2), (5, 6)] and r.frames == [1, 3] and r.none == []


def test_files_and_fingerprints(spark, tmp_path):
    big = bytes(range(256)) * (9 * 4096 + 1)
    for name, data in (("a.MP4", b"x"), ("sub/b.mkv", big), ("sub/c.mov", big), ("d.txt", b"y")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {r.path.rsplit("/", 1)[1] for r in I.video_files(spark, str(tmp_path)).collect()} == {"a.MP4", "b.mkv", "c.mov"}
    with open(tmp_path / "sub/e.avi", "wb") as f:  # sparse, beyond what a cell can hold
        f.truncate(3 << 30)
    rows = I.video_files(spark, str(tmp_path)).select("path").unionByName(spark.createDataFrame([(f"file:{tmp_path}/gone.mp4",)], "path string"))
    got = {r.path.rsplit("/", 1)[1]: r for r in I.fingerprints(rows).collect()}
    size = len(big).to_bytes(8, "little")
    assert got["b.mkv"].partial == hashlib.sha256(size + big[: 4 << 20] + big[-(4 << 20) :]).hexdigest()
    assert got["a.MP4"].partial == hashlib.sha256((1).to_bytes(8, "little") + b"x").hexdigest() and got["a.MP4"].full is None
    assert got["b.mkv"].full == got["c.mov"].full == hashlib.sha256(big).hexdigest()
    assert got["e.avi"].partial == hashlib.sha256((3 << 30).to_bytes(8, "little") + bytes(8 << 20)).hexdigest() and got["e.avi"].full is None
    assert got["gone.mp4"].partial is None and got["gone.mp4"].error


def test_labels_and_logs(spark, tmp_path):
    for name, text in (("i/a.jpg", "x"), ("i/b.png", "x"), ("i/c.gif", "x"), ("l/a.txt", "0 1 1 1 1\n\n2 1 1 1 1\n"), ("l/c.txt", "0 1 1 1 1")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = I.labels_read(spark, f"{tmp_path}/i", f"{tmp_path}/l").collect()
    assert [(r.stem, r.lines) for r in rows] == [("a", ["0 1 1 1 1", "2 1 1 1 1"])]
    (tmp_path / "log.csv").write_text(" epoch , train/box_loss\n1,0.5\nx,\n2,bad\n")
    got = I.training_log_read(spark, f"{tmp_path}/log.csv")
    assert got.columns == ["epoch", "train/box_loss"] and [tuple(r) for r in got.collect()] == [(1.0, 0.5), (2.0, None)]
    (tmp_path / "zones.json").write_text('[{"zone_type": "stop_line", "polygon": [[0, 1], [2, 3]]}]')
    zone = I.zones_file(spark, f"{tmp_path}/zones.json", 4).withColumn("id", F.lit(1))
    assert [tuple(p) for p in I.zones_parse(zone).first().points] == [(0, 1), (2, 3)]
