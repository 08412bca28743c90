"""Named queries of the library over the derived tables, and DuckDB SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.functions import geometry as G
from roadtrace.functions import text as X
from roadtrace.operators import analytics as A
from roadtrace.operators import annotations as N
from roadtrace.operators import audit as AU
from roadtrace.operators import changes as C
from roadtrace.operators import datasets as D
from roadtrace.operators import duplicates as U
from roadtrace.operators import export as E
from roadtrace.operators import isolation as L
from roadtrace.operators import plates as P
from roadtrace.operators import rules as R
from roadtrace.operators import study as S
from roadtrace.operators import tracks as T
from roadtrace.plans import checks as Q
from roadtrace.schemas import VIOLATION_NAMES
from roadtrace.session import new_folder
from roadtrace.sources import ingest as I
from roadtrace.sources.adapters import load
from roadtrace.sources import zone_files as Z
from roadtrace.sources.video_table import VideoTable, analysed
from roadtrace.streaming.incremental import ExtractionLog

Query = Callable[[SparkSession, str], DataFrame]
SECRET = Q.SECRET


class Tables:
    """The derived tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    @property
    def parsed_zones(self) -> DataFrame:
        return I.zones_parse(self.zones)

    @property
    def rule_input(self) -> R.RuleInput:
        return R.RuleInput(self.detections, self.parsed_zones, self.calibrations, self.videos, frames_of(self.detections))

    @property
    def hashed(self) -> DataFrame:
        return self.hashes


#: Height and width of a frame by night, and by day.
NIGHT_FRAME, DAY_FRAME = (460, 170), (46, 17)


def frames_of(detections: DataFrame) -> DataFrame:
    """Frames drawn from the detections: every fifth one of each video, as a sampler decodes them.

    Videos whose id is divisible by 4 are of the night. The first track's box holds lamps
    there while it is inside the picture: two of them, one small one, two coloured ones or
    one large one, by the video. The others are of the day, in small pictures. Plain pixels are
    padded to lengths that follow from the rows: a literal picture would stand in every plan
    that reads frames, and in all the descriptions of it that the driver keeps.
    """
    first = F.min_by(F.struct("bbox_x1", "bbox_y1"), F.when(F.col("track_id") == 1, F.col("id")))
    at = detections.filter("frame_no % 5 = 0").groupBy("video_id", "frame_no").agg(first.alias("b"))
    h, w = NIGHT_FRAME
    x, y = F.floor("b.bbox_x1"), F.floor("b.bbox_y1")
    night, kind = F.col("video_id") % 4 == 0, F.floor(F.col("video_id") / 4) % 4
    # rows above the lamps, rows of the lamps (12 high, in the lower third of the box), rows below
    top, left = F.least(y + 36, F.lit(h - 12)).cast("int"), (x + 8).cast("int")
    inside = F.coalesce((y + 48 <= h) & (x + 52 <= w), F.lit(False))
    grey = lambda value: F.lit(bytearray([value] * 3))
    all_of = lambda pixel, pixels: F.rpad(F.lit(bytearray()), 3 * pixels, pixel)
    ground = lambda pixels: all_of(grey(10), pixels)
    shine = F.when(kind == 2, F.lit(bytearray(b"\x32\x32\xfa") * 12)).otherwise(F.lit(bytearray([250] * 36)))
    dark = F.lit(bytearray([10] * 36))
    line = F.concat(ground(left), shine, F.when(kind == 3, shine).otherwise(dark), F.when(kind == 1, dark).otherwise(shine), ground(w - left - 36))
    lit = F.concat(ground(top * w), *[line] * 12, ground((h - top - 12) * w))
    size = lambda k: F.when(night, NIGHT_FRAME[k]).otherwise(DAY_FRAME[k])
    picture = F.when(night & inside, lit).otherwise(all_of(F.when(night, grey(10)).otherwise(grey(200)), size(0) * size(1)))
    return at.select("video_id", "frame_no", size(0).alias("height"), size(1).alias("width"), picture.alias("bgr"))


def shown(rows: DataFrame) -> DataFrame:
    """Violation rows in a form that other engines can be held against."""
    return rows.select("video_id", "violation_type", "track_id", "start_ms", "end_ms", F.round("confidence", 4).alias("confidence"), F.concat_ws(",", "evidence").alias("evidence"))


def _ids(array: str) -> Column:
    return F.concat_ws(",", F.col(array))


def _centres(t: Tables) -> DataFrame:
    """Arrays of points per track, for functions on whole tracks."""
    rows = T.track_rows(t.detections)
    pts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "cx", "cy"))), lambda p: F.struct(p["cx"].alias("x"), p["cy"].alias("y")))
    return rows.groupBy("video_id", "track_id").agg(pts.alias("points"))


def _frame_results(t: Tables) -> DataFrame:
    """The detector's arrays per sampled frame, as an analysis would return them."""
    box = F.struct("id", F.array("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2").alias("xyxy"), "confidence", F.pmod("id", F.lit(15)).cast("int").alias("cls"), "track_id")
    g = t.detections.groupBy("video_id", F.col("frame_no").alias("kept_idx")).agg(F.array_sort(F.collect_list(box)).alias("b"))
    return g.select("video_id", "kept_idx", F.lit(3).alias("stride"), F.col("b.xyxy").alias("xyxy"), F.col("b.confidence").alias("conf"), F.col("b.cls").alias("cls"), F.col("b.track_id").alias("ids"))


def _boxes_of_frames(t: Tables) -> DataFrame:
    rows = I.detections_from_frames(_frame_results(t), t.rule_input.rates)
    corners = (F.round(f"bbox_{c}", 3).alias(c) for c in G.Box._fields)
    return rows.select("video_id", "frame_no", "timestamp_ms", "class_name", "track_id", F.round("confidence", 4).alias("confidence"), *corners)


def _reanalysed(t: Tables) -> DataFrame:
    return t.detections.filter("frame_no < 5 and video_id % 2 = 0")


def _touched(t: Tables) -> DataFrame:
    return t.videos.filter("id % 3 = 0").select(F.col("id").alias("video_id"))


def _probes(t: Tables) -> DataFrame:
    stream = F.concat(F.lit('{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":1280,"height":720,"avg_frame_rate":"'), F.when(F.col("id") % 3 == 0, "0/0").otherwise(F.concat(F.col("id").cast("string"), F.lit("/2"))), F.lit('","r_frame_rate":"25/1"}'))
    doc = F.concat(F.lit('{"format":{"duration":"'), F.col("duration_sec").cast("string"), F.lit('","size":"'), (F.col("id").cast("long") * 1000003).cast("string"), F.lit('","tags":{"creation_time":"2024-03-01T08:00:00Z"}},"streams":['), stream, F.lit("]}"))
    return t.videos.select(F.col("filepath").alias("path"), F.when(F.col("id") % 8 == 0, "{broken").otherwise(doc).alias("json"))


def _box_pairs(t: Tables) -> DataFrame:
    """Boxes of the same frame: motorcycles, and persons or helmets."""
    d = t.detections
    a = d.filter("class_name = 'motorcycle'").select("id", "video_id", "frame_no", *(F.col(f"bbox_{c}") for c in G.Box._fields))
    b = d.filter("class_name in ('person', 'helmet')").select(F.col("id").alias("o_id"), "video_id", "frame_no", *(F.col(f"bbox_{c}").alias(f"o_{c}") for c in G.Box._fields))
    return a.join(b, ["video_id", "frame_no"])


def _import_files(t: Tables) -> DataFrame:
    return t.hashes.select(F.concat(F.lit("/in/"), F.col("id").cast("string"), F.lit(".mp4")).alias("path"), F.substring("file_hash", 1, 8).alias("partial"), F.col("file_hash").alias("full"), F.when(F.col("id") % 31 == 0, "unreadable").alias("error"))


def _import_known(t: Tables) -> DataFrame:
    return t.hashes.filter("id % 17 = 0").select(F.concat(F.lit("/in/"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-F.col("id")).cast("string"), F.lit(".mp4")).alias("filepath"), F.col("file_hash").alias("full"))


def _references(t: Tables) -> DataFrame:
    x = F.col("id").cast("double")
    pts = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct((x % 50).alias("x"), F.lit(0.0).alias("y")), F.struct((x % 50).alias("x"), F.lit(10.0).alias("y")))
    dist = F.when(F.col("id") % 7 == 0, F.array(F.lit(1.0))).when(F.col("id") % 11 == 0, F.array(F.lit(-1.0), F.lit(2.0))).otherwise(F.array(F.lit(5.0), F.lit(2.0)))
    return t.videos.select(F.col("id").alias("video_id"), pts.alias("points"), dist.alias("distances"))


def _geometry(t: Tables) -> DataFrame:
    g = _centres(t)
    mean = G.polygon_centroid(F.col("points"))
    return g.select("video_id", "track_id", F.size("points").cast("bigint").alias("n"), F.round(G.path_length(F.col("points")), 3).alias("path_px"), F.round(G.displacement(F.col("points")), 3).alias("moved_px"), F.round(mean["x"], 3).alias("mx"), F.round(mean["y"], 3).alias("my"), G.is_stationary(F.col("points"), 5.0).alias("stationary"))


def _zone_hits(t: Tables) -> DataFrame:
    zones = t.parsed_zones.filter("zone_type = 'no_parking'").select("video_id", "points")
    d = t.detections.join(zones, "video_id").filter(G.point_in_polygon(G.center_x(G.box()), G.center_y(G.box()), F.col("points")))
    return d.groupBy("video_id", "class_name").agg(F.count("*").alias("n"))


def _clips(t: Tables) -> DataFrame:
    lines = T.lines_of(t.parsed_zones, ["lane_line_solid"])
    on = G.clip_length(F.col("lx1"), F.col("ly1"), F.col("lx2"), F.col("ly2"), G.box())
    return t.detections.join(lines, "video_id").select("id", F.round(on, 4).alias("on_line")).filter("on_line > 0")


def _crossed(t: Tables) -> DataFrame:
    x = t.rule_input
    return T.first_crossing(x.segments, T.lines_of(x.zones, ["stop_line"])).select("video_id", "track_id", "frame_no")


def _runs(t: Tables) -> DataFrame:
    return T.consecutive_runs(t.detections, ["video_id", "class_name"], 2).withColumn("n_frames", F.col("n_frames").cast("bigint"))


def _plates(t: Tables) -> DataFrame:
    return P.plates_for_track(t.rule_input.vehicles, t.detections).select("video_id", "track_id", "frame_no", "box_id")


def _votes(t: Tables) -> DataFrame:
    return P.plate_vote(t.plate_reads, ["video_id", "track_id"])


def _readings(t: Tables) -> DataFrame:
    r = t.plate_reads
    return r.select("read_id", "video_id", X.normalize_arabic(F.col("raw_text")).alias("arabic"), X.normalize_plate(F.col("raw_text")).alias("plate"), X.looks_like_plate(F.col("raw_text")).alias("looks")).distinct()


def _ready(t: Tables) -> DataFrame:
    ids = t.videos.select("id").unionByName(t.videos.select((F.col("id") + 100_000).alias("id")))
    return A.readiness(ids, t.detections, t.zones, t.calibrations, t.videos.filter("width is not null"))


def _valid(t: Tables) -> DataFrame:
    return C.validate_manual(t.changes, t.videos)


def _study(t: Tables) -> DataFrame:
    parts = E.study_build(t.violations, t.videos)
    by = lambda name, c: parts[name].select(F.lit(name).alias("part"), F.col(c).cast("string").alias("key"), "n")
    return by("by_type", "violation_type").unionByName(by("by_hour", "hour")).unionByName(by("by_weekday", "weekday")).unionByName(by("by_status", "review_status"))


def _extracted(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """Violations and the statuses of their videos after an extraction."""
    rows = rows.join(videos.select(F.col("id").alias("video_id"), "status").hint("merge"), "video_id", "left")
    source = F.coalesce("source", F.lit("auto")).alias("source")
    return rows.select("video_id", source, "violation_type", "track_id", "start_ms", "end_ms", "license_plate", "status")


def _extract(t: Tables) -> DataFrame:
    """All rules on all videos, with plates and statuses, as a re-run of the whole library leaves them."""
    return _extracted(*C.extract(t.rule_input, t.violations, t.videos, _votes(t)))


def _incremental(t: Tables) -> DataFrame:
    """The same from a stream: detections come in three files by frame, so that every batch touches most videos again."""
    at = _folder(t, "stream")
    t.detections.repartitionByRange(3, "frame_no").write.parquet(f"{at}/in")
    log = ExtractionLog(t.spark, f"{at}/log", t.rule_input, _votes(t))
    log.follow(f"{at}/in", f"{at}/checkpoint", files=1).awaitTermination()
    return _extracted(*log.state(t.violations, t.videos))


def _isolated(t: Tables) -> DataFrame:
    """The report of all rules, of one that cannot be planned, and of one that fails on its rows."""
    broken = {
        "no_such_column": lambda x: x.rows.select("lamp"),
        "failing_rows": lambda x: R.speeding(x).withColumn("confidence", F.raise_error(F.lit("no confidence")).cast("double")),
    }
    rows, report = L.run_isolated(t.rule_input, R.RULES | broken)
    found = rows.groupBy(F.col("violation_type").alias("rule")).agg(F.countDistinct("video_id").alias("videos"), F.sum("start_ms").alias("starts"))
    return report.drop("error").join(found, "rule", "left")


def _replaced(t: Tables) -> DataFrame:
    """Detections after every third video was analysed again, read back from the table, with the status of their videos.

    Videos without a detection now are rows, too.
    """
    new = t.detections.filter("frame_no < 5 and video_id % 2 = 0")
    held = VideoTable(t.spark, _folder(t, "detections"), t.detections.schema).create(t.detections)
    held.replace(_touched(t), new)
    videos = analysed(t.videos, _touched(t)).select(F.col("id").alias("video_id"), "status")
    return videos.join(held.read(), "video_id", "left").select("video_id", "status", "id", "frame_no", "class_name", F.round("bbox_x1", 3).alias("x1"))


def _batch_results(t: Tables) -> DataFrame:
    """Results of which some videos have a malformed frame: a score short, no boxes, no index, a box of two corners."""
    rows, v, k = _frame_results(t), F.col("video_id"), F.col("kept_idx")
    short = F.when((v % 9 == 0) & (k == 2), F.slice("conf", 1, F.greatest(F.size("conf") - 1, F.lit(0)))).otherwise(F.col("conf"))
    boxes = F.when((v % 14 == 5) & (k == 4), None).when((v % 17 == 3) & (k < 3), F.transform("xyxy", lambda b: F.slice(b, 1, 2))).otherwise(F.col("xyxy"))
    return rows.withColumns({"conf": short, "xyxy": boxes, "kept_idx": F.when((v % 23 == 1) & (k == 7), None).otherwise(k)})


def _batch(t: Tables) -> DataFrame:
    """Both outputs of a batch: the detections of readable videos by frame, and the reasons of the others."""
    good, bad = I.analyze_batch(_batch_results(t), t.rule_input.rates)
    good = good.groupBy("video_id", "frame_no").agg(F.count("*").alias("n"), F.round(F.sum("bbox_x1"), 2).alias("x1"))
    return good.unionByName(bad.select("video_id", F.col("frames").alias("n"), "error"), allowMissingColumns=True)


def _study_lines(t: Tables) -> DataFrame:
    """The anonymised study, written and read back, its nested lines laid flat."""
    at = _folder(t, "study")
    S.write_study(S.anonymize_study(S.study_lines(t.violations, t.videos), SECRET), at)
    back = S.read_study(t.spark, at)
    text = lambda c: F.col(c).cast("string")
    key = F.coalesce(text("violation.id"), "type.code", text("hour.hour"), text("weekday.weekday"), "review.status")
    n = F.coalesce("type.n", "hour.n", "weekday.n", "review.n", "figures.violations")
    return back.select(
        "part", "anonymized", key.alias("key"), n.alias("n"), F.col("figures.videos").alias("videos"), F.col("violation.video.filename").alias("filename"), F.col("violation.type.name").alias("name"),
        F.col("violation.interval.end_ms").alias("end_ms"), F.round("violation.confidence", 4).alias("confidence"), F.col("violation.license_plate").alias("plate"),
    )


def _annotation_files(t: Tables) -> DataFrame:
    """Boxes, heads and refused videos of annotation files that were written and read back."""
    at = _folder(t, "annotations")
    images, refused = N.annotation_images(t.detections, t.videos)
    N.write_annotations(images, N.annotation_tasks(t.detections, t.videos), at)
    boxes, tasks = N.read_annotations(t.spark, at)
    rows = boxes.select(F.lit("box").alias("part"), "video_id", "image", "frame_no", "place", F.col("class_name").alias("text"), "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
    heads = tasks.select(F.lit("task").alias("part"), "video_id", F.col("size").alias("image"), F.concat_ws("|", "name", "mode", "labels").alias("text"))
    gone = refused.select(F.lit("refused").alias("part"), "video_id", F.col("error").alias("text"))
    return rows.unionByName(heads, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)


def _audited(t: Tables) -> DataFrame:
    """The audit of reviews, accepted edits and inserts, deletes and new recording times, appended after the write of the reviewed rows and read back."""
    accepted = _valid(t).filter("reason is null").select("change_id")
    log = t.changes.join(accepted, "change_id", "left_semi").unionByName(t.changes.filter("op in ('review', 'D')"))
    times = t.changes.filter("op = 'U'").select(F.col("video_id").alias("id"), F.when(F.col("change_id") % 2 == 0, F.col("changed_at").cast("timestamp")).alias("recorded_at"), "actor", "changed_at", "change_id")
    audit = AU.violation_audit(t.violations, log).unionByName(AU.video_audit(t.videos, times))
    at = _folder(t, "audit")
    failed = AU.write_audited(C.apply_review(t.violations, t.changes), f"{at}/violations", audit, f"{at}/audit")
    if failed:
        raise RuntimeError(failed)
    return t.spark.read.parquet(f"{at}/audit").select("entity", "entity_id", "action", "old_value", "new_value", "actor")


def _zone_files(t: Tables) -> DataFrame:
    """Zones after a file of each video replaced them: every seventh file is broken off, every fifth has a bad zone among good ones."""
    line = '{"zone_type": "lane_line_dashed",\n  "polygon": [[0, 9.5], [9, 9.5]]}'
    bad = F.when(F.col("id") % 5 == 0, ',\n{"zone_type": "island", "polygon": [[1,1],[2,2]]},\n{"zone_type": "no_parking", "polygon": [[1,1],[2,2]]}').otherwise("")
    content = F.when(F.col("id") % 7 == 0, f"[{line}, ").otherwise(F.concat(F.lit(f"[\n{line}"), bad, F.lit("]\n")))
    at = _folder(t, "zones")
    I.write_files(t.videos.select(F.concat(F.lit("zones_"), F.col("id").cast("string"), F.lit(".json")).alias("name"), content.alias("content")), f"{at}/files")
    good, refused = Z.read_zone_files(t.spark, f"{at}/files")
    held = VideoTable(t.spark, f"{at}/table", Z.ZONE).create(t.zones.withColumn("id", F.col("id").cast("long")))
    Z.replace_zones(held, good)
    zones = I.zones_parse(held.read()).select(F.lit("zone").alias("part"), "video_id", "zone_type", _points("points").alias("text"))
    return zones.unionByName(refused.select(F.lit("refused").alias("part"), "video_id", "zone_type", F.concat_ws(": ", "file", "reason").alias("text")))


def _video_changes(t: Tables) -> DataFrame:
    new = t.changes.filter("op = 'U'").select(F.col("video_id").alias("id"), F.when(F.col("change_id") % 2 == 0, F.col("changed_at").cast("timestamp")).alias("recorded_at"), F.when(F.col("change_id") % 3 == 0, F.lit("cctv")).alias("source_type"), F.lit("reviewed").alias("status"), "changed_at", "change_id")
    return C.video_changes(t.videos, new).select("id", "source_type", "status", F.date_format("recorded_at", "yyyy-MM-dd HH:mm").alias("recorded"))


def _deleted(t: Tables) -> DataFrame:
    """What is left of each table, row by row."""
    tables = {"videos": t.videos, "detections": t.detections, "violations": t.violations, "zones": t.zones, "calibrations": t.calibrations}
    out = None
    for name, df in C.delete_videos_cascade(tables, t.videos.filter("id % 4 = 1")).items():
        key = "video_id" if name == "calibrations" else "id"
        rows = df.select(F.lit(name).alias("part"), F.col(key).cast("bigint").alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _inserted(t: Tables) -> DataFrame:
    new = t.hashes.select(F.concat(F.lit("/media/clip_"), F.col("id").cast("string"), F.lit(".mp4")).alias("filepath"), F.concat(F.lit("clip_"), F.col("id").cast("string"), F.lit(".mp4")).alias("filename"))
    return I.videos_insert(t.videos, new).select("filepath", "filename", "status", (F.col("id") > 0).alias("has_id"))


def _constraints(t: Tables) -> DataFrame:
    v = t.videos
    odd = v.filter("id % 10 = 0").select((F.col("id") + 1_000_000).alias("id"), F.when(F.col("id") % 20 == 0, F.col("filepath")).otherwise(F.concat("filepath", F.lit("x"))).alias("filepath"), F.when(F.col("id") % 3 == 0, "film").otherwise(F.col("source_type")).alias("source_type"))
    return I.constraint_breaks(v.select("id", "filepath", "source_type").unionByName(odd))


def _messy_zones(t: Tables) -> DataFrame:
    """Polygons as people leave them: whole, with a bad point, no JSON, a null, too short."""
    raw = F.when(F.col("id") % 5 == 0, '[[1,2],["x",3],[4],[5,"6"],7]').when(F.col("id") % 5 == 1, "not json").when(F.col("id") % 5 == 2, F.lit(None)).when(F.col("id") % 5 == 3, "[[1,2]]").otherwise(F.col("polygon"))
    kind = F.when(F.col("id") % 7 == 0, "island").otherwise(F.col("zone_type"))
    return I.zones_validate(I.zones_parse(t.zones.withColumn("polygon", raw).withColumn("zone_type", kind)))


def _points(c: str) -> Column:
    return F.concat_ws(";", F.transform(c, lambda p: F.concat_ws(",", F.round(p["x"], 1).cast("decimal(12,1)").cast("string"), F.round(p["y"], 1).cast("decimal(12,1)").cast("string"))))


def _weak(t: Tables) -> DataFrame:
    return D.weak_classes(t.eval_metrics, D.class_stats(t.label_lines))


def _folder(t: Tables, name: str) -> str:
    """A new folder for files that a query writes from the tables and reads back; it goes with the application."""
    return new_folder(t.spark, name)


def _media(t: Tables) -> str:
    """A file for each video: every third is a note, and 40 contents repeat."""
    rows = t.videos.select(F.concat(F.when(F.col("id") % 3 == 0, "note_").otherwise("clip_"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, ".txt").otherwise(".mp4")).alias("name"), F.repeat(F.concat(F.lit("video "), (F.col("id") % 40).cast("string"), F.lit("\n")), F.lit(50)).alias("content"))
    return I.write_files(rows, _folder(t, "media"))


def _name(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _fingerprints(t: Tables) -> DataFrame:
    files = I.video_files(t.spark, _media(t))
    return I.fingerprints(files).select(_name().alias("name"), "partial", "full", "error")


def _labels(t: Tables) -> DataFrame:
    """Label files and images by video: a line for each detection, and an image for every second video."""
    lines = t.detections.groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat((F.col("id") % 13).cast("string"), F.lit(" 0.5 0.5 0.1 0.2")))), "\n").alias("content"))
    at = _folder(t, "labels")
    I.write_files(lines.select(F.concat(F.lit("clip_"), "video_id", F.lit(".txt")).alias("name"), "content"), f"{at}/labels")
    I.write_files(t.videos.filter("width is not null").select(F.concat(F.lit("clip_"), "id", F.lit(".jpg")).alias("name"), F.lit("pixels").alias("content")), f"{at}/images")
    read = I.labels_read(t.spark, f"{at}/images", f"{at}/labels")
    first = F.transform("lines", lambda x: F.split(x, " ")[0].cast("bigint"))
    return read.select("stem", _name("image").alias("image"), F.size("lines").cast("bigint").alias("n"), F.aggregate(first, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("classes"))


def _log_read(t: Tables) -> DataFrame:
    at = _folder(t, "log")
    t.training_log.select(F.col("epoch").alias("  epoch"), F.col("box_loss").alias(" train/box_loss "), F.col("cls_loss").alias("train/cls_loss")).write.csv(f"{at}/results", header=True)
    return I.training_log_read(t.spark, f"{at}/results").select("epoch", F.col("`train/box_loss`").alias("box_loss"), F.col("`train/cls_loss`").alias("cls_loss"))


def _export_csv(t: Tables) -> DataFrame:
    at = _folder(t, "csv")
    E.export_csv(E.export_rows(t.violations, t.videos, SECRET), at)
    back = t.spark.read.csv(at, header=True, escape='"')
    return back.select(F.col("id").cast("int").alias("id"), "filename", "violation_type", "type_name", F.col("start_sec").cast("double").alias("start_sec"), F.col("license_plate").alias("plate"), F.col("anonymized").cast("boolean").alias("anonymized"))


def _export_json(t: Tables) -> DataFrame:
    at = _folder(t, "json")
    E.export_json(t.violations.select("id", "notes", "license_plate", "created_at"), at)
    return t.spark.read.schema("id int, notes string, license_plate string, created_at string").json(at)


def _detail_tables(t: Tables) -> DataFrame:
    at = _folder(t, "tables")
    E.export_detail_tables(E.detail_tables(t.violations, t.videos, SECRET), at)
    back = lambda name: t.spark.read.csv(f"{at}/{name}", header=True, escape='"')
    long = lambda name, key, value: back(name).select(F.lit(name).alias("part"), F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    details = back("details").groupBy(F.lit("details").alias("part"), F.col("violation_type").alias("key")).agg(F.sum(F.col("start_sec").cast("double")).alias("value"))
    return long("summary", "figure", "value").unionByName(long("by_type", "type_name", "n")).unionByName(long("by_hour", "hour", "n")).unionByName(details.withColumn("value", F.round("value", 3)))


def _export_log(t: Tables) -> DataFrame:
    """A log to which an export of each source's videos is appended, in two writes."""
    at = _folder(t, "exports")
    rows = A.videos_by_source(t.videos).select(F.concat(F.lit("study of "), "source").alias("study_name"), F.to_json(F.struct("source")).alias("filter_json"), F.lit("csv").alias("format"), F.concat(F.lit("/out/"), "source").alias("output_path"))
    for _ in range(2):
        E.export_log(at, rows)
    return t.spark.read.parquet(at).groupBy("study_name", "filter_json", "format", "output_path").agg(F.count("*").alias("n"))


def _prepared(t: Tables) -> DataFrame:
    pairs = t.label_lines.groupBy("stem").agg(F.collect_list("line").alias("lines")).select("stem", F.concat("stem", F.lit(".jpg")).alias("image"), "lines")
    parts = D.dataset_prepare(pairs)
    of = lambda name, key, n: parts[name].select(F.lit(name).alias("part"), F.col(key).alias("key"), n.cast("bigint").alias("n"))
    split = D.split_counts(parts["split"]).select(F.lit("split").alias("part"), F.col("split").alias("key"), "n")
    manifest = parts["manifest"].agg(F.lit("manifest").alias("part"), F.lit("images").alias("key"), F.countDistinct("image").alias("n"))
    return split.unionByName(manifest).unionByName(of("stats", "class_name", F.col("instances"))).unionByName(of("issues", "issue", F.lit(1)))


def _direct_speeds(t: Tables) -> DataFrame:
    x = t.rule_input
    moved = T.track_motion(x.segments).join(x.scale, "video_id")
    return moved.select("video_id", "track_id", F.round(G.speed_kmh(F.col("displacement_px"), F.col("elapsed_ms"), F.col("meters_per_px")), 3).alias("kmh"))


def _zone_changes(t: Tables) -> DataFrame:
    """Zones with a second, dashed line for every video (every fifth of them broken), and without the stop lines."""
    new = t.videos.select(F.col("id").alias("video_id"), F.lit("lane_line_dashed").alias("zone_type"), F.when(F.col("id") % 5 == 0, "[[1,1]]").otherwise("[[0,9],[9,9]]").alias("polygon"))
    left = I.zones_delete(I.zones_add(t.zones, new), t.zones.filter("zone_type = 'stop_line'"))
    return left.groupBy("zone_type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("video_id").alias("videos"))


def _scalar_hash(t: Tables) -> DataFrame:
    h = t.hashes
    other = h.select((F.col("id") - 1).alias("id"), F.col("phash").alias("next"))
    return h.join(other, "id").select("id", X.phash_distance(F.col("phash"), F.col("next")).cast("bigint").alias("bits"))


def _cells(t: Tables) -> DataFrame:
    v = t.violations
    return v.select("id", X.sanitize_cell(F.col("notes")).alias("notes"), X.display_name(F.col("violation_type"), {k: n for k, n in VIOLATION_NAMES.items() if k != "speeding"}).alias("name"), F.date_format(X.violation_moment(F.col("created_at"), F.col("start_ms")), "yyyy-MM-dd HH:mm").alias("moment"))


def _q(f: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))


def _rule(name: str, t: Tables) -> DataFrame:
    return shown(R.RULES[name](t.rule_input))


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # sources and ingestion
    "src_video_files": lambda t: I.video_files(t.spark, _media(t)).select(_name().alias("name"), "size"),
    "file_fingerprints": _fingerprints,
    "labels_read": _labels,
    "training_log_read": _log_read,
    "import_classify": lambda t: I.import_classify(_import_files(t), _import_known(t)).groupBy("outcome").agg(F.count("*").alias("n")),
    "probe_to_metadata": lambda t: I.probe_metadata(_probes(t)).select("path", "duration_sec", "width", "height", "codec", "fps", "file_size_mb", F.date_format("recorded_at", "yyyy-MM-dd HH:mm").alias("recorded")),
    "detections_from_frames": _boxes_of_frames,
    "detections_replace": lambda t: I.detections_replace(t.detections, _reanalysed(t), _touched(t)).select("video_id", "id", "frame_no", "class_name"),
    "detections_replaced": _replaced,
    "analysis_summary": lambda t: I.analysis_summary(t.detections),
    "analyze_batch": lambda t: I.analyze_batch(_frame_results(t).withColumn("conf", F.when((F.col("video_id") % 9 == 0) & (F.col("kept_idx") == 2), F.slice("conf", 1, 1)).otherwise(F.col("conf"))), t.rule_input.rates)[0].groupBy("video_id").agg(F.count("*").alias("n")),
    "videos_insert": _inserted,
    "zones_parse": lambda t: _messy_zones(t).select("id", _points("points").alias("points")),
    "zones_validate": lambda t: _messy_zones(t).groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("n")),
    "zones_upsert": lambda t: I.zones_upsert(t.zones, t.zones.filter("video_id % 3 = 0 and zone_type = 'stop_line'")).groupBy("zone_type").agg(F.count("*").alias("n")),
    "zone_changes": _zone_changes,
    "zones_from_files": _zone_files,
    "analyze_batch_outputs": _batch,
    "calibration_compute": lambda t: I.calibration_compute(_references(t)).select("video_id", F.round("meters_per_px", 6).alias("meters_per_px"), "reason"),
    "calibration_upsert": lambda t: I.calibration_upsert(t.calibrations.unionByName(t.calibrations.withColumn("calibrated_at", F.expr("calibrated_at - interval 1 day")).withColumn("meters_per_px", F.lit(9.0)))).select("video_id", "meters_per_px"),
    "evidence_decode": lambda t: t.violations.select("id", _ids_of(I.evidence_decode(F.col("evidence_frames"))).alias("frames")),
    "constraint_breaks": _constraints,
    # listings
    "list_videos": lambda t: A.list_videos(t.videos, search="CLIP_1", limit=25),
    "video_details": lambda t: t.videos.select("id", "filename", "filepath", "source_type", "duration_sec", "width", "height", "codec", "status"),
    "videos_by_status": lambda t: C.statuses(t.videos, ["imported", "prelabeled"]),
    "detections_of_video": lambda t: A.detections_listed(t.detections).select("video_id", "place", "id", "frame_no", "class_name", "track_id", F.round("confidence", 4).alias("confidence")),
    "list_violations": lambda t: A.list_violations(t.violations, t.videos, kind="speeding", limit=100).select("id", "filename", "violation_type", "type_name", "start_ms", "license_plate", "review_status"),
    "list_violations_editable": lambda t: A.list_editable(t.violations, t.videos),
    "violation_for_edit": lambda t: t.violations.select("id", "video_id", "violation_type", "start_ms", "end_ms", "license_plate", "notes", "review_status"),
    "count_violations": lambda t: A.filtered(t.violations, kind="lane_keeping", review="confirmed").agg(F.count("*").alias("n")),
    "violation_evidence": lambda t: A.violation_evidence(t.violations, t.videos).select("id", "filepath", "pos", "frame_no"),
    "fps_or_default": lambda t: t.videos.select("id", X.fps_or_default(F.when(F.col("id") % 8 == 0, 0.0).otherwise(F.col("fps"))).alias("fps")),
    "video_summaries": lambda t: A.video_summaries(t.videos, t.detections, t.violations),
    # tracks and frames
    "build_tracks": lambda t: T.track_rows(t.detections).groupBy("video_id", "track_id", "track_class").agg(F.count("*").alias("n"), F.sum(F.col("pos") * F.col("frame_no")).cast("bigint").alias("order_sum")),
    "track_summary": lambda t: T.track_summary(t.detections),
    "track_segments": lambda t: T.track_segments(T.track_rows(t.detections)).groupBy("video_id", "track_id").agg(F.count("*").alias("n"), F.round(F.sum(G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))), 3).alias("path_px"), F.sum("frame_no").alias("frames")),
    "detections_by_frame": lambda t: T.grouped_by_frame(t.detections).select("video_id", "frame_no", F.size("detections").cast("bigint").alias("n"), F.concat_ws(",", F.transform("detections", lambda d: d["class_name"])).alias("classes")),
    "consecutive_runs": _runs,
    "first_crossing": _crossed,
    "stride_sample": lambda t: T.stride_sample(t.detections, 5, ["video_id", "class_name"]),
    # rules
    **{f"rule_{n}": partial(_rule, n) for n in R.RULES},
    "run_rules": lambda t: shown(R.run_rules(t.rule_input)),
    "rule_gating": lambda t: shown(R.run_rules(t.rule_input, {n: R.RULES[n] for n in ("speeding", "unsafe_following", "high_beam_misuse")})),
    "extract_violations": _extract,
    "incremental_extraction": _incremental,
    "run_rules_isolated": _isolated,
    "readiness": lambda t: _ready(t).withColumn("zone_types", _ids("zone_types")),
    "detectors_blocked": lambda t: A.detectors_blocked(_ready(t)).groupBy("rule", "missing").agg(F.count("*").alias("n")),
    "estimate_speed": _direct_speeds,
    "track_speeds": lambda t: R.track_speeds(t.rule_input).select("video_id", "track_id", F.round("kmh", 3).alias("kmh")),
    # aggregations
    "kpis": lambda t: A.kpis(t.videos, t.violations).withColumn("per_video", F.round("per_video", 4)),
    "videos_by_source": lambda t: A.videos_by_source(t.videos),
    "violations_by_type": lambda t: A.counts_by(t.violations, "violation_type"),
    "violations_by_review_status": lambda t: A.counts_by(t.violations, "review_status"),
    "violations_by_hour": lambda t: A.by_hour(t.violations, t.videos),
    "violations_by_weekday": lambda t: A.by_weekday(t.violations, t.videos),
    "violations_heatmap": lambda t: A.heatmap(t.violations, t.videos),
    "violations_over_time": lambda t: A.over_time(t.violations, t.videos),
    "violations_without_time": lambda t: A.without_time(t.violations, t.videos),
    "library_totals": lambda t: A.library_totals(t.videos),
    "class_stats": lambda t: D.class_stats(t.label_lines),
    # scalar functions
    "bbox_functions": lambda t: _box_pairs(t).select("id", "o_id", F.round(G.iou(G.box(), G.box("o_")), 6).alias("iou"), F.round(G.area(G.box()), 3).alias("area"), G.above(G.box("o_"), G.box()).alias("above"), G.contains(G.box(), G.center_x(G.box("o_")), G.center_y(G.box("o_"))).alias("inside")),
    "track_geometry": _geometry,
    "point_in_polygon": _zone_hits,
    "clip_segment_length": _clips,
    "plate_texts": _readings,
    "phash_distance": _scalar_hash,
    "cells_names_moments": _cells,
    "pseudonymize_plate": lambda t: t.violations.select("license_plate", X.pseudonymize_plate(F.col("license_plate"), SECRET).alias("pseudonym")).groupBy("pseudonym").agg(F.count("*").alias("n")),
    "json_codecs": lambda t: E.detections_json(t.detections),
    # duplicates and plates
    "exact_duplicates": lambda t: U.exact_duplicates(t.hashed).select("representative", "duplicate"),
    "near_duplicate_pairs": lambda t: U.near_pairs(t.hashed),
    "near_duplicates": lambda t: U.near_duplicates(t.hashed).select("representative", "duplicate"),
    "duplicate_groups": lambda t: U.duplicate_groups(t.hashed),
    "plates_for_track": _plates,
    "plate_vote": lambda t: _votes(t).select("video_id", "track_id", "text", F.round("confidence", 6).alias("confidence"), "reads"),
    "best_reading": lambda t: P.best_reading(t.plate_reads, ["video_id", "track_id", "image"]),
    "plate_for_image_set": lambda t: P.plate_for_image_set(t.plate_reads, ["video_id", "track_id"], "image").select("video_id", "track_id", "text", F.round("confidence", 6).alias("confidence"), "reads"),
    "plate_for_violation": lambda t: P.plate_for_violation(t.violations, _votes(t)).select("id", "license_plate", F.round("plate_conf", 6).alias("plate_conf")),
    # label data sets and reports
    "split_dataset": lambda t: D.split_counts(D.split_dataset(t.label_lines)),
    "dataset_validate": lambda t: D.dataset_validate(D.class_stats(t.label_lines), D.split_dataset(t.label_lines, train=0.97, val=0.02, test=0.01)),
    "dataset_manifest": lambda t: D.dataset_manifest(t.label_lines.select("stem", F.concat("stem", F.lit(".jpg")).alias("image")).distinct(), t.label_lines.select("stem", "split").distinct()),
    "weak_classes": _weak,
    "augment_advice": lambda t: D.augment_recipe(_weak(t)),
    "augment_tips": lambda t: D.augment_tips(_weak(t)),
    "dataset_prepare": _prepared,
    "error_report": lambda t: D.error_report(t.eval_metrics).select("threshold", F.round("map50", 6).alias("map50"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "n_weak", "passes_threshold"),
    "loss_series": lambda t: D.loss_series(t.training_log),
    "label_export_xml": lambda t: E.label_export(t.detections, t.videos)[0].select("filename", "_id", F.size("box").cast("bigint").alias("n"), F.concat_ws("|", F.col("box")[0]["_label"], F.col("box")[0]["_x1"], F.col("box")[0]["_y2"]).alias("first")),
    # exports and changes
    "study_build": _study,
    "study_lines": _study_lines,
    "annotation_files": _annotation_files,
    "audit_log": _audited,
    "export_rows": lambda t: E.export_rows(t.violations, t.videos, SECRET).select(*E.CELLS),
    "study_document": lambda t: E.study_document(t.violations, t.videos),
    "export_csv": _export_csv,
    "export_json": _export_json,
    "export_detail_tables": _detail_tables,
    "export_log": _export_log,
    "apply_review": lambda t: C.apply_review(t.violations, t.changes).select("id", "review_status"),
    "validate_manual": lambda t: _valid(t).select("change_id", "reason"),
    "apply_manual_insert": lambda t: C.manual_inserts(_valid(t)),
    "apply_manual_edit": lambda t: C.apply_edits(t.violations, _valid(t)).select("id", "violation_type", "start_ms", "end_ms", "license_plate", "source"),
    "apply_delete": lambda t: C.apply_deletes(t.violations, t.changes).select("id", "violation_type"),
    "audit_append": lambda t: C.audit_rows(t.violations, t.changes).select("entity", "entity_id", "action", "old_value", "new_value", "actor"),
    "video_changes": _video_changes,
    "delete_videos_cascade": _deleted,
    "deletion_audit": lambda t: C.deletion_audit(t.videos, t.videos.filter("id % 4 = 1"), "admin"),
}


def _ids_of(array: Column) -> Column:
    return F.concat_ws(",", array)


def queries() -> dict[str, Query]:
    return {name: _q(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in Q.SQL.items() if name in QUERIES}
