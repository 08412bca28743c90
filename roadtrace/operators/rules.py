"""Nine violation rules. Each takes a RuleInput and returns rows of schemas.VIOLATION.

All sides of their joins grow with the videos, so joins are merged and nothing is broadcast:
the planner takes a written table for as small as its files, and many joins of one plan would
hold their tables in the driver at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadtrace.functions import geometry as G
from roadtrace.functions.text import fps_or_default
from roadtrace.operators import tracks as T
from roadtrace.operators.glare import judge_frames, lit_frames
from roadtrace.schemas import LANE_LINES, VEHICLES, VIOLATION
from roadtrace.session import materialise

KEY = T.KEY
COLUMNS = ["video_id", "violation_type", "track_id", "start_ms", "end_ms", "confidence", "evidence"]


@dataclass
class RuleInput:
    """detections; parsed zones (points); calibrations; videos (id, fps); frames with pixels where there are any."""

    detections: DataFrame
    zones: DataFrame
    calibrations: DataFrame
    videos: DataFrame
    frames: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    @cached_property
    def rows(self) -> DataFrame:
        return T.track_rows(self.detections)

    @cached_property
    def vehicles(self) -> DataFrame:
        return self.rows.filter(F.col("track_class").isin(VEHICLES))

    @cached_property
    def segments(self) -> DataFrame:
        return T.track_segments(self.vehicles)

    @cached_property
    def summary(self) -> DataFrame:
        return T.track_summary(self.detections)

    @cached_property
    def rates(self) -> DataFrame:
        return self.videos.select(F.col("id").alias("video_id"), fps_or_default(F.col("fps")).alias("fps")).hint("merge")

    @cached_property
    def scale(self) -> DataFrame:
        return self.calibrations.filter("meters_per_px > 0").select("video_id", "meters_per_px").hint("merge")

    def written(self) -> RuleInput:
        """The same input with its detections, tracks, segments and summaries written once, for many rules."""
        seen = materialise(self.detections, "detections")
        out = RuleInput(seen, self.zones, self.calibrations, self.videos, self.frames, self.extra)
        out.__dict__["rows"] = materialise(T.track_rows(seen), "track-rows")
        out.__dict__["segments"] = materialise(out.segments, "segments")
        out.__dict__["summary"] = materialise(T.track_summary(seen), "track-summary")
        return out


def _whole_track(hits: DataFrame, x: RuleInput, kind: str, confidence: Column) -> DataFrame:
    """hits: video_id, track_id, evidence and what the confidence needs; the interval is the whole track's."""
    ends = x.summary.select(*KEY, "start_frame", "end_frame", "start_ms", "end_ms")
    return hits.join(ends.hint("merge"), KEY).select("video_id", F.lit(kind).alias("violation_type"), "track_id", "start_ms", "end_ms", confidence.cast("double").alias("confidence"), "evidence")


def _frame_ms(frame: Column, fps: Column) -> Column:
    return F.floor(frame * 1000 / fps).cast("int")


def red_light(x: RuleInput) -> DataFrame:
    """A vehicle crosses a stop line in a frame that shows a red light."""
    red = x.detections.filter("class_name = 'traffic_light_red'").select("video_id", "frame_no").distinct()
    at = T.first_crossing(x.segments, T.lines_of(x.zones, ["stop_line"])).join(red.hint("merge"), ["video_id", "frame_no"], "left_semi")
    # the first detection of the crossing's frame, and two on either side
    first = x.vehicles.join(at.select(*KEY, "frame_no").hint("merge"), [*KEY, "frame_no"], "left_semi").groupBy(*KEY).agg(F.min("pos").alias("at"))
    near = x.vehicles.join(first.hint("merge"), KEY).filter(F.abs(F.col("pos") - F.col("at")) <= 2)
    shown = near.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "frame_no"))).alias("e")).select(*KEY, F.col("e.frame_no").alias("evidence"))
    return _whole_track(shown, x, "red_light_running", F.lit(0.85))


def wrong_direction(x: RuleInput, share: float = 0.8, least_ms: int = 2000) -> DataFrame:
    """A vehicle moves against the circular mean of all headings of its video, of which three at least are needed."""
    motion = T.track_motion(x.segments)
    mean = motion.groupBy("video_id").agg(F.count("*").alias("k"), F.atan2(F.sum(F.sin("heading")), F.sum(F.cos("heading"))).alias("prevailing")).filter("k >= 3").drop("k")
    ang = G.heading(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    against = F.abs(G.angle_diff(ang, F.col("prevailing")) - math.pi) < math.pi / 3
    part = x.segments.join(mean.hint("merge"), "video_id").groupBy(*KEY, "n").agg(F.avg(against.cast("double")).alias("share")).filter(F.col("share") >= share)
    long = x.summary.filter(F.col("duration_ms") >= least_ms).select(*KEY)
    part = part.join(long.hint("merge"), KEY, "left_semi")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    shown = x.vehicles.join(part.select(*KEY, "share").hint("merge"), KEY).filter(F.col("pos") % step == 0).groupBy(*KEY, "share").agg(F.array_sort(F.collect_list(F.struct("pos", "frame_no"))).alias("e"))
    return _whole_track(shown.select(*KEY, "share", F.col("e.frame_no").alias("evidence")), x, "wrong_direction", F.least(F.lit(0.95), F.col("share")))


def no_helmet(x: RuleInput, least_sec: float = 2.0, overlap: float = 0.1, max_gap: int = 2) -> DataFrame:
    """A motorcycle carries a person without a helmet over one run of frames."""
    bikes = x.rows.filter("track_class = 'motorcycle'")
    other = lambda name: x.detections.filter(F.col("class_name") == name).select("video_id", "frame_no", *(F.col(f"bbox_{c}").alias(f"o_{c}") for c in G.Box._fields)).hint("merge")
    at = ["video_id", "frame_no"]
    bare = bikes.alias("b").join(other("person").alias("o"), [F.col(f"b.{c}") == F.col(f"o.{c}") for c in at] + [G.above(G.box("o_"), G.box())], "left_semi")
    bare = bare.alias("b").join(other("helmet").alias("o"), [F.col(f"b.{c}") == F.col(f"o.{c}") for c in at] + [G.iou(G.box("o_"), G.box()) >= overlap], "left_anti")
    runs = T.consecutive_runs(bare, KEY, max_gap)
    best = runs.groupBy(*KEY).agg(F.max(F.struct((F.col("run_end") - F.col("run_start")).alias("length"), (-F.col("run_start")).alias("first"), "run_end")).alias("r"))
    best = best.select(*KEY, (-F.col("r.first")).alias("run_start"), F.col("r.run_end").alias("run_end")).join(x.rates, "video_id").filter((F.col("run_end") - F.col("run_start") + 1) / F.col("fps") >= least_sec)
    frames = bare.select(*KEY, "frame_no", "pos").join(best.hint("merge"), KEY).filter(F.col("frame_no").between(F.col("run_start"), F.col("run_end")))
    shown = frames.groupBy(*KEY, "run_start", "run_end").agg(F.slice(F.array_sort(F.collect_list("frame_no")), 1, 5).alias("evidence"))
    ms = bikes.join(best.select(*KEY, "run_start", "run_end").hint("merge"), KEY).groupBy(*KEY).agg(
        F.max_by("timestamp_ms", F.when(F.col("frame_no") == F.col("run_start"), F.col("id"))).alias("start_ms"), F.max_by("timestamp_ms", F.when(F.col("frame_no") == F.col("run_end"), F.col("id"))).alias("end_ms")
    )
    return shown.join(ms.hint("merge"), KEY).select("video_id", F.lit("no_helmet").alias("violation_type"), "track_id", "start_ms", "end_ms", F.lit(0.80).alias("confidence"), "evidence")


def illegal_parking(x: RuleInput, least_ms: int = 60_000, radius: float = 5.0) -> DataFrame:
    """A vehicle (no motorcycle) stands for a minute inside a no-parking polygon."""
    long = x.summary.filter((F.col("class_name") == "vehicle") & (F.col("duration_ms") >= least_ms)).select(*KEY)
    rows = x.rows.join(long.hint("merge"), KEY, "left_semi")
    mean = Window.partitionBy(*KEY)
    rows = rows.withColumn("mx", F.avg("cx").over(mean)).withColumn("my", F.avg("cy").over(mean))
    still = rows.groupBy(*KEY).agg(
        F.max(G.distance(F.col("cx"), F.col("cy"), F.col("mx"), F.col("my"))).alias("far"),
        F.max_by(F.struct("cx", "cy"), F.when(F.col("pos") == F.floor(F.col("n") / 2), 1)).alias("mid"),
        F.min("frame_no").alias("f0"),
        F.max("frame_no").alias("f1"),
    ).filter(F.col("far") <= radius)
    areas = x.zones.filter("zone_type = 'no_parking'").select("video_id", "points").hint("merge")
    inside = still.alias("s").join(areas.alias("a"), [F.col("s.video_id") == F.col("a.video_id"), G.point_in_polygon(F.col("s.mid.cx"), F.col("s.mid.cy"), F.col("a.points"))], "left_semi")
    return _whole_track(inside.select(*KEY, T.evidence(F.col("f0"), F.col("f1")).alias("evidence")), x, "illegal_parking", F.lit(0.90))


def illegal_overtaking(x: RuleInput) -> DataFrame:
    """A vehicle crosses a solid lane line."""
    at = T.first_crossing(x.segments, T.lines_of(x.zones, ["lane_line_solid"]))
    return _whole_track(at.select(*KEY, T.evidence(F.col("frame_no")).alias("evidence")), x, "illegal_overtaking", F.lit(0.70))


def track_speeds(x: RuleInput) -> DataFrame:
    """Speeds of vehicles with two detections or more, over real times, in calibrated videos."""
    motion = T.track_motion(x.segments).join(x.scale, "video_id")
    return motion.select(*KEY, "meters_per_px", G.speed_kmh(F.col("path_px"), F.col("elapsed_ms"), F.col("meters_per_px")).alias("kmh"))


def speeding(x: RuleInput, limit_kmh: float = 80.0) -> DataFrame:
    fast = track_speeds(x).filter(F.col("kmh") > limit_kmh)
    ends = x.summary.select(*KEY, F.array("start_frame", "end_frame").alias("evidence"))
    return _whole_track(fast.join(ends.hint("merge"), KEY).select(*KEY, "evidence"), x, "speeding", F.lit(0.75))


def lane_keeping(x: RuleInput, least_sec: float = 2.0, ratio: float = 0.15) -> DataFrame:
    """A vehicle stays on a lane line through consecutive detections of its own.

    Each detection stands with its length on every line, seen or drawn, and once without
    any; one exchange by track then serves the largest length, the runs and their ends.
    """
    corners = ("x1", "y1", "x2", "y2")
    lines = x.detections.filter(F.col("class_name").isin(LANE_LINES)).select("video_id", "frame_no", *(F.col(f"bbox_{c}").alias(f"l{c}") for c in corners))
    clip = G.clip_length(F.col("lx1"), F.col("ly1"), F.col("lx2"), F.col("ly2"), G.box())
    mine = x.vehicles.select(*KEY, "pos", "frame_no", *(f"bbox_{c}" for c in corners))
    size = F.least(F.greatest(F.lit(1.0), F.col("bbox_x2") - F.col("bbox_x1")), F.greatest(F.lit(1.0), F.col("bbox_y2") - F.col("bbox_y1")))
    part = lambda df, on: df.select(*KEY, "pos", "frame_no", size.alias("size"), on.alias("on"))
    on = part(mine, F.lit(0.0)).unionByName(part(mine.join(lines.hint("merge"), ["video_id", "frame_no"]), clip))
    on = on.unionByName(part(mine.join(T.lines_of(x.zones, LANE_LINES).hint("merge"), "video_id"), clip))
    rows = on.repartition(*KEY).groupBy(*KEY, "pos").agg(F.max("on").alias("on"), F.min("frame_no").alias("frame_no"), F.min("size").alias("size"))
    rows = rows.withColumn("straddles", F.col("on") > ratio * F.col("size"))
    order = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("island", F.sum((~F.col("straddles")).cast("int")).over(order)).filter("straddles")
    # first and last of a run in the order of detections
    runs = rows.groupBy(*KEY, "island").agg(F.min_by("frame_no", "pos").alias("a"), F.max_by("frame_no", "pos").alias("z")).join(x.rates, "video_id")
    runs = runs.withColumn("sec", (F.col("z") - F.col("a") + 1) / F.col("fps")).filter(F.col("sec") >= least_sec)
    mid = F.floor((F.col("a") + F.col("z")) / 2)
    return runs.select(
        "video_id",
        F.lit("lane_keeping").alias("violation_type"),
        "track_id",
        _frame_ms(F.col("a"), F.col("fps")).alias("start_ms"),
        _frame_ms(F.col("z"), F.col("fps")).alias("end_ms"),
        F.least(F.lit(0.95), F.col("sec") / 4).alias("confidence"),
        T.evidence(F.col("a"), mid, F.col("z")).alias("evidence"),
    )


def unsafe_following(x: RuleInput, ttc_sec: float = 2.0, least_sec: float = 2.0, lane_px: float = 60.0, least_kmh: float = 15.0) -> DataFrame:
    """A vehicle follows another of its lane too closely: the first leader that qualifies, by bucket, then first appearance.

    Leaders are found by an equi-join on (video, bucket of the mean x), the follower standing
    in three buckets, and then frame by frame; no pair outside neighbouring buckets is made.
    """
    span = [F.min(F.struct("frame_no", "id")).alias("seen"), F.max("frame_no").alias("until")]
    tracks = x.vehicles.filter("n >= 2").groupBy(*KEY).agg(F.floor(F.avg("cx") / lane_px).alias("bucket"), *span)
    tracks = tracks.join(track_speeds(x).select(*KEY, "meters_per_px", "kmh").hint("merge"), KEY)
    side = lambda p: tracks.select("video_id", *(F.col(c).alias(p + c) for c in ("track_id", "bucket", "seen", "until", "kmh")), *(["meters_per_px"] if p == "f_" else []))
    near = side("f_").filter(F.col("f_kmh") >= least_kmh).withColumn("l_bucket", F.explode(F.array(*(F.col("f_bucket") + k for k in (-1, 0, 1)))))
    # tracks that were never seen at the same time share no frame
    together = "f_track_id <> l_track_id and f_seen.frame_no <= l_until and l_seen.frame_no <= f_until"
    pairs = near.join(side("l_").hint("merge"), ["video_id", "l_bucket"]).filter(together).drop("f_until", "l_until")
    # of repeated (track, frame) rows the last counts
    last = x.vehicles.groupBy(*KEY, "frame_no").agg(F.max(F.struct("id", "cx", "bbox_y1", "bbox_y2")).alias("d"))
    det = lambda p: last.select("video_id", F.col("track_id").alias(p + "track_id"), "frame_no", *(F.col(f"d.{c}").alias(p + n) for c, n in (("cx", "cx"), ("bbox_y1", "y1"), ("bbox_y2", "y2"))))
    shared = pairs.join(det("f_").hint("merge"), ["video_id", "f_track_id"]).join(det("l_").hint("merge"), ["video_id", "l_track_id", "frame_no"])
    gap_m = F.greatest(F.lit(0.0), F.col("f_y1") - F.col("l_y2")) * F.col("meters_per_px")
    rel = F.greatest(F.lit(0.5), F.col("f_kmh") / 3.6 - F.col("l_kmh") / 3.6)
    unsafe = (gap_m / rel < ttc_sec) | (gap_m < 0.5 * F.col("f_kmh"))
    middle = lambda c: F.get(F.array_sort(F.collect_list(c)), F.floor(F.count("*") / 2).cast("int"))
    pair = shared.groupBy("video_id", "f_track_id", "l_track_id", "l_bucket", "l_seen").agg(
        F.count("*").alias("k"),
        middle(F.abs(F.col("f_cx") - F.col("l_cx"))).alias("dx"),
        middle(F.col("f_y2")).alias("f_bottom"),
        middle(F.col("l_y2")).alias("l_bottom"),
        F.array_sort(F.collect_list(F.when(unsafe, F.col("frame_no")))).alias("bad"),
    )
    pair = pair.filter((F.col("k") >= 2) & (F.col("dx") <= lane_px) & (F.col("f_bottom") > F.col("l_bottom")) & (F.size("bad") > 0)).join(x.rates, "video_id")
    a, z = F.get("bad", F.lit(0)), F.get("bad", F.size("bad") - 1)
    pair = pair.withColumn("sec", (z - a + 1) / F.col("fps")).filter(F.col("sec") >= least_sec)
    first = pair.groupBy("video_id", "f_track_id").agg(F.min_by(F.struct("bad", "fps", "sec"), F.struct("l_bucket", "l_seen")).alias("p")).select("video_id", F.col("f_track_id").alias("track_id"), "p.*")
    mid = F.get("bad", F.floor(F.size("bad") / 2).cast("int"))
    return first.select("video_id", F.lit("unsafe_following").alias("violation_type"), "track_id", _frame_ms(a, F.col("fps")).alias("start_ms"), _frame_ms(z, F.col("fps")).alias("end_ms"), F.least(F.lit(0.90), F.lit(0.55) + F.col("sec") / 10).alias("confidence"), T.evidence(a, mid, z).alias("evidence"))


#: What is known of a night frame without its pixels.
LIT = "video_id int, frame_no int, height int, width int, top int, bits binary"


def high_beam(x: RuleInput, every: int = 5, least_sec: float = 2.0) -> DataFrame:
    """A vehicle glares at night over two seconds of sampled frames. Frames of another size than they say, or without pixels, show nothing."""
    if x.frames is None:
        return x.detections.sparkSession.createDataFrame([], VIOLATION)
    taken = x.vehicles.join(T.stride_sample(x.vehicles, every).hint("merge"), [*KEY, "frame_no"], "left_semi")
    boxes = taken.groupBy("video_id", "frame_no").agg(F.collect_list(F.struct("track_id", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")).alias("boxes"))
    # pixels stay where they are: only masks of night frames meet the boxes
    lit = x.frames.select("video_id", "frame_no", "height", "width", "bgr").mapInArrow(lit_frames, LIT)
    seen = lit.join(boxes.hint("merge"), ["video_id", "frame_no"]).mapInArrow(judge_frames, "video_id int, track_id int, frame_no int")
    g = seen.groupBy(*KEY).agg(F.array_sort(F.collect_set("frame_no")).alias("f")).join(x.rates, "video_id")
    a, z = F.get("f", F.lit(0)), F.get("f", F.size("f") - 1)
    g = g.withColumn("sec", (z - a + 1) / F.col("fps")).filter(F.col("sec") >= least_sec)
    confidence = F.least(F.lit(0.75), F.lit(0.55) + F.col("sec") / 20).alias("confidence")
    return g.select(
        "video_id", F.lit("high_beam_misuse").alias("violation_type"), "track_id", _frame_ms(a, F.col("fps")).alias("start_ms"), _frame_ms(z, F.col("fps")).alias("end_ms"), confidence, F.slice("f", 1, 5).alias("evidence")
    )


Rule = Callable[[RuleInput], DataFrame]
#: Rules that every video takes; speeding and unsafe_following need a calibration, high_beam needs frames.
DEFAULT_RULES: dict[str, Rule] = {"red_light_running": red_light, "wrong_direction": wrong_direction, "no_helmet": no_helmet, "illegal_parking": illegal_parking, "illegal_overtaking": illegal_overtaking, "lane_keeping": lane_keeping}
RULES: dict[str, Rule] = DEFAULT_RULES | {"speeding": speeding, "unsafe_following": unsafe_following, "high_beam_misuse": high_beam}


def run_rules(x: RuleInput, rules: dict[str, Rule] | None = None) -> DataFrame:
    """All violations of some rules, as one plan over tracks that are built once; videos without a calibration or frames drop out of the rules that need them."""
    x = x.written()
    out: DataFrame | None = None
    for rule in (rules or RULES).values():
        rows = rule(x).select(*COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out
