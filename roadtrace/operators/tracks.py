"""Tracks, segments, runs and crossings. Every window stays inside one (video_id, track_id).

Joins are merged: sizes of files say little of rows as repetitive as these, and the planner
would broadcast millions of them through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from roadtrace.functions import geometry as G
from roadtrace.session import dealt

KEY = ["video_id", "track_id"]


def track_rows(detections: DataFrame) -> DataFrame:
    """Detections of tracks with their order (pos, from 0), their track's size n and majority class (ties: the first by name).

    The class is counted per (track, class) before the shuffle and joined back, so only the
    ordering window moves whole rows, in more tasks where there are more of them; classes are
    dealt like the rows, which then need no other exchange to meet them.
    """
    mine = detections.filter("track_id is not null")
    votes = mine.groupBy(*KEY, "class_name").agg(F.count("*").alias("votes"))
    # the first name among the most votes
    best = dealt(votes, *KEY).groupBy(*KEY).agg(F.sum("votes").cast("int").alias("n"), F.min_by("class_name", F.struct(-F.col("votes"), F.col("class_name"))).alias("track_class"))
    order = Window.partitionBy(*KEY).orderBy("frame_no", "id")
    return dealt(mine, *KEY).withColumn("pos", F.row_number().over(order) - 1).join(best.hint("merge"), KEY).withColumn("cx", G.center_x(G.box())).withColumn("cy", G.center_y(G.box()))


def track_summary(detections: DataFrame) -> DataFrame:
    """One row per track: class, size, first and last frame and time."""
    mine = detections.filter("track_id is not null")
    ends = mine.groupBy(*KEY, "class_name").agg(F.count("*").alias("votes"), F.min(F.struct("frame_no", "id", "timestamp_ms")).alias("a"), F.max(F.struct("frame_no", "id", "timestamp_ms")).alias("z"))
    whole = ends.groupBy(*KEY).agg(F.sum("votes").alias("n"), F.min_by("class_name", F.struct(-F.col("votes"), F.col("class_name"))).alias("class_name"), F.min("a").alias("a"), F.max("z").alias("z"))
    return whole.select(*KEY, "class_name", "n", F.col("a.frame_no").alias("start_frame"), F.col("z.frame_no").alias("end_frame"), F.col("a.timestamp_ms").alias("start_ms"), F.col("z.timestamp_ms").alias("end_ms"), (F.col("z.timestamp_ms") - F.col("a.timestamp_ms")).alias("duration_ms"))


def track_segments(rows: DataFrame) -> DataFrame:
    """Consecutive centres of track_rows: (x1, y1) to (x2, y2), the later frame and both times."""
    order = Window.partitionBy(*KEY).orderBy("frame_no", "id")
    nxt = lambda c: F.lead(c).over(order)
    seg = rows.select(*KEY, "track_class", "n", "pos", F.col("cx").alias("x1"), F.col("cy").alias("y1"), nxt("cx").alias("x2"), nxt("cy").alias("y2"), F.col("timestamp_ms").alias("ms1"), nxt("timestamp_ms").alias("ms2"), nxt("frame_no").alias("frame_no"))
    return seg.filter("x2 is not null")


def track_motion(segments: DataFrame) -> DataFrame:
    """Path length, displacement and elapsed time of every track with a segment."""
    g = segments.groupBy(*KEY, "track_class", "n").agg(
        F.sum(G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("path_px"),
        F.min(F.struct("pos", "x1", "y1", "ms1")).alias("a"),
        F.max(F.struct("pos", "x2", "y2", "ms2")).alias("z"),
    )
    moved = G.distance(F.col("a.x1"), F.col("a.y1"), F.col("z.x2"), F.col("z.y2"))
    return g.select(*KEY, "track_class", "n", "path_px", moved.alias("displacement_px"), G.heading(F.col("a.x1"), F.col("a.y1"), F.col("z.x2"), F.col("z.y2")).alias("heading"), (F.col("z.ms2") - F.col("a.ms1")).alias("elapsed_ms"))


def consecutive_runs(frames: DataFrame, keys: list[str], max_gap: int = 1) -> DataFrame:
    """Runs of distinct frames per key; a gap above max_gap frames starts a new run. Returns keys, run_start, run_end, n_frames."""
    order = Window.partitionBy(*keys).orderBy("frame_no")
    rows = frames.select(*keys, "frame_no").distinct()
    rows = rows.withColumn("new", (F.col("frame_no") - F.lag("frame_no").over(order) > max_gap + 1).cast("int"))
    rows = rows.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "run").agg(F.min("frame_no").alias("run_start"), F.max("frame_no").alias("run_end"), F.count("*").alias("n_frames")).drop("run")


def lines_of(zones: DataFrame, types: list[str]) -> DataFrame:
    """The first two points of the zones of some types, from parsed zones (points array)."""
    two = zones.filter(F.col("zone_type").isin(types) & (F.size("points") >= 2))
    p, q = F.get("points", F.lit(0)), F.get("points", F.lit(1))
    return two.select("video_id", p["x"].alias("lx1"), p["y"].alias("ly1"), q["x"].alias("lx2"), q["y"].alias("ly2"))


def first_crossing(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """Per track the later frame of the first segment that crosses any line of its video."""
    pt = lambda *c: tuple(F.col(x) for x in c)
    hit = segments.join(lines.hint("merge"), "video_id").filter(G.segments_intersect(pt("x1", "y1"), pt("x2", "y2"), pt("lx1", "ly1"), pt("lx2", "ly2")))
    return hit.groupBy(*KEY, "track_class", "n").agg(F.min(F.struct("pos", "frame_no")).alias("at")).select(*KEY, "track_class", "n", (F.col("at.pos") + 1).alias("pos"), F.col("at.frame_no").alias("frame_no"))


def grouped_by_frame(detections: DataFrame) -> DataFrame:
    """The detections of each frame as one array, for sinks."""
    return detections.groupBy("video_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("id", "class_name", "confidence"))).alias("detections"))


@F.pandas_udf(ArrayType(IntegerType()))
def _strided(frames: pd.Series, every: pd.Series) -> pd.Series:
    def taken(ordered: np.ndarray, step: int) -> list[int]:
        out, at = [], 0
        while at < len(ordered):
            out.append(int(ordered[at]))
            at = int(np.searchsorted(ordered, ordered[at] + step))
        return out

    return pd.Series([taken(f, e) for f, e in zip(frames, every)])


def stride_sample(rows: DataFrame, every: int = 5, keys: list[str] = KEY) -> DataFrame:
    """Per key the frames that a greedy sampler takes: the first, then the first at least `every` after the last taken one."""
    frames = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("frame_no")).alias("frames"))
    return frames.select(*keys, F.explode(_strided("frames", F.lit(every))).alias("frame_no"))


def evidence(*frames: Column) -> Column:
    return F.array(*(f.cast("int") for f in frames))
