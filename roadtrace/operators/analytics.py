"""Key figures, calendars, listings and readiness of the catalogue and its violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadtrace.functions.text import display_name, violation_moment
from roadtrace.schemas import VIOLATION_NAMES


def kpis(videos: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: videos, violations, and violations per video (0 without videos)."""
    both = videos.select(F.lit(1).alias("v"), F.lit(0).alias("x")).unionByName(violations.select(F.lit(0).alias("v"), F.lit(1).alias("x")))
    n, m = F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("x"), F.lit(0))
    return both.agg(n.alias("videos"), m.alias("violations"), F.when(n > 0, m / n).otherwise(0.0).alias("per_video"))


def videos_by_source(videos: DataFrame) -> DataFrame:
    return videos.groupBy(F.coalesce("source_type", F.lit("other")).alias("source")).agg(F.count("*").alias("n"))


def counts_by(violations: DataFrame, column: str) -> DataFrame:
    """Groups with their sizes, the largest first."""
    return violations.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def moments(violations: DataFrame, videos: DataFrame) -> DataFrame:
    """Violations of videos with a recording time, and the moment of each."""
    when = videos.filter("recorded_at is not null").select(F.col("id").alias("video_id"), "recorded_at")
    return violations.join(when, "video_id").withColumn("moment", violation_moment(F.col("recorded_at"), F.col("start_ms")))


def by_hour(violations: DataFrame, videos: DataFrame) -> DataFrame:
    return moments(violations, videos).groupBy(F.hour("moment").cast("bigint").alias("hour")).agg(F.count("*").alias("n"))


def by_weekday(violations: DataFrame, videos: DataFrame) -> DataFrame:
    """Monday is 0."""
    return moments(violations, videos).groupBy(F.weekday("moment").cast("bigint").alias("weekday")).agg(F.count("*").alias("n"))


def heatmap(violations: DataFrame, videos: DataFrame) -> DataFrame:
    """All 7 x 24 cells, empty ones too."""
    seen = moments(violations, videos).groupBy(F.weekday("moment").cast("bigint").alias("weekday"), F.hour("moment").cast("bigint").alias("hour")).agg(F.count("*").alias("n"))
    spark = violations.sparkSession
    grid = spark.range(7 * 24).select(F.floor(F.col("id") / 24).alias("weekday"), F.pmod("id", F.lit(24)).alias("hour"))
    return grid.join(seen, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def over_time(violations: DataFrame, videos: DataFrame) -> DataFrame:
    return moments(violations, videos).groupBy(F.to_date("moment").cast("string").alias("day")).agg(F.count("*").alias("n"))


def without_time(violations: DataFrame, videos: DataFrame) -> DataFrame:
    return violations.join(videos.filter("recorded_at is null").select(F.col("id").alias("video_id")), "video_id", "left_semi").agg(F.count("*").alias("n"))


def library_totals(videos: DataFrame) -> DataFrame:
    return videos.agg(F.count("*").alias("videos"), F.coalesce(F.sum("duration_sec"), F.lit(0.0)).alias("duration_sec"))


def _limited(rows: DataFrame, limit: int | None) -> DataFrame:
    """0 or None: no limit."""
    return rows.limit(limit) if limit else rows


def list_videos(videos: DataFrame, source: str | None = None, status: str | None = None, search: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; search is a literal part of the filename, in any case."""
    if source:
        videos = videos.filter(F.col("source_type") == source)
    if status:
        videos = videos.filter(F.col("status") == status)
    if search:
        videos = videos.filter(F.contains(F.lower("filename"), F.lit(search.lower())))
    return _limited(videos.orderBy(F.desc("imported_at"), F.desc("id")), limit).select("id", "filename", "source_type", "duration_sec", "status", "codec")


def filtered(violations: DataFrame, kind: str | None = None, review: str | None = None, video_id: int | None = None) -> DataFrame:
    for column, value in (("violation_type", kind), ("review_status", review), ("video_id", video_id)):
        if value is not None:
            violations = violations.filter(F.col(column) == value)
    return violations


def list_violations(violations: DataFrame, videos: DataFrame, kind: str | None = None, review: str | None = None, video_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Latest first, with the video's filename and the shown name of the type."""
    rows = filtered(violations, kind, review, video_id).join(videos.select(F.col("id").alias("video_id"), "filename", "source_type"), "video_id")
    rows = rows.withColumn("type_name", display_name(F.col("violation_type"), VIOLATION_NAMES))
    return _limited(rows.orderBy(F.desc("id")), limit).select("id", "video_id", "filename", "source_type", "violation_type", "type_name", "start_ms", "end_ms", "confidence", "license_plate", "review_status")


def list_editable(violations: DataFrame, videos: DataFrame, limit: int = 500) -> DataFrame:
    """Also violations of unknown videos; nulls are shown as text."""
    rows = violations.orderBy(F.desc("id")).limit(limit).join(videos.select(F.col("id").alias("video_id"), "filename"), "video_id", "left")
    shown = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return rows.select("id", "video_id", shown("filename", "—"), "violation_type", "start_ms", "end_ms", shown("license_plate", ""), shown("source", "auto"), shown("notes", ""), "review_status")


def detections_listed(detections: DataFrame) -> DataFrame:
    """Every video's detections with their place in its listing, by frame and id."""
    return detections.withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_no", "id")).cast("bigint"))


def violation_evidence(violations: DataFrame, videos: DataFrame, first: int = 6) -> DataFrame:
    """Each evidence frame of each violation, in order, `first` at most, with the video's path."""
    from roadtrace.sources.ingest import evidence_decode

    rows = violations.join(videos.select(F.col("id").alias("video_id"), "filepath"), "video_id")
    return rows.select("id", "video_id", "filepath", F.posexplode(F.slice(evidence_decode(F.col("evidence_frames")), 1, first)).alias("pos", "frame_no"))


def video_summaries(videos: DataFrame, detections: DataFrame, violations: DataFrame) -> DataFrame:
    """Videos with their numbers of detections and violations, 0 where they have none."""
    count = lambda rows, name: rows.groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias(name))
    rows = videos.select("id", "filename").join(count(detections, "n_detections"), "id", "left").join(count(violations, "n_violations"), "id", "left")
    return rows.na.fill(0, ["n_detections", "n_violations"])


#: What a rule needs beyond detections, as readiness lists it.
REQUIREMENTS = {
    "red_light_running": ["tracks", "stop_line"],
    "wrong_direction": ["tracks"],
    "no_helmet": ["tracks"],
    "illegal_parking": ["tracks", "no_parking"],
    "illegal_overtaking": ["tracks", "lane_line_solid"],
    "lane_keeping": ["tracks"],
    "speeding": ["tracks", "calibration"],
    "unsafe_following": ["tracks", "calibration"],
    "high_beam_misuse": ["tracks", "video_file"],
}


def readiness(ids: DataFrame, detections: DataFrame, zones: DataFrame, calibrations: DataFrame, files: DataFrame) -> DataFrame:
    """Per requested id: what the video has, all false for an unknown one. files: id of the videos whose file exists."""
    seen = detections.groupBy(F.col("video_id").alias("id")).agg(F.lit(True).alias("has_detections"), (F.count("track_id") > 0).alias("has_tracks"))
    types = zones.groupBy(F.col("video_id").alias("id")).agg(F.array_sort(F.collect_set("zone_type")).alias("zone_types"))
    scaled = calibrations.filter("meters_per_px > 0").select(F.col("video_id").alias("id"), F.lit(True).alias("has_calibration")).distinct()
    there = files.select("id", F.lit(True).alias("has_video_file")).distinct()
    rows = ids.select("id").distinct()
    for part in (seen, types, scaled, there):
        rows = rows.join(part, "id", "left")
    flags = ["has_detections", "has_tracks", "has_calibration", "has_video_file"]
    return rows.na.fill(False, flags).select("id", *flags, F.coalesce("zone_types", F.array().cast("array<string>")).alias("zone_types"))


def detectors_blocked(ready: DataFrame) -> DataFrame:
    """id, rule and what the rule misses, a row for each rule that cannot run."""
    have = F.concat("zone_types", F.array_compact(F.array(F.when(F.col("has_tracks"), F.lit("tracks")), F.when(F.col("has_calibration"), F.lit("calibration")), F.when(F.col("has_video_file"), F.lit("video_file")))))
    needs = F.array(*(F.struct(F.lit(r).alias("rule"), F.array(*map(F.lit, n)).alias("needs")) for r, n in REQUIREMENTS.items()))
    rows = ready.select("id", have.alias("have"), F.explode(needs).alias("r")).select("id", "r.rule", F.array_except("r.needs", "have").alias("missing"))
    return rows.filter(F.size("missing") > 0).select("id", "rule", F.concat_ws(",", F.array_sort("missing")).alias("missing"))
