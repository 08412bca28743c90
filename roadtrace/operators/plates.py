"""Plates: which boxes belong to a track, and the vote over their readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadtrace.functions import geometry as G
from roadtrace.functions.text import normalize_plate


def plates_for_track(rows: DataFrame, detections: DataFrame, most: int = 5) -> DataFrame:
    """Per frame of a track the first plate box whose centre lies in the vehicle's, of the first `most` frames."""
    plates = detections.filter("class_name = 'license_plate'").select("video_id", "frame_no", F.col("id").alias("box_id"), *(F.col(f"bbox_{c}").alias(f"p_{c}") for c in G.Box._fields))
    last = rows.groupBy("video_id", "track_id", "frame_no").agg(F.max_by(F.struct("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"), "id").alias("b")).select("video_id", "track_id", "frame_no", "b.*")
    inside = last.join(plates, ["video_id", "frame_no"]).filter(G.contains(G.box(), G.center_x(G.box("p_")), G.center_y(G.box("p_"))))
    first = inside.groupBy("video_id", "track_id", "frame_no").agg(F.min("box_id").alias("box_id"))
    order = Window.partitionBy("video_id", "track_id").orderBy("frame_no")
    return first.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")


def plate_vote(reads: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """reads: keys, raw_text, confidence. Per key the text read most often, then with the higher mean confidence, then the first text.

    Confidences are summed as decimals: equal means are equal in whatever order their rows come.
    """
    good = reads.withColumn("text", normalize_plate(F.col("raw_text"))).filter((F.col("text") != "") & (F.col("confidence") >= least))
    total = F.coalesce(F.sum(F.col("confidence").try_cast("decimal(28,18)")), F.lit(0))
    votes = good.groupBy(*keys, "text").agg(F.count("*").alias("n"), total.alias("total"))
    mean = (F.col("total").cast("double") / F.col("n")).alias("mean")
    best = votes.groupBy(*keys).agg(F.min_by(F.struct("text", mean, "n"), F.struct(-F.col("n"), -F.col("total"), F.col("text"))).alias("b"))
    return best.select(*keys, "b.text", F.col("b.mean").alias("confidence"), F.col("b.n").alias("reads"))


def best_reading(reads: DataFrame, keys: list[str]) -> DataFrame:
    """The reading of the highest confidence per key; ties go to the first text."""
    best = reads.groupBy(*keys).agg(F.min_by(F.struct("raw_text", "confidence"), F.struct(-F.col("confidence"), F.col("raw_text"))).alias("b"))
    return best.select(*keys, "b.raw_text", "b.confidence")


def plate_for_image_set(reads: DataFrame, set_keys: list[str], image: str) -> DataFrame:
    """One reading per image, then the vote over a set's images."""
    return plate_vote(best_reading(reads, [*set_keys, image]), set_keys)


def plate_for_violation(violations: DataFrame, votes: DataFrame) -> DataFrame:
    """Violations with their track's plate, kept as it was where the vote says nothing."""
    won = votes.filter((F.col("text") != "") & (F.col("confidence") > 0)).select("video_id", "track_id", F.col("text").alias("voted"), F.col("confidence").alias("voted_conf"))
    rows = violations.join(won.hint("merge"), ["video_id", "track_id"], "left")
    return rows.withColumn("license_plate", F.coalesce("voted", "license_plate")).withColumn("plate_conf", F.coalesce("voted_conf", "plate_conf")).drop("voted", "voted_conf")
