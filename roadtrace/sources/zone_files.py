"""Zones that people keep in files: read, judged, and put into the table of zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadtrace.session import materialise
from roadtrace.sources.ingest import parse_points, zones_validate
from roadtrace.sources.video_table import VideoTable

BROKEN = "_broken"
FILE = f"zone_type string, polygon string, metadata string, {BROKEN} string"
ZONE = T.StructType([T.StructField("id", T.LongType()), T.StructField("video_id", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("zone_type", "polygon", "metadata"))])


def read_zone_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good zones (video_id, zone_type, polygon, metadata) of a folder's JSON files, and what was refused (file, video_id, zone_type, reason).

    A file belongs to the video whose number ends its name, and lists objects of zone_type,
    polygon and metadata over any number of lines; one object alone counts as such a list. A
    file that is no JSON, or names no video, is refused whole, a zone of an unknown type or of
    too few points alone. The files are read once.
    """
    raw = spark.read.schema(FILE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)
    name = F.col("_metadata.file_name")
    video = F.regexp_extract(name, r"(\d+)\.[^.]*$", 1).try_cast("int")
    rows = materialise(raw.select(name.alias("file"), video.alias("video_id"), "zone_type", "polygon", "metadata", BROKEN), "zone-files")
    judged = zones_validate(rows.withColumn("points", parse_points(F.col("polygon"))))
    reason = F.when(F.col(BROKEN).isNotNull(), "no JSON").when(F.col("video_id").isNull(), "no video").otherwise(F.col("reason"))
    judged = judged.withColumn("reason", reason).drop("points")
    good = judged.filter("reason is null").select("video_id", "zone_type", "polygon", "metadata")
    return good, judged.filter("reason is not null").select("file", "video_id", "zone_type", "reason")


def replace_zones(table: VideoTable, zones: DataFrame) -> list[int]:
    """Put zones in place of all those of their videos; new ids follow the largest known one. A video all of whose zones were refused keeps what it had."""
    top = table.read().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = materialise(zones.withColumn("id", F.lit(top) + 1 + F.monotonically_increasing_id()), "new-zones")
    return table.replace(rows.select("video_id"), rows)
