"""A study as one nested document: lines of JSON, each of which belongs to a part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.functions.text import pseudonymize_plate
from roadtrace.operators import analytics as A

#: Of each part but the head, the field that its lines hold.
PARTS = {"kpis": "figures", "violations": "violation", "by_type": "type", "by_hour": "hour", "by_weekday": "weekday", "by_review_status": "review"}
LINE = (
    "part string, anonymized boolean, figures struct<videos:bigint,violations:bigint,per_video:double>, violation struct<id:int,video:struct<id:int,filename:string,source_type:string>,"
    "type:struct<code:string,name:string>,interval:struct<start_ms:int,end_ms:int>,confidence:double,license_plate:string,review_status:string>, type struct<code:string,n:bigint>,"
    " hour struct<hour:bigint,n:bigint>, weekday struct<weekday:bigint,n:bigint>, review struct<status:string,n:bigint>"
)


def study_lines(violations: DataFrame, videos: DataFrame) -> DataFrame:
    """The document's lines (LINE): a head, the figures, every violation, and the counts by type, hour, weekday and review.

    A line has its part and the field of the part; nothing is gathered into one row, so the
    listing may be of any size. A violation of an unknown video, or a null key of a count,
    has null fields, which JSON leaves out.
    """
    listed = A.list_violations(violations, videos)
    video = F.struct(F.col("video_id").alias("id"), "filename", "source_type")
    kind = F.struct(F.col("violation_type").alias("code"), F.col("type_name").alias("name"))
    nested = F.struct("id", video.alias("video"), kind.alias("type"), F.struct("start_ms", "end_ms").alias("interval"), "confidence", "license_plate", "review_status")
    count = lambda rows, key, name: rows.select(F.struct(F.col(key).alias(name), "n").alias("x"))
    parts = {
        "kpis": A.kpis(videos, violations).select(F.struct("videos", "violations", "per_video").alias("x")),
        "violations": listed.select(nested.alias("x")),
        "by_type": count(A.counts_by(violations, "violation_type"), "violation_type", "code"),
        "by_hour": count(A.by_hour(violations, videos), "hour", "hour"),
        "by_weekday": count(A.by_weekday(violations, videos), "weekday", "weekday"),
        "by_review_status": count(A.counts_by(violations, "review_status"), "review_status", "status"),
    }
    spark = violations.sparkSession
    whole = spark.createDataFrame([], LINE).schema
    line = lambda part, rows: rows.select(F.lit(part).alias("part"), F.lit(False).alias("anonymized"), F.col("x").cast(whole[PARTS[part]].dataType).alias(PARTS[part]))
    lines = [spark.createDataFrame([("study", False)], "part string, anonymized boolean"), *(line(k, v) for k, v in parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lines).select(*whole.names)


def anonymize_study(lines: DataFrame, key: str) -> DataFrame:
    """The lines with pseudonyms in place of plates, one plate the same everywhere, and marked as such."""
    plate = pseudonymize_plate(F.col("violation.license_plate"), key)
    hidden = F.when(F.col("violation").isNotNull(), F.col("violation").withField("license_plate", plate))
    return lines.withColumn("violation", hidden).withColumn("anonymized", F.lit(True))


def write_study(lines: DataFrame, path: str) -> None:
    """Lines of JSON in a folder for each part; a count's part is one small file, the listing as many as it has tasks."""
    lines.write.mode("overwrite").partitionBy("part").json(path)


def read_study(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINE).json(path)
