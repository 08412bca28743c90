"""Governed exports: pseudonyms, safe cells, documents and label files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.functions.text import display_name, pseudonymize_plate, sanitize_cell
from roadtrace.operators import analytics as A
from roadtrace.schemas import VIOLATION_NAMES

CELLS = ["id", "filename", "violation_type", "type_name", "start_sec", "end_sec", "confidence", "license_plate", "review_status", "source_type", "anonymized"]


def anonymize_violations(violations: DataFrame, key: str) -> DataFrame:
    return violations.withColumn("license_plate", pseudonymize_plate(F.col("license_plate"), key)).withColumn("anonymized", F.lit(True))


def export_rows(violations: DataFrame, videos: DataFrame, key: str | None) -> DataFrame:
    """The eleven columns of a listing as safe cells; plates are pseudonyms unless key is None."""
    rows = anonymize_violations(violations, key) if key is not None else violations.withColumn("anonymized", F.lit(False))
    rows = rows.join(videos.select(F.col("id").alias("video_id"), "filename", "source_type"), "video_id")
    rows = rows.withColumn("type_name", display_name(F.col("violation_type"), VIOLATION_NAMES)).withColumn("start_sec", F.col("start_ms") / 1000.0).withColumn("end_sec", F.col("end_ms") / 1000.0)
    texts = ["filename", "violation_type", "type_name", "license_plate", "review_status", "source_type"]
    return rows.withColumns({c: sanitize_cell(F.col(c)) for c in texts}).select(*CELLS)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


def study_build(violations: DataFrame, videos: DataFrame) -> dict[str, DataFrame]:
    """The parts of a study: figures, the listing, and counts by type, hour, weekday and review."""
    return {
        "kpis": A.kpis(videos, violations),
        "violations": A.list_violations(violations, videos),
        "by_type": A.counts_by(violations, "violation_type"),
        "by_hour": A.by_hour(violations, videos),
        "by_weekday": A.by_weekday(violations, videos),
        "by_status": A.counts_by(violations, "review_status"),
    }


def study_document(violations: DataFrame, videos: DataFrame) -> DataFrame:
    """One JSON document of the counts of a study, each part in order; parts are small whatever the input."""
    out = None
    for name, df in study_build(violations, videos).items():
        if name == "violations":
            continue
        row = df.agg(F.lit(name).alias("part"), F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


def detail_tables(violations: DataFrame, videos: DataFrame, key: str | None) -> dict[str, DataFrame]:
    """The four tables of a workbook: key figures, counts by type with shown names, counts by hour, and the listing."""
    parts = study_build(violations, videos)
    figures = parts["kpis"].select(F.explode(F.array(*(F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in ("videos", "violations", "per_video")))).alias("f")).select("f.*")
    types = parts["by_type"].select(sanitize_cell(F.col("violation_type")).alias("violation_type"), display_name(F.col("violation_type"), VIOLATION_NAMES).alias("type_name"), "n")
    return {"summary": figures, "by_type": types, "by_hour": parts["by_hour"], "details": export_rows(violations, videos, key)}


def export_detail_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV in a folder of its own below path."""
    for name, df in tables.items():
        export_csv(df, f"{path}/{name}")


def export_log(path: str, rows: DataFrame) -> None:
    """Append (study_name, filter_json, format, output_path, exported_at)."""
    rows.write.mode("append").parquet(path)


def detections_json(detections: DataFrame) -> DataFrame:
    """video_id and its detections' frames as JSON, one row a (video, frame)."""
    cells = F.struct("id", "class_name", F.round("confidence", 4).alias("confidence"))
    return detections.groupBy("video_id", "frame_no").agg(F.to_json(F.array_sort(F.collect_list(cells))).alias("json"))


def label_export(detections: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents for label tools, a row per (video, frame) with its boxes as attributes, and the videos refused for an unknown size."""
    size = videos.select(F.col("id").alias("video_id"), "filename", "width", "height")
    good = size.filter("width is not null and height is not null")
    corner = lambda c: F.printf(F.lit("%.2f"), F.col(f"bbox_{c}")).alias(f"_{c}")
    box = F.struct("id", F.col("class_name").alias("_label"), corner("x1"), corner("y1"), corner("x2"), corner("y2"))
    frames = detections.join(good, "video_id").groupBy("video_id", "filename", "width", "height", "frame_no").agg(F.array_sort(F.collect_list(box)).alias("box"))
    return frames.withColumnsRenamed({"frame_no": "_id", "width": "_width", "height": "_height"}), size.filter("width is null or height is null").select("video_id", F.lit("unknown size").alias("error"))


def label_export_xml(frames: DataFrame, path: str) -> None:
    frames.write.mode("overwrite").option("rowTag", "image").option("rootTag", "annotations").format("xml").save(path)
