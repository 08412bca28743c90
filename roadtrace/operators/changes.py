"""Batches of human changes: validation, application and the audit trail they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.operators.plates import plate_for_violation
from roadtrace.operators.rules import RuleInput, run_rules

MOST_PLATE, MOST_NOTES = 12, 2000


def latest(changes: DataFrame, key: str = "violation_id") -> DataFrame:
    """The last change of each key: by time, then by change_id."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("changed_at", "change_id")).alias("c")).select(key, "c.*")


def validate_manual(changes: DataFrame, videos: DataFrame) -> DataFrame:
    """Manual inserts and edits with the reason for which one is refused, null for the good ones."""
    rows = changes.filter("op in ('I', 'U')").join(videos.select(F.col("id").alias("video_id"), F.col("duration_sec").alias("d"), F.lit(True).alias("known")), "video_id", "left")
    reason = (
        F.when(F.col("known").isNull(), "unknown video")
        .when(F.col("end_ms") <= F.col("start_ms"), "empty interval")
        .when(F.col("end_ms") > F.col("d") * 1000, "beyond the video")
        .when(F.length("license_plate") > MOST_PLATE, "plate too long")
        .when(F.length("notes") > MOST_NOTES, "notes too long")
    )
    return rows.withColumn("reason", reason).drop("d", "known")


def manual_inserts(valid: DataFrame) -> DataFrame:
    """New violations out of accepted inserts."""
    rows = valid.filter("reason is null and op = 'I'")
    return rows.select("video_id", "violation_type", "start_ms", "end_ms", F.lit(1.0).alias("confidence"), "license_plate", F.lit("confirmed").alias("review_status"), F.lit("manual").alias("source"), F.concat(F.lit("[manual] "), F.coalesce("notes", F.lit(""))).alias("notes"), F.col("actor").alias("manual_user"))


def apply_review(violations: DataFrame, changes: DataFrame) -> DataFrame:
    """Violations with the last review of each."""
    new = latest(changes.filter("op = 'review'")).select(F.col("violation_id").alias("id"), F.col("review_status").alias("new"), F.col("changed_at").alias("reviewed_at"))
    return violations.join(new, "id", "left").withColumn("review_status", F.coalesce("new", "review_status")).drop("new")


def apply_edits(violations: DataFrame, valid: DataFrame) -> DataFrame:
    """Violations with the last accepted edit of each: it turns them manual, and leaves their review alone."""
    new = latest(valid.filter("reason is null and op = 'U'").drop("reason"))
    new = new.select(F.col("violation_id").alias("id"), *(F.col(c).alias(f"new_{c}") for c in ("violation_type", "start_ms", "end_ms", "license_plate", "notes")), F.lit("manual").alias("new_source"))
    rows = violations.join(new, "id", "left")
    cols = ["violation_type", "start_ms", "end_ms", "license_plate", "notes", "source"]
    return rows.withColumns({c: F.when(F.col("new_source").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)) for c in cols}).drop(*(f"new_{c}" for c in cols))


def apply_deletes(violations: DataFrame, changes: DataFrame) -> DataFrame:
    return violations.join(changes.filter("op = 'D'").select(F.col("violation_id").alias("id")).distinct(), "id", "left_anti")


def audit_rows(violations: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per change of a known violation: entity, id, action, old and new value, actor, time."""
    rows = changes.join(violations.select(F.col("id").alias("violation_id"), F.col("review_status").alias("old")), "violation_id")
    action = F.when(F.col("op") == "review", "review").when(F.col("op") == "D", "delete").when(F.col("op") == "U", "edit").otherwise("insert")
    return rows.select(F.lit("violation").alias("entity"), F.col("violation_id").alias("entity_id"), action.alias("action"), F.when(F.col("op") == "review", F.col("old")).alias("old_value"), F.when(F.col("op") == "review", F.col("review_status")).alias("new_value"), "actor", F.col("changed_at").alias("occurred_at"))


def extract_violations(old: DataFrame, found: DataFrame, detections: DataFrame) -> DataFrame:
    """Violations after the rules ran again: automatic rows of videos with detections are replaced, all others stay."""
    touched = detections.select("video_id").distinct().hint("merge")
    kept = old.filter("coalesce(source, 'auto') = 'auto'").join(touched, "video_id", "left_anti").unionByName(old.filter("coalesce(source, 'auto') <> 'auto'"))
    fresh = found.join(touched, "video_id", "left_semi").withColumn("source", F.lit("auto")).withColumn("review_status", F.lit("pending"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def with_plates(found: DataFrame, votes: DataFrame) -> DataFrame:
    """New violations with their tracks' plates from votes (video_id, track_id, text, confidence)."""
    bare = found.withColumn("license_plate", F.lit(None).cast("string")).withColumn("plate_conf", F.lit(None).cast("double"))
    return plate_for_violation(bare, votes)


def extract(x: RuleInput, old: DataFrame, videos: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The violations and videos after all rules ran on all videos with detections.

    Every rule judges the videos that have what it needs; new violations take their track's
    plate from votes (video_id, track_id, text, confidence), and the videos that were judged
    become analyzed.
    """
    rows = extract_violations(old, with_plates(run_rules(x), votes), x.detections)
    judged = x.detections.select(F.col("video_id").alias("id")).distinct().withColumn("judged", F.lit(True)).hint("merge")
    status = F.when(F.col("judged"), "analyzed").otherwise(F.col("status"))
    return rows, videos.join(judged, "id", "left").withColumn("status", status).drop("judged")


def video_changes(videos: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id, recorded_at, source_type, status, changed_at, change_id; null means unchanged. The last change of each column counts."""
    order = F.struct("changed_at", "change_id")
    new = changes.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"new_{c}") for c in ("recorded_at", "source_type", "status")))
    rows = videos.join(new, "id", "left")
    return rows.withColumns({c: F.coalesce(f"new_{c}", c) for c in ("recorded_at", "source_type", "status")}).drop("new_recorded_at", "new_source_type", "new_status")


def delete_videos_cascade(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """videos (id) and child tables (video_id) without the given ids."""
    gone = ids.select("id").distinct()
    return {name: df.join(gone, "id", "left_anti") if name == "videos" else df.join(gone.withColumnRenamed("id", "video_id"), "video_id", "left_anti") for name, df in tables.items()}


def deletion_audit(videos: DataFrame, ids: DataFrame, actor: str) -> DataFrame:
    """An audit row for each known video that goes, with its filename as the old value."""
    gone = videos.join(ids.select("id").distinct(), "id", "left_semi")
    none = F.lit(None).cast("string")
    return gone.select(F.lit("video").alias("entity"), F.col("id").alias("entity_id"), F.lit("delete").alias("action"), F.coalesce("filename", F.col("id").cast("string")).alias("old_value"), none.alias("new_value"), F.lit(actor).alias("actor"))


def statuses(videos: DataFrame, wanted: list[str]) -> DataFrame:
    """Ids of the videos that wait in some status, in order."""
    return videos.filter(F.col("status").isin(wanted)).select("id").orderBy("id")


def append_audit(rows: DataFrame, path: str) -> str | None:
    """Append to the audit table; a failure is returned and never raised, since the main write is done."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception as e:  # noqa: BLE001
        return str(e).splitlines()[0]
    return None
