"""The audit trail: what every kind of change replaced, in the order of the change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadtrace.operators.changes import append_audit

AUDIT = ["entity", "entity_id", "action", "old_value", "new_value", "actor", "occurred_at"]


def _label(kind: Column, source: Column) -> Column:
    return F.concat(kind, F.lit(" (source="), source, F.lit(")"))


def violation_audit(violations: DataFrame, changes: DataFrame) -> DataFrame:
    """An audit row (AUDIT) for each change of the log: reviews, edits, deletes and manual inserts.

    violations: the state before the log; changes: accepted ones (change_id, op, violation_id,
    violation_type, video_id, review_status, actor, changed_at), whose order is changed_at,
    then change_id. The old value is what the changes before left, or the state before the log
    did; a change of an unknown id, or of one that was deleted before, has none, and is
    recorded all the same. An insert's entity is the id that new_ids gives it.
    """
    none = lambda kind="string": F.lit(None).cast(kind)
    kept = ["violation_id", "order_at", "change_id", "op", "label", "review", "violation_type", "video_id", "actor", "changed_at"]
    before = violations.select(
        F.col("id").alias("violation_id"), none("timestamp_ntz").alias("order_at"), none("long").alias("change_id"), F.lit("base").alias("op"), _label(F.col("violation_type"), F.coalesce("source", F.lit("auto"))).alias("label"),
        F.col("review_status").alias("review"), none().alias("violation_type"), none("int").alias("video_id"), none().alias("actor"), none("timestamp_ntz").alias("changed_at"),
    )
    mine = changes.filter("op <> 'I'").withColumns(
        {
            "order_at": F.col("changed_at").cast("timestamp_ntz"),
            "changed_at": F.col("changed_at").cast("timestamp_ntz"),
            "label": F.when(F.col("op") == "U", _label(F.col("violation_type"), F.lit("manual"))),
            "review": F.when(F.col("op") == "review", F.col("review_status")),
        }
    )
    # the state before the log comes first, since nulls do
    order = Window.partitionBy("violation_id").orderBy(F.asc_nulls_first("order_at"), "change_id")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = before.select(*kept).unionByName(mine.select(*kept))
    rows = rows.withColumns(
        {
            "known": F.coalesce(F.max((F.col("op") == "base").cast("int")).over(earlier), F.lit(0)) > F.coalesce(F.max((F.col("op") == "D").cast("int")).over(earlier), F.lit(0)),
            "label_was": F.last("label", ignorenulls=True).over(earlier),
            "review_was": F.last("review", ignorenulls=True).over(earlier),
        }
    ).filter("op <> 'base'")
    review = F.col("op") == "review"
    action = F.when(review, "review_status").when(F.col("op") == "D", "delete").otherwise("edit")
    old = F.when(F.col("known"), F.when(review, F.col("review_was")).otherwise(F.col("label_was")))
    changed = rows.select(F.lit("violation").alias("entity"), F.col("violation_id").cast("long").alias("entity_id"), action.alias("action"), old.alias("old_value"), F.coalesce("review", "label").alias("new_value"), "actor", F.col("changed_at").alias("occurred_at"))
    made = F.concat("violation_type", F.lit(" @ video "), F.col("video_id").cast("string"))
    inserted = new_ids(violations, changes).select(F.lit("violation").alias("entity"), F.col("id").alias("entity_id"), F.lit("create_manual").alias("action"), none().alias("old_value"), made.alias("new_value"), "actor", F.col("changed_at").cast("timestamp_ntz").alias("occurred_at"))
    return changed.unionByName(inserted)


def new_ids(violations: DataFrame, changes: DataFrame) -> DataFrame:
    """The log's inserts with ids that no violation has: the largest known id, and the change's own number behind it.

    They follow from the log alone, so a job that runs again gives the same ids, and no
    number is drawn in one place. Change numbers are above 0, and distinct.
    """
    top = violations.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    return changes.filter("op = 'I'").withColumn("id", top + F.col("change_id") + 1)


def video_audit(videos: DataFrame, changes: DataFrame) -> DataFrame:
    """An audit row for each new recording time of the log (id, recorded_at, actor, changed_at, change_id); other changes leave none.

    The old value is the time that the change before set, or the catalogue's; unknown videos
    have none.
    """
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    none = lambda kind: F.lit(None).cast(kind)
    before = videos.select("id", text("recorded_at").alias("value"), none("timestamp_ntz").alias("changed_at"), none("long").alias("change_id"), none("string").alias("actor"), F.lit(True).alias("base"))
    mine = changes.filter("recorded_at is not null").select("id", text("recorded_at").alias("value"), F.col("changed_at").cast("timestamp_ntz").alias("changed_at"), F.col("change_id").cast("long").alias("change_id"), "actor", F.lit(False).alias("base"))
    order = Window.partitionBy("id").orderBy(F.desc("base"), "changed_at", "change_id")
    known = F.max("base").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = before.unionByName(mine).withColumn("old_value", F.lag("value").over(order)).withColumn("known", known).filter("not base")
    return rows.select(F.lit("video").alias("entity"), F.col("id").cast("long").alias("entity_id"), F.lit("set_recorded_at").alias("action"), F.when(F.col("known"), F.col("old_value")).alias("old_value"), F.col("value").alias("new_value"), "actor", F.col("changed_at").alias("occurred_at"))


def write_audited(rows: DataFrame, path: str, audit: DataFrame, audit_path: str) -> str | None:
    """Write rows, then append their audit. The first failure is raised and leaves no audit; the second is returned, since the rows are written."""
    rows.write.mode("overwrite").parquet(path)
    return append_audit(audit, audit_path)
