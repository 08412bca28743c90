"""Tables in folders whose rows are replaced by whole videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadtrace.session import delete

PART = "video_part"


class VideoTable:
    """Rows with a video_id in a folder, in `parts` partitions of video_id.

    However many videos there are, a table has so many folders at most, and a replacement
    reads and writes those of its videos only.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, parts: int = 64):
        self.spark, self.path, self.schema, self.parts = spark, path.rstrip("/"), schema, parts

    def _part(self) -> Column:
        return F.pmod(F.coalesce("video_id", F.lit(-1)), F.lit(self.parts)).cast("int").alias(PART)

    def create(self, rows: DataFrame) -> VideoTable:
        """Write all rows, those without video_id too."""
        rows = rows.select(*self.schema.names).withColumn(PART, self._part())
        rows.repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self._stored().drop(PART)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(PART, T.IntegerType())])).parquet(self.path)

    def replace(self, touched: DataFrame, new: DataFrame) -> list[int]:
        """Put `new` in place of all rows of the touched videos (video_id); rows of `new` about other videos are left out.

        One dynamic partition overwrite: tasks write beside the table and the last step moves
        the partitions, so a lost executor or a failed job leaves the old rows. Spark leaves a
        partition alone for which nothing was written; those that lost all their rows are
        deleted afterwards, and returned. A replacement that broke off in between is mended by
        running it again. Null video_ids are touched by none.
        """
        ids = touched.select("video_id").filter("video_id is not null").distinct()
        mine = sorted(r[0] for r in ids.select(self._part()).distinct().collect())  # `parts` numbers at most
        if not mine:
            return []
        kept = self._stored().filter(F.col(PART).isin(mine)).join(ids, "video_id", "left_anti")
        fresh = new.join(ids, "video_id", "left_semi").withColumn(PART, self._part())
        filled = Observation()
        rows = kept.unionByName(fresh, allowMissingColumns=True).select(*kept.columns).repartition(PART)
        rows.observe(filled, F.collect_set(PART).alias("parts")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
        emptied = sorted(set(mine) - set(filled.get["parts"]))
        for part in emptied:
            delete(self.spark, f"{self.path}/{PART}={part}")
        return emptied


def analysed(videos: DataFrame, touched: DataFrame) -> DataFrame:
    """videos (id, status) after the touched ones (video_id) were analysed again: they wait for review as prelabeled."""
    ids = touched.select(F.col("video_id").alias("id"), F.lit(True).alias("again")).distinct()
    return videos.join(ids, "id", "left").withColumn("status", F.when(F.col("again"), "prelabeled").otherwise(F.col("status"))).drop("again")
