"""Incremental extraction: new detection files trigger the rules for the videos they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadtrace.operators.changes import extract, extract_violations, with_plates
from roadtrace.operators.rules import COLUMNS, RuleInput, run_rules
from roadtrace.schemas import DETECTION
from roadtrace.session import exists


def _restricted(x: RuleInput, ids: DataFrame) -> RuleInput:
    """The input of some videos (video_id) only. Pixels are not moved where that can be helped."""
    mine = lambda rows, ids=ids.hint("merge"): rows.join(ids, "video_id", "left_semi")
    return RuleInput(mine(x.detections), mine(x.zones), mine(x.calibrations), x.videos, None if x.frames is None else mine(x.frames, ids), x.extra)


def extract_touched(x: RuleInput, touched: DataFrame, old: DataFrame, videos: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All violations and videos after the rules ran again for the touched videos (video_id); those of others stay as they are."""
    return extract(_restricted(x, touched.select("video_id").distinct()), old, videos, votes)


def detection_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream over detection files, `files` of them in a batch at most."""
    reader = spark.readStream.schema(DETECTION)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def watch_detections(spark: SparkSession, path: str, checkpoint: str, extract: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    """Start a stream over detection files; extract(videos, batch_id) gets the distinct touched video_ids of each batch.

    Touched videos are analysed whole, so a batch that is run again gives the same result.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        extract(batch.select("video_id").distinct(), batch_id)

    stream = detection_stream(spark, path)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class ExtractionLog:
    """Violations that follow a stream of detections, kept as a log of batches in a folder.

    A batch writes three parts under its own number: the detections that came, the violations
    of all videos they touch, judged whole over everything that came so far, and, last, the
    ids of these videos. A part that is written again replaces itself, so a batch that the
    stream replays after a failure leaves the same log; one that broke off is not yet read,
    since its ids are missing. What holds for a video is what the last batch about it wrote:
    nothing older is rewritten.
    """

    def __init__(self, spark: SparkSession, path: str, x: RuleInput, votes: DataFrame):
        """x: all inputs of the rules; its detections only serve to name their columns. votes: plates as extract takes them."""
        self.spark, self.path, self.x, self.votes = spark, path.rstrip("/"), x, votes

    def _write(self, rows: DataFrame, part: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{part}/batch={batch_id}")

    def _read(self, part: str) -> DataFrame | None:
        at = f"{self.path}/{part}"
        return self.spark.read.parquet(at) if exists(self.spark, at) else None

    def run_batch(self, batch: DataFrame, batch_id: int) -> None:
        """One batch of detections, as foreachBatch calls it. A batch without rows leaves no part."""
        if batch.isEmpty():
            return
        self._write(batch, "detections", batch_id)
        came = self._read("detections").filter(F.col("batch") <= batch_id)
        ids = came.filter(F.col("batch") == batch_id).select("video_id").distinct()
        x = RuleInput(came.drop("batch"), self.x.zones, self.x.calibrations, self.x.videos, self.x.frames, self.x.extra)
        found = with_plates(run_rules(_restricted(x, ids)), self.votes)
        self._write(found, "violations", batch_id)
        self._write(ids, "judged", batch_id)

    def follow(self, path: str, checkpoint: str, files: int | None = None, **trigger) -> StreamingQuery:
        """Start the stream over the detection files of a folder, by default until all of them are done."""
        stream = detection_stream(self.spark, path, files)
        return stream.writeStream.foreachBatch(self.run_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def judged(self) -> DataFrame:
        """video_id and the last batch that judged it."""
        seen = self._read("judged")
        if seen is None:
            return self.spark.createDataFrame([], "video_id int, batch int")
        return seen.groupBy("video_id").agg(F.max("batch").alias("batch"))

    def state(self, old: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All violations and videos now: automatic rows of judged videos are those of their last batch, all others as in old."""
        last = self.judged()
        found = self._read("violations")
        if found is None:
            return old, videos
        fresh = found.join(last.hint("merge"), ["video_id", "batch"], "left_semi").drop("batch")
        rows = extract_violations(old, fresh, last)
        done = last.select(F.col("video_id").alias("id"), F.lit(True).alias("judged"))
        after = videos.join(done.hint("merge"), "id", "left").withColumn("status", F.when(F.col("judged"), "analyzed").otherwise(F.col("status"))).drop("judged")
        return rows, after


__all__ = ["COLUMNS", "ExtractionLog", "detection_stream", "extract_touched", "watch_detections"]
