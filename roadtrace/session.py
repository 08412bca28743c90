"""Session helpers: where lineage is cut, and how tables are read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset in local mode (tests: driver and executors on one machine) a
    temporary folder serves the application; on a cluster, whose executors would not see
    that folder, an unset one is refused.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        there = _local[app]
    return there.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs its tasks only.

    The folder goes when the application ends, or with discard.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for df in tables:
        delete(df.sparkSession, df._folder)


#: Bytes of files of which one task sorts the rows: some hundred thousand narrow ones.
TASK_BYTES = 8 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many partitions as its files have TASK_BYTES, so that no task grows with them; left alone where the session's own number is enough."""
    spark = df.sparkSession
    size = 0
    for file in df.inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        size += at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    parts = -(-size // TASK_BYTES)
    return df.repartition(parts, *keys) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else df


class Scratch:
    """Materialised tables that are deleted together, once nothing reads them any more."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(materialise(df, name))
        return self.tables[-1]

    def clear(self) -> None:
        discard(*self.tables)
        self.tables = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
