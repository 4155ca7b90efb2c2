"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of rows that go to a Python worker at once. Spark's default lets long texts make batches of 64 MB.
BATCH_BYTES, _DEFAULT_BYTES = "8m", "67108864b"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts. For the whole session, Arrow batches get BATCH_BYTES unless it sets a size of its own."""
    if spark.conf.get(_BYTES, _DEFAULT_BYTES) == _DEFAULT_BYTES:
        spark.conf.set(_BYTES, BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that was just read, dealt out to all cores if it has fewer files than there are cores.

    A file of one row group is one task, however long its texts take. Large tables have more files and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master may go without the setting; it then gets a folder of its own in /tmp.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if known := context.getCheckpointDir():
        return known.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again.

    This cuts the lineage: what follows reads files that every executor sees, so a lost executor
    costs only its own tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fitted(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df in as many partitions as its rows need, at least 8 and never more than it has; for tables that may be small."""
    return df.coalesce(max(8, -(-rows // each)))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most the given number of (narrow) rows, else df itself.

    df is counted for this; pass a written table. Beyond the bound Spark shuffles both sides and
    AQE splits hot keys.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
