"""Cutting lineage with tables in the shared checkpoint folder.

A table written there survives the loss of any executor and keeps column pruning for later readers. What
was written is not computed again by later readers; a task that is lost while writing does run again, so a
model may be asked twice for the prompts of that task. `drop_tables` deletes what a session has written, and
`discard` a table that nothing reads any more.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only for a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="issueloom-"))
        current = context.getCheckpointDir()
    return current


def run_folder(spark: SparkSession) -> str:
    """Where the tables of this session are."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables of this session. Call it when all results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `durable` or `counted` returned. All that was made from them must be written itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside are removed when each ends, not when the driver collects its garbage."""
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, was)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the checkpoint folder and return a reader of what was written."""
    return counted(df, name)[0]


def counted(df: DataFrame, name: str, measure: Column | None = None) -> tuple[DataFrame, int]:
    """As `durable`, with the number of rows, or another sum, observed while they are written."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    seen = Observation(f"size-of-{name}")
    size = (F.count(F.lit(1)) if measure is None else measure).alias("size")
    with _shuffles_removed(spark):  # the table is read from now on, so they are read no more
        df.observe(seen, size).write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path), seen.get["size"] or 0
