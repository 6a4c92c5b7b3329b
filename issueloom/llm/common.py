"""What several operators share: reading tables, spare column names, exact ranks, batch helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spare_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores in front until no column of `df` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def map_rows(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]]
) -> DataFrame:
    """`mapInArrow` with a function that `make` builds once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)


def text_column(
    make: Callable[[], Callable[[list[str]], list]], kind: str
):
    """A column function of a text column; `make` builds the function of a block of texts once per task."""

    def run(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        step = make()
        for block in blocks:
            yield pd.Series(step(block.tolist()))

    run.__annotations__ = {"blocks": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def ranked(rows: DataFrame, group: str, part: str, order: list[str], name: str) -> DataFrame:
    """Add `name`: the exact place, from 0, of a row in its group, in the order of (part, `order`).

    `rows` is a written table, so `part`, the task that wrote a row, doesn't change when it is read again.
    No group meets in one task, even if it holds all rows: places are taken inside (group, part), which is
    never larger than one input split, and moved by the counts of the parts before it.
    """
    counts = rows.groupBy(group, part).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(group, part, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, part).orderBy(*order)
    return (
        rows.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(before, [group, part])
        .withColumn(name, F.col("_inside") + F.col("_before"))
        .drop("_inside", "_before")
    )
