"""Running sums over an ordered table without putting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issueloom.operators.durable import discard, durable


def exclusive_sums(
    df: DataFrame, key: list[str], order: str, values: list[str], parts: int | None = None
) -> DataFrame:
    """Add `before_<value>`: the sum of `value` over the rows of the same key with a smaller `order`.

    `df` has one row per `(key, order)`. Its rows are dealt to ranges of `(key, order)` of about equal
    numbers of rows, however sparse the order is, and written with the number of their range. The sum is
    taken inside the ranges, and over the totals of the ranges of a key, of which there are as many as
    partitions. So no task holds a key, even if one key (or, with no key, the table) holds all rows.
    """
    columns = [*key, order]
    ranged = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    spans = durable(ranged.withColumn("_span", F.spark_partition_id()), "ordered")
    totals = spans.groupBy(*key, "_span").agg(*[F.sum(v).alias(f"_span_{v}") for v in values])
    over_spans = (
        Window.partitionBy(*key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *key,
        "_span",
        *[F.coalesce(F.sum(f"_span_{v}").over(over_spans), F.lit(0)).alias(f"_off_{v}") for v in values],
    )
    in_span = (
        Window.partitionBy(*key, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        spans.join(offsets, [*key, "_span"])
        .withColumns(
            {
                f"before_{v}": F.col(f"_off_{v}") + F.coalesce(F.sum(v).over(in_span), F.lit(0))
                for v in values
            }
        )
        .drop("_span", *[f"_off_{v}" for v in values])
    )


def dense_numbers(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Add `name`: the place of each row, from 0, in the order of its columns; a written table.

    Rows are dealt to ranges of about equal size, numbered inside them, and moved by the sizes of the ranges before.
    """
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    spans = durable(ranged.withColumn("_span", F.spark_partition_id()), "ranges")
    sizes = spans.groupBy("_span").agg(F.count(F.lit(1)).alias("_rows"))
    # A row per partition, so one task holds them all.
    ahead = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_span", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_span").orderBy(*order)) - 1
    numbered = spans.withColumn(name, inside).join(F.broadcast(before), "_span")
    written = durable(numbered.withColumn(name, F.col(name) + F.col("_before")).drop("_span", "_before"), "numbered")
    discard(spans)
    return written
