"""Joins that stay balanced when one key holds a large share of the rows.

Hot keys are found from exact counts per key, combined on the map side. The counts only decide how rows are
spread, so results never depend on them. They are written to the checkpoint folder, so that both sides of a
join, and any retry, use the same salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueloom.operators.durable import counted

HOT_ROWS = 1_000_000
LOOKUP_ROWS = 100_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows `(_hash, _salts)` for all keys of `hot_rows` rows or more, at most rows / hot_rows of them."""
    counts = df.groupBy(F.xxhash64(*keys).alias("_hash")).agg(F.count(F.lit(1)).alias("_rows"))
    return _salted(counts.filter(F.col("_rows") >= hot_rows), hot_rows)


def _salted(counts: DataFrame, hot_rows: int) -> DataFrame:
    return counts.select("_hash", F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("int").alias("_salts"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    spread: list[str],
    hot_rows: int = HOT_ROWS,
    left_rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Inner or left join whose hot left keys are cut into salts of about `hot_rows` rows.

    `spread` names left columns that tell rows of one key apart. The salt is their hash, so a retried
    task gives the same salts. Right rows of a hot key are repeated once per salt; all others stay single.
    Without a hot key the join is a plain one. `left_rows`, if known, saves the search where it is below
    `hot_rows`. `counts (_hash, _rows)` of the hot keys, if known, saves the counting.
    """
    if left_rows is not None and left_rows < hot_rows:
        return left.join(right, keys, how)
    hot, found = counted(hot_keys(left, keys, hot_rows) if counts is None else _salted(counts, hot_rows), "hot-keys")
    if found == 0:
        return left.join(right, keys, how)
    salted_left = (
        left.withColumn("_hash", F.xxhash64(*keys))
        .join(hot, "_hash", "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int"))
        .drop("_hash", "_salts")
    )
    salted_right = (
        right.withColumn("_hash", F.xxhash64(*keys))
        .join(hot, "_hash", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_hash", "_salts")
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str,
    spread: list[str],
    max_rows: int = LOOKUP_ROWS,
) -> DataFrame:
    """Join to a table expected to be small. It is broadcast only after its size was counted.

    The count stops at `max_rows + 1`. A larger table is joined by `salted_join` instead.
    """
    if lookup.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(lookup), keys, how)
    return salted_join(left, lookup, keys, how, spread)
