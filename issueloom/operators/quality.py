"""Row checks. A checked table carries a `reason` column, null for accepted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issueloom.fixed import DEFAULT_CATEGORIES, PRIORITY_LEVELS
from issueloom.functions.text import is_blank


def split_rejects(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without the `reason` column, and rejected rows with it."""
    accepted = checked.filter(F.col("reason").isNull()).drop("reason")
    return accepted, checked.filter(F.col("reason").isNotNull())


def require_valid(checked: DataFrame) -> DataFrame:
    """Strict form: the job fails on the first rejected row."""
    failing = F.col("reason").isNotNull()
    return checked.filter(
        F.when(failing, F.raise_error(F.col("reason")).isNotNull()).otherwise(F.lit(True))
    ).drop("reason")


def validate_scored(df: DataFrame, with_score: bool = True) -> DataFrame:
    """Check priority level, category and score. `with_score=False` checks a classification."""
    reason = F.when(
        F.col("priority_level").isNull() | ~F.col("priority_level").isin(PRIORITY_LEVELS),
        F.concat(F.lit("unknown priority level "), F.coalesce("priority_level", F.lit("(null)"))),
    ).when(F.coalesce(F.col("category"), F.lit("")) == "", F.lit("no category"))
    if with_score:
        reason = reason.when(F.col("score").isNull(), F.lit("no score"))
    return df.withColumn("reason", reason)


def vocabulary_rejects(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value cannot enter a vocabulary."""
    return df.filter(is_blank(value)).withColumn("reason", F.lit("blank value"))


def category_vocabulary(spark: SparkSession, categories: list[str] | None = None) -> DataFrame:
    """The categories `(value, pos)` to sort issues into, each once; the default ones when none are given."""
    given = DEFAULT_CATEGORIES if categories is None else categories
    rows = spark.createDataFrame([(name, pos) for pos, name in enumerate(given)], "value string, pos int")
    return first_seen_distinct(rows, "value", "pos")


def first_seen_distinct(df: DataFrame, value: str, order: str, strict: bool = False) -> DataFrame:
    """Distinct values `(value, pos)` in first-seen order; the job fails when no value remains.

    Null and blank values are left to `vocabulary_rejects`; with `strict` they fail the job.
    """
    blank = is_blank(value)
    keep: Column = ~blank
    if strict:
        keep = F.when(blank, F.raise_error(F.lit("blank value")).isNotNull()).otherwise(
            F.lit(True)
        )
    kept = df.filter(keep).select(F.col(value).alias("value"), F.col(order).alias("pos"))
    found = kept.groupBy("value").agg(F.min("pos").alias("pos"))
    empty = kept.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    guard = empty.select(
        F.raise_error(F.lit("no values remain")).cast("string").alias("value"),
        F.lit(None).cast(found.schema["pos"].dataType).alias("pos"),
    )
    return found.unionByName(guard).orderBy("pos")
