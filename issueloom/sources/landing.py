"""Readers of landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issueloom import schemas


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Pages from one JSON file each, in folders `repo=<owner%2Fname>/page=<n>/`.

    A filter on `repo` or `page` prunes folders. For large landings prefer `read_page_table`, as one file
    per page costs one open per page.
    """
    files = spark.read.schema("value string, repo string, page long").text(path, wholetext=True)
    return files.select("repo", "page", F.col("value").alias("body"))


def read_page_table(spark: SparkSession, path: str) -> DataFrame:
    """Pages compacted into parquet `(repo, page, body)`, partitioned by `repo` or not."""
    return spark.read.schema(schemas.PAGE).parquet(path)


def read_reaction_files(spark: SparkSession, path: str) -> DataFrame:
    """Reaction arrays from JSON files in folders `repo=<owner%2Fname>/number=<n>/`."""
    files = spark.read.schema("value string, repo string, number long").text(path, wholetext=True)
    return files.select("repo", "number", F.col("value").alias("body"))


def repo_list(spark: SparkSession, repos: list[str]) -> DataFrame:
    """The ordered list of repositories as a table."""
    if not repos:
        raise ValueError("the list of repositories is empty")
    return spark.createDataFrame(list(enumerate(repos)), schemas.REPO_LIST)
