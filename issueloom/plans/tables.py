"""Bindings of the test tables: each is one projection of them, the same as in the oracles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2001, 8, 1)
UNKNOWN = 1_000_000_000


# Schemas of the test tables that are read here.
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


REPO = "concat('acme/r', o_custkey % 10) AS repo"


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS number",
        REPO,
        "cast(o_custkey % 10 AS int) AS repo_pos",
        "o_orderkey div 100 AS page",
        "cast(o_orderkey % 100 AS int) AS pos",
        "concat('Order | ', o_orderkey) AS title",
        "o_orderpriority AS body",
        "CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state",
        "o_orderstatus = 'P' AS is_pr",
        "o_orderdate AS created_at",
        "o_orderdate AS updated_at",
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS created_text",
        "concat('https://x/', o_orderkey) AS html_url",
        "o_totalprice AS score",
        "0L AS comments",
    )


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).select("repo_pos", "repo").distinct()


def lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text per repository, but none for repository 8, and a second, longer one for repository 7."""
    text = F.element_at(
        F.array(*[F.lit(t) for t in ("2y", "6m", "30d", " 1Y ", "bad")]), F.col("repo_pos") % 5 + 1
    )
    given = repos(spark, sf_dir).filter("repo_pos <> 8").select("repo", "repo_pos", text.alias("since"))
    again = given.filter("repo_pos = 7").withColumn("since", F.lit("6m"))
    return given.unionByName(again).drop("repo_pos")


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS number",
        "l_linenumber",
        "CASE concat(l_returnflag, l_linestatus) WHEN 'RO' THEN '+1' WHEN 'RF' THEN 'heart' WHEN 'AO' THEN 'rocket' "
        "WHEN 'NF' THEN 'eyes' WHEN 'AF' THEN 'confused' ELSE '-1' END AS content",
    )
    keys = issues(spark, sf_dir).select("number", "repo")
    return lines.join(keys, "number").select("repo", "number", "l_linenumber", "content")


def reaction_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reaction arrays of up to 100 reactions each."""
    item = F.struct("l_linenumber", F.concat(F.lit('{"content":"'), "content", F.lit('"}')).alias("json"))
    return (
        reactions(spark, sf_dir)
        .withColumn("part", F.expr("l_linenumber div 100"))
        .groupBy("repo", "number", "part")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select(
            "repo",
            "number",
            F.concat(F.lit("["), F.array_join("items.json", ","), F.lit("]")).alias("body"),
        )
    )


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        REPO,
        "0L AS batch_id",
        "o_orderkey AS pos",
        "o_orderkey AS issue_id",
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'P0' WHEN '2' THEN 'P1' WHEN '3' THEN 'P2' "
        "WHEN '5' THEN 'P9' END AS priority",
        "o_orderpriority AS reasoning",
    )


def priority_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several priorities per issue, one per line item. Rows of one position are equal."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS issue_id",
        "l_linenumber * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS pos",
        "concat('P', l_linenumber) AS priority",
        "l_returnflag AS reasoning",
    )
    keys = issues(spark, sf_dir).selectExpr("number AS issue_id", "repo")
    return lines.join(keys, "issue_id").selectExpr(
        "repo", "0L AS batch_id", "pos", "issue_id", "priority", "reasoning"
    )


def urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One urgent list per landed page; every seventh id is unknown."""
    return table(spark, sf_dir, "orders").selectExpr(
        REPO,
        "o_orderkey div 100 AS batch_id",
        "cast(o_orderkey % 100 AS int) AS pos",
        f"o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN {UNKNOWN}L ELSE 0L END AS issue_id",
    )


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of neighbouring issues of a repository; every 13th id is unknown."""
    return table(spark, sf_dir, "orders").selectExpr(
        REPO,
        "0L AS batch_id",
        "o_orderkey div 40 AS group_pos",
        "cast(o_orderkey % 40 AS int) AS member_pos",
        f"o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN {UNKNOWN}L ELSE 0L END AS issue_id",
    )


def issue_json(reshaped: bool = False) -> Column:
    """An issue of `issues` as JSON, with the odd shapes that occur in the wild.

    `reshaped` also turns some numbers into texts, as a raw issue of unknown origin may have them.
    """
    number = "number"
    if reshaped:
        number = """CASE WHEN number % 64 = 5 THEN '"n/a"' WHEN number % 8 = 3 THEN concat('"', number, '"')
          ELSE cast(number AS string) END"""
    return F.expr(f"""concat(
      '{{"number":', {number}, ',"title":"', title, '","body":"', body, '","labels":',
      CASE WHEN number % 10 = 7 THEN 'null' WHEN number % 10 = 8 THEN '[]'
           ELSE concat('[{{"name":"', body, '"}},"', state, '",{{"name":null}},7,null]') END,
      CASE WHEN number % 4 = 0 THEN '' WHEN number % 16 = 1 THEN ',"comments":null'
           ELSE concat(',"comments":', number % 9) END,
      ',"created_at":"', created_text, '","updated_at":"', created_text, '","state":"', state,
      '","html_url":"', html_url, '"',
      CASE WHEN NOT is_pr THEN '' WHEN number % 2 = 0 THEN ',"pull_request":null'
           ELSE ',"pull_request":{{"url":"x"}}' END,
      ',"reactions":{{"url":"u","total_count":', number % 5 + number % 3, ',"+1":', number % 5,
      ',"heart":', number % 3, '}}',
      CASE WHEN number % 6 = 0 THEN concat(',"reactions_total":', number % 4, ',"reactions_positive":2')
           ELSE '' END,
      '}}')""")


def pages(spark: SparkSession, sf_dir: str, reshaped: bool = False) -> DataFrame:
    """Landed pages. A page number covers 100 order keys, so a page has at most 100 issues."""
    item = F.struct("pos", issue_json(reshaped).alias("json"))
    return (
        issues(spark, sf_dir)
        .groupBy("repo", "page")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select(
            "repo", "page", F.concat(F.lit("["), F.array_join("items.json", ","), F.lit("]")).alias("body")
        )
    )


def broken_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages of which some are cut off, objects or missing, or hold odd elements and numbers."""
    body = """CASE page % 10 WHEN 3 THEN substring(body, 1, 40) WHEN 4 THEN '{"message":"gone"}' WHEN 5 THEN NULL
      WHEN 6 THEN concat('[7,null,', substring(body, 2)) ELSE body END"""
    return pages(spark, sf_dir, reshaped=True).withColumn("body", F.expr(body))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as issues. A file of few row groups is spread over the cores before its texts are worked on.

    A scan that already has a partition per core is left as it is.
    """
    scan = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS number",
        "source AS repo",
        "doc_id div 100 AS page",
        "cast(doc_id % 100 AS int) AS pos",
        "substring_index(text, '\n', 1) AS title",
        "text AS body",
    )
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(cores, "number") if scan.rdd.getNumPartitions() < cores else scan


def scored(spark: SparkSession, sf_dir: str, labelled_only: bool = True) -> DataFrame:
    """Classified and scored documents; unlabelled ones have no category, and some rows are invalid."""
    marks = table(spark, sf_dir, "labels")
    joined = table(spark, sf_dir, "documents").join(marks, "doc_id", "inner" if labelled_only else "left")
    return joined.selectExpr(
        "doc_id AS number",
        "source AS repo",
        "CASE WHEN toxic = 1 THEN 'security' WHEN quality = 0 THEN 'bug' WHEN quality = 1 THEN 'feature' ELSE '' END "
        "AS category",
        "CASE lang WHEN 'en' THEN 'P0' WHEN 'fr' THEN 'P1' WHEN 'de' THEN 'P9' END AS priority_level",
        "CASE WHEN n_chars % 10 <> 0 THEN cast(n_chars AS double) END AS score",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers in the shapes that occur, one per landed page: sound, cut off, not an object, missing."""
    entry = F.expr("""concat(
      '{"issue_id":', CASE WHEN number % 17 = 0 THEN concat('"', number, '"') ELSE cast(number AS string) END,
      CASE WHEN number % 5 = 4 THEN '' ELSE concat(',"priority":"P', number % 5, '"') END,
      ',"reasoning":"r ', number, '"}')""")
    items = F.sort_array(F.collect_list(F.struct("pos", entry.alias("entry"), "number")))
    body = """concat('{"priorities":[', array_join(items.entry, ','), '],"duplicates":[[',
      array_join(cast(items.number AS array<string>), ','), '],[]],"top_urgent_issues":[',
      array_join(cast(reverse(items.number) AS array<string>), ','), ']}')"""
    return (
        issues(spark, sf_dir)
        .groupBy("repo", "page")
        .agg(items.alias("items"))
        .withColumn("body", F.expr(body))
        .selectExpr(
            "repo",
            "page AS batch_id",
            "CASE page % 10 WHEN 3 THEN substring(body, 1, 40) WHEN 4 THEN concat('[', body, ']') "
            "WHEN 5 THEN NULL WHEN 6 THEN 'Invalid JSON' ELSE body END AS response",
        )
    )


def answers_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose urgent lists name issues by texts, which are no ids: `"#12"`, or the number in quotes."""
    name = F.concat(F.lit('"'), F.when(F.col("number") % 2 == 0, "#").otherwise(""), F.col("number").cast("string"), F.lit('"'))
    listed = F.array_join(F.collect_list(name), ",")
    body = F.concat(F.lit('{"top_urgent_issues":['), listed, F.lit("]}"))
    return issues(spark, sf_dir).groupBy("repo", F.col("page").alias("batch_id")).agg(body.alias("response"))
