"""One query per operator over the test tables. Oracles with the same names are in `oracles`."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issueloom.functions.json import array_field, label_names, whole_number
from issueloom.operators import filters, ingest, limits, model, quality, reactions, report, similar
from issueloom.operators.durable import durable
from issueloom.plans import tables
from issueloom.plans.report import report_lines as assemble
from issueloom.plans.standin import standin
from issueloom.plans.triage import triage_report as run_triage

SINCE = datetime(1996, 1, 1)
TALLY_LIMIT = 5_000
GLOBAL_LIMIT = 300
LARGE_LIMIT = 5_000
PER_REPO_LIMIT = 100
DOC_PROMPT = (20, 30_000)
ISSUE_PROMPT = (50, 5_000)
PREAMBLE = "Judge these issues.\n\n"
SIMILARITY = (4, 5)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def utc_text(column: str, name: str):
    """A timestamp as UTC text, whatever the time zone of the session."""
    return F.date_format(F.to_utc_timestamp(column, F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias(name)


def named_groups(members: DataFrame) -> DataFrame:
    return members.select("repo", "batch_id", "group_pos").distinct()


def joined_labels(column: str):
    return F.array_join(column, ",", "<null>").alias(column)


@query
def explode_pages(spark, sf):
    rows = ingest.explode_pages(tables.pages(spark, sf))
    raw = F.col("raw")
    return rows.select(
        "repo",
        "page",
        "pos",
        whole_number(raw, "$.number").alias("number"),
        F.try_variant_get(raw, "$.title", "string").alias("title"),
    )


@query
def page_rejects(spark, sf):
    return ingest.page_rejects(tables.broken_pages(spark, sf))


@query
def explode_reactions(spark, sf):
    return ingest.explode_reactions(tables.reaction_pages(spark, sf))


@query
def first_seen_distinct(spark, sf):
    return quality.first_seen_distinct(tables.docs(spark, sf), "title", "number")


@query
def report_lines(spark, sf):
    issues = tables.issues(spark, sf)
    priorities = tables.priorities(spark, sf)
    members = tables.duplicates(spark, sf)
    lines = assemble(
        report.report_summary(issues, priorities, members.select("repo", "batch_id", "group_pos")),
        report.top_urgent(tables.urgent(spark, sf), priorities, issues),
        report.enrich_priorities(priorities, issues),
        report.duplicate_lines(named_groups(members), report.duplicate_members(members, issues)),
    )
    return lines.select("section", "rank", "line")


@query
def exclude_pull_requests(spark, sf):
    kept = ingest.exclude_pull_requests(ingest.explode_pages(tables.pages(spark, sf)))
    return kept.select("repo", "page", whole_number(F.col("raw"), "$.number").alias("number"))


@query
def open_only(spark, sf):
    return filters.open_only(tables.issues(spark, sf)).select("repo", "number", "title", "state")


@query
def updated_since(spark, sf):
    return filters.updated_since(tables.issues(spark, sf), SINCE).select("repo", "number", "created_text")


@query
def lookback_filter(spark, sf):
    kept = filters.lookback_filter(tables.issues(spark, sf), tables.lookback(spark, sf), tables.AS_OF)
    return kept.select("repo", "number", "created_text")


@query
def normalize_issue(spark, sf):
    rows = ingest.normalize_issue(ingest.explode_pages(tables.pages(spark, sf)))
    return rows.select(
        "repo", "page", "number", "title", "body", joined_labels("labels"), "comments",
        utc_text("created_at", "created"),
        utc_text("updated_at", "updated"),
        "state", "html_url",
    )


@query
def issue_from_raw(spark, sf):
    rows = ingest.issue_from_raw(ingest.explode_pages(tables.pages(spark, sf, reshaped=True)))
    return rows.select(
        "repo", "page", "number", "title", "body", joined_labels("labels"), "comments",
        utc_text("created_at", "created"),
        "state", "html_url", "reactions_total", "reactions_positive", "reason",
    )


@query
def label_names_of_issues(spark, sf):
    labels = array_field(F.col("raw"), "$.labels")
    rows = ingest.explode_pages(tables.pages(spark, sf)).select(
        whole_number(F.col("raw"), "$.number").alias("number"),
        label_names(labels).alias("names"),
        label_names(labels, objects_only=True).alias("listed"),
    )
    return rows.select("number", joined_labels("names"), joined_labels("listed"))


QUERIES["label_names"] = QUERIES.pop("label_names_of_issues")


@query
def split_repo(spark, sf):
    n = F.col("number")
    written = (
        F.when(n % 3 == 0, F.col("repo"))
        .when(n % 3 == 1, F.concat("repo", F.lit("/x")))
        .otherwise(F.concat(F.lit("r"), n.cast("string")))
    )
    rows = tables.issues(spark, sf).select("number", written.alias("repo"))
    return ingest.split_repo(rows)


@query
def validate_scored(spark, sf):
    checked = quality.validate_scored(tables.scored(spark, sf, labelled_only=False))
    return checked.select("repo", "number", "category", "priority_level", "score", "reason")


@query
def attach_reactions(spark, sf):
    issues = tables.issues(spark, sf).select("repo", "number", "title")
    return reactions.attach_reactions(issues, tables.reactions(spark, sf))


@query
def enrich_priorities(spark, sf):
    issues = tables.issues(spark, sf).filter(~F.col("is_pr"))
    return report.enrich_priorities(tables.priorities(spark, sf), issues)


@query
def urgent_rows(spark, sf):
    return report.urgent_rows(
        tables.urgent(spark, sf), tables.priority_log(spark, sf), tables.issues(spark, sf)
    )


@query
def duplicate_members(spark, sf):
    return report.duplicate_members(tables.duplicates(spark, sf), tables.issues(spark, sf)).withColumn(
        "found", F.col("found").cast("int")
    )


@query
def reaction_counts(spark, sf):
    return reactions.reaction_counts(tables.reactions(spark, sf))


@query
def reaction_counts_from_summary(spark, sf):
    n = F.col("number")

    def entry(name: str, value):
        return F.create_map(F.lit(name), value.cast("long"))

    summary = F.map_concat(
        entry("total_count", n % 5 + n % 3),
        entry("+1", n % 5),
        F.when(n % 2 == 0, entry("heart", n % 3)).otherwise(F.create_map().cast("map<string,bigint>")),
        entry("confused", n % 4),
    )
    rows = tables.issues(spark, sf).select(
        "repo",
        "number",
        F.when(n % 9 != 0, summary).alias("reactions"),
        F.when(n % 7 == 0, n % 4).alias("reactions_total"),
        F.when(n % 11 == 0, n % 3).alias("reactions_positive"),
    )
    return reactions.reaction_counts_from_summary(rows).drop("reactions")


@query
def category_counts(spark, sf):
    return report.category_counts(tables.scored(spark, sf, labelled_only=False))


@query
def report_summary(spark, sf):
    groups_of = tables.duplicates(spark, sf).select("repo", "batch_id", "group_pos")
    return report.report_summary(tables.issues(spark, sf), tables.priorities(spark, sf), groups_of)


@query
def fetch_tally(spark, sf):
    issues = tables.issues(spark, sf).filter(~F.col("is_pr"))
    return limits.fetch_tally(tables.repos(spark, sf), issues, TALLY_LIMIT)


@query
def limit_global(spark, sf):
    issues = tables.issues(spark, sf).filter(~F.col("is_pr"))
    return limits.limit_global(issues, GLOBAL_LIMIT).select("repo_pos", "page", "pos", "number")


@query
def limit_global_none(spark, sf):
    issues = tables.issues(spark, sf).filter(~F.col("is_pr"))
    return limits.limit_global(issues, None).select("repo_pos", "page", "pos", "number")


@query
def limit_global_by_counts(spark, sf):
    issues = tables.issues(spark, sf).filter(~F.col("is_pr"))
    kept = limits.limit_global(issues, LARGE_LIMIT)
    return kept.select("repo_pos", "page", "pos", "number")


@query
def limit_per_repo(spark, sf):
    issues = tables.issues(spark, sf).filter(~F.col("is_pr"))
    kept = limits.limit_per_repo(issues, PER_REPO_LIMIT)
    return kept.select("repo", "page", "pos", "number", "title")


@query
def top_by_score(spark, sf):
    return report.top_by_score(tables.issues(spark, sf)).select("number", "repo", "title", "score")


@query
def sort_by_priority(spark, sf):
    return report.sort_by_priority(tables.priorities(spark, sf))


@query
def top_urgent_fallback(spark, sf):
    issues = tables.issues(spark, sf).filter(~F.col("is_pr"))
    no_list = model.parse_analysis(tables.answers_without_ids(spark, sf)).urgent
    return report.top_urgent_fallback(tables.priorities(spark, sf), issues, no_list)


@query
def last_per_key(spark, sf):
    return report.last_per_key(tables.priority_log(spark, sf), ["repo", "issue_id"], ["batch_id", "pos"])


@query
def union_repos(spark, sf):
    listed = tables.repos(spark, sf).filter("repo_pos <> 9")
    again = listed.filter("repo_pos % 3 = 0").withColumn("repo_pos", F.col("repo_pos") + 10)
    rows = ingest.union_repos(listed.unionByName(again), tables.pages(spark, sf))
    return rows.select("repo_pos", "repo", "page", F.length("body").cast("long").alias("chars"))


@query
def render_prompt_block(spark, sf):
    counted = reactions.attach_reactions(tables.issues(spark, sf), tables.reactions(spark, sf))
    return model.render_prompt_block(counted).select("repo", "number", "block")


@query
def report_rows(spark, sf):
    issues = tables.issues(spark, sf).filter(~F.col("is_pr"))
    return report.report_rows(report.enrich_priorities(tables.priorities(spark, sf), issues))


@query
def duplicate_lines(spark, sf):
    members = tables.duplicates(spark, sf)
    return report.duplicate_lines(
        named_groups(members), report.duplicate_members(members, tables.issues(spark, sf))
    )


@query
def parse_analysis(spark, sf):
    answers = durable(model.with_parsed(tables.answers(spark, sf)), "answers")
    parsed = model.parse_analysis(answers)
    columns = {
        "pos": "int", "member_pos": "int", "issue_id": "long", "priority": "string",
        "reasoning": "string", "reason": "string",
    }

    def rows(kind: str, df: DataFrame) -> DataFrame:
        df = df.withColumnRenamed("group_pos", "pos")
        return df.select(
            F.lit(kind).alias("kind"), "repo", "batch_id",
            *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()],
        )

    return (
        rows("priority", parsed.priorities)
        .unionByName(rows("group", parsed.groups))
        .unionByName(rows("duplicate", parsed.duplicates))
        .unionByName(rows("urgent", parsed.urgent))
        .unionByName(rows("reject", parsed.rejects))
    )


@query
def pack_prompts(spark, sf):
    rows = tables.docs(spark, sf).withColumns(
        {c: F.lit(None) for c in ("reactions_total", "reactions_positive", "comments", "created_text")}
    )
    return model.pack_prompts(model.render_prompt_block(rows), *DOC_PROMPT, PREAMBLE)


@query
def apply_model(spark, sf):
    issues = reactions.attach_reactions(tables.issues(spark, sf), tables.reactions(spark, sf))
    blocks = durable(model.render_prompt_block(issues).select("repo", "page", "pos", "block"), "blocks")
    prompts = durable(model.pack_prompts(blocks, *ISSUE_PROMPT, PREAMBLE), "prompts")
    return model.apply_model_once(prompts, standin(), model.new_ledger(spark))


@query
def similar_pairs(spark, sf):
    return similar.similar_pairs(tables.docs(spark, sf), *SIMILARITY)


@query
def duplicate_groups(spark, sf):
    return similar.similar_groups(tables.docs(spark, sf), *SIMILARITY)


@query
def similar_pairs_split(spark, sf):
    """As `similar_pairs`, with thresholds so low that keys are paired, cut into cells, and joins salted."""
    return similar.similar_pairs(tables.docs(spark, sf), *SIMILARITY, frequent=20, bucket_rows=20, hot_rows=500)


@query
def duplicate_groups_split(spark, sf):
    """As `duplicate_groups`, with thresholds so low that every skew path runs."""
    return similar.similar_groups(tables.docs(spark, sf), *SIMILARITY, frequent=20, bucket_rows=20, hot_rows=500)


@query
def triage_report(spark, sf):
    done = run_triage(
        tables.repos(spark, sf),
        tables.pages(spark, sf),
        tables.reactions(spark, sf),
        standin(),
        since=SINCE,
        preamble=PREAMBLE,
        limit=None,
        max_issues=ISSUE_PROMPT[0],
        max_chars=ISSUE_PROMPT[1],
    )
    return done.lines.select("section", "rank", "line")


@query
def triage_report_limited(spark, sf):
    """As `triage_report`, with a limit per repository, a lookback, and groups joined across prompts."""
    done = run_triage(
        tables.repos(spark, sf),
        tables.pages(spark, sf),
        tables.reactions(spark, sf),
        standin(),
        preamble=PREAMBLE,
        as_of=tables.AS_OF,
        lookback=tables.lookback(spark, sf),
        limit=PER_REPO_LIMIT,
        per_repo=True,
        max_issues=ISSUE_PROMPT[0],
        max_chars=ISSUE_PROMPT[1],
        similarity=(1, 1),
    )
    return done.lines.select("section", "rank", "line")
