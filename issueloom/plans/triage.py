"""The whole run: landed pages to report lines."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueloom.fixed import DEFAULT_LIMIT
from issueloom.operators.durable import counted, discard, durable
from issueloom.operators.filters import lookback_filter, open_only, updated_since
from issueloom.operators.groups import duplicate_groups, group_links
from issueloom.operators.ingest import (
    exclude_pull_requests,
    explode_pages,
    normalize_issue,
    page_rejects,
    union_repos,
)
from issueloom.operators.limits import limit_global, limit_per_repo
from issueloom.operators.model import (
    apply_model_once,
    new_ledger,
    pack_prompts,
    parse_analysis,
    render_prompt_block,
    with_parsed,
)
from issueloom.operators.reactions import attach_reactions
from issueloom.operators.report import (
    KEY,
    duplicate_lines,
    duplicate_members,
    enrich_priorities,
    group_lines,
    last_per_key,
    report_summary,
    top_urgent,
)
from issueloom.operators.running import exclusive_sums
from issueloom.operators.similar import similar_groups
from issueloom.operators.skew import lookup_join
from issueloom.plans.report import report_lines

#: Issues that a landed page holds at most, and how many times the pages so far a wave has.
PAGE_ISSUES = 100
GROWTH = 3


class Triage(NamedTuple):
    """The report lines and the tables behind them; None, but for the rejects, when no issue was found."""

    lines: DataFrame | None
    issues: DataFrame | None = None
    priorities: DataFrame | None = None
    duplicates: DataFrame | None = None
    summary: DataFrame | None = None
    rejects: DataFrame | None = None


def landed_issues(
    repos: DataFrame,
    pages: DataFrame,
    as_of: datetime | None = None,
    lookback: DataFrame | None = None,
    since: datetime | None = None,
    span: DataFrame | None = None,
) -> DataFrame:
    """Open issues of the listed repositories, without pull requests, updated recently enough.

    Elements whose number cannot be read are left to `page_rejects`. `span (repo_pos, first_page, last_page)`
    leaves out all other pages before they are parsed; its outermost pages reach the scan as plain predicates.
    """
    if span is None:
        listed = union_repos(repos, pages)
    else:
        first, last = span.agg(F.min("first_page"), F.max("last_page")).first()
        near = pages.filter(F.col("page").between(first, last)) if first is not None else pages.limit(0)
        listed = union_repos(repos.join(span, "repo_pos"), near).filter("page BETWEEN first_page AND last_page")
        listed = listed.drop("first_page", "last_page")
    raw = exclude_pull_requests(explode_pages(listed))
    readable = normalize_issue(raw).filter(F.col("number").isNotNull())
    issues = updated_since(open_only(readable), since)
    if lookback is None:
        return issues
    if as_of is None:
        raise ValueError("a lookback needs as_of")
    return lookback_filter(issues, lookback, as_of)


def page_ranks(repos: DataFrame, pages: DataFrame, per_repo: bool) -> DataFrame:
    """(repo_pos, page, before_n): how many pages of the listed repositories, or of the page's own, come before.

    Only the names of pages are read, none is parsed.
    """
    named = union_repos(repos, pages.select("repo", "page")).groupBy("repo_pos", "page").agg(F.lit(1).alias("n"))
    if per_repo:
        return durable(exclusive_sums(named, ["repo_pos"], "page", ["n"]).drop("n"), "page-ranks")
    placed = named.withColumn("at", F.struct("repo_pos", "page"))
    return durable(exclusive_sums(placed, [], "at", ["n"]).drop("n", "at"), "page-ranks")


def first_issues(
    repos: DataFrame,
    pages: DataFrame,
    find: Callable[[DataFrame], DataFrame],
    limit: int,
    per_repo: bool,
    wave: int | None = None,
) -> DataFrame:
    """Found issues of the first pages, as many pages as hold the limit; a written table.

    Pages are parsed in waves, in arrival order, and each page once. A wave takes the pages next in line, or
    those of the repositories that are still below their limit. The first one has `wave` pages, by default as
    many as would hold the limit if a quarter of the issues is kept. Later ones have what the issues per page so
    far call for and half as much again, at least GROWTH times the pages so far. `find` gives the issues of the
    pages in a span.
    """
    ranks = page_ranks(repos, pages, per_repo)
    lines = ranks.select("repo_pos").distinct().count() if per_repo else 1
    upto, done = 0, wave or -(-4 * limit // PAGE_ISSUES)
    found: DataFrame | None = None
    total = 0
    open_pages = ranks
    while True:
        span = open_pages.filter((F.col("before_n") >= upto) & (F.col("before_n") < done)).groupBy("repo_pos").agg(
            F.min("page").alias("first_page"), F.max("page").alias("last_page")
        )
        part, rows = counted(find(durable(span, "page-span")), "found")
        total += rows
        found = part if found is None else found.unionByName(part)
        if per_repo:
            full = durable(found.groupBy("repo_pos").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit), "full")
            open_pages = lookup_join(ranks, full.select("repo_pos", F.lit(True).alias("full")), ["repo_pos"], "left", ["page"])
            open_pages = open_pages.filter("full IS NULL").drop("full")
        elif total >= limit:
            return found
        if open_pages.filter(F.col("before_n") >= done).isEmpty():
            return found
        called_for = -(-3 * limit * lines * done // (2 * max(total, 1))) if total else 0
        upto, done = done, max(done * (1 + GROWTH), called_for)


def kept_issues(
    repos: DataFrame, pages: DataFrame, find: Callable[[DataFrame | None], DataFrame], limit: int | None, per_repo: bool
) -> DataFrame:
    """The issues that `find` finds up to the limit, with their texts, written once.

    With a limit, pages behind the one that fills it are not parsed.
    """
    if limit is None:
        return durable(find(None), "kept")
    found = first_issues(repos, pages, find, limit, per_repo)
    return durable(limit_per_repo(found, limit) if per_repo else limit_global(found, limit), "kept")


def rejected(landed: DataFrame, answers: DataFrame) -> DataFrame:
    """Unreadable pages, elements and answers in one table, with a reason."""
    columns = {"repo": "string", "page": "long", "batch_id": "long", "pos": "int", "reason": "string"}

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(
            *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
        )

    return shaped(landed).unionByName(shaped(answers))


def triage_report(
    repos: DataFrame,
    pages: DataFrame,
    reactions: DataFrame,
    make_model: Callable[[], Callable[[str], str | None]],
    *,
    preamble: str,
    as_of: datetime | None = None,
    lookback: DataFrame | None = None,
    since: datetime | None = None,
    limit: int | None = DEFAULT_LIMIT,
    per_repo: bool = False,
    max_issues: int = 100,
    max_chars: int = 100_000,
    prompts_per_task: int = 100,
    similarity: tuple[int, int] | None = None,
    header: list[str] | None = None,
    strict: bool = False,
    ledger: str | None = None,
) -> Triage:
    """Read, limit, count reactions, ask the model, parse its answers, and lay out the report.

    The same rules hold for one prompt and for many. Urgent lists are merged entry by entry. The model's
    duplicate groups are a bullet each. With `similarity`, a fraction, groups of all prompts are joined where
    they overlap, and with near-duplicates that are found across prompts.

    Unreadable pages, elements and answers are in `rejects`; with `strict` a bad page fails the run. Kept
    issues, prompts and answers are written to the checkpoint folder, so that pages are not parsed again
    and the model is asked once. A `ledger` folder keeps the answers for later runs: one that follows a run that
    failed asks only for what is missing.
    """
    bad_pages = page_rejects(pages.join(repos.select("repo").distinct(), "repo", "left_semi"))
    if strict and (bad := bad_pages.first()) is not None:
        raise ValueError(f"page {bad['page']} of {bad['repo']}: {bad['reason']}")
    # Small tables that every wave asks again.
    repos = durable(repos, "repos")
    lookback = None if lookback is None else durable(lookback, "lookback")
    find = lambda span: landed_issues(repos, pages, as_of, lookback, since, span)
    kept = kept_issues(repos, pages, find, limit, per_repo)
    if kept.isEmpty():
        return Triage(None, rejects=rejected(bad_pages, bad_pages.limit(0)))

    rendered = render_prompt_block(attach_reactions(kept, reactions, issues_limited=True))
    # Packing reads them twice, and reactions and the filter of their keys are worked on once.
    blocks = durable(rendered.select("repo", "page", "pos", "block"), "blocks")
    prompts = durable(pack_prompts(blocks, max_issues, max_chars, preamble), "prompts")
    discard(blocks)
    asked = apply_model_once(prompts, make_model, ledger or new_ledger(prompts.sparkSession), prompts_per_task)
    answers = durable(with_parsed(asked), "answers")
    places = repos.groupBy("repo").agg(F.min("repo_pos").alias("repo_pos"))
    analysis = parse_analysis(lookup_join(answers, places, ["repo"], "inner", spread=["batch_id"]))

    arrival = ["repo_pos", "page", "pos"]
    issues = last_per_key(kept.select(*KEY, "title", "html_url", *arrival), KEY, arrival)
    issues = durable(issues, "issues")
    # Few rows, written apart, so that the plan of the lines and the tasks that run side by side in it stay few.
    top = durable(top_urgent(analysis.urgent, analysis.priorities, issues), "top")
    if similarity is None:
        duplicates = duplicate_members(analysis.duplicates, issues)
        lines = duplicate_lines(analysis.groups, duplicates)
        names = analysis.groups.select("repo", "batch_id", "group_pos")
    else:
        links = group_links(analysis.duplicates)
        texts = last_per_key(kept.select(*KEY, "title", "body", *arrival), KEY, arrival)
        alike = similar_groups(texts, *similarity).selectExpr(
            "group_repo AS repo_a", "group_number AS number_a", "repo AS repo_b", "number AS number_b"
        )
        links = links.unionByName(alike)
        duplicates = duplicate_groups(links)
        lines = group_lines(duplicates, issues)
        names = duplicates.select("group_repo", "group_number")
    enriched = enrich_priorities(analysis.priorities, issues)
    summary = durable(report_summary(issues, analysis.priorities, names), "summary")
    return Triage(
        lines=report_lines(summary, top, enriched, lines, header),
        issues=issues,
        priorities=enriched,
        duplicates=duplicates,
        summary=summary,
        rejects=rejected(bad_pages, analysis.rejects),
    )
