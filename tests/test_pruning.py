"""Steps that leave out rows early: what they leave out, and that the result is the same."""

import random
import re
from datetime import datetime

import pytest
from make import landed_issue
from pyspark.sql import functions as F

from issueloom.operators.bloom import key_filter, maybe_in
from issueloom.operators.filters import lookback_filter
from issueloom.operators.reactions import attach_reactions
from issueloom.operators.report import last_per_key
from issueloom.plans.triage import first_issues, kept_issues, landed_issues
from issueloom.sources.landing import repo_list
from issueloom.sources.sinks import write_report


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def pages(spark):
    import json

    rng = random.Random(3)
    rows = []
    for repo, count in (("o/a", 17), ("o/b", 3), ("o/c", 40)):
        for page in range(1, count + 1):
            issues = [landed_issue(100 * page + i) for i in range(rng.randrange(5))]
            rows.append((repo, page, json.dumps(issues)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "repo string, page long, body string").cache()


@pytest.mark.parametrize("per_repo", [False, True])
@pytest.mark.parametrize(("limit", "wave"), [(1, 1), (30, 2), (10**6, 9)])
def test_waves_keep_what_parsing_all_pages_keeps(spark, pages, per_repo, limit, wave):
    repos = repo_list(spark, ["o/c", "o/none", "o/a", "o/b", "o/a"])
    find = lambda span: landed_issues(repos, pages, span=span)
    everything = sorted((r.repo_pos, r.page, r.pos, r.number) for r in find(None).collect())
    spans = []

    def watched(span):
        spans.append(sorted(map(tuple, span.collect())))
        return find(span)

    found = first_issues(repos, pages, watched, limit, per_repo, wave)
    places = [(r.repo_pos, r.page, r.pos, r.number) for r in found.collect()]
    assert len(places) == len(set(places)) and set(places) <= set(everything)
    cover = [(place, page) for span in spans for place, a, b in span for page in range(a, b + 1)]
    assert len(cover) == len(set(cover))
    if per_repo:
        want = [r for place in range(5) for r in [x for x in everything if x[0] == place][:limit]]
    else:
        want = everything[:limit]
    kept = kept_issues(repos, pages, find, limit, per_repo)
    assert sorted((r.repo_pos, r.page, r.pos, r.number) for r in kept.collect()) == want
    assert set(want) <= set(places)
    if limit == 1 and wave == 1:
        assert len(cover) < 25


def test_pages_are_cut_before_they_are_parsed(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages")
    span = spark.createDataFrame([(0, 2, 3)], "repo_pos int, first_page long, last_page long")
    found = landed_issues(repo_list(spark, ["o/a"]), spark.read.parquet(f"{tmp_path}/pages"), span=span)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("first_page")  # a plan is printed from its result down
    assert {r.page for r in found.select("page").collect()} <= {2, 3}


def test_the_earliest_cutoff_reaches_the_scan(spark, tmp_path):
    rows = [(f"o/{i % 3}", i, datetime(2020, 1, 1 + i % 28)) for i in range(60)]
    spark.createDataFrame(rows, "repo string, number long, updated_at timestamp").write.parquet(f"{tmp_path}/issues")
    issues = spark.read.parquet(f"{tmp_path}/issues")
    given = spark.createDataFrame([("o/0", "5d"), ("o/1", "4y"), ("o/1", "1d")], "repo string, since string")
    kept = lookback_filter(issues, given, datetime(2022, 1, 10))
    assert re.search(r"PushedFilters: [^\n]*GreaterThanOrEqual\(updated_at", plan_of(kept))
    assert {r.repo for r in kept.collect()} == {"o/1", "o/2"}
    endless = spark.createDataFrame([("o/0", "9999999d")], "repo string, since string")
    assert lookback_filter(issues, endless, datetime(2022, 1, 10)).filter("repo = 'o/0'").count() == 20


def test_a_filter_prunes_reactions_beyond_the_bound_of_keys(spark):
    issues = spark.range(0, 400_000, 2).select(F.concat(F.lit("o/"), F.col("id") % 3).alias("repo"), F.col("id").alias("number"))
    reactions = spark.range(1_200_000).select(
        F.concat(F.lit("o/"), (F.col("id") % 400_000) % 3).alias("repo"), (F.col("id") % 400_000).alias("number"), F.lit("heart").alias("content")
    )
    let = maybe_in(reactions, key_filter(issues, ["repo", "number"]), ["repo", "number"])
    passed = let.count()
    assert 600_000 <= passed < 640_000
    assert let.join(issues, ["repo", "number"], "left_semi").count() == 600_000
    counted = attach_reactions(issues, reactions, issues_limited=True)
    assert "_bitmap" in plan_of(counted)
    assert counted.agg(F.count(F.lit(1)), F.sum("reactions_total"), F.min("reactions_positive")).first()[:] == (200_000, 600_000, 3)
    assert maybe_in(reactions, key_filter(issues.limit(0), ["repo", "number"]), ["repo", "number"]).count() == 0
    few = key_filter(issues, ["repo", "number"], max_blocks=1)
    assert maybe_in(reactions, few, ["repo", "number"]).join(issues, ["repo", "number"], "left_semi").count() == 600_000


def test_last_rows_are_found_on_narrow_rows(spark):
    rows = [("o/a", 1, 0, 3, "x" * 9), ("o/a", 1, 0, 4, "last"), ("o/a", 1, -1, 9, "before"), ("o/a", 2, None, 5, "null"), ("o/a", 2, -(2**62), -5, "low")]
    rows += [(None, None, 1, 1, "no key"), (None, None, 0, 2, "no key before"), ("o/b", 7, 2, 2, "same"), ("o/b", 7, 2, 2, "same")]
    rows += [("o/hot", 1, n, 0, f"t{n}") for n in range(500)]
    df = spark.createDataFrame(rows, "repo string, issue_id long, batch_id long, pos int, title string").repartition(5)
    last = last_per_key(df, ["repo", "issue_id"], ["batch_id", "pos"])
    assert last.columns == df.columns
    got = sorted((r.repo or "", r.issue_id or 0, r.title) for r in last.collect())
    assert got == [("", 0, "no key"), ("o/a", 1, "last"), ("o/a", 2, "low"), ("o/b", 7, "same"), ("o/hot", 1, "t499")]
    assert "SortAggregate" not in plan_of(last)


def test_a_report_of_many_parts_becomes_one_file(spark, tmp_path):
    lines = spark.range(20_000).select(F.lit(1).alias("section"), (19_999 - F.col("id")).alias("rank"), F.concat(F.lit("línea "), 19_999 - F.col("id")).alias("line"))
    path = tmp_path / "report"
    write_report(lines.repartition(7), str(path), single_file=True)
    assert (path / "part-00000.txt").read_text() == "".join(f"línea {n}\n" for n in range(20_000))
    assert [p.name for p in path.glob("part-*")] == ["part-00000.txt"]
    write_report(lines.limit(0), str(path), single_file=True)
    assert (path / "part-00000.txt").read_text() == ""
