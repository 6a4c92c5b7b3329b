import json
from datetime import datetime

import pytest

from issueloom.plans.triage import triage_report
from issueloom.sources.landing import repo_list
from issueloom.sources.sinks import in_report_order
from make import landed_issue

ASK = dict(preamble="Judge:\n")
SINCE = datetime(2021, 1, 1)


@pytest.fixture(scope="module")
def landed(spark):
    twin = dict(title="Cannot save", body="saving a file of more than two pages ends with a blank screen on my machine")
    a = [
        landed_issue(11, "o/a", **twin), landed_issue(12, "o/a"), landed_issue(13, "o/a", pull_request=None),
        landed_issue(14, "o/a", state="closed"), landed_issue(15, "o/a", updated_at="2020-01-01T00:00:00Z"),
        landed_issue(16, "o/a"),
    ]
    b = [landed_issue(11, "o/b"), landed_issue(17, "o/b", **twin)]
    pages = spark.createDataFrame(
        [("o/b", 1, json.dumps(b)), ("o/a", 1, json.dumps(a))], "repo string, page long, body string"
    )
    reactions = spark.createDataFrame([("o/a", 11, "+1"), ("o/a", 11, "-1")], "repo string, number long, content string")
    return pages, reactions


def lines_of(done):
    return [r.line for r in in_report_order(done.lines).collect()]


def fixed_answer(text):
    def make_model():
        return lambda prompt: text

    return make_model


def judge(**lists):
    """A model that rates odd numbers P0 and others P2, and answers with lists computed from the ids asked."""

    def make_model():
        def answer(prompt):
            ids = [int(x[4:]) for x in prompt.splitlines() if x.startswith("ID: ")]
            rated = [dict(issue_id=n, priority="P0" if n % 2 else "P2", reasoning=f"due to | {n}") for n in ids]
            return json.dumps(dict(priorities=rated) | {k: of(ids) for k, of in lists.items()})

        return answer

    return make_model


LISTS = dict(duplicates=lambda ids: [ids[:2], []], top_urgent_issues=lambda ids: ids[::-1])


def section(lines, title):
    start = lines.index(title) + 1
    end = next((i for i in range(start, len(lines)) if lines[i] == ""), len(lines))
    return lines[start:end]


def ids_of(lines):
    return [x.split("/o/")[1].split(")")[0] for x in lines if x.startswith("| [#")]


@pytest.mark.parametrize("max_issues", [100, 2, 1])
@pytest.mark.parametrize("repos", [["o/a"], ["o/a", "o/b"]])
def test_the_same_rules_hold_for_one_prompt_and_many(spark, landed, repos, max_issues):
    given = repo_list(spark, repos)
    done = triage_report(given, *landed, judge(**LISTS), since=SINCE, max_issues=max_issues, header=["# R"], **ASK)
    lines = lines_of(done)
    assert lines[:2] == ["# R", ""] and done.rejects.count() == 0
    asked = {"o/a": [11, 12, 16], "o/b": [11, 17]}
    prompts = [(r, ids[i : i + max_issues]) for r in repos for ids in [asked[r]] for i in range(0, len(ids), max_issues)]
    assert lines[2] == f"- Total Issues Analyzed: {sum(len(asked[r]) for r in repos)}"
    # Urgent: all first entries in the order of the prompts, then all second ones.
    entries = sorted((pos, place, f"{r}/{n}") for place, (r, ids) in enumerate(prompts) for pos, n in enumerate(ids[::-1]))
    assert ids_of(section(lines, "## Top 20 Urgent Issues")) == [x[2][2:] for x in entries]
    # Each group of each prompt is a bullet, also an empty one.
    bullets = section(lines, "## Potential Duplicate Issues")
    assert lines[6] == f"- Duplicate Groups: {len(bullets)}" and len(bullets) == 2 * len(prompts)
    assert bullets.count("- ") == len(prompts)
    assert [b.count("[#") for b in bullets if b != "- "] == [len(ids[:2]) for _, ids in prompts]


def test_table_is_sorted_and_escaped(spark, landed):
    done = triage_report(repo_list(spark, ["o/a"]), *landed, judge(), since=SINCE, **ASK)
    table = section(lines_of(done), "## All Issues (Sorted by Priority)")
    assert ids_of(table) == ["a/11", "a/12", "a/16"]
    assert table[2] == "| [#11](https://tracker/o/a/11) | Cannot save | P0 | due to \\| 11 |"
    assert ids_of(section(lines_of(done), "## Top 20 Urgent Issues")) == ["a/11", "a/12", "a/16"]


def test_similarity_joins_groups_across_prompts(spark, landed):
    done = triage_report(
        repo_list(spark, ["o/b", "o/a"]), *landed, judge(duplicates=lambda ids: [ids[:2]]), since=SINCE, similarity=(4, 5), **ASK
    )
    assert section(lines_of(done), "## Potential Duplicate Issues") == [
        "- [#11](https://tracker/o/a/11) - Cannot save",
        "  , [#12](https://tracker/o/a/12) - No. 12",
        "  , [#11](https://tracker/o/b/11) - No. 11",
        "  , [#17](https://tracker/o/b/17) - Cannot save",
    ]
    assert "- Duplicate Groups: 1" in lines_of(done)


@pytest.mark.parametrize("per_repo", [False, True])
def test_limits(spark, landed, per_repo):
    done = triage_report(
        repo_list(spark, ["o/a", "o/b"]), *landed, fixed_answer("not json"), limit=2, per_repo=per_repo, **ASK
    )
    assert done.issues.count() == (4 if per_repo else 2)
    lines = lines_of(done)
    assert lines.count("No issues found.") == 2 and lines[-1] == "No duplicates found."
    assert {r.reason for r in done.rejects.collect()} == {"answer is not valid JSON"}


def test_no_issues_ends_early_without_a_call(spark, landed):
    def make_model():
        raise AssertionError("must not be called")

    for done in (
        triage_report(repo_list(spark, ["o/none"]), *landed, make_model, **ASK),
        triage_report(repo_list(spark, ["o/a"]), *landed, make_model, since=datetime(2030, 1, 1), **ASK),
        triage_report(repo_list(spark, ["o/a"]), *landed, make_model, limit=0, **ASK),
    ):
        assert done.lines is None and done.rejects.count() == 0


def test_unreadable_pages_are_reported_or_fail_the_run(spark, landed):
    good = json.dumps([landed_issue(1), landed_issue("x"), 7])
    pages = spark.createDataFrame(
        [("o/a", 1, good), ("o/a", 2, good[:50]), ("o/a", 3, '{"message":"gone"}'), ("o/z", 1, "[")], "repo string, page long, body string"
    )
    done = triage_report(repo_list(spark, ["o/a"]), pages, landed[1], judge(), **ASK)
    assert [r.number for r in done.issues.collect()] == [1]
    assert {(r.page, r.pos, r.reason) for r in done.rejects.collect()} == {
        (1, 1, "number cannot be read"),
        (1, 2, "element is not an object"),
        (2, None, "page is not valid JSON"),
        (3, None, "page is not an array"),
    }
    with pytest.raises(ValueError, match="of o/a"):
        triage_report(repo_list(spark, ["o/a"]), pages, landed[1], judge(), strict=True, **ASK)


def test_lookback_per_repository(spark, landed):
    lookback = spark.createDataFrame([("o/a", "1y"), ("o/b", "1d")], "repo string, since string")
    done = triage_report(
        repo_list(spark, ["o/a", "o/b"]), *landed, fixed_answer("{}"), lookback=lookback, as_of=datetime(2022, 7, 1), **ASK
    )
    assert sorted((r.repo, r.number) for r in done.issues.collect()) == [("o/a", 11), ("o/a", 12), ("o/a", 16)]
    with pytest.raises(ValueError):
        triage_report(repo_list(spark, ["o/a"]), *landed, fixed_answer("{}"), lookback=lookback, **ASK)


def test_reactions_are_read_once_and_small_parts_of_the_report_are_written(spark, landed):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    rows = [("o/a", 11, "+1")] * 5 + [("o/b", 17, "-1")] * 4
    reactions = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(seen), landed[1].schema)
    done = triage_report(repo_list(spark, ["o/a", "o/b"]), landed[0], reactions, judge(**LISTS), since=SINCE, **ASK)
    assert len(ids_of(section(lines_of(done), "## Top 20 Urgent Issues"))) == 5
    assert read.value == len(rows)
    plan = done.lines._jdf.queryExecution().optimizedPlan().toString()
    assert "$.priorities" in plan and "$.top_urgent_issues" not in plan
