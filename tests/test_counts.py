import pytest

from issueloom.fixed import DEFAULT_CATEGORIES
from issueloom.operators import quality, reactions, report


def test_reaction_counts_and_zero_fill(spark):
    rows = [("o/a", 1, "hooray")] * 4 + [("o/a", 1, "laugh"), ("o/a", 2, "confused"), ("o/c", 3, "eyes")]
    landed = spark.createDataFrame(rows, "repo string, number long, content string")
    issues = spark.createDataFrame([("o/a", 1), ("o/a", 2), ("o/a", 3), ("o/b", 1)], "repo string, number long")
    for limited in (False, True):
        for bound in (0, 100):
            got = reactions.attach_reactions(issues, landed, limited, bound).collect()
            assert {tuple(r) for r in got} == {("o/a", 1, 5, 4), ("o/a", 2, 1, 0), ("o/a", 3, 0, 0), ("o/b", 1, 0, 0)}


def test_counts_from_summary(spark):
    full = {"rocket": 5, "laugh": 2, "+1": 1, "total_count": 8}
    rows = spark.createDataFrame(
        [(1, full, None, None), (2, full, 0, 0), (3, full, 4, 1), (4, None, None, None), (5, {"+1": 2}, 9, None)],
        "number long, reactions map<string,long>, reactions_total long, reactions_positive long",
    )
    got = reactions.reaction_counts_from_summary(rows).drop("reactions").collect()
    assert sorted(tuple(r) for r in got) == [(1, 8, 6), (2, 8, 6), (3, 4, 1), (4, 0, 0), (5, 9, 2)]


def test_first_seen_distinct(spark):
    rows = spark.createDataFrame(
        list(enumerate(["x", None, "y", "x", "", "z z", "\t", "y"])), "at long, v string"
    )
    assert [r.value for r in quality.first_seen_distinct(rows, "v", "at").collect()] == ["x", "y", "z z"]
    assert {r["at"] for r in quality.vocabulary_rejects(rows, "v").collect()} == {1, 4, 6}
    with pytest.raises(Exception, match="blank value"):
        quality.first_seen_distinct(rows, "v", "at", strict=True).collect()
    with pytest.raises(Exception, match="no values remain"):
        quality.first_seen_distinct(rows.filter("v = ''"), "v", "at").collect()


SCORED = "number long, category string, priority_level string, score double"


def test_validation(spark):
    rows = spark.createDataFrame(
        [(1, "bug", "P0", 1.0), (2, "", "P1", 1.0), (3, "bug", "P9", 1.0), (4, "bug", None, 1.0), (5, "bug", "P2", None)],
        SCORED,
    )
    checked = quality.validate_scored(rows)
    good, bad = quality.split_rejects(checked)
    assert [r.number for r in good.collect()] == [1]
    assert {r.number: r.reason for r in bad.collect()} == {
        2: "no category",
        3: "unknown priority level P9",
        4: "unknown priority level (null)",
        5: "no score",
    }
    classified, _ = quality.split_rejects(quality.validate_scored(rows, with_score=False))
    assert sorted(r.number for r in classified.collect()) == [1, 5]
    with pytest.raises(Exception, match="unknown priority level"):
        quality.require_valid(checked.filter("number = 3")).collect()
    assert quality.require_valid(quality.validate_scored(rows.filter("number = 1"))).count() == 1


def test_categories_and_top_scores(spark):
    kinds = ["test", "docs", "docs"]
    rows = [(n, f"o/{n % 4}", kinds[n % 3], [0.5, 7.25, 7.25, -1.0][n % 4]) for n in range(30)]
    scored = spark.createDataFrame(rows, "number long, repo string, category string, score double")
    assert {r.category: r.n for r in report.category_counts(scored).collect()} == {"test": 10, "docs": 20}
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[3], r[0]))[:10]]
    assert [r.number for r in report.top_by_score(scored).collect()] == want


def test_default_vocabulary(spark):
    given = quality.category_vocabulary(spark, ["b", "a", "b", " "]).collect()
    assert [(r.value, r.pos) for r in given] == [("b", 0), ("a", 1)]
    assert [r.value for r in quality.category_vocabulary(spark).collect()] == DEFAULT_CATEGORIES


def test_last_per_key(spark):
    rows = [("o/a", 1, 0, "x"), ("o/a", 1, 2, "z"), ("o/a", 1, 1, "y"), ("o/b", 1, 0, "w")]
    df = spark.createDataFrame(rows, "repo string, number long, at long, v string")
    got = {tuple(r) for r in report.last_per_key(df, ["repo", "number"], ["at"]).collect()}
    assert got == {("o/a", 1, 2, "z"), ("o/b", 1, 0, "w")}
