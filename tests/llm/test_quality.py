import re
from collections import Counter

import cases
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from issueloom.llm import quality
from issueloom.llm.oracles import LLM_ORACLES
from issueloom.llm.queries import LLM_QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_base_measures_equal_brute_force(spark):
    more = ["a b c d e f a b c d e g a b c d e", "x x x x x x x", "1 2 3 4", "#a *b\n#a *b\n\n \n\t\n#a *b\nq", "é日 😀\x0b\x0c\r\nz\x85z\xa0z"]
    given = [(i, t, "en", "s") for i, t in enumerate(cases.texts() + more)]
    rows = spark.createDataFrame(given, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge_documents(rows).collect()}
    for i, text, *_ in given:
        base = slow_base(text)
        assert tuple(got[i][n] for n in quality.BASE) == base, text
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        assert got[i].base_failed == failed
        assert not (failed and got[i].kept)


def test_buckets_are_narrow(spark):
    rows = spark.range(0, 100_000, 7).select("id", quality.bucket("id").alias("b"))
    assert rows.filter("b > id OR (id < 64 AND b != id) OR id > b * 1.04 + 1").count() == 0


def test_sketches_merge_to_the_sketch_of_all(spark):
    rows = cases.docs(spark)
    slim = rows.select("lang", "source", F.coalesce("text", F.lit("")).alias("body"))  # of rows inside the base rules
    measured = quality.with_base(slim, "body").withColumns(quality.rates())
    by_group = quality.merged(quality.sketches(measured, "lang", "source"), [])
    whole = quality.merged(quality.sketches(measured.withColumn("lang", F.lit("x")), "lang", "source"), [])
    assert sorted(map(tuple, by_group.collect())) == sorted(map(tuple, whole.collect()))


def test_thresholds_follow_the_group(spark):
    # In source "dense" every text has many symbols, so there they are normal; elsewhere one such text is odd.
    plain, marked = "some plain words that go on for a while here and then end in other ways", "some #a# #b# #c# that go #d# for #e# while here now"
    given = [(i, f"{plain} {i}", "en", "plain") for i in range(300)] + [(1000 + i, f"{marked} {i}", "en", "dense") for i in range(300)]
    given += [(2000, marked, "en", "plain"), (2001, marked, "xx", "tiny"), (2002, None, None, None)]
    rows = spark.createDataFrame(given, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge_documents(rows).collect()}
    assert all(kept[i] for i in range(300)) and all(kept[1000 + i] for i in range(300))
    assert not kept[2000] and not kept[2002]


def test_a_small_group_has_the_fence_of_its_language_and_a_large_one_its_own(spark):
    plain, marked = "some plain words that go on for a while here and then end in other ways", "some #a# #b# #c# that go #d# for #e# while here now"
    shares = []
    for n in (1, 5, 400):
        given = [(i, f"{plain} {i}", "en", "plain") for i in range(2000)] + [(5000 + i, f"{marked} {i}", "en", "dense") for i in range(n)]
        rows = spark.createDataFrame(given, "doc_id long, text string, lang string, source string")
        measured = quality.with_base(rows.withColumnRenamed("text", "body"), "body").withColumns(quality.rates())
        low = {r.source: r for r in quality.thresholds(measured, "lang", "source").collect()}
        shares.append(low["dense"].symbol_rate_high)
        assert low["plain"].symbol_rate_high == 30
    assert shares[0] == shares[1] == 30 and shares[2] > 200


def test_filter_keeps_columns_and_rows(spark):
    docs = cases.docs(spark)
    judged = quality.judge_documents(docs)
    kept = quality.without_odd(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    want = Counter(r.doc_id for r in judged.filter("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == want and judged.count() == len(cases.rows())


def test_empty_table(spark):
    assert quality.judge_documents(cases.empty(spark)).collect() == []
    assert quality.without_odd(cases.empty(spark)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = quality.judge_documents(cases.docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_oracle(spark, sf):
    folder = f"/root/testdata/{sf}"
    query = LLM_QUERIES["op9_quality_rules"](spark, folder)
    assert differences(query, connect(folder), LLM_ORACLES["op9_quality_rules"]) == []
