import re

import pytest
from pyspark.sql import functions as F

from issueloom.llm import urls
from issueloom.llm.common import table

ODD = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org", "http://example.org/es", "ftp://a.org:80/es/",
    "http://x.com/fr/1#/de/", "http://notexample.org/es/1", "http://a.b.example.org/en/1", "http://example.org/en/2?/en/1", "//x.org/a",
    "http://É.com/de/É", "http://com/de/\nq", "x://y://z.org/", "http://evilorg/", "http://a.com?/fr/", "http://" + "a" * 5000 + ".com/de/" + "b" * 5000,
]


def slow(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = re.search(r"[/?#]", rest)
        host = rest[: cut.start()] if cut else rest
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for h, p, v in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, *(best or (None, None))


def test_rules_equal_brute_force(spark):
    given = spark.createDataFrame(list(enumerate(ODD)), "page_id long, url string").withColumn("host", F.lit("x"))
    for r in urls.judged_by_rules(given.select("page_id", "url"), carry=("page_id",)).collect():
        assert (r.host, r.path, r.rule, r.rule_verdict) == slow(ODD[r.page_id])
    got = urls.judge(given, None).collect()
    assert all(r.verdict == (slow(ODD[r.page_id])[3] or "allow") for r in got) and len(got) == len(ODD)


def test_model_learns_what_rules_say(spark):
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    known = urls.labelled_by_rules(pages)
    learnt = known.filter(F.xxhash64("host", "path") % 4 != 0)
    rest = known.filter(F.xxhash64("host", "path") % 4 == 0)
    model = urls.train(learnt)
    asked = rest.select(F.lit(0).cast("long").alias("page_id"), F.concat(F.lit("http://"), "host", "path").alias("url"), "blocked")
    scored = urls.judge(asked, model).selectExpr("host", "path", "score > 0.5 AS said").join(rest, ["host", "path"])
    assert scored.filter("said = (blocked = 1)").count() / rest.count() > 0.9


def test_one_verdict_only_and_empty(spark):
    one = spark.createDataFrame([("a.com", "/", 1)], "host string, path string, blocked int")
    assert urls.train(one) is None and urls.train(one.limit(0)) is None
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(pages, urls.train(urls.labelled_by_rules(pages))).collect() == []


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame(list(enumerate(ODD)), "page_id long, url string").union(spark.range(9).selectExpr("id", "concat('http://a.org/', id)"))
    rows = spark.createDataFrame([("a.com", "/x", 1), ("b.org", "/y", 0)], "host string, path string, blocked int")
    judged = urls.judge(pages, urls.train(rows))
    assert judged.count() == len(ODD) + 9
    assert not re.search("Python|Pandas|Arrow", judged._jdf.queryExecution().toString())


@pytest.mark.parametrize("n", [0, 1])
def test_sample_is_bounded_and_stable(spark, n):
    pages = spark.range(300).selectExpr("id AS page_id", "concat('http://h', id, IF(id % 2 = 0, '.com/fr/', '.com/de/')) AS url")
    a = urls.labelled_by_rules(pages, per_class=20)
    assert a.groupBy("blocked").count().filter(F.col("count") != 20).count() == 0
    assert sorted(a.collect()) == sorted(urls.labelled_by_rules(pages.repartition(5), per_class=20).collect())
