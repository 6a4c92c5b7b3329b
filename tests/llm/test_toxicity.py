import random
import zlib

import cases
import numpy as np

from issueloom.llm import toxicity
from issueloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_ngrams_equal_brute_force():
    given = ["Abcab", "", "xy", "日本語テキスト", "abc" * 40]
    for n, (bucket, owner) in zip(toxicity.ORDERS, toxicity.ngram_buckets(given), strict=True):
        grams = [(g, i) for i, t in enumerate(given) for g in [t.lower()[k : k + n] for k in range(len(t) - n + 1)]]
        assert owner.tolist() == [i for _, i in grams]
        by_gram = {}
        for (gram, _), b in zip(grams, bucket.tolist(), strict=True):
            assert by_gram.setdefault(gram, b) == b
        assert len(set(by_gram.values())) >= len(by_gram) - 1


def test_slices_of_long_texts_hold_all_ngrams_once():
    rng = random.Random(3)
    long = "".join(rng.choice("abcdeİΣ") for _ in range(5000))
    given = ["Abcab", "", long, "xy", "abc" * 40, "日本語テキスト"]
    want = {i: set(np.concatenate([b for b, _ in toxicity.ngram_buckets([t.lower()])]).tolist()) for i, t in enumerate(given)}
    for most in (64, 300, 1 << 18):
        got = {}
        for start, n, keys in toxicity.present(given, most=most):
            assert (np.diff(keys) > 0).all()
            for i in range(n):
                got[start + i] = set((keys[keys // toxicity.BUCKETS == i] % toxicity.BUCKETS).tolist())
        assert got == want


def slow_fit(flat, owner, target, ratios, steps=20_000):
    """Plain gradient steps on the dense table."""
    x = np.zeros((len(target), len(ratios)))
    x[owner, flat] = 1
    x = x * ratios
    each = np.where(target == 1, 0.5 / target.sum(), 0.5 / (len(target) - target.sum()))
    w, b = np.zeros(len(ratios)), 0.0
    rate = 4 / ((x**2).sum(axis=1).max() + 1)
    for _ in range(steps):
        off = each * (1 / (1 + np.exp(-(x @ w + b))) - target)
        w, b = w - rate * (x.T @ off + toxicity.RIDGE * w), b - rate * off.sum()
    return w * ratios, b


def test_fit_reaches_the_optimum():
    rng = np.random.default_rng(5)
    x = rng.random((80, 6)) < 0.4
    target = (x[:, 0] | (rng.random(80) < 0.2)).astype("float64")
    owner, flat = np.nonzero(x)
    ratios = rng.normal(size=6)
    weights, intercept = toxicity.fit(flat, owner, target, ratios)
    want, at = slow_fit(flat, owner, target, ratios)
    assert np.allclose(weights, want, atol=0.1) and abs(intercept - at) < 0.1


def planted(n=600):
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([8, 60, 400]))]
        if i % 9 == 0:
            text[rng.randrange(len(text))] = rng.choice(["Vexjunk", "wqzzor!"])
        yield i, " ".join(text), int(i % 9 == 0)


def test_planted_words_are_found_in_texts_never_seen(spark):
    rows = list(planted())
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(10**9, 1), (None, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, keep=~toxicity.held_out())
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out == (r in held) for r in rows)
    right = [got[r[0]].predicted == r[2] for r in held]
    assert np.mean(right) > 0.95 and len(held) > 80
    clean = toxicity.without_toxic(docs, model)
    assert {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if r.predicted == 0}


def test_held_out_accuracy_on_the_test_table(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(docs, labels, keep=~toxicity.held_out())
    rows = toxicity.score_documents(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93


def test_cases_and_missing_labels(spark):
    docs = cases.docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, none)
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == len(cases.rows()) and {r.predicted for r in rows} == {0}
    some = spark.createDataFrame([(0, 1, "a"), (1, 0, "b"), (2, None, "c"), (0, 1, "a")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, some)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert toxicity.score_documents(cases.empty(spark), model).collect() == []
    assert toxicity.train(cases.empty(spark), some).weights.size == 0


def test_an_id_that_many_rows_repeat_is_learnt_from_once(spark):
    once = [(i, f"fine words {i % 7}") for i in range(40)] + [(i, f"vex words {i % 7}") for i in range(40, 60)]
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(60)], "doc_id long, toxic int")
    schema = "doc_id long, text string"
    a = toxicity.train(spark.createDataFrame(once, schema), labels)
    b = toxicity.train(spark.createDataFrame(once + [once[3]] * 500, schema).repartition(5), labels)
    assert np.array_equal(a.buckets, b.buckets) and np.allclose(a.weights, b.weights) and np.isclose(a.intercept, b.intercept)
