import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from issueloom.llm import pivots
from issueloom.llm.common import table


def slow(rows, k):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good.setdefault(i, []).append(np.array(v, "float64"))
    found = {}
    for q in [i for i in good if i % 100 == 0]:
        far = [(min(float(np.sqrt(((x - good[q][0]) ** 2).sum())) for x in xs), i) for i, xs in good.items() if i != q]
        found[q] = sorted(far)[:k]
    return found


def collected(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((r.score, r.vec_id))
    return found


def test_small_tables_are_exact_with_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(350)]
    rows += [(400, None), (500, [0.0] * 4), (600, [1.0, None, 0.0, 0.0]), (700, [float("nan"), 1.0, 0.0, 0.0]), (800, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [rows[0], rows[5], rows[5], rows[100]]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    got = collected(pivots.nearest(given, F.col("vec_id") % 100 == 0, pivots=20, prefix=8, block=64, query_block=2))
    want = slow(rows, 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], rel=1e-12)


def test_recall_on_the_test_embeddings(spark):
    given = table(spark, "/root/testdata/sf0.1", "embeddings")
    # Small blocks and no floor, so that every block reranks its share only.
    got = collected(pivots.nearest(given, F.col("vec_id") % 100 == 0, least=10, block=1000))
    want = slow([(r.vec_id, r.embedding) for r in given.collect()], 10)
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want]
    assert np.mean(hits) / 10 > 0.95


def test_fewer_rows_than_neighbours_and_empty(spark):
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert [i for _, i in collected(pivots.nearest(three, F.col("vec_id") % 100 == 0))[0]] == [1, 2]
    assert pivots.nearest(three.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    nothing = spark.createDataFrame([(0, [0.0])], "vec_id long, embedding array<float>")
    assert pivots.nearest(nothing, F.col("vec_id") % 100 == 0).collect() == []


def test_near_copies_neither_fill_the_pivots_nor_are_cut(spark):
    rng = np.random.default_rng(3)
    free, centre = rng.normal(size=(1500, 16)), rng.normal(size=16)
    group = centre + 0.01 * rng.normal(size=(900, 16))
    rows = list(enumerate(np.vstack([free, group]).astype("float32").tolist()))
    random.Random(1).shuffle(rows)
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collected(pivots.nearest(given, F.col("vec_id") % 100 == 0, pivots=64, prefix=32, least=10, block=1000))
    want = slow(rows, 10)
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]
    near = [h for h, q in zip(hits, want, strict=True) if want[q][0][0] < 0.2]
    assert np.mean(hits) > 0.95 and len(near) > 3 and min(near) == 1.0


def test_spread_out_pivots_differ():
    sample = np.vstack([np.zeros((50, 3)) + [1, 0, 0], np.eye(3), np.eye(3)])
    assert len(pivots.spread_out(sample, 10)) == 3


def test_rows_of_one_id_do_not_use_up_the_share(spark):
    rng = np.random.default_rng(4)
    free, own, other = rng.normal(size=(1200, 16)), rng.normal(size=16), rng.normal(size=16)
    rows = [(i + 1000, v.tolist()) for i, v in enumerate(free)]
    rows += [(100, (own + 1e-3 * rng.normal(size=16)).tolist()) for _ in range(500)] + [(100, own.tolist())] * 100
    # The query 200 stands in a group whose other rows all have one id.
    rows += [(201, (other + 1e-3 * rng.normal(size=16)).tolist()) for _ in range(500)] + [(200, other.tolist())]
    random.Random(1).shuffle(rows)
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collected(pivots.nearest(given, F.col("vec_id") % 100 == 0, pivots=64, prefix=32, least=10, block=4000))
    want = slow(rows, 10)
    assert {q: len(found) for q, found in got.items()} == dict.fromkeys(want, 10)
    assert got[200][0][1] == 201
    for q in (100, 200):
        assert len({i for _, i in got[q]} & {i for _, i in want[q]}) >= 8


def test_a_vector_of_odd_length_at_the_first_place_changes_nothing(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    make = lambda given: spark.createDataFrame(given, "vec_id long, embedding array<double>")
    ids = make(rows).orderBy(F.xxhash64("vec_id")).select("vec_id").limit(2).collect()
    odd = {ids[0].vec_id: 7, ids[1].vec_id: 9}
    changed = [(i, (v + v)[: odd[i]] if i in odd else v) for i, v in rows]
    without = [r for r in rows if r[0] not in odd]
    search = lambda given: collected(pivots.nearest(make(given), F.col("vec_id") % 100 == 0, pivots=20, prefix=8))
    assert search(changed) == search(without) != {}


def test_the_smallest_vector_of_a_repeated_query_asks(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)), 1)]
    own = [(100, [-9.0, 0.0, 0.0, 0.0]), (100, [9.0, 0.0, 0.0, 0.0])]
    rows = [r for r in rows if r[0] != 100]
    make = lambda given: spark.createDataFrame(given, "vec_id long, embedding array<double>").repartition(3)
    search = lambda given: collected(pivots.nearest(make(given), F.col("vec_id") == 100, pivots=20, prefix=8))
    assert search(rows + own) == search(rows + own[::-1]) == search(rows + own[:1])
