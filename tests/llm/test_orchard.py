import hashlib
import math
import random

import numpy as np
import pytest

from issueloom.llm import orchard

ROWS = "vec_id long, embedding array<float>, cluster string, distance int, vector int"


def vectors(n=300, width=64, seed=3):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(9)]
    found = [(i, [m + rng.gauss(0, 0.1) for m in middles[i % 9]]) for i in range(n)]
    found += [found[5], found[5], (found[5][0], found[6][1]), (n + 1, found[7][1])]
    found += [(n + 2, None), (n + 3, [0.5] * (width - 1)), (n + 4, [None] + [0.5] * (width - 1)), (n + 5, [math.nan] * width)]
    return [*found, (n + 6, [math.inf] * width), (n + 7, [0.0] * width), (None, [0.25] * width), (n + 8, [])]


def made(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], ROWS).repartition(3)


def brute(rows, clusters=16, rounds=3, width=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    mark = lambda i: (i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest())
    points = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(points)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                points[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    digest = lambda c: hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()
    return sorted(((i, c, d, sum(e for _, o, e in found if o == c), total, digest(c)) for i, c, d in found), key=repr)


@pytest.mark.parametrize("clusters", [1, 2, 16])
def test_equals_brute_force(spark, clusters):
    rows = vectors()
    got = orchard.with_inertia(*orchard.cluster_vectors(made(spark, rows), clusters=clusters))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, clusters)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = vectors()[:4]
    got = orchard.with_inertia(*orchard.cluster_vectors(made(spark, rows)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    for none in ([], [(1, None), (2, [])]):
        assert orchard.with_inertia(*orchard.cluster_vectors(made(spark, none))).collect() == []


def test_a_component_that_is_too_large_fails(spark):
    with pytest.raises(Exception, match="beyond"):
        orchard.cluster_vectors(made(spark, [(1, [3e9] * 64)]))


def test_search_finds_ties_and_skips_far_centroids():
    rng = np.random.default_rng(1)
    points = rng.integers(-3, 4, (40, 3)) + 40 * rng.integers(0, 4, (40, 1))  # many equal points and distances
    given = rng.integers(-3, 4, (500, 3)) + 40 * rng.integers(0, 4, (500, 1))
    own, distance, measured = orchard.search(given, orchard.neighbour_lists(points))
    apart = ((given[:, None] - points[None]) ** 2).sum(axis=2)
    assert (own == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()
    assert measured < 0.6 * apart.size
