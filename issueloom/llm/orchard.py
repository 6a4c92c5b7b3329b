"""Centroid clustering with Orchard's search.

Vectors are made integers once, and all sums and distances are exact. In each round the driver sorts, for
every centroid, the others by their distance from it (`clusters`² numbers, whatever the data). A vector
starts at a centroid and walks its list, nearest first. A centroid of the list that is closer takes over:
the walk goes on in its list, from the front, past what is marked as visited. It stops where a centroid of
the list is strictly more than twice as far from the current one as the vector is, since no later one can
then be closer or as close. A tie goes to the smaller number, which counts as closer.

A task runs the walks of a batch side by side and keeps one sum per cluster and component. Only these
sums, `clusters * (width + 1)` rows per task, are shuffled, and their totals go to the driver.

Defined cases: vectors that are null, of another length, or hold null or non-finite numbers take no part;
fewer vectors than clusters give as many clusters; repeated rows are vectors of their own, also as seeds,
where equal hashes are ordered by the vector; a null vec_id is a seed only after all others; an empty table
gives no rows; other columns are ignored. A component beyond ±LARGEST fails the job, as squared distances
of such vectors don't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueloom.llm.common import map_rows
from issueloom.operators.durable import durable

WIDTH = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED_TEXT = "1:"
LARGEST = 1 << 26
#: Rows that are walked side by side.
BLOCK = 4096


class Centroids(NamedTuple):
    """Centroids, for each the others nearest first, and the squared distances of these from it."""

    points: np.ndarray
    lists: np.ndarray
    apart: np.ndarray


def whole_vectors(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector) of the rows that take part; `vector` has floor(scale * x) as longs."""
    vector = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fitting = vectors.select(F.col("vec_id").cast("long"), vector.alias("vector")).filter(F.size("vector") == width)
    large = F.exists("vector", lambda x: F.abs(x) * scale > LARGEST)
    checked = F.when(large, F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}"))).otherwise(
        F.transform("vector", lambda x: F.floor(x * scale))
    )
    return fitting.filter(~F.exists("vector", bad)).select("vec_id", checked.cast("array<bigint>").alias("vector"))


def first_centroids(rows: DataFrame, clusters: int, seed: str = SEED_TEXT) -> np.ndarray:
    """The vectors with the smallest sha256 of the seed and their id, in the order of the hash."""
    mark = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    taken = rows.select(mark.alias("mark"), "vector").orderBy(F.asc_nulls_last("mark"), "vector").limit(clusters)
    return np.array([r["vector"] for r in taken.collect()], dtype="int64")


def neighbour_lists(points: np.ndarray) -> Centroids:
    apart = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")
    others = np.array([[s for s in row if s != c] for c, row in enumerate(order)], dtype="int64").reshape(len(points), -1)
    return Centroids(points, others, np.take_along_axis(apart, others, axis=1))


def search(vectors: np.ndarray, to: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each vector, and how many distances it took."""
    n, k = len(vectors), len(to.points)
    current = np.zeros(n, dtype="int64")
    best = ((vectors - to.points[0]) ** 2).sum(axis=1)
    place = np.zeros(n, dtype="int64")
    visited = np.zeros((n, k), dtype=bool)
    visited[:, 0] = True
    walking = np.arange(n if k > 1 else 0)
    measured = n
    while len(walking):
        # Squared: strictly more than twice as far is more than four times the square.
        walking = walking[to.apart[current[walking], place[walking]] <= 4 * best[walking]]
        seen = to.lists[current[walking], place[walking]]
        place[walking] += 1
        new = ~visited[walking, seen]
        at, other = walking[new], seen[new]
        visited[at, other] = True
        distance = ((vectors[at] - to.points[other]) ** 2).sum(axis=1)
        measured += len(at)
        closer = (distance < best[at]) | ((distance == best[at]) & (other < current[at]))
        moved = at[closer]
        current[moved], best[moved], place[moved] = other[closer], distance[closer], 0
        walking = walking[place[walking] < k - 1]
    return current, best, measured


def _vectors(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    flat = batch.column("vector").flatten().to_numpy().reshape(-1, width)
    for at in range(0, len(flat), BLOCK):
        yield at, flat[at : at + BLOCK]


def next_points(rows: DataFrame, points: np.ndarray) -> np.ndarray:
    """Each centroid moved to the floored mean of its vectors; one without vectors stays."""
    to = neighbour_lists(points)
    clusters, width = points.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, width + 1), dtype="int64")
        for batch in batches:
            for _, block in _vectors(batch, width):
                own, _, _ = search(block, to)
                for c in np.unique(own):
                    mine = block[own == c]
                    total[c, :width] += mine.sum(axis=0)
                    total[c, width] += len(mine)
        c, place = np.divmod(np.arange(total.size), width + 1)
        yield pa.RecordBatch.from_pydict({"cluster": c.astype("int32"), "place": place.astype("int32"), "total": total.ravel()})

    partial = rows.select("vector").mapInArrow(sums, "cluster int, place int, total long")
    # Decimals, so that no sum overflows; clusters * (width + 1) rows reach the driver.
    found = partial.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums_of = {(r["cluster"], r["place"]): int(r["total"]) for r in found}
    moved = points.copy()
    for c in range(clusters):
        if n := sums_of.get((c, width), 0):
            moved[c] = [sums_of[c, i] // n for i in range(width)]
    return moved


def assigned(rows: DataFrame, points: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    to = neighbour_lists(points)
    width = points.shape[1]

    def make():
        def step(batch: pa.RecordBatch):
            for at, block in _vectors(batch, width):
                own, distance, _ = search(block, to)
                ids = batch.column("vec_id").slice(at, len(block))
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": own.astype("int32"), "distance": distance})

        return step

    return map_rows(rows.select("vec_id", "vector"), "vec_id long, cluster int, distance long", make)


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids."""
    rows = durable(whole_vectors(vectors, width, scale), "whole-vectors")
    points = first_centroids(rows, clusters)
    if not len(points):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), points
    for _ in range(rounds):
        points = next_points(rows, points)
    return durable(assigned(rows, points), "clusters"), points


def with_inertia(found: DataFrame, points: np.ndarray) -> DataFrame:
    """Add the summed distances of each cluster and of all, and the sha256 of the final centroid.

    One row per cluster goes to the driver and comes back as a broadcast of as many rows.
    """
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    whole = sum(int(r["total"]) for r in sums)
    digest = lambda c: hashlib.sha256(",".join(map(str, points[c].tolist())).encode()).hexdigest()
    rows = [(r["cluster"], int(r["total"]), whole, digest(r["cluster"])) for r in sums]
    about = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
