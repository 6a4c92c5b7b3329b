"""Approximate nearest neighbours with a permutation index.

A vector is represented by its `prefix` nearest pivots, nearest first. The rows are dealt evenly into
blocks, and each block keeps an inverted file: for each pivot the rows that hold it, and at which place. A
query walks the lists of its own nearest pivots. Each common pivot lowers the footrule distance of the two
prefixes (a pivot missing from one counts as standing just behind its end), so after the walk all rows of
the block have theirs. The nearest `share` of the block by footrule is reranked by exact distance in double
precision, and the best of the blocks are merged. A share, not a number: it grows with the block, rows that
tie at its end are reranked too, and so are all rows so near by footrule (`DENSE` of the largest one) that
they belong to one dense group, however large it is. Blocks of up to `least` rows are reranked whole.

The pivots are the most spread-out ones of a bounded sample (`SAMPLED` vectors, those with the smallest hash
of their id); every row is indexed. Recall of the 10 nearest against brute force is over 0.98 on the test embeddings, which have no
clusters (64 dimensions, distances nearly all alike); tests hold it to 0.95.

Vectors that are null, zero, of another length than most, or hold nulls or non-finite numbers take no part (of
equally frequent lengths the smaller one counts). Of several vectors of a query the smallest one asks. Equal rows are merged before. Rows that repeat a vec_id count as one, at its smallest distance,
in the share too; a row with the query's id is never its neighbour and takes no part of the share. An empty table gives no rows; columns besides vec_id and embedding are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issueloom.llm.common import map_rows
from issueloom.operators.durable import counted, durable

PIVOTS = 256
SAMPLED = 1_024
PREFIX = 64
SHARE = 0.2
DENSE = 0.25
LEAST = 1_000
BLOCK = 8_192
QUERY_BLOCK = 2_048


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part; `vector` has doubles."""
    vector = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = vectors.select(F.col("vec_id").cast("long"), vector.alias("vector")).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    return whole.filter(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))


def spread_out(sample: np.ndarray, pivots: int) -> np.ndarray:
    """`pivots` different vectors of the sample, each the farthest from those chosen before it.

    A group of near copies in the sample gives one pivot. Several would fill prefixes with pivots that all
    say the same.
    """
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < pivots and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, sampled: int = SAMPLED) -> np.ndarray:
    """At most `pivots` vectors of a sample of `sampled` ones, all of one length."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(max(pivots, sampled)).collect()
    return spread_out(np.array([r["vector"] for r in sample], dtype="float64"), pivots) if sample else np.empty((0, 0))


def of_usual_length(rows: DataFrame) -> DataFrame:
    """The rows whose vectors have the most frequent length."""
    length = F.size("vector")
    usual = rows.groupBy(length.alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.filter(length == usual["n"]) if usual else rows


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The places of the nearest pivots of each vector, nearest first, ties to the smaller place."""
    apart = (pivots**2).sum(axis=1)[None] - 2 * vectors @ pivots.T
    return np.argsort(apart, axis=1, kind="stable")[:, :prefix].astype("<u2")


def build_index(rows: DataFrame, pivots: np.ndarray, prefix: int = PREFIX) -> DataFrame:
    """(vec_id, vector, prefix, spread) of every usable row; vector and prefix are packed numbers."""
    width = pivots.shape[1]

    def make():
        def represent(batch: pa.RecordBatch):
            values = batch.column("vector").flatten().to_numpy().reshape(-1, width)
            prefixes = nearest_pivots(values, pivots, prefix)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id"),
                    "spread": batch.column("spread"),
                    "vector": pa.array([v.tobytes() for v in values], pa.binary()),
                    "prefix": pa.array([p.tobytes() for p in prefixes], pa.binary()),
                }
            )

        return represent

    # The number is written with the row; it deals rows to blocks evenly even if they repeat one id.
    numbered = rows.select("vec_id", F.xxhash64(F.monotonically_increasing_id()).alias("spread"), "vector")
    return map_rows(numbered, "vec_id long, spread long, vector binary, prefix binary", make)


def _stack(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1)


def search_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int, pivots: int, share: float, least: int) -> pd.DataFrame:
    """The k nearest rows of a block for each query of a block."""
    rows = rows.sort_values("vec_id", kind="stable")
    ids, vectors, prefixes = rows["vec_id"].to_numpy(), _stack(rows["vector"], "<f8"), _stack(rows["prefix"], "<u2")
    single, firsts = np.unique(ids, return_index=True)
    n, m = prefixes.shape
    # The inverted file: rows and places, sorted by pivot.
    order = np.argsort(prefixes, axis=None, kind="stable")
    posted, places = np.divmod(order, m)
    ends = np.searchsorted(prefixes.ravel()[order], np.arange(pivots + 1))
    quota = max(least, int(np.ceil(share * n)))
    dense = int(DENSE * m * (m + 1))
    found = []
    asked = zip(queries["vec_id"], _stack(queries["vector"], "<f8"), _stack(queries["prefix"], "<u2"), strict=True)
    for query_id, vector, prefix in asked:
        footrule = np.full(n, m * (m + 1), dtype="int32")
        for place, pivot in enumerate(prefix):
            post = slice(ends[pivot], ends[pivot + 1])
            footrule[posted[post]] -= 2 * (m - np.maximum(places[post], place)).astype("int32")
        # Of other ids only, and each once, so rows of one id don't fill the quota.
        lows = np.minimum.reduceat(footrule, firsts)[single != query_id]
        reranked = min(len(lows), quota)
        cut = np.partition(lows, reranked - 1)[reranked - 1] if reranked else 0
        near = np.flatnonzero((footrule <= max(cut, dense)) & (ids != query_id))
        score = np.sqrt(((vectors[near] - vector) ** 2).sum(axis=1))
        best = np.lexsort((ids[near], score))
        # Rows of one id follow each other only if they are equal, so some more are passed on than k.
        best = best[pd.Series(ids[near][best]).drop_duplicates().index[:k]]
        found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[near][best], "score": score[best]}))
    return pd.concat(found)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    share: float = SHARE,
    least: int = LEAST,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row with `is_query` (of vec_id)."""
    rows = of_usual_length(durable(usable(vectors).distinct(), "vectors"))
    chosen = choose_pivots(rows, pivots)
    if not len(chosen):
        none = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
        return none.filter("false")
    index, n = counted(build_index(rows, chosen, prefix), "permutations")
    smallest = rows.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries, asked = counted(build_index(smallest, chosen, prefix), "asked")
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-asked // query_block))
    deal = lambda by, parts: F.pmod(by, F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = index.select("vec_id", "vector", "prefix", deal(F.col("spread"), blocks).alias("b"), each(query_blocks).alias("q"))
    right = queries.select("vec_id", "vector", "prefix", each(blocks).alias("b"), deal(F.xxhash64("vec_id"), query_blocks).alias("q"))
    n_pivots = len(chosen)

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(rows, queries, k, n_pivots, share, least)

    cells = left.groupBy("b", "q").cogroup(right.groupBy("b", "q"))
    found = cells.applyInPandas(search, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
