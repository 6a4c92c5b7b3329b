"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `replicas` virtual nodes on a ring of 64-bit hashes, and a row belongs to the first node
clockwise of the hash of its doc_id. A shard takes no more rows than its capacity; rows that find their
shard full continue clockwise to the next shard with room. With `slack` 0 the capacities add up to the
number of rows, so shards differ by one row at most (law `rows`); with more slack fewer rows move on.

All rows of an arc, the stretch between two nodes, walk past the same shards. So the rows are counted per
arc, a table of at most `shards * replicas` rows, and the driver only settles how many rows of each arc
stop at each shard: shard by shard in rounds, a shard taking the rows that come to it in ring order while
it has room. The rows find their stretch by their exact rank in their arc, in the order of their hashes: so which
rows of a full shard move on doesn't depend on files, but for rows that repeat a doc_id.

Defined cases: null text has size 1 and crc 0; a null doc_id is a key like any other; repeated rows, which
have one hash, are ranked by task and so never meet in one; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from issueloom.llm.common import ranked
from issueloom.operators.durable import durable
from issueloom.operators.running import exclusive_sums
from issueloom.operators.skew import salted_join

SHARDS = 16
REPLICAS = 256
SEED = 7


def ring(shards: int = SHARDS, replicas: int = REPLICAS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of the virtual nodes (signed 64-bit), and the shard of each."""
    nodes = sorted(
        (xxh64_intdigest(f"{shard}/{replica}", seed) - (1 << 63), shard)
        for shard in range(shards)
        for replica in range(replicas)
    )
    return np.array([p for p, _ in nodes], dtype="int64"), np.array([s for _, s in nodes], dtype="int64")


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows per shard: equal but for one row, and larger by the slack."""
    even = [rows // shards + (s < rows % shards) for s in range(shards)]
    return [c + int(slack * c) for c in even]


def settle(counts: np.ndarray, owners: np.ndarray, room: list[int]) -> list[list[tuple[int, int]]]:
    """Per arc, (shard, rows) in the order in which its rows, by rank, stop.

    In each round the rows that are left move to the next shard clockwise that they haven't passed.
    """
    arcs, shards = len(owners), len(room)
    room, left = list(room), counts.tolist()
    walk = []
    for arc in range(arcs):
        seen: dict[int, None] = {}
        at = arc
        while len(seen) < shards and at < arc + arcs:
            seen.setdefault(int(owners[at % arcs]))
            at += 1
        walk.append(list(seen))
    stops: list[list[tuple[int, int]]] = [[] for _ in range(arcs)]
    for turn in range(shards):
        for arc in range(arcs):
            if left[arc] and turn < len(walk[arc]):
                shard = walk[arc][turn]
                taken = min(left[arc], room[shard])
                if taken:
                    stops[arc].append((shard, taken))
                    room[shard] -= taken
                    left[arc] -= taken
    return stops


def assign(keyed: DataFrame, shards: int, replicas: int, slack: float, order: list[str]) -> DataFrame:
    """Add `shard` and `slot` to a written table with `key_hash` and `part`."""
    positions, owners = ring(shards, replicas)

    @F.pandas_udf("int")
    def arc_of(key_hash: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(positions, key_hash.to_numpy()) % len(positions)).astype("int32")

    # Written, so that the arcs of the rows are found once.
    rows = durable(keyed.withColumn("_arc", arc_of("key_hash")), "ring-arcs")
    found = rows.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per arc at most
    counts = np.zeros(len(positions), dtype="int64")
    for r in found:
        counts[r["_arc"]] = r["n"]
    stops = settle(counts, owners, capacities(int(counts.sum()), shards, slack))
    ahead = np.array([0, *accumulate(counts.tolist())][:-1], dtype="int64")
    # All rows stand in one line by (arc, rank); each stop is one stretch of it.
    stretch, filled = [], [0] * shards
    for arc, stop in enumerate(stops):
        at = int(ahead[arc])
        for shard, n in stop:
            stretch.append((at, shard, filled[shard]))
            at, filled[shard] = at + n, filled[shard] + n
    lines = np.array(stretch, dtype="int64").reshape(-1, 3)

    @F.pandas_udf("struct<shard: int, slot: long>")
    def seat(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = ahead[arc.to_numpy()] + rank.to_numpy()
        stop = lines[np.searchsorted(lines[:, 0], at, side="right") - 1]
        return pd.DataFrame({"shard": stop[:, 1].astype("int32"), "slot": stop[:, 2] + at - stop[:, 0]})

    # The place of a row is that of its hash in the arc, and then its own among the rows of the hash.
    hashes = rows.groupBy("_arc", "key_hash").agg(F.count(F.lit(1)).alias("n"))
    before = exclusive_sums(hashes, ["_arc"], "key_hash", ["n"]).select("key_hash", "before_n")
    inside = ranked(rows, "key_hash", "part", order, "_inside_hash")
    spread = [c for c in inside.columns if c != "key_hash"]
    joined = salted_join(inside, before, ["key_hash"], "inner", spread)
    placed = joined.withColumn("_seat", seat("_arc", F.col("before_n") + F.col("_inside_hash")))
    return placed.select(*[c for c in keyed.columns if c not in ("part", "key_hash")], "_seat.shard", "_seat.slot")


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, replicas: int = REPLICAS, slack: float = 0.0
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; the texts are read once, and not carried."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(
        F.col("doc_id").cast("long"),
        (F.length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("key_hash"),
        F.spark_partition_id().alias("part"),
    )
    return assign(keyed, shards, replicas, slack, ["doc_id", "text_crc32", "size"])
