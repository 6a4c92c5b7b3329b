"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at distance `radius` or less have a point halfway, at most half the radius from both. So
every distinct fingerprint emits all variants within half the radius (1 + 64 for radius 2), and the
variants are shuffled. Fingerprints that meet on a variant are neighbours in its sorted list: each is
linked to the one before it, the link is verified by counting differing bits, and repeated links are
dropped. Meeting on a variant bounds the distance by the radius, so neighbours in the list join all that
meet there, and a variant of k fingerprints costs k - 1 links, not k². A variant can meet at most 65
fingerprints, whatever the data, so no group of copies makes a large key.

Defined cases: null text counts as empty; without words the fingerprint is zero and links like any other;
repeated rows share a fingerprint; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from issueloom.llm.common import spare_name, text_column, text_or_empty
from issueloom.operators.durable import counted, durable
from issueloom.operators.skew import HOT_ROWS, salted_join

RADIUS = 2
SHINGLE = 3
SEED = 42
BITS = 64
BLOCK = 1 << 14
MAX_ROUNDS = 60


def shingles(text: str, shingle: int, seed: int = SEED) -> list[int]:
    """The hashes of all runs of `shingle` words; a shorter text is one run."""
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: only A-Z, and only ASCII white space
    if len(words) < shingle:
        return [xxh64_intdigest(b" ".join(words), seed)] if words else []
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return [xxh64_intdigest(r, seed) for r in runs]


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text as a signed 64-bit number. A bit is 1 if set in over half the hashes."""
    hashes = shingles(text, shingle, seed)
    if not hashes:
        return 0
    votes = np.zeros(BITS, dtype="int64")
    for at in range(0, len(hashes), BLOCK):
        block = np.array(hashes[at : at + BLOCK], dtype="<u8").view("u1").reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype="uint32")
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text):
    return text_column(lambda: lambda texts: [fingerprint(t) for t in texts], "long")(text)


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """All patterns of at most half the radius set bits, as signed numbers. The radius is even."""
    if radius % 2:
        raise ValueError("the radius must be even: both sides go half the way")
    found = [sum(1 << b for b in c) for n in range(radius // 2 + 1) for c in combinations(range(bits), n)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a < b, that join all distinct fingerprints of column `fp` within the radius."""
    flips = F.array(*[F.lit(m).cast("long") for m in masks(radius)])
    variants = prints.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    return (
        variants.select(before.alias("a"), F.col("fp").alias("b"))
        .filter("a IS NOT NULL AND a < b")
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        .distinct()
    )


def _star(arcs: DataFrame, rows: int, hot_rows: int) -> DataFrame:
    """Arcs (at, to) with `low`, the smallest of `at` and what it points to. A node of many arcs is salted."""
    lows = arcs.groupBy("at").agg(F.least(F.min("to"), F.col("at")).alias("low"))
    return salted_join(arcs, lows, ["at"], "inner", ["to"], hot_rows, rows)


def components(links: DataFrame, max_rounds: int = MAX_ROUNDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root) of every linked node; the root is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014). Each round is a written table.
    """
    edges, rows = counted(links.selectExpr("b AS child", "a AS parent").distinct(), "simhash-links")
    for _ in range(max_rounds):
        both = edges.selectExpr("child AS at", "parent AS to").unionByName(edges.selectExpr("parent AS at", "child AS to"))
        large = _star(both, 2 * rows, hot_rows).filter("to > at").selectExpr("to AS child", "low AS parent").distinct()
        down = _star(large.selectExpr("child AS at", "parent AS to"), 2 * rows, hot_rows)
        small = down.selectExpr("explode(array(at, to)) AS child", "low AS parent").filter("child != parent").distinct()
        digest = F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))
        was = edges.agg(digest.alias("d")).first()["d"]
        edges, now = counted(small, "simhash-links")
        if now == rows and edges.agg(digest.alias("d")).first()["d"] == was:
            roots = edges.select(F.col("parent").alias("node")).distinct()
            return edges.selectExpr("child AS node", "parent AS root").unionByName(roots.selectExpr("node", "node AS root"))
        rows = now
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")


def fingerprint_groups(printed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component): each distinct fingerprint of a written table with its component's smallest one."""
    prints = durable(printed.select("fp").distinct(), "fingerprints")
    linked = components(near_links(prints, radius)).withColumnRenamed("node", "fp")
    return prints.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"))


def near_components(docs: DataFrame, radius: int = RADIUS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest doc_id reachable over links; one row per row."""
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty())
    marked = texts.select("doc_id", fingerprint_column("text").alias("fp"), F.monotonically_increasing_id().alias("row"))
    printed, rows = counted(marked, "simhash")
    groups = durable(fingerprint_groups(printed, radius), "simhash-groups")
    lows = printed.groupBy("fp").agg(F.min("doc_id").alias("low"))
    # One row per fingerprint on both sides; a component of many is salted.
    low = groups.join(lows, "fp").groupBy("component").agg(F.min("low").alias("component_id"))
    named = durable(salted_join(groups, low, ["component"], "inner", ["fp"], hot_rows, rows).select("fp", "component_id"), "simhash-names")
    return salted_join(printed, named, ["fp"], "inner", ["row"], hot_rows, rows).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_per_component(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The row of each component with the smallest doc_id, nulls last, with all columns of `docs`."""
    fp, row = spare_name(docs, "simhash_fp"), spare_name(docs, "simhash_row")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The row number is written with the row, so it is the same for every later reader.
    marked = docs.withColumn(fp, fingerprint_column(text)).withColumn(row, F.monotonically_increasing_id())
    printed = durable(marked, "simhash-docs")
    keys = printed.select(F.col(fp).alias("fp"), F.col("doc_id").alias("_id"), F.col(row).alias("_row"))
    groups = fingerprint_groups(keys, radius)
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_row")).alias("first")
    firsts = keys.groupBy("fp").agg(first).join(groups, "fp")
    kept = firsts.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first._row").alias(row))
    return printed.join(kept, row, "left_semi").select(*docs.columns)
