"""Quality classifier by importance resampling (DSIR, Xie et al. 2023).

Two bag-of-n-grams models over hashed words and word pairs are estimated: one of target text (documents
labelled good), one of the raw corpus (all documents). The log of their ratio, summed over a document's
n-grams, is its log importance weight. Adding Gumbel noise to the weights and keeping the top k draws k
documents without replacement in proportion to them. The noise is a hash of id and text, so a repeated run
or a retried task draws the same documents.

k is a share of the rows. The cut is found exactly, without sorting or collecting: the keys are counted in
ranges of their leading bits, the range that holds the cut is counted more finely, and so on; rows that tie
at the cut are taken in the order of their hash.

Texts are read whole. What comes to the driver is two counts per hash
bucket. Defined cases: null text counts as empty, with weight 0; a null id is hashed like any other;
repeated rows have one key and are drawn together unless the cut falls between them; without labelled
documents all weights are 0 and the draw is uniform; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueloom.llm.common import map_rows, ranked, text_column, text_or_empty
from issueloom.operators.durable import durable

BUCKETS = 10_000
SMOOTHING = 1.0
DRAWN = 0.8
TARGETS = 20_000
SEED = 17
LEVELS = (48, 32, 16, 0)
#: An odd multiplier and its inverse modulo 2^64, for rolling hashes.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
BLOCK_BYTES = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype="uint64")
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def ngrams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its text) of every word and every pair of neighbouring words.

    Words are runs of bytes over ASCII white space, A-Z lower-cased. A word's hash comes from running sums
    of its bytes times powers, so no word is cut out.
    """
    data = [t.encode("utf-8", "replace").lower() for t in texts]
    joined = np.frombuffer(b" ".join(data) + b" ", dtype="u1")
    sizes = np.array([len(d) + 1 for d in data], dtype="int64")
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    ends = np.flatnonzero(space & np.append(False, ~space[:-1]))
    sums = np.append(np.uint64(0), np.cumsum((joined.astype("uint64") + np.uint64(1)) * _powers(STEP, len(joined))))
    words = _mix((sums[ends] - sums[starts]) * _powers(BACK, len(joined) + 1)[starts] + (ends - starts).astype("uint64"))
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = _mix(words[pair] * np.uint64(STEP) + words[pair + 1])
    hashes = np.concatenate([words, pairs]) % np.uint64(buckets)
    return hashes.astype("int64"), np.concatenate([owner, owner[pair]])


def _blocks(texts: list[str]):
    start = size = 0
    for at, text in enumerate(texts):
        if size and size + len(text) > BLOCK_BYTES:
            yield start, at
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-grams of all rows, and of those with `good`. One row per task and bucket is
    made before the sum."""

    def count(batches):
        raw, target = np.zeros(buckets, "int64"), np.zeros(buckets, "int64")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            good = np.array(batch.column("good").to_pylist(), dtype=bool)
            for start, end in _blocks(texts):
                bucket, owner = ngrams(texts[start:end], buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[start:end][owner]], minlength=buckets)
        if raw.any():
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(buckets)), "raw": pa.array(raw), "target": pa.array(target)})

    parts = docs.select(text_or_empty(), "good").mapInArrow(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    raw, target = np.full(buckets, smoothing), np.full(buckets, smoothing)
    for r in counts.collect():  # a row per bucket
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if target.sum() <= smoothing * buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weight_column(ratios: np.ndarray):
    buckets = len(ratios)

    def make():
        def weigh(texts: list[str]) -> list[float]:
            found = []
            for start, end in _blocks(texts):
                bucket, owner = ngrams(texts[start:end], buckets)
                found.append(np.bincount(owner, ratios[bucket], end - start))
            return np.concatenate(found).tolist() if found else []

        return weigh

    return text_column(make, "double")


def exact_cut(keys: DataFrame, k: int) -> tuple[int, int]:
    """(cut, ties): rows with a larger `order` than the cut are in the top k, and `ties` rows at it.

    `order` is a signed 64-bit number. Four passes over a written table, each returning at most 65,536 counts.
    """
    low, left = -(1 << 63), k
    inside = keys
    for shift in LEVELS:
        slot = F.shiftrightunsigned(F.col("order") - F.lit(low), shift) if shift else F.col("order") - F.lit(low)
        if shift == LEVELS[0]:
            slot = F.shiftright("order", shift) + F.lit(1 << 15)
        counts = sorted(((r["slot"], r["n"]) for r in inside.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        for at, n in counts:
            if left <= n:
                break
            left -= n
        low += at << shift
        inside = keys.filter((F.col("order") >= F.lit(low)) & (F.col("order") <= F.lit(low + (1 << shift) - 1)))
    return low, left


def resample(
    docs: DataFrame,
    labels: DataFrame,
    drawn: float = DRAWN,
    buckets: int = BUCKETS,
    seed: int = SEED,
    targets: int = TARGETS,
) -> DataFrame:
    """doc_id, log_weight, gumbel_key and kept of every row; a share `drawn` of the rows is kept.

    The target model learns from at most `targets` documents labelled good, those with the smallest hash of
    their id; the raw model from all documents.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), text_or_empty())
    known = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    good = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(targets).withColumn("good", F.lit(True))
    marked = narrow.join(F.broadcast(good), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    ratios = log_ratios(bucket_counts(marked, buckets), buckets)
    noise = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    uniform = (F.shiftrightunsigned(noise, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    weighed = narrow.select("doc_id", weight_column(ratios)("text").alias("log_weight"), noise.alias("noise"), uniform.alias("u"))
    keyed = weighed.select("doc_id", "log_weight", "noise", (F.col("log_weight") - F.log(-F.log("u"))).alias("gumbel_key"))
    # A whole number in the order of the key, fine enough that different keys hardly share one.
    fine = F.round(F.col("gumbel_key") * F.lit(float(1 << 36)))
    order = F.greatest(F.least(fine, F.lit(float(1 << 62))), F.lit(-float(1 << 62))).cast("long")
    keys = durable(keyed.withColumn("order", order).withColumn("part", F.spark_partition_id()), "gumbel")
    rows = keys.count()
    k = round(drawn * rows)
    if not k:
        return keys.select("doc_id", "log_weight", "gumbel_key", F.lit(False).alias("kept"))
    cut, ties = exact_cut(keys, k)
    at_cut = keys.filter(F.col("order") == F.lit(cut)).withColumn("one", F.lit(0))
    tied = ranked(at_cut, "one", "part", ["noise", "doc_id"], "place")
    columns = ["doc_id", "log_weight", "gumbel_key"]
    beside = keys.filter(F.col("order") != F.lit(cut)).select(*columns, (F.col("order") > F.lit(cut)).alias("kept"))
    return beside.unionByName(tied.select(*columns, (F.col("place") < ties).alias("kept")))
