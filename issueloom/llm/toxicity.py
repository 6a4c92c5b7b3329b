"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed character n-grams (lower-cased, 3 to 5 code points) is counted per class in a labelled
sample. The log ratio of the smoothed class shares scales each n-gram, and a logistic regression on the
scaled features is fitted (Wang and Manning 2012). Only the n-grams whose ratio is most significant enter
the regression; the others have weight 0, so a text of any length is scored by a look-up per character.

The sample is bounded: at most `per_class` labelled texts of each class, those with the smallest hash of
their id, one text of each id, and texts included whole. It is sent to the tasks only as ids, and comes back as lists of
selected features. Scoring reads all texts, whole.

Defined cases: null text counts as empty and gets the score of a text without known n-grams; labels that
are null are skipped; with labels of one class only, or none, every score is the smoothed share of toxic
labels (0.5 without labels) less a hair at 0.5; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueloom.llm.common import map_rows, spare_name, text_column, text_or_empty
from issueloom.operators.durable import durable

ORDERS = (3, 4, 5)
BUCKETS = 1 << 20
PER_CLASS = 4_000
FEATURES = 4_096
SMOOTHING = 1.0
RIDGE = 1e-3
STEPS = 400
FOLDS = 5
#: Code points that are turned to n-grams together.
BLOCK = 1 << 18


class Model(NamedTuple):
    """Weights of the selected n-gram buckets and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float


def ngram_buckets(texts: list[str], orders=ORDERS, buckets: int = BUCKETS):
    """For each order, (bucket per start, index of its text); n-grams never span two texts."""
    lowered = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in lowered], dtype="int64")
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), dtype="<u4")
    owner = np.repeat(np.arange(len(texts), dtype="int32"), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # code points to the text's end
    rolled = np.zeros(len(codes), dtype="uint32")
    for n in range(1, max(orders) + 1):
        rolled = rolled[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] if len(codes) >= n else rolled[:0]
        if n in orders:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
            mixed = (mixed ^ (mixed >> np.uint32(12))) % np.uint32(buckets)
            whole = left[: len(rolled)] >= n
            yield mixed[whole], owner[: len(rolled)][whole]


def _blocks(texts: list[str], most: int):
    """Runs (first text, texts) of about `most` code points together; a longer text is alone."""
    start = size = 0
    for at, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, texts[start:at]
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]


def present(texts: list[str], place: np.ndarray | None = None, most: int = BLOCK):
    """For runs of texts: (first text, number of texts, sorted distinct text * BUCKETS + place of its n-grams).

    `place` maps buckets to places, -1 for those to leave out; without it buckets are places. A text of more
    than `most` code points is read in slices that overlap by the longest n-gram, so memory is bounded.
    """
    for start, block in _blocks(texts, most):
        lowered = [t.lower() for t in block]
        if len(block) == 1 and len(lowered[0]) > most:
            runs = ([lowered[0][at : at + most + max(ORDERS) - 1]] for at in range(0, len(lowered[0]), most))
        else:
            runs = iter([lowered])
        found = np.empty(0, dtype="int64")
        for run in runs:
            for bucket, owner in ngram_buckets(run):
                at = bucket.astype("int32") if place is None else place[bucket]
                known = slice(None) if place is None else at >= 0
                keys = np.unique(owner[known].astype("int64") * BUCKETS + at[known])
                found = np.union1d(found, keys) if len(found) else keys
        yield start, len(block), found


def sample_labels(labels: DataFrame, per_class: int = PER_CLASS, keep=None) -> DataFrame:
    """(doc_id, toxic), at most `per_class` rows of each class: those with the smallest hash of the id."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id IS NOT NULL")
    if keep is not None:
        known = known.filter(keep)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    one = lambda value: known.filter(F.col("toxic") == value).distinct().orderBy(*order).limit(per_class)
    return one(0).unionByName(one(1))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES, keep=None) -> Model:
    """Fit on the labelled sample. `keep` is a condition on doc_id that labels must meet to be learnt from."""
    sample = durable(sample_labels(labels, per_class, keep), "toxic-sample")
    labelled = docs.select(F.col("doc_id").cast("long"), text_or_empty()).join(F.broadcast(sample), "doc_id")
    marked = labelled.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    written = durable(marked, "toxic-texts")
    # One text per id: that of the smallest hash. Longs are compared, and at most 2 * per_class rows broadcast.
    lows = written.groupBy("doc_id").agg(F.min("hash").alias("hash"))
    first = written.join(F.broadcast(lows), ["doc_id", "hash"]).groupBy("doc_id", "toxic").agg(F.min("row").alias("row"))
    rows = written.join(F.broadcast(first.select("doc_id", "toxic", "row")), ["doc_id", "toxic", "row"], "left_semi")

    def make():
        def grams(batch: pa.RecordBatch):
            texts = batch.column("text").to_pylist()
            toxic = batch.column("toxic").to_pylist()
            for start, n, keys in present(texts):
                ends = np.searchsorted(keys, np.arange(n + 1) * BUCKETS)
                lists = [(keys[a:b] % BUCKETS).astype("int32") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(toxic[start : start + n], pa.int32()), pa.array(lists, pa.list_(pa.int32()))],
                    ["toxic", "buckets"],
                )

        return grams

    learnt = durable(map_rows(rows.select("toxic", "text"), "toxic int, buckets array<int>", make), "toxic-grams")
    sizes = {r["toxic"]: r["n"] for r in learnt.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, bad = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not bad:
        share = (bad + 1) / (clean + bad + 2)
        return Model(np.empty(0, "int32"), np.empty(0), math.log(share / (1 - share)) - 1e-9)
    share = lambda value, n: (F.sum((F.col("toxic") == value).cast("int")) + SMOOTHING) / (n + 2 * SMOOTHING)
    counted = learnt.select("toxic", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        share(1, bad).alias("p"), share(0, clean).alias("q"), F.count(F.lit(1)).alias("df")
    )
    ratio = F.log(F.col("p") / F.col("q"))
    gain = F.abs(ratio) * F.abs(F.col("p") - F.col("q"))
    top = counted.filter("df > 2").select("bucket", ratio.alias("r"), gain.alias("g")).orderBy(F.desc("g"), "bucket").limit(features)
    chosen = top.collect()  # at most `features` rows
    order = sorted((r["bucket"], r["r"]) for r in chosen)
    buckets = np.array([b for b, _ in order], dtype="int32")
    ratios = np.array([r for _, r in order])

    def narrow():
        place = np.full(BUCKETS, -1, dtype="int32")
        place[buckets] = np.arange(len(buckets))

        def keep_chosen(batch: pa.RecordBatch):
            column = batch.column("buckets")
            sizes = column.value_lengths().to_numpy()
            found = place[column.flatten().to_numpy()]
            known = found >= 0
            counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes))
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("int32"))
            places = pa.ListArray.from_arrays(ends, pa.array(found[known]))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), places], ["toxic", "places"])

        return keep_chosen

    # At most 2 * per_class rows of at most `features` places each.
    sampled = map_rows(learnt, "toxic int, places array<int>", narrow).toArrow()
    target = sampled.column("toxic").to_numpy().astype("float64")
    places = sampled.column("places").combine_chunks()
    ends = places.offsets.to_numpy()
    flat = places.values.to_numpy()[ends[0] : ends[-1]]
    owner = np.repeat(np.arange(len(target)), np.diff(ends))
    weights, intercept = fit(flat, owner, target, ratios)
    return Model(buckets, weights, intercept)


def fit(flat: np.ndarray, owner: np.ndarray, target: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression of rows that hold feature `flat[i]`, worth its ratio, in row `owner[i]`.

    Classes weigh alike, so that a rare class isn't lost. Nesterov's accelerated gradient steps.
    """
    n, m = len(target), len(ratios)
    each = np.where(target == 1, 0.5 / target.sum(), 0.5 / (n - target.sum()))
    value = ratios[flat]
    step = 4.0 / (np.bincount(owner, value**2, n).max() + 1 + 4 * RIDGE)
    w, b, w_at, b_at, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(STEPS):
        margin = b_at + np.bincount(owner, value * w_at[flat], n)
        off = each * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target)
        w_new = w_at - step * (np.bincount(flat, value * off[owner], m) + RIDGE * w_at)
        b_new = b_at - step * off.sum()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        w_at, b_at = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w * ratios, float(b)


def scorer(model: Model):
    """A function of a list of texts that gives their scores."""
    table = np.full(BUCKETS, -1, dtype="int32")
    table[model.buckets] = np.arange(len(model.buckets))

    def scores(texts: list[str]) -> list[float]:
        margin = np.full(len(texts), model.intercept)
        for start, n, keys in present(texts, table):
            owner, place = np.divmod(keys, BUCKETS)
            if len(place):
                margin[start : start + n] += np.bincount(owner, model.weights[place], n)
        return (1 / (1 + np.exp(-np.clip(margin, -50, 50)))).tolist()

    return scores


def score_column(model: Model):
    return text_column(lambda: scorer(model), "double")


def held_out():
    """True where the crc32 of doc_id, as text, leaves no remainder; a null id counts as an empty text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % FOLDS == 0


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = docs.select(F.col("doc_id").cast("long"), text_or_empty()).select(
        "doc_id", held_out().alias("held_out"), score_column(model)("text").alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with a score below 0.5, with all columns of `docs`."""
    name = spare_name(docs, "toxic_score")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn(name, score_column(model)(text)).filter(F.col(name) < 0.5).select(*docs.columns)
