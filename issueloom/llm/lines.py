"""Line dedup: lines that many documents share stay in one of them only.

A line's key is the line stripped of ASCII white space, with A-Z lower-cased. Keys of at least `least_chars`
characters that `least_docs` documents or more hold are repeats; their lines are dropped, but in the
document with the largest doc_id. The work is done in three passes over the texts:

1. Each task fills two Bloom filters with the hashes of its keys: `once`, and `twice` for hashes that `once`
   already holds. The pairs of all tasks are merged piece by piece: a bit is set in the merged `twice` if it is
   set in one `twice`, or in two of the `once`. So a key of two documents is always in `twice`.
2. Keys in `twice` are suspects. Only they are shuffled, as (doc_id, sha256), and counted exactly: documents
   that hold them, and the largest doc_id.
3. The texts drop the lines of confirmed keys. Up to `max_lookup` of these are broadcast, after they were
   counted; more of them are joined to the suspects, and the drops of a text to the text.

The filters have 8 bits for each line that the texts can hold, between LEAST_BITS and `max_bits`. Where
`max_bits` is too few, more keys are suspects and are shuffled; the result is the same. As many filter pairs
are made as the session has cores, however many files there are.

Defined cases: a null or empty text is one empty line; a doc_id that several rows repeat is one document, and
keeps its lines in all of these rows; a null doc_id is one document too, and smaller than all others; repeated
lines of one document count once and share their fate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from issueloom.llm.common import map_rows, text_or_empty
from issueloom.operators.durable import counted, durable
from issueloom.operators.skew import salted_join

LEAST_CHARS = 40
LEAST_DOCS = 5
BLANKS = b" \t\x0b\x0c\r"
LEAST_BITS = 1 << 18
MAX_BITS = 1 << 28
HASHES = 4
SEGMENT = 4096
MAX_LOOKUP = 100_000


def keys_of(text: str, least_chars: int = LEAST_CHARS) -> list[bytes | None]:
    """The key of each line; None for a line that is too short to be a repeat."""
    found: list[bytes | None] = []
    for line in text.encode("utf-8", "replace").lower().split(b"\n"):  # of bytes: only A-Z
        key = line.strip(BLANKS)
        if len(key) < least_chars or (not key.isascii() and len(key.decode()) < least_chars):
            found.append(None)
        else:
            found.append(key)
    return found


class Bloom:
    """A Bloom filter of 64-bit hashes, with a power of two of bits."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, dtype="u1") if data is None else data

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The bits of each hash: HASHES steps of its odd upper half from its lower half on."""
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        turns = np.arange(HASHES, dtype="u8")[:, None]
        return (hashes + turns * step) & np.uint64(self.bits - 1)

    def add(self, hashes: np.ndarray) -> None:
        at = self.places(hashes).ravel()
        np.bitwise_or.at(self.data, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype("u1"))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1") & 1).all(axis=0)


class Pair:
    """The two filters of a task."""

    def __init__(self, bits: int):
        self.once, self.twice = Bloom(bits), Bloom(bits)

    def add(self, hashes: np.ndarray) -> None:
        single, times = np.unique(hashes, return_counts=True)
        self.twice.add(single[(times > 1) | self.once.holds(single)])
        self.once.add(single)


def _hashes(texts: list[str], least_chars: int) -> np.ndarray:
    """The hashes of the keys of the texts; a key that a text repeats comes once for it."""
    return np.array([xxh64_intdigest(k) for t in texts for k in set(keys_of(t, least_chars)) if k is not None], dtype="u8")


def filter_bits(texts: DataFrame, least_chars: int, max_bits: int) -> int:
    """Bits for all lines that texts of this size can hold."""
    most = texts.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    wanted = 8 * most // (least_chars + 1)
    return max(LEAST_BITS, min(max_bits, 1 << wanted.bit_length()))


def twice_seen(texts: DataFrame, bits: int, least_chars: int = LEAST_CHARS) -> Bloom:
    """The merged filter of the keys that two documents or more may hold."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pair(bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                own.add(_hashes(batch.column("text").slice(at, 500).to_pylist(), least_chars))
        once, twice = own.once.data.reshape(-1, SEGMENT), own.twice.data.reshape(-1, SEGMENT)
        used = np.flatnonzero(once.any(axis=1))
        for some in np.array_split(used, max(1, len(used) // 256)):
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array(some.astype("int32")),
                    "once": pa.array([once[i].tobytes() for i in some], pa.binary()),
                    "twice": pa.array([twice[i].tobytes() for i in some], pa.binary()),
                }
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by segment."""
        last, once, twice = None, None, None
        for batch in batches:
            done: list[tuple[int, bytes]] = []
            for segment, a, b in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True):
                a, b = np.frombuffer(a, "u1"), np.frombuffer(b, "u1")
                if segment == last:
                    twice |= b | (once & a)
                    once |= a
                else:
                    if last is not None:
                        done.append((last, twice.tobytes()))
                    last, once, twice = segment, a.copy(), b.copy()
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int32()), pa.array([d for _, d in done], pa.binary())], ["segment", "twice"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["segment", "twice"])

    cores = texts.sparkSession.sparkContext.defaultParallelism
    parts = texts.select("text").coalesce(cores).mapInArrow(build, "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    found = merged.toArrow()  # max_bits / 8 bytes at most
    data = np.zeros((bits // 8 // SEGMENT, SEGMENT), dtype="u1")
    for segment, part in zip(found["segment"].to_pylist(), found["twice"].to_pylist(), strict=True):
        data[segment] = np.frombuffer(part, "u1")
    return Bloom(bits, data.ravel())


def suspects(texts: DataFrame, seen: Bloom, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Distinct (doc_id, digest) of the keys that the filter holds."""
    shared = texts.sparkSession.sparkContext.broadcast(seen.data)
    bits = seen.bits

    def make():
        twice = Bloom(bits, shared.value)

        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                pairs = [
                    (doc_id, key)
                    for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)
                    for key in set(keys_of(text, least_chars))
                    if key is not None
                ]
                held = twice.holds(np.array([xxh64_intdigest(k) for _, k in pairs], dtype="u8")).tolist()
                kept = [(doc_id, hashlib.sha256(key).digest()) for (doc_id, key), h in zip(pairs, held, strict=True) if h]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in kept], pa.int64()), pa.array([k for _, k in kept], pa.binary())], ["doc_id", "digest"]
                )

        return step

    return map_rows(texts.select("doc_id", "text"), "doc_id long, digest binary", make).distinct()


def confirmed(suspected: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(digest, keeper) of the keys that enough documents hold. Counted before the shuffle, so none is hot."""
    found = suspected.groupBy("digest").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
    return found.filter(F.col("docs") >= least_docs).select("digest", "keeper")


KEPT = "doc_id long, text string, n_lines long, n_dropped long"


def _kept_batch(ids: list, texts: list[str], drops) -> pa.RecordBatch:
    """`drops(doc_id, place, key)` tells whether a line goes."""
    kept, sizes, gone = [], [], []
    for at, (doc_id, text, (keys, drop)) in enumerate(zip(ids, texts, drops, strict=True)):
        lines = text.split("\n")
        stay = [line for line, key in zip(lines, keys, strict=True) if key is None or not drop(key)]
        kept.append(text if len(stay) == len(lines) else "\n".join(stay))
        sizes.append(len(lines))
        gone.append(len(lines) - len(stay))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())],
        ["doc_id", "text", "n_lines", "n_dropped"],
    )


def _drop_by_lookup(texts: DataFrame, repeats: DataFrame, least_chars: int) -> DataFrame:
    """With the confirmed keys, a counted number, in every task. No text is shuffled."""
    rows = repeats.toArrow()
    keepers = dict(zip(rows["digest"].to_pylist(), rows["keeper"].to_pylist(), strict=True))
    shared = texts.sparkSession.sparkContext.broadcast(keepers)

    def make():
        known = shared.value

        def drop_for(doc_id):
            def drop(key: bytes) -> bool:
                digest = hashlib.sha256(key).digest()
                return digest in known and known[digest] != doc_id

            return drop

        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 500):
                ids, bodies = (c.to_pylist() for c in batch.slice(at, 500).columns)
                yield _kept_batch(ids, bodies, [(keys_of(t, least_chars), drop_for(d)) for d, t in zip(ids, bodies, strict=True)])

        return step

    return map_rows(texts.select("doc_id", "text"), KEPT, make)


def _drop_by_join(texts: DataFrame, suspected: DataFrame, repeats: DataFrame, least_chars: int) -> DataFrame:
    """With the digests to drop joined to each row. Equal rows share theirs, so a repeated one costs little."""
    text_key = F.struct("doc_id", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size")).alias("row")
    bad = salted_join(suspected, repeats, ["digest"], "inner", ["doc_id"]).filter("doc_id IS NULL OR doc_id != keeper")
    keyed = durable(texts.select("doc_id", "text", text_key), "line-texts")

    def make():
        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [
                    (row, hashlib.sha256(key).digest())
                    for row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True)
                    for key in set(keys_of(text, least_chars))
                    if key is not None
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["doc_id"] for r, _ in made], pa.int64()),
                        pa.array([r["hash"] for r, _ in made], pa.int64()),
                        pa.array([r["size"] for r, _ in made], pa.int32()),
                        pa.array([d for _, d in made], pa.binary()),
                    ],
                    ["doc_id", "hash", "size", "digest"],
                )

        return step

    # Only texts of documents with a bad line are asked, and their lines meet the bad ones of their own document.
    owners = bad.select(F.struct("doc_id").alias("owner")).distinct()
    asked = salted_join(keyed.withColumn("owner", F.struct("doc_id")), owners, ["owner"], "inner", ["row"])
    held = map_rows(asked.select("row", "text"), "doc_id long, hash long, size int, digest binary", make).distinct()
    pair = lambda df: df.withColumn("line", F.struct("doc_id", "digest")).drop("doc_id", "digest")
    met = salted_join(
        held.select(F.struct("doc_id", "digest").alias("line"), F.struct("doc_id", "hash", "size").alias("row"), "digest"),
        pair(bad.select("doc_id", "digest")).distinct(),
        ["line"],
        "inner",
        ["row"],
    )
    drops = met.groupBy("row").agg(F.collect_set("digest").alias("drops"))  # as many as the text has lines, at most
    both = salted_join(keyed.withColumn("n", F.monotonically_increasing_id()), drops, ["row"], "left", ["n"])

    def finish():
        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 500):
                ids, bodies, gone = (c.to_pylist() for c in batch.slice(at, 500).columns)
                sets = [set(g or ()) for g in gone]
                yield _kept_batch(
                    ids,
                    bodies,
                    [(keys_of(t, least_chars), lambda k, s=s: bool(s) and hashlib.sha256(k).digest() in s) for t, s in zip(bodies, sets, strict=True)],
                )

        return step

    return map_rows(both.select("doc_id", "text", "drops"), KEPT, finish)


def dedup_lines(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    max_bits: int = MAX_BITS,
    max_lookup: int = MAX_LOOKUP,
) -> DataFrame:
    """doc_id, text without the repeated lines, n_lines before and n_dropped of every row."""
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty())
    seen = twice_seen(texts, filter_bits(texts, least_chars, max_bits), least_chars)
    suspected = durable(suspects(texts, seen, least_chars), "suspects")
    repeats, n = counted(confirmed(suspected, least_docs), "repeats")
    if n <= max_lookup:
        return _drop_by_lookup(texts, repeats, least_chars)
    return _drop_by_join(texts, suspected, repeats, least_chars)
