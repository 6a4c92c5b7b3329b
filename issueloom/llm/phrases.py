"""Phrase collocations, counted in counting quotient filters.

Words that occur `least` times in their language make up the vocabulary, since no phrase is more frequent
than its words. The `dense` most frequent ones, a bounded number, get ids of ID_BITS bits and are broadcast. A
phrase of up to three such words packs into one number of KEY_BITS bits. `permute` maps these numbers onto
themselves, invertibly, so that they spread evenly whatever the words are. The leading bits of a permuted
number are its quotient, the others its remainder, kept in full: so a filter is lossless, and holds for each
quotient the length of its run, and for each entry the remainder and a counter.

A task adds its phrases to a sorted filter and gives it out in slots of quotients, whenever it has `entries`
entries and at its end. Slots of one range are shuffled together, and merged as sorted lists are. As the
permutation spreads the phrases, ranges are equally large, and a frequent phrase is one entry per filter.

Phrases with a word of the vocabulary that is not among the dense ones are counted by their text, in an
ordinary aggregation. There are none while the vocabulary has at most `dense` words.

Scores, the choice among longer phrases and the ranking are joins, aggregations and windows over the phrases
that are frequent enough. Products are decimals of 38 digits.

Defined cases: null text counts as empty, null lang as `und`; repeated rows count as often as they come; the
white space and marks that end words and pieces are ASCII, all other characters belong to words; a text of any
length is read in blocks that overlap by two words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issueloom.llm.common import text_or_empty
from issueloom.operators.durable import counted, durable
from issueloom.operators.skew import salted_join

LEAST = 10
LONGEST = 3
TOP = 2_000
COVER = 50
SCALE = 1_000_000
NO_LANG = "und"
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: No word holds it, as it ends pieces.
END = b"."
ID_BITS = 20
KEY_BITS = ID_BITS * LONGEST
DENSE = 1 << 19
ENTRIES = 2_000_000
WORDS_KEPT = 300_000
BLOCK = 1 << 20
#: Words of the corpus for each range of the shuffle, the least number of ranges, and entries per slot.
RANGE_WORDS = 1 << 20
LEAST_RANGES = 64
SLOT = 1024
SALTS = 64

MASK = np.uint64((1 << KEY_BITS) - 1)
#: Odd numbers, whose products are invertible, and a shift of at least half the bits, which undoes itself.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SHIFT = np.uint64(KEY_BITS // 2 + 1)


def permute(keys: np.ndarray) -> np.ndarray:
    """A one-to-one map of the numbers of KEY_BITS bits."""
    for factor in FACTORS:
        keys = (keys * np.uint64(factor)) & MASK
        keys = keys ^ (keys >> SHIFT)
    return keys


def restore(keys: np.ndarray) -> np.ndarray:
    """What `permute` has mapped to `keys`."""
    for factor in reversed(FACTORS):
        keys = keys ^ (keys >> SHIFT)
        keys = (keys * np.uint64(pow(factor, -1, 1 << KEY_BITS))) & MASK
    return keys


def _pack_numbers(values: np.ndarray) -> bytes:
    """Counters of a byte each; 255 says that the next of the long ones at the end holds the value."""
    long = values[values >= 255].astype("<u8")
    return len(long).to_bytes(4, "little") + np.minimum(values, 255).astype("u1").tobytes() + long.tobytes()


def _unpack_numbers(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    n_long = int.from_bytes(data[at : at + 4], "little")
    values = np.frombuffer(data, "u1", n, at + 4).astype("u8")
    end = at + 4 + n
    values[values == 255] = np.frombuffer(data, "<u8", n_long, end)
    return values, end + 8 * n_long


def encode_slot(keys: np.ndarray, counts: np.ndarray, slot: int, slot_bits: int) -> bytes:
    """The filter of the sorted permuted keys whose leading `slot_bits` are `slot`."""
    width = KEY_BITS - slot_bits
    quotient_bits = min(width, max(0, len(keys).bit_length() - 1))
    rest_bits = width - quotient_bits
    inside = keys & np.uint64((1 << width) - 1)
    runs = np.bincount((inside >> np.uint64(rest_bits)).astype("int64"), minlength=1 << quotient_bits)
    rest = (inside & np.uint64((1 << rest_bits) - 1)).astype("<u8")
    size = -(-rest_bits // 8)
    head = bytes([slot_bits, quotient_bits]) + slot.to_bytes(8, "little") + len(keys).to_bytes(4, "little")
    return head + _pack_numbers(runs) + rest.view("u1").reshape(-1, 8)[:, :size].tobytes() + _pack_numbers(counts)


def decode_slot(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted permuted keys of a filter, and their counts."""
    slot_bits, quotient_bits = data[0], data[1]
    slot, n = int.from_bytes(data[2:10], "little"), int.from_bytes(data[10:14], "little")
    rest_bits = KEY_BITS - slot_bits - quotient_bits
    runs, at = _unpack_numbers(data, 14, 1 << quotient_bits)
    size = -(-rest_bits // 8)
    wide = np.zeros((n, 8), dtype="u1")
    wide[:, :size] = np.frombuffer(data, "u1", n * size, at).reshape(n, size)
    counts, _ = _unpack_numbers(data, at + n * size, n)
    quotient = np.repeat(np.arange(1 << quotient_bits, dtype="u8"), runs.astype("int64"))
    lead = np.uint64(slot << (KEY_BITS - slot_bits))
    return lead | (quotient << np.uint64(rest_bits)) | wide.view("<u8").ravel(), counts


def merge_sorted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of sorted lists of (keys, counts); counts of equal keys are added."""
    keys = np.concatenate([k for k, _ in parts]) if parts else np.empty(0, "u8")
    counts = np.concatenate([c for _, c in parts]) if parts else np.empty(0, "u8")
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, "int64")
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Filter:
    """A counting quotient filter that grows in memory: permuted keys, added block by block."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        single, times = np.unique(permute(keys), return_counts=True)
        self.merge(single, times.astype("u8"))

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def settle(self) -> int:
        """Merge what was added; gives the number of entries."""
        if len(self.parts) > 1:
            self.parts = [merge_sorted(self.parts)]
        self.size = sum(len(k) for k, _ in self.parts)
        return self.size

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        return self.parts[0] if self.parts else (np.empty(0, "u8"), np.empty(0, "u8"))

    def slots(self, range_bits: int) -> Iterator[tuple[int, bytes]]:
        """(range, filter) of slots of about SLOT entries; a range is one slot or more."""
        keys, counts = self.entries()
        if not len(keys):
            return
        slot_bits = min(KEY_BITS, max(range_bits, (len(keys) // SLOT).bit_length()))
        of = keys >> np.uint64(KEY_BITS - slot_bits)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            slot = int(of[a])
            yield slot >> (slot_bits - range_bits), encode_slot(keys[a:b], counts[a:b], slot, slot_bits)


def token_blocks(texts: list[str], block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of the texts, lower-cased, with END between pieces and texts, in blocks of about `block` bytes.

    A block of a text that is cut begins with None and the LONGEST - 1 tokens before it, END at the start.
    """
    spaced = b" " + END + b" "
    ends = bytes.maketrans(ENDS, END * len(ENDS))
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = text.encode("utf-8", "replace").lower().translate(ends).replace(END, spaced)
        if size and size + len(data) > block:
            yield b" . ".join(held).split()
            held, size = [], 0
        if len(data) <= 2 * block:
            held.append(data)
            size += len(data)
            continue
        at, carried = 0, [END] * (LONGEST - 1)
        while at < len(data):
            cut = data.find(b" ", min(len(data), at + block))
            cut = len(data) if cut < 0 else cut
            tokens = data[at:cut].split()
            yield [None, *carried, *tokens]
            carried, at = [*carried, *tokens][1 - LONGEST :], cut
    if held:
        yield b" . ".join(held).split()


def _by_lang(batch: pa.RecordBatch, rows: int = 1_000) -> Iterator[tuple[str, list[str]]]:
    for at in range(0, batch.num_rows, rows):
        texts: dict[str, list[str]] = {}
        part = batch.slice(at, rows)
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        yield from texts.items()


def _new_tokens(tokens: list[bytes]) -> list[bytes]:
    """Without the ones that a block repeats from the block before it."""
    return tokens[LONGEST:] if tokens and tokens[0] is None else tokens


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, n): the occurrences of every word in its language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            found = [(lang, w, n) for lang, words in own.items() for w, n in words.items() if w != END]
            own.clear()
            langs, words, times = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array([w.decode() for w in words], pa.string()), pa.array(times, pa.int64())], ["lang", "word", "n"]
            )

        for batch in batches:
            for lang, block in _by_lang(batch):
                for tokens in token_blocks(block):
                    own.setdefault(lang, Counter()).update(_new_tokens(tokens))
                if sum(map(len, own.values())) > WORDS_KEPT:
                    yield out()
        yield out()

    partial = texts.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def windows(ids: np.ndarray, repeated: int, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length from 2 on: where its windows start, and their ids side by side.

    Windows that lie in the first `repeated` tokens only are left out.
    """
    for n in range(2, longest + 1):
        if len(ids) >= n:
            start = np.arange(max(0, repeated - n + 1), len(ids) - n + 1)
            yield n, start, np.stack([ids[start + i] for i in range(n)])


def count_phrases(texts: DataFrame, vocabulary: dict[str, dict[bytes, int]], range_bits: int, entries: int = ENTRIES, with_rest: bool = False) -> DataFrame:
    """Rows (range, filter) of dense phrases and, `with_rest`, rows (lang, phrase, n) of the others."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rest, known = Filter(), Counter(), shared.value

        def out(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal own
            if own.size > entries and own.settle() > entries // 2 or final:
                slots = list(own.slots(range_bits))
                own = Filter()
                for at in range(0, len(slots), SLOT):
                    some = slots[at : at + SLOT]
                    none = pa.nulls(len(some), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r for r, _ in some], pa.int32()), pa.array([f for _, f in some], pa.binary()), none, none, pa.nulls(len(some), pa.int64())],
                        ["range", "filter", "lang", "phrase", "n"],
                    )
            if len(rest) > WORDS_KEPT or final and rest:
                found = list(rest.items())
                rest.clear()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(len(found), pa.int32()),
                        pa.nulls(len(found), pa.binary()),
                        pa.array([k[0] for k, _ in found], pa.string()),
                        pa.array([k[1].decode() for k, _ in found], pa.string()),
                        pa.array([n for _, n in found], pa.int64()),
                    ],
                    ["range", "filter", "lang", "phrase", "n"],
                )

        for batch in batches:
            for lang, block in _by_lang(batch):
                number = known.get(lang, {END: 0}).get
                for tokens in token_blocks(block):
                    repeated = LONGEST - 1 if tokens and tokens[0] is None else 0
                    tokens = tokens[1:] if repeated else tokens
                    ids = np.array([number(t, -1) for t in tokens], dtype="int64")  # END has id 0
                    for n, start, ids_of in windows(ids, repeated):
                        low = ids_of.min(axis=0)
                        dense = ids_of[:, low > 0].astype("u8")
                        key = np.zeros(dense.shape[1], dtype="u8")
                        for i in range(LONGEST):
                            key = (key << np.uint64(ID_BITS)) | (dense[i] if i < n else np.uint64(0))
                        own.add(key)
                        if with_rest:
                            for at in start[(low < 0) & (ids_of != 0).all(axis=0)]:
                                rest[lang, b" ".join(tokens[at : at + n])] += 1
                    yield from out(final=False)
        yield from out(final=True)

    return texts.select("lang", "text").mapInArrow(count, "range int, filter binary, lang string, phrase string, n long")


def merge_filters(slots: DataFrame, names: list[tuple[str, str]], ranges: int, least: int = LEAST) -> DataFrame:
    """(lang, phrase, n) of the phrases with `least` occurrences, from rows (range, filter) of all tasks.

    `names` has language and word of each id, from 1 on.
    """
    shared = slots.sparkSession.sparkContext.broadcast(names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        last, own, settled = None, Filter(), 0

        def frequent() -> pa.RecordBatch:
            keys, counts = own.entries()
            often = counts >= least
            packed, times = restore(keys[often]), counts[often].astype("int64")
            at = np.stack([(packed >> np.uint64(ID_BITS * i)) & np.uint64((1 << ID_BITS) - 1) for i in reversed(range(LONGEST))])
            ids = at.T.astype("int64").tolist()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([known[r[0] - 1][0] for r in ids], pa.string()),
                    pa.array([" ".join(known[i - 1][1] for i in r if i) for r in ids], pa.string()),
                    pa.array(times, pa.int64()),
                ],
                ["lang", "phrase", "n"],
            )

        for batch in batches:
            for k, data in zip(batch.column("range").to_pylist(), batch.column("filter").to_pylist(), strict=True):
                if k != last:
                    if last is not None:
                        yield frequent()
                    last, own, settled = k, Filter(), 0
                own.merge(*decode_slot(data))
                if own.size > 2 * settled + ENTRIES:
                    settled = own.settle()
        if last is not None:
            yield frequent()

    dealt = slots.repartition(ranges, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(merge, "lang string, phrase string, n long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, dense: int = DENSE, entries: int = ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases of one to three words with `least` occurrences, and (lang, n) of all words."""
    if dense >= 1 << ID_BITS:
        raise ValueError(f"at most {(1 << ID_BITS) - 1} words can be dense")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), text_or_empty())
    words, total = counted(count_words(texts), "words", F.sum("n"))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary, n_words = counted(words.filter(F.col("n") >= least), "vocabulary")
    top = vocabulary.orderBy(F.desc("n"), "lang", "word").limit(dense).select("lang", "word").toArrow()  # bounded by `dense`
    names = list(zip(top["lang"].to_pylist(), top["word"].to_pylist(), strict=True))
    numbers: dict[str, dict[bytes, int]] = {}
    for at, (lang, word) in enumerate(names):
        numbers.setdefault(lang, {END: 0})[word.encode()] = at + 1
    ranges = 1 << max(LEAST_RANGES, total // RANGE_WORDS).bit_length() - 1
    with_rest = n_words > len(names)
    made = count_phrases(texts, numbers, ranges.bit_length() - 1, entries, with_rest)
    if with_rest:
        made = durable(made, "phrase-filters")
    found = merge_filters(made.filter("range IS NOT NULL").select("range", "filter"), names, ranges, least)
    if with_rest:
        rest = made.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        found = found.unionByName(rest.filter(F.col("n") >= least))
    return durable(found.unionByName(vocabulary.withColumnRenamed("word", "phrase")), "phrases"), sizes


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more, by the cut that scores least."""
    words = F.split("phrase", " ")
    long = phrases.withColumn("words", words).filter("size(words) > 1").withColumnRenamed("n", "a")
    cuts = long.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("rest"),
    )
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = salted_join(cuts, part("first", "l"), ["lang", "first"], "inner", ["phrase", "k"])
    both = salted_join(both, part("rest", "r"), ["lang", "rest"], "inner", ["phrase", "k"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    share = (F.lit(SCALE).cast("decimal(7,0)") * (wide("a") * wide("a"))).cast("decimal(38,0)")
    whole = both.withColumn("product", share).withColumn("base", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cut = whole.withColumn("score", F.expr("cast(product div base AS long)"))
    return (
        cut.groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )


def uncovered(phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """The phrases without those that lie in a longer one with `cover` percent of their occurrences."""
    sized = phrases.withColumn("words", F.split("phrase", " "))
    n = F.size("words")
    spans = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), "
        "i -> array_join(slice(words, i, m), ' '))))"
    )
    inner = (
        sized.filter(n > 2)
        .select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    stays = F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))
    return phrases.join(inner, ["lang", "phrase"], "left").filter(stays).drop("longer")


def best(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """Add `rank`, from 1, and keep the first `top` of each language.

    Phrases of a language are cut in SALTS parts first, so that a large language doesn't meet in one task.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    first = phrases.withColumn("salt", salt).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    return first.drop("salt").withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, dense: int = DENSE, entries: int = ENTRIES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of two or three words of each language."""
    phrases, sizes = frequent_phrases(docs, least, dense, entries)
    kept = best(uncovered(durable(scored(phrases), "scored-phrases")), top)
    # A row per language on the right; the left has `top` rows of each.
    return kept.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
