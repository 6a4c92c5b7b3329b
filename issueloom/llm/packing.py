"""Best-fit packing (best-two-fit) of token pieces into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so a packing is decided by how many pieces there are of each
length. Those counts, at most `capacity` rows however large the corpus is, go to the driver. `two_fit` fills
a bin greedily, longest piece first, then puts back its smallest piece if two unpacked pieces fill the gap
more tightly, and uses the same bin again as often as the counts allow. The result is a list of runs:
"the pieces of length L from rank a to rank b go to the sequences from s on". The pieces themselves stay
distributed; each finds its run by its exact rank among the pieces of its length.

Defined cases: a null or empty text is one piece with the end id alone; repeated rows are packed as often as
they come; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from issueloom.llm.common import map_rows, ranked, text_or_empty
from issueloom.operators.durable import durable

CAPACITY = 4096
END_ID = 1
BLOCK_ROWS = 500
CHUNKS_KEPT = 1_000_000
LONG_CHUNK = 64
#: Marks that end many words, and the end of the Latin letters whose classes all Unicode versions share.
MARKS = ".,;:!?*#$%&|<>()[]{}-+=/~^_@"
LONG_MARKS = 8
LATIN_END = "\u0250"
#: Control characters that Python takes for white space and the tokenizer doesn't.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int"
PIECE_TYPES = (
    ("doc_id", pa.int64()),
    ("piece", pa.int32()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("part", pa.int32()),
)


class ChunkEncoder:
    """Token ids of a text as little-endian bytes; equal chunks between white space are encoded once.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its chunks, joined.
    """

    def __init__(self, tokenizer_file: str, kept: int = CHUNKS_KEPT):
        self.kept = kept
        self.plain = Tokenizer.from_file(tokenizer_file)
        self.plain.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}

    def _alone(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words of lower-case Latin letters, each of which is one word of the tokenizer too."""
        found = self.plain.encode(" ".join(words), add_special_tokens=False)
        data = np.array(found.ids, dtype="<u4").tobytes()
        ends = (np.flatnonzero(np.diff(np.array(found.word_ids, dtype="int64"))) + 1).tolist()
        cuts = zip([0, *ends], [*ends, len(found.ids)], strict=True)
        return dict(zip(words, [data[4 * a : 4 * b] for a, b in cuts], strict=True)) if words else {}

    def learn(self, chunks: set[str]) -> None:
        """Most chunks are a word with marks after it; they are cut, and all distinct words encoded at once.

        Words and marks are kept like chunks, as they come again with other marks and cases.
        """
        known = self.known
        plain, words, marks, rest = [], set(), set(), []
        for chunk in chunks:
            core = chunk.rstrip(MARKS)
            lower = core.lower()
            end = chunk[len(core) :]
            if lower.isalpha() and max(lower) < LATIN_END and len(lower) == len(core) <= LONG_CHUNK and len(end) <= LONG_MARKS:
                plain.append((chunk, lower, end))
                if lower not in known:
                    words.add(lower)
                if end not in known:
                    marks.add(end)
            else:
                rest.append(chunk)
        known.update(self._words(list(words)))
        for other in [*marks, *rest]:
            known[other] = self._alone(other)
        for chunk, lower, end in plain:
            known[chunk] = known[lower] + known[end]

    def block(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > self.kept:
            known.clear()
        cut = [None if any(c in t for c in SEPARATORS) else t.split() for t in texts]
        got = [None if c is None else list(map(known.get, c)) for c in cut]
        new = {c for t, g in zip(cut, got, strict=True) if t for c, ids in zip(t, g, strict=True) if ids is None}
        self.learn(new)
        ids = [
            self._alone(text) if t is None else b"".join([known[c] if i is None else i for c, i in zip(t, g, strict=True)])
            for text, t, g in zip(texts, cut, got, strict=True)
        ]
        for c in new:
            if len(c) > LONG_CHUNK:
                del known[c]
        return ids


@lru_cache(maxsize=2)
def chunk_encoder(tokenizer_file: str, kept: int = CHUNKS_KEPT) -> ChunkEncoder:
    """One encoder per worker process, so that what it has met serves all tasks of the process."""
    return ChunkEncoder(tokenizer_file, kept)


def token_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    kept: int = CHUNKS_KEPT,
) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32, part, and on request ids.

    Only documents longer than `capacity` are cut, into pieces of `capacity` tokens and a last shorter one.
    `part` is the task that made the row. A worker process keeps the ids of about `kept` chunks, some 200
    bytes each, for all its tasks; fewer cost time only.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def make():
        encoder = chunk_encoder(tokenizer_file, kept)

        def pieces(batch: pa.RecordBatch):
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                out: list[tuple] = []
                held: list[np.ndarray] = []
                doc_ids, texts, parts = (c.to_pylist() for c in batch.slice(first, BLOCK_ROWS).columns)
                for doc_id, part, ids in zip(doc_ids, parts, encoder.block(texts), strict=True):
                    whole = ids + end
                    for piece, at in enumerate(range(0, len(whole), step)):
                        cut = whole[at : at + step]
                        out.append((doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut), part))
                        if with_ids:
                            held.append(np.frombuffer(cut, "<u4").astype("int32"))
                columns = {n: pa.array(c, k) for (n, k), c in zip(PIECE_TYPES, zip(*out, strict=True), strict=True)}
                if with_ids:
                    columns["ids"] = pa.array(held, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

        return pieces

    narrow = docs.select(F.col("doc_id").cast("long"), text_or_empty(), F.spark_partition_id().alias("part"))
    return map_rows(narrow, PIECES + (", ids array<int>" if with_ids else ""), make)


def two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset, pieces per sequence).

    A run says: of the pieces of this length, those from the first rank on lie, `pieces per sequence` side
    by side from `offset` on, in sequences numbered from the first sequence on.
    """
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    unpacked = sum(1 << length for length, n in enumerate(left) if n)
    mirror = sum(1 << (capacity - length) for length, n in enumerate(left) if n)
    used = [0] * (capacity + 1)
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequence = 0

    def take(length: int, n: int) -> None:
        nonlocal unpacked, mirror
        if left[length] and left[length] == n:
            unpacked &= ~(1 << length)
            mirror &= ~(1 << (capacity - length))
        elif not left[length] and n < 0:
            unpacked |= 1 << length
            mirror |= 1 << (capacity - length)
        left[length] -= n

    def pair(least: int, room: int) -> tuple[int, int] | None:
        """The two unpacked lengths with the largest sum over `least` and up to `room`."""
        for total in range(min(room, capacity), least, -1):
            both = unpacked & (mirror >> (capacity - total))
            while both:
                long = both.bit_length() - 1
                short = total - long
                if long < short:
                    break
                if long != short or left[long] > 1:
                    return long, short
                both &= ~(1 << long)
        return None

    while unpacked:
        inside: dict[int, int] = {}
        gap = capacity
        while gap and (fits := unpacked & ((2 << gap) - 1)):
            length = fits.bit_length() - 1
            n = min(gap // length, left[length])
            take(length, n)
            inside[length] = inside.get(length, 0) + n
            gap -= n * length
        smallest = min(inside)
        if gap and sum(inside.values()) > 1 and (found := pair(smallest, gap + smallest)):
            inside[smallest] -= 1
            take(smallest, -1)
            for length in found:
                take(length, 1)
                inside[length] = inside.get(length, 0) + 1
        inside = {length: n for length, n in inside.items() if n}
        again = min(left[length] // n for length, n in inside.items())
        offset = 0
        for length in sorted(inside, reverse=True):
            n = inside[length]
            take(length, n * again)
            runs.append((length, used[length], n * (again + 1), sequence, offset, n))
            used[length] += n * (again + 1)
            offset += n * length
        sequence += again + 1
    return runs


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to a written table of pieces (columns length, part and others)."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(two_fit(counts, capacity))
    lengths = sorted(counts)
    ahead = dict(zip(lengths, accumulate([0, *(counts[x] for x in lengths)]), strict=False))
    # All pieces stand in one line by (length, rank), and each run is one stretch of it.
    stretch = np.array([(ahead[r[0]] + r[1], r[3], r[4], r[5]) for r in runs], dtype="int64").reshape(-1, 4)
    start = np.zeros(capacity + 1, dtype="int64")
    start[lengths] = [ahead[x] for x in lengths]

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size = length.to_numpy()
        at = start[size] + rank.to_numpy()
        run = stretch[np.searchsorted(stretch[:, 0], at, side="right") - 1]
        turn, side = np.divmod(at - run[:, 0], run[:, 3])
        return pd.DataFrame({"sequence_id": run[:, 1] + turn, "offset": run[:, 2] + side * size})

    rows = ranked(pieces, "length", "part", ["doc_id", "piece", "ids_crc32"], "_rank")
    return rows.withColumn("_seat", seat("length", "_rank")).select(
        *[c for c in pieces.columns if c != "part"], "_seat.sequence_id", "_seat.offset"
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    kept: int = CHUNKS_KEPT,
) -> DataFrame:
    """Pack all documents; one row per piece. The token table is written once and then only read."""
    pieces = durable(token_pieces(docs, tokenizer_file, capacity, end_id, with_ids, kept), "pieces")
    return place(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from rows made `with_ids`; a sequence is bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
