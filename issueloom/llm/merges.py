"""Byte-level BPE by corpus-level merge replay.

A block of documents is a small corpus: its distinct words are laid out once as one line of symbols, and an
inverted index leads from the rank that a pair of neighbours would merge into to the positions where the
pair stands. Ranks are taken in order; each merge is applied at all its positions in the block, and only
the pairs with the touched neighbours are looked up anew. A merge never crosses a word, so how documents
are dealt to blocks can't change a result. Words met before in a task keep their ids, up to a bound.

Words are the matches of the split pattern. Texts are first cut into stretches of white space and what
follows it: no match spans two stretches, and equal stretches, the common case, are matched once.

Defined cases: null text counts as empty, with no ids; repeated rows are encoded each; an empty table gives
no rows; very long words cost their length times its logarithm; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueloom.llm.common import map_rows, text_or_empty

KEPT = 800_000
BLOCK_CHARS = 1 << 23
LONG = 64
#: Fixed set: Unicode white space, as the \\s of the split pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STRETCH = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks by token, tokens by rank, and the rank that each pair of neighbouring tokens merges into."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of = {rank: data for data, rank in ranks.items()}
        self.shared = np.arange(self.size).astype(object)  # one object per id
        self.byte_rank = np.array([ranks[bytes([i])] for i in range(256)], dtype="int64")
        splits = [
            (ranks[data[:k]] * self.size + ranks[data[k:]], rank)
            for data, rank in ranks.items()
            for k in range(1, len(data))
            if data[:k] in ranks and data[k:] in ranks
        ]
        pairs = np.array(sorted(splits), dtype="int64").reshape(-1, 2)
        self.pairs, self.pair_rank = pairs[:, 0].copy(), pairs[:, 1].copy()

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the pair doesn't merge."""
        if not len(self.pairs):
            return np.full(len(left), -1, dtype="int64")
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_rank[at], -1)

    def one(self, word: bytes) -> list[int]:
        """The ids of one word, merge by merge: always the lowest rank, leftmost first."""
        tokens = [word[i : i + 1] for i in range(len(word))]
        ranks = self.ranks.get
        heap = [(r, i) for i in range(len(tokens) - 1) if (r := ranks(tokens[i] + tokens[i + 1])) is not None]
        heapq.heapify(heap)
        after = [*range(1, len(tokens)), -1] if tokens else []
        before = list(range(-1, len(tokens) - 1))
        while heap:
            rank, at = heapq.heappop(heap)
            following = after[at]
            if not tokens[at] or following < 0 or ranks(tokens[at] + tokens[following]) != rank:
                continue
            tokens[at], tokens[following] = tokens[at] + tokens[following], b""
            beyond = after[at] = after[following]
            if beyond >= 0:
                before[beyond] = at
                if (r := ranks(tokens[at] + tokens[beyond])) is not None:
                    heapq.heappush(heap, (r, at))
            if before[at] >= 0 and (r := ranks(tokens[before[at]] + tokens[at])) is not None:
                heapq.heappush(heap, (r, before[at]))
        return [self.ranks[t] for t in tokens if t]


def distinct(places: np.ndarray) -> np.ndarray:
    places = np.sort(places)
    return places[np.append(True, places[1:] != places[:-1])] if len(places) else places


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """The ids of each word, by applying every merge to all words at once, in rank order.

    All words are one line of symbols with links to their neighbours. `where` is the inverted index: the
    positions of each pair, under the rank it merges into. After a rank is applied at all its positions,
    only the pairs beside them are looked up again. Where that order could differ from the one that a word
    alone would see (a merge opens a pair of lower rank beside it, or two positions overlap), the word is
    set aside and merged alone.
    """
    sizes = np.array([len(w) for w in words], dtype="int64")
    n = int(sizes.sum())
    owner = np.repeat(np.arange(len(words)), sizes)
    token = vocabulary.byte_rank[np.frombuffer(b"".join(words), dtype="u1")]
    # A last place stands for "no neighbour"; its token merges with nothing.
    token = np.append(token, vocabulary.size * vocabulary.size)
    inner = owner[1:] == owner[:-1] if n else np.empty(0, bool)
    after, before = np.full(n + 1, n), np.full(n + 1, n)
    at = np.flatnonzero(inner)
    after[at], before[at + 1] = at + 1, at
    pending = np.full(n + 1, -1, dtype="int64")  # the rank of the pair that begins here
    pending[at] = vocabulary.merged(token[at], token[at + 1])
    gone = np.zeros(n, dtype=bool)  # joined to the symbol before it
    alone = np.zeros(len(words), dtype=bool)
    where: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def post(places: np.ndarray) -> None:
        ranks = pending[places]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranks)], strict=True):
            rank = int(ranks[start])
            if rank not in where:
                where[rank] = []
                heapq.heappush(waiting, rank)
            where[rank].append(places[start:end])

    if len(first := np.flatnonzero(pending >= 0)):
        post(first)
    while waiting:
        rank = heapq.heappop(waiting)
        lists = where.pop(rank)
        at = np.concatenate(lists) if len(lists) > 1 else lists[0]
        at = at[pending[at] == rank]
        if len(lists) > 1:
            at = distinct(at)
        if not len(at):
            continue
        following = after[at]
        alone[owner[at[pending[following] == rank]]] = True
        beyond = after[following]
        here = np.full(len(at), rank)
        # The neighbours' tokens now, for a word in which some positions are merged and others not yet.
        right, left = token[beyond], token[before[at]]
        pending[following] = -1
        gone[following] = True
        token[at] = rank
        after[at] = beyond
        before[beyond] = at
        before[n] = n
        back = before[at]
        opened = vocabulary.merged(
            np.concatenate([here, left, here, token[back]]), np.concatenate([right, here, token[beyond], here])
        ).reshape(4, -1)
        pending[at] = opened[2]
        pending[back] = opened[3]
        pending[n] = -1
        alone[owner[at[((opened >= 0) & (opened < rank)).any(axis=0)]]] = True
        touched = np.concatenate([at, back])
        touched = touched[pending[touched] > rank]
        touched = touched[~alone[owner[touched]]]
        if len(touched):
            post(distinct(touched))
    keep = np.flatnonzero(~gone)
    ids, ends = vocabulary.shared[token[keep]].tolist(), np.searchsorted(owner[keep], np.arange(len(words) + 1)).tolist()
    found = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    for i in np.flatnonzero(alone):
        found[i] = vocabulary.shared[vocabulary.one(words[i])].tolist()
    return found


class Encoder:
    """Encodes and decodes blocks of texts. Stretches met before keep their ids, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.words = regex.compile(pattern)
        self.decimal = {i: str(i) for i in ranks.values()}
        self.known: dict[str, list[int]] = {}

    def learn(self, stretches: set[str]) -> None:
        cut = {s: self.words.findall(s) for s in stretches}
        words = list(set(chain.from_iterable(cut.values())))
        ids = dict(zip(words, replay([w.encode("utf-8", "replace") for w in words], self.vocabulary), strict=True))
        for s, ws in cut.items():
            self.known[s] = ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]]

    def block(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        if len(self.known) > KEPT:
            self.known.clear()
        cut = [STRETCH.findall(t) for t in texts]
        new = set().union(*cut) - self.known.keys()
        if new:
            self.learn(new)
        known = self.known.__getitem__
        encoded = [list(chain.from_iterable(map(known, stretches))) for stretches in cut]
        for s in new:
            if len(s) > LONG:
                del self.known[s]
        return encoded

    def decimals(self, ids: list[int]) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(ranks_file: str, pattern: str) -> Encoder:
    """One encoder per worker process, so that what it has met serves all tasks of the process."""
    return Encoder(read_ranks(ranks_file), pattern)


def blocks(texts: list[str], most: int):
    """Ranges of texts of about `most` characters together; a longer text is alone."""
    start = size = 0
    for at, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, at
            start, size = at, 0
        size += len(text)
    yield start, len(texts)


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and on request the ids.

    `ranks_file` is a path that every executor has.
    """

    def make():
        own = encoder(ranks_file, pattern)

        def encode(batch: pa.RecordBatch):
            texts = batch.column("text").to_pylist()
            for start, end in blocks(texts, BLOCK_CHARS):
                out: list[list] = [[], [], []]
                encoded = own.block(texts[start:end])
                for ids in encoded:
                    out[0].append(len(ids))
                    out[1].append(hashlib.sha256(own.decimals(ids).encode()).hexdigest())
                    out[2].append(hashlib.sha256(own.decode(ids)).hexdigest())
                columns = {
                    "doc_id": batch.column("doc_id").slice(start, end - start),
                    "n_tokens": pa.array(out[0], pa.int64()),
                    "ids_sha256": pa.array(out[1], pa.string()),
                    "decoded_sha256": pa.array(out[2], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array(encoded, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

        return encode

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    narrow = docs.select(F.col("doc_id").cast("long"), text_or_empty())
    return map_rows(narrow, schema + (", ids array<int>" if with_ids else ""), make)


def decode_documents(encoded: DataFrame, ranks_file: str) -> DataFrame:
    """doc_id and the decoded bytes of rows encoded `with_ids`."""

    def make():
        bytes_of = {rank: data for data, rank in read_ranks(ranks_file).items()}

        def decode(batch: pa.RecordBatch):
            decoded = [b"".join(map(bytes_of.__getitem__, ids)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(decoded, pa.binary())})

        return decode

    return map_rows(encoded.select("doc_id", "ids"), "doc_id long, decoded binary", make)
