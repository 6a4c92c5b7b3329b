import random
import re
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest

from issueloom.llm import phrases


def brute(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = tuple(w for w in re.split("[\x20\x09]+", piece) if w)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, words[i : i + size]) for i in range(len(words) - size + 1))
    found = defaultdict(list)
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for (lang, words), a in often.items():
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        longer = [b for (other, w), b in often.items() if other == lang and len(w) > len(words) and words in (w[:2], w[1:])]
        if all(100 * b < 50 * a for b in longer):
            found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, each in found.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(each)[:top], 1)
    )


def rows(seed=4, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Émile", "日本", "a-b", "x\x85y", "\x00", "\x1c"]
    made = []
    for i in range(n):
        text = ""
        while len(text) < rng.choice([20, 200, 1500]):
            text += rng.choice(["New York City ", "los ANGELES\t", "of the ", rng.choice(words) + rng.choice([" ", " ", " ", ", ", ".", "\n", "  "])])
        made.append((["en", "de", None, "und"][i % 4], text))
    return [*made, ("en", None), ("en", ""), (None, "..."), ("fr", "so so so so so so so so so so so so"), made[0], made[0]]


@pytest.mark.parametrize("dense, entries, top", [(1 << 19, 2_000_000, 2000), (7, 50, 2000), (1, 2_000_000, 5)])
def test_equals_brute_force(spark, dense, entries, top):
    docs = spark.createDataFrame(rows(), "lang string, text string").repartition(5)
    got = phrases.collocations(docs, dense=dense, entries=entries, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows(), top=top)


def test_odd_rows_and_clashing_columns(spark):
    got = phrases.collocations(cases.docs(spark))
    assert sorted(map(tuple, got.collect())) == brute([(r[2], r[1]) for r in cases.rows()])
    assert phrases.collocations(cases.empty(spark)).collect() == []


def test_long_texts_are_read_in_blocks_without_a_gap():
    text = "".join(random.Random(1).choice(["a ", "bb ", "ccc. ", "d,", "\t"]) for _ in range(3000)) + "x" * 500 + " end"
    [whole] = phrases.token_blocks([text])
    number = {t: i + 1 for i, t in enumerate(sorted({*whole} - {phrases.END}))} | {phrases.END: 0}
    count = lambda tokens, repeated: Counter(
        (n, *map(int, w)) for n, _, ids in phrases.windows(np.array([number[t] for t in tokens]), repeated) for w in ids.T if min(w) > 0
    )
    blocks = list(phrases.token_blocks([text, text], block=64))
    assert len(blocks) > 50
    got = Counter()
    words = Counter()
    for tokens in blocks:
        cut = tokens[0] is None
        got += count(tokens[1:] if cut else tokens, 2 if cut else 0)
        words.update(phrases._new_tokens(tokens))
    want = Counter(whole)
    assert all(words[t] == 2 * want[t] for t in want if t != phrases.END)
    full = count(whole, 0)
    assert all(got[w] == 2 * full[w] for w in full) and sum(got.values()) == 2 * sum(full.values())


def test_permutation_is_undone_and_spreads():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << phrases.KEY_BITS, 10_000).astype("u8"))
    keys = np.concatenate([keys, np.arange(5000, dtype="u8"), [phrases.MASK]])
    mixed = phrases.permute(keys)
    assert (phrases.restore(mixed) == keys).all() and (mixed <= phrases.MASK).all()
    small = phrases.permute(np.arange(1 << 16, dtype="u8")) >> np.uint64(phrases.KEY_BITS - 6)
    assert np.bincount(small.astype("int64")).max() < 1.3 * (1 << 10)


@pytest.mark.parametrize("n, range_bits", [(0, 3), (1, 3), (5000, 3), (5000, 6), (300, 0)])
def test_filters_lose_nothing(n, range_bits):
    rng = np.random.default_rng(n)
    own, want = phrases.Filter(), Counter()
    for _ in range(3):
        keys = rng.integers(0, 1 << 40, n).astype("u8")
        keys = np.concatenate([keys, np.full(700 if n else 0, 5, "u8"), keys[: n // 2]])
        own.add(keys)
        want.update(keys.tolist())
    found = Counter()
    for part, data in own.slots(range_bits):
        keys, counts = phrases.decode_slot(data)
        assert (np.diff(keys.astype("int64")) > 0).all() and (keys >> np.uint64(phrases.KEY_BITS - range_bits) == part).all()
        found.update(dict(zip(phrases.restore(keys).tolist(), counts.tolist(), strict=True)))
    assert found == want
