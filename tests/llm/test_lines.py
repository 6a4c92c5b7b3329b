import random
import re
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest

from issueloom.llm import lines

BLANK = "[\x20\x09-\x0d]"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(f"^{BLANK}+|{BLANK}+$", "", line))


def brute(rows, least_chars=40, least_docs=5):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(doc_id)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= least_docs}
    out = []
    for doc_id, text in rows:
        parts = (text or "").split("\n")
        stay = [p for p in parts if key(p) not in keeper or (doc_id is not None and keeper[key(p)] == doc_id)]
        out.append((doc_id, "\n".join(stay), len(parts), len(parts) - len(stay)))
    return Counter(out)


def rows(n=80, seed=2):
    rng = random.Random(seed)
    common = [f"Common LINE number {i} with some more words in it, ünd more" for i in range(12)] + ["é" * 39, "é" * 40, "short"]
    made = []
    for i in range(n):
        parts = [f"line {i} {j} is found in this document only, nowhere else" for j in range(rng.randrange(5))]
        parts += [f"  {c}\t" if rng.random() < 0.3 else c.upper() if rng.random() < 0.3 else c for c in rng.sample(common, rng.randrange(6))]
        parts += parts[:1]
        rng.shuffle(parts)
        made.append((i, "\n".join(parts)))
    made += [(3, "again\n" + common[0]), made[5], made[5], (None, common[0] + "\n" + common[1]), (None, None), (900, ""), (901, None), (902, "\n\n")]
    return [*made, (903, common[2] + "\x85"), (904, "\n".join(common) + "\r"), (905, common[3] + "\n" + "word " * 50_000)]


@pytest.mark.parametrize("max_lookup", [100_000, 0])
def test_equals_brute_force(spark, max_lookup):
    given = rows()
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    got = lines.dedup_lines(docs, max_lookup=max_lookup)
    assert Counter(map(tuple, got.collect())) == brute(given)


@pytest.mark.parametrize("max_lookup", [100_000, 0])
def test_odd_rows_and_clashing_columns(spark, max_lookup):
    got = lines.dedup_lines(cases.docs(spark), least_chars=3, least_docs=2, max_lookup=max_lookup)
    assert Counter(map(tuple, got.collect())) == brute([(r[0], r[1]) for r in cases.rows()], 3, 2)
    assert lines.dedup_lines(cases.empty(spark), max_lookup=max_lookup).collect() == []


def test_a_filter_that_is_too_small_costs_no_line(spark):
    given = [r for r in rows() if r[1] is not None]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    full = lines.Bloom(lines.LEAST_BITS, np.full(lines.LEAST_BITS // 8, 255, "u1"))
    everything = lines.suspects(docs, full)
    some = lines.suspects(docs, lines.twice_seen(docs, lines.LEAST_BITS))
    assert sorted(lines.confirmed(some).collect()) == sorted(lines.confirmed(everything).collect())
    assert some.count() < everything.count()


def test_merged_filters_hold_what_two_tasks_have_seen(spark):
    shared = [f"this line stands in the first and the last of the texts, {i}" for i in range(50)]
    own = [[f"this line stands in one of the texts only, in number {n}, {i}" for i in range(200)] for n in range(8)]
    texts = [(n, "\n".join(own[n] + (shared if n in (0, 7) else []))) for n in range(8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartitionByRange(8, "doc_id")
    seen = lines.twice_seen(docs, lines.LEAST_BITS)
    assert seen.holds(lines._hashes(["\n".join(shared)], 40)).all()
    assert seen.holds(lines._hashes(["\n".join(x) for x in own], 40)).mean() < 0.05
