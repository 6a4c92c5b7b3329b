import random
import re
from collections import Counter

import cases
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from issueloom.llm import simhash
from issueloom.llm.queries import LLM_QUERIES


def slow_print(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=2):
    """{print: smallest print reachable}"""
    low = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= radius and low[b] < low[a]:
                    low[a], changed = low[b], True
    return low


def test_masks():
    assert len(simhash.masks(2)) == 65 and len(set(simhash.masks(4))) == 1 + 64 + 2016
    with pytest.raises(ValueError):
        simhash.masks(3)


def test_documents_equal_brute_force(spark):
    given = cases.rows()
    prints = [slow_print(r[1]) for r in given]
    low = slow_components(sorted(set(prints)))
    smallest = {}
    for r, p in zip(given, prints, strict=True):
        if r[0] is not None:
            smallest[low[p]] = min(r[0], smallest.get(low[p], r[0]))
    want = Counter((r[0], f"{p:016x}", smallest.get(low[p])) for r, p in zip(given, prints, strict=True))
    for hot_rows in (simhash.HOT_ROWS, 5):
        assert Counter(map(tuple, simhash.near_components(cases.docs(spark), hot_rows=hot_rows).collect())) == want


@pytest.mark.parametrize("radius", [2, 4])
def test_links_join_exactly_the_near_ones(spark, radius):
    rng = random.Random(radius)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for _ in range(3):  # chains of flips of one to five bits
            for bit in rng.sample(range(64), rng.choice([1, 2, 2, 3, 4, 5])):
                p ^= 1 << bit
            prints.append(p)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    prints = sorted(set(prints))
    table = spark.createDataFrame([(signed(p),) for p in prints + prints[:5]], "fp long")
    got = {r.fp: r.component for r in simhash.fingerprint_groups(table, radius).collect()}
    low = slow_components(prints, radius)
    assert len(got) == len(prints)
    same = lambda of: {frozenset(p for p in prints if of(p) == of(q)) for q in prints}
    assert same(lambda p: got[signed(p)]) == same(low.get)


@pytest.mark.parametrize("hot_rows", [simhash.HOT_ROWS, 10])
def test_long_chain_and_star_settle(spark, hot_rows):
    links = spark.range(1, 70).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    star = spark.range(101, 150).select(F.lit(100).cast("long").alias("a"), F.col("id").alias("b"))
    got = {r.node: r.root for r in simhash.components(links.unionByName(star), hot_rows=hot_rows).collect()}
    assert got == {i: 0 for i in range(70)} | {i: 100 for i in range(100, 150)}


def test_one_row_of_each_group_stays_with_all_columns(spark):
    docs = cases.docs(spark)
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {r.component_id for r in simhash.near_components(docs).collect()}
    assert len(ids) == len(set(ids)) and set(ids) == want


def test_empty_table(spark):
    assert simhash.near_components(cases.empty(spark)).collect() == []
    assert simhash.one_per_component(cases.empty(spark)).collect() == []


def test_the_op8_query_has_the_radius_of_its_contract_only(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    low = slow_components(sorted({slow_print(r.text) for r in docs}))
    smallest = {}
    for r in docs:
        root = low[slow_print(r.text)]
        smallest[root] = min(r.doc_id, smallest.get(root, r.doc_id))
    got = {(r.doc_id, r.component_id) for r in LLM_QUERIES["op8_simhash"](spark, folder).collect()}
    assert got == {(r.doc_id, smallest[low[slow_print(r.text)]]) for r in docs}
