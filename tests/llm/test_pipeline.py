import zlib

import cases
import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_quality import slow_base
from test_simhash import slow_components, slow_print
from tokenizers import Tokenizer

from issueloom.llm import packing, quality, simhash, toxicity
from issueloom.llm.common import table
from issueloom.llm.oracles import LLM_ORACLES
from issueloom.llm.queries import WORD_TOKENIZER

SF = "/root/testdata/sf0.001"


def test_stages_equal_their_operators(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    left = {r.doc_id for r in toxicity.score_documents(docs, model).collect() if not r.predicted}
    docs = docs.filter(F.col("doc_id").isin(left))
    left = {r.doc_id for r in quality.judge_documents(docs).collect() if r.kept}
    docs = docs.filter(F.col("doc_id").isin(left))
    left = {r.component_id for r in simhash.near_components(docs).collect()}
    docs = docs.filter(F.col("doc_id").isin(left))
    want = packing.token_pieces(docs, WORD_TOKENIZER).select("doc_id", "piece", "start", "length", "ids_crc32")
    got = corpus_pipeline.run(spark, SF)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())
    assert 0.4 * table(spark, SF, "documents").count() < len(left)


def test_filtering_stages_keep_columns_and_bear_odd_rows(spark):
    for docs in (cases.docs(spark), cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, SF)
            assert kept.columns == docs.columns and kept.count() <= docs.count()


def folder_of(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{path}/labels.parquet")
    return str(path)


def slow_score(model, text):
    """The score of a text alone: the weights of its distinct n-grams, summed one by one."""
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    found = {b for bucket, _ in toxicity.ngram_buckets([text]) for b in bucket.tolist()}
    return 1 / (1 + np.exp(-np.clip(model.intercept + sum(weights.get(b, 0.0) for b in found), -50, 50)))


def slow_pieces(docs, capacity=4096):
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    for d in docs:
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            yield d["doc_id"], piece, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())


def test_run_equals_brute_force_with_odd_rows_and_clashing_columns(spark, tmp_path):
    odd = cases.docs(spark).withColumn("doc_id", F.col("doc_id") + 100_000)
    given = table(spark, SF, "documents")
    copies = given.filter("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 200_000)
    extra = {c: F.lit(v).cast(odd.schema[c].dataType) for c, v in zip(odd.columns[5:], cases.EXTRA, strict=True)}
    docs = given.unionByName(copies).withColumns(extra).unionByName(odd)
    folder = folder_of(spark, docs, tmp_path)
    packed = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]

    left = [r.asDict() for r in docs.collect()]
    model = toxicity.train(docs, table(spark, SF, "labels"))
    sizes = [len(left)]
    left = [d for d in left if slow_score(model, d["text"] or "") < 0.5]
    sizes.append(len(left))
    con = duckdb.connect()
    # By row, as ids repeat: the row's number stands for its id.
    columns = {"doc_id": range(len(left)), **{c: [d[c] for d in left] for c in ("text", "lang", "source")}}
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])
    con.register("documents", pa.table({c: list(v) for c, v in columns.items()}, kinds))
    verdicts = con.sql(LLM_ORACLES["op9_quality_rules"])
    kept = {r[verdicts.columns.index("doc_id")] for r in verdicts.fetchall() if r[verdicts.columns.index("kept")]}
    left = [d for i, d in enumerate(left) if i in kept]
    assert all(slow_base(d["text"])[0] >= 10 for d in left)
    sizes.append(len(left))
    prints = [slow_print(d["text"]) for d in left]
    low, first = slow_components(sorted(set(prints))), {}
    for d, p in zip(left, prints, strict=True):
        best = first.get(low[p])
        if best is None or (d["doc_id"] is None, d["doc_id"]) < (best["doc_id"] is None, best["doc_id"]):
            first[low[p]] = d
    sizes.append(len(first))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 50  # every stage takes some rows
    assert sorted(r[:5] for r in packed) == sorted(slow_pieces(first.values()))
    seats: dict[int, list] = {}
    for *_, length, _, sequence, offset in packed:
        seats.setdefault(sequence, []).append((offset, length))
    for places in seats.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]]
        assert sum(places[-1]) <= 4096
    assert (len(seats) - 1) * 4096 < sum(r[3] for r in packed) * 1.05


def test_run_of_an_empty_table(spark, tmp_path):
    done = corpus_pipeline.run(spark, folder_of(spark, cases.empty(spark), tmp_path))
    assert done.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert done.collect() == []
