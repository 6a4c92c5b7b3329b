"""One query per operator over the whole test tables. Their SQL, where there is any, is in `oracles`."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issueloom.llm import lines, merges, orchard, packing, phrases, pivots, quality, resample, ring, simhash, toxicity, urls, warc
from issueloom.llm.common import table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    LLM_QUERIES[build.__name__] = build
    return build


@query
def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


@query
def op2_pivot_index(spark, sf_dir):
    return pivots.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), keep=~toxicity.held_out())
    return toxicity.score_documents(docs, model)


@query
def op4_ring_shards(spark, sf_dir):
    placed = ring.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_warc_derivatives(spark, sf_dir):
    records = warc.derive(warc.responses(table(spark, sf_dir, "pages")), "page_id")
    return records.withColumn("text_sha256", F.sha2("block", 256)).drop("block")


@query
def op6_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.train(urls.labelled_by_rules(pages)))


@query
def op7_byte_bpe(spark, sf_dir):
    return merges.encode_documents(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


@query
def op8_simhash(spark, sf_dir):
    return simhash.near_components(table(spark, sf_dir, "documents"), radius=2)


@query
def op9_quality_rules(spark, sf_dir):
    return quality.judge_documents(table(spark, sf_dir, "documents"))


@query
def op10_importance_resampling(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_orchard_clustering(spark, sf_dir):
    return orchard.with_inertia(*orchard.cluster_vectors(table(spark, sf_dir, "embeddings")))


@query
def op12_line_dedup(spark, sf_dir):
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op13_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))
