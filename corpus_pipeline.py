"""The corpus pipeline: toxicity, quality rules, SimHash near-dedup, best-fit packing.

A stage gets what its predecessor kept, reread from Parquet. All but the last return the columns of their
input; the last returns the packed pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from issueloom.llm import packing, quality, simhash, toxicity
from issueloom.llm.common import table
from issueloom.llm.queries import WORD_TOKENIZER
from issueloom.operators.durable import durable


#: Chunks whose ids a worker process keeps. Its memory stays with it while other stages run.
CHUNKS_KEPT = 150_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model of all labelled documents."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_odd(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the base rules and the fences of their language and source."""
    return quality.without_odd(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of fingerprints that few bits part (those of op8)."""
    return simhash.one_per_component(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, packed into sequences."""
    return packing.pack_documents(docs, WORD_TOKENIZER, kept=CHUNKS_KEPT)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_odd),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]
#: No SQL: a fitted classifier, XXH64 and a tokenizer have no counterpart there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
