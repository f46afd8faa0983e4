"""From raw documents to packed training sequences, stage by stage.

Each stage calls one operator, works on all that the stage before it kept, and is written as a
table that the next one reads:

1. ``quality``: line-first cleaning; rejected documents go, failing lines of the others too.
2. ``near_duplicates``: one document of each near-duplicate group stays.
3. ``mixing``: documents become the copies that the mix takes, in the columns of documents; a
   copy that the mix takes in part is cut after its words.
4. ``packing``: the copies' tokens, cut into pieces of training sequences.

Defined results, in every stage: null and empty texts go in the first stage (they have no words); null ids, equal ids
and repeated rows are rows of their own, compared by their texts; very long texts are taken whole; an empty table gives
an empty one; other columns than those of documents, whatever their names, pass through until the last stage, which has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodewright.llm import common, minhash_forest, mixing, packing, quality_rules
from lodewright.llm.queries import tokenizer_path

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_forest.one_of_each_group(docs, width=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixing", source_mixing),
    ("packing", sequence_packing),
]

#: Neither MinHash signatures nor tokenizers can be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
