"""Question sets: candidate pools, overlap filter, acceptance in a seeded order, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_overlap, question_reply
from . import models
from .fusion import seeded
from ..staging import stage

TEXT_PROMPT = "Write one question that this passage answers, as JSON with question and answer.\n\n%s"
VISUAL_PROMPT = "Write one question that this table or figure answers, as JSON with question and answer.\n\n%s"
PAIR_PROMPT = "Write one question that needs both passages, as JSON with question and answer.\n\nA: %s\n\nB: %s"


def _shuffled(seed: int, key: str) -> Column:
    return seeded(seed, F.col(key))


def text_pool(chunks: DataFrame) -> DataFrame:
    rows = chunks.filter(F.length("text") > 200)
    return rows.select(F.lit("text_answerable").alias("query_type"), F.col("chunk_id").alias("source"), "doc_id", F.col("source_region_ids").alias("gold_region_ids"), F.col("text").alias("passage"), F.format_string(TEXT_PROMPT, F.substring("text", 1, 2000)).alias("prompt"))


def visual_pool(regions: DataFrame) -> DataFrame:
    rows = regions.filter(F.col("region_type").isin("figure", "table") & (F.length("text") > 20))
    return rows.select(F.lit("visual_requiring").alias("query_type"), F.col("region_id").alias("source"), "doc_id", F.array("region_id").alias("gold_region_ids"), F.col("text").alias("passage"), F.format_string(VISUAL_PROMPT, "text").alias("prompt"))


def pair_pool(chunks: DataFrame, seed: int = 42) -> DataFrame:
    """Two chunks of each document that has as many, the first by a seeded hash."""
    order = Window.partitionBy("doc_id").orderBy(_shuffled(seed, "chunk_id"), "chunk_id")
    two = chunks.withColumn("n", F.row_number().over(order)).filter("n <= 2").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "text", "source_region_ids"))).alias("p"))
    a, b = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return two.filter(F.size("p") == 2).select(F.lit("multi_hop").alias("query_type"), F.col("doc_id").alias("source"), "doc_id", F.concat(a["source_region_ids"], b["source_region_ids"]).alias("gold_region_ids"), F.concat(a["text"], F.lit(" "), b["text"]).alias("passage"), F.format_string(PAIR_PROMPT, F.substring(a["text"], 1, 1000), F.substring(b["text"], 1, 1000)).alias("prompt"))


def accepted(pool: DataFrame, n: int, max_overlap: float = 0.6, seed: int = 42) -> DataFrame:
    """The first ``n`` questions of each type, in seeded order, whose reply parses and does not repeat its passage.

    ``pool`` has the columns of a candidate pool and ``reply``.
    """
    parsed = pool.withColumn("r", question_reply(F.col("reply"))).filter("r is not null")
    parsed = parsed.withColumn("overlap", lexical_overlap(F.col("r.question"), F.col("passage"))).filter(F.col("overlap") <= max_overlap)
    order = Window.partitionBy("query_type").orderBy(_shuffled(seed, "source"), "source")
    taken = parsed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n)
    place = F.when(F.col("query_type") == "text_answerable", 0).when(F.col("query_type") == "visual_requiring", 1).otherwise(2)
    counter = F.row_number().over(Window.orderBy(place, "n")) - 1  # at most n rows of each type
    prefix = F.when(place == 0, "text").when(place == 1, "visual").otherwise("multihop")
    return taken.select(F.format_string("%s_%04d", prefix, counter).alias("qa_id"), F.col("r.question").alias("question"), "query_type", "gold_region_ids", F.col("r.answer").alias("gold_answer"), "doc_id")


def statistics(questions: DataFrame) -> DataFrame:
    """(query_type, n, mean_gold_regions), with a row ``total``."""
    kind = F.when(F.grouping("query_type") == 1, "total").otherwise(F.col("query_type"))
    grouped = questions.rollup("query_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size("gold_region_ids")), 2).alias("mean_gold_regions"), kind.alias("kind"))
    return grouped.select(F.col("kind").alias("query_type"), "n", "mean_gold_regions")


def built(pool: DataFrame, cache: DataFrame, model: models.Model, n: int, backend: str = "stub", name: str = "stub", **options) -> tuple[DataFrame, DataFrame]:
    """Questions accepted from a model's replies to a pool's prompts, and the new cache rows."""
    asked = models.keyed(pool, backend, name)
    new = stage(models.complete(asked, cache, model, **options), "questions-replies")
    replies = cache.select("key", "reply").unionByName(new).dropDuplicates(["key"])
    return accepted(asked.join(replies, "key"), n), new
