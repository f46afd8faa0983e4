"""Evidence lines, prompts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NO_EVIDENCE, stub_answer

PROMPT = (
    "Use only the evidence below to answer.\n\n%s\n\nQuestion: %s\n\n"
    "Answer in at most three sentences and cite evidence by its id in brackets, as in [%s]. "
    "If the evidence does not say, reply exactly: " + NO_EVIDENCE + "\n\nAnswer:"
)


def text_lines(ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, part, rank, line) of ranked chunks; unknown ids are left out."""
    known = ranking.join(chunks.select(F.col("chunk_id").alias("item_id"), "text"), "item_id")
    return known.select("query_id", F.lit(0).alias("part"), "rank", F.concat(F.lit("["), F.col("item_id"), F.lit("] (text) "), F.col("text")).alias("line"))


def visual_lines(ranking: DataFrame, regions: DataFrame) -> DataFrame:
    """(query_id, part, rank, line) of ranked regions: id, type, page and text, or a note of the type without text."""
    known = ranking.join(regions.select(F.col("region_id").alias("item_id"), "region_type", "page_id", "doc_id", "text"), "item_id")
    shown = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.concat("region_type", F.lit(" region")))
    line = F.format_string("[%s] (%s on page %s of %s) %s", "item_id", "region_type", "page_id", "doc_id", shown)
    return known.select("query_id", F.lit(1).alias("part"), "rank", line.alias("line"))


def graph_lines(descriptions: DataFrame) -> DataFrame:
    told = descriptions.filter(~F.col("description").contains("no graph relations"))
    line = F.concat(F.lit("[knowledge_graph] Structured relations:\n"), F.col("description"))
    return told.select("query_id", F.lit(2).alias("part"), F.lit(1).alias("rank"), line.alias("line"))


def prompts(queries: DataFrame, lines: DataFrame) -> DataFrame:
    """(query_id, question, evidence, prompt); both are null for a query without evidence."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", "rank", "line"))), lambda x: x["line"])
    joined = lines.groupBy("query_id").agg(ordered.alias("lines"))
    joined = joined.select("query_id", F.array_join("lines", "\n\n").alias("evidence"), F.regexp_extract(F.get("lines", F.lit(0)), r"^\[([^\[\]]+)\]", 1).alias("example"))
    out = queries.join(joined, "query_id", "left")
    prompt = F.format_string(PROMPT.replace("%s", "%s"), "evidence", "question", F.coalesce(F.nullif(F.col("example"), F.lit("")), F.lit("id")))
    return out.select("query_id", "question", "evidence", F.when(F.col("evidence").isNotNull(), prompt).alias("prompt"))


def stub_answers(asked: DataFrame, responses: dict[str, str] | None = None) -> DataFrame:
    """Answers of the offline model; a query without evidence is refused without asking."""
    return asked.withColumn("answer", F.when(F.col("prompt").isNull(), F.lit(NO_EVIDENCE)).otherwise(F.trim(stub_answer(F.col("prompt"), responses))))
