"""The catalogue's inputs: tables of the given data, seen as pages, regions, chunks, questions and a graph corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import tokens
from .staging import stage

KINDS = ("text", "text", "title", "list", "table", "figure")
METHODS = ("random forest", "CNN", "decision trees", "logistic regression", "graph neural networks")
METRICS = ("accuracy", "AUC", "F1 score", "recall")
DATASETS = ("Cardio", "Retina", "Genome", "Atlas9")
SEGMENTS = ("text_answerable", "visual_requiring", "multi_hop")
GOLD_WORDS = 6
MAX_BROADCAST = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], number):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as regions of one page each, from top to bottom, of all types in turn."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    box = F.struct(F.lit(0.0).alias("x"), (F.col("i") * 10.0).alias("y"), F.lit(100.0).alias("w"), F.lit(9.0).alias("h"))
    return lines.select(
        F.format_string("D%d_0#r%03d", "doc_id", "i").alias("region_id"),
        F.format_string("D%d", "doc_id").alias("doc_id"),
        F.lit("0").alias("page_id"),
        pick(KINDS, F.col("i")).alias("region_type"),
        box.alias("bbox"),
        "text",
        F.lit(None).cast("string").alias("image_path"),
        F.lit(None).cast("double").alias("ocr_confidence"),
    )


REGIONS_SQL = """regions AS (
  SELECT printf('D%d_0#r%03d', doc_id, i) AS region_id, 'D' || doc_id AS doc_id, '0' AS page_id,
    (['text', 'text', 'title', 'list', 'table', 'figure'])[i % 6 + 1] AS region_type, line AS text, i
  FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def graph_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each part, with a method, a dataset, a metric, its value and a table."""
    p = F.col("p_partkey")
    text = F.concat(
        F.lit("We train a "), pick(METHODS, p), F.lit(" on the "), pick(DATASETS, p), F.lit(" dataset; the "), pick(METRICS, F.col("p_size")),
        F.lit(" of "), F.format_string("%d.%d", p % 90 + 10, F.col("p_size") % 10), F.lit("% is given in Table "), (p % 7 + 1).cast("string"), F.lit("."),
    )
    return table(spark, sf_dir, "part").select(F.format_string("P%06d_0#r%03d", F.floor(p / 10), p % 10).alias("region_id"), text.alias("text"))


GRAPH_REGIONS_SQL = """gregions AS (
  SELECT printf('P%06d_0#r%03d', p_partkey // 10, p_partkey % 10) AS region_id,
    'We train a ' || (['random forest', 'CNN', 'decision trees', 'logistic regression', 'graph neural networks'])[p_partkey % 5 + 1] || ' on the '
    || (['Cardio', 'Retina', 'Genome', 'Atlas9'])[p_partkey % 4 + 1] || ' dataset; the ' || (['accuracy', 'AUC', 'F1 score', 'recall'])[p_size % 4 + 1]
    || ' of ' || (p_partkey % 90 + 10) || '.' || (p_size % 10) || '% is given in Table ' || (p_partkey % 7 + 1) || '.' AS text FROM part)"""


def graph_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    question = F.concat(F.lit("Which "), pick(METRICS, n), F.lit("  does a "), pick(METHODS, n), F.lit(" reach in Table "), (n % 7 + 1).cast("string"), F.lit("?"))
    return table(spark, sf_dir, "nation").select(F.format_string("Q%02d", n).alias("query_id"), question.alias("question"))


GRAPH_QUESTIONS_SQL = """gquestions AS (
  SELECT printf('Q%02d', n_nationkey) AS query_id, 'Which ' || (['accuracy', 'AUC', 'F1 score', 'recall'])[n_nationkey % 4 + 1] || '  does a '
    || (['random forest', 'CNN', 'decision trees', 'logistic regression', 'graph neural networks'])[n_nationkey % 5 + 1] || ' reach in Table ' || (n_nationkey % 7 + 1) || '?' AS question
  FROM nation)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions (query_id, question, query_type)."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.format_string("B%05d", "item_id").alias("query_id"), F.col("text").alias("question"), pick(SEGMENTS, F.col("item_id")).alias("query_type"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id) of documents that hold a benchmark passage.

    Some words of each passage are a key; windows of document words meet the benchmark by that key (in a
    broadcast join behind a check of its rows), and only documents that have one are searched for the passage itself.
    """
    part = lambda col, at: F.array_join(F.slice(col, at, GOLD_WORDS), " ")
    asked = questions(spark, sf_dir).select("query_id", "question", part(tokens(F.col("question")), F.lit(2)).alias("key"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    windows = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    keys = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("t") - GOLD_WORDS + 1)), lambda i: part(F.col("t"), i))
    windows = windows.select("doc_id", F.explode(F.array_distinct(keys)).alias("key"))
    if asked.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        asked = F.broadcast(asked)
    met = stage(windows.join(asked, "key").select("doc_id", "query_id", "question").distinct(), "gold-met")
    return met.join(docs, "doc_id").filter(F.col("text").contains(F.col("question"))).select("query_id", "doc_id").distinct()


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.format_string("D%07d", "doc_id")
    return d.select(name.alias("chunk_id"), name.alias("doc_id"), F.lit("0").alias("page_id"), "text", F.array(F.format_string("R%07d", "doc_id")).alias("source_region_ids"))


def question_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with gold regions (empty where no document holds the passage)."""
    golden = gold(spark, sf_dir).groupBy("query_id").agg(F.sort_array(F.collect_set(F.format_string("R%07d", "doc_id"))).alias("gold_region_ids"))
    q = questions(spark, sf_dir).join(golden, "query_id", "left")
    return q.select(F.col("query_id").alias("qa_id"), "question", "query_type", F.coalesce("gold_region_ids", F.array().cast("array<string>")).alias("gold_region_ids"))
