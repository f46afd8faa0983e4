"""BM25 over documents.

A query's terms are few and the corpus's are many, so postings are made for query terms only:
the tokens of each document meet the (size-checked) query terms before anything is shuffled.
Document frequency, length and average come from the same pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..staging import spread, stage
from . import checks

K1, B = 1.5, 0.75
MAX_BROADCAST = 1_000_000
#: Pairs of a query and a document that a task scores at a time, and documents that it takes at least.
TASK_PAIRS, TASK_DOCS = 1_000_000, 1000


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(id_col), F.explode(tokens(F.col(text))).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Term, number of documents that have it, and its inverse document frequency (never negative)."""
    terms = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return terms.crossJoin(F.broadcast(n)).select("term", "df", _idf().alias("idf"))  # n is one row


def _idf():
    return F.greatest(F.lit(0.0), F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Number of documents, their mean and total length in tokens: one row."""
    length = F.size(tokens(F.col(text)))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("avgdl"), F.sum(length).alias("n_tokens"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, id, score) of documents that share a term with a query of (query_id, question); repeated terms count again.

    Texts are tokenised once, into a staged table.  Documents are then dealt by their id, and with query terms that may be
    broadcast, postings and scores add up where a document lies: nothing else is shuffled.  A task holds up to all queries
    with each of its documents, so it takes fewer documents as queries grow.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = stage(asked, "lexical-terms")
    wanted = _few(asked.select("term").distinct())
    sized = stage(docs.select(F.col(id_col), tokens(F.col(text)).alias("tokens")), "lexical-tokens")
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    df = sized.select(F.explode(F.array_distinct("tokens")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = asked.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", "times", "avgdl", _idf().alias("idf"))  # stats is one row
    weighted = _few(stage(weighted, "lexical-weights"))
    rows = max(TASK_DOCS, TASK_PAIRS // max(1, asked.select("query_id").distinct().count()))
    postings = (
        spread(sized.repartition(F.col(id_col)), id_col, rows=rows, n=sized.count())
        .select(id_col, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        .join(wanted, "term", "left_semi")
        .groupBy(id_col, "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return postings.join(weighted, "term").groupBy("query_id", id_col).agg(F.sum(F.col("times") * F.col("idf") * tf).alias("score"))


def top_k(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Ranking (query_id, item_id, score, rank), ties by id.  Documents of score 0 fill it up to ``k``.

    The first ``k`` ids are enough to fill any query, so only those are added for it.
    """
    checks.positive("k", k)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.col(id_col))
    best = scores(docs, queries, id_col, text).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    best = stage(best.drop("rank"), "lexical-best")
    fill = docs.select(F.col(id_col)).orderBy(id_col).limit(2 * k)
    # A query lacks at most k items, and at most k of the first 2k ids can be among those it has.
    filled = queries.select("query_id").crossJoin(F.broadcast(fill)).join(best, ["query_id", id_col], "left_anti").withColumn("score", F.lit(0.0))
    ranked = best.unionByName(filled).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col(id_col).alias("item_id"), "score", "rank")
