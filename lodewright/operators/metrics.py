"""Retrieval and answer metrics, per question and by segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checks
from .lexical import _few


def per_question(log: DataFrame, k_values: Sequence[int] = (1, 3, 5, 10), keys: Sequence[str] = ("system", "qa_id", "query_type")) -> DataFrame:
    """Scores of each row of a log with arrays gold_region_ids and retrieved_region_ids.

    recall: share of distinct gold in the first k; precision: hits over what was returned in the first k;
    ndcg: binary gain against the best order; rr: 1 / rank of the first hit at any depth.
    """
    for k in k_values:
        checks.positive("k", k)
    got = F.coalesce("retrieved_region_ids", F.array().cast("array<string>"))
    rows = log.select(*keys, F.array_distinct(F.coalesce("gold_region_ids", F.array().cast("array<string>"))).alias("gold"), got.alias("got"))
    rows = rows.withColumn("hits", F.expr("transform(got, (x, i) -> IF(array_contains(gold, x), i + 1, 0))"))
    rows = rows.withColumn("ranks", F.filter("hits", lambda h: h > 0))
    n_gold = F.size("gold")
    out = [*keys, n_gold.cast("long").alias("n_gold"), F.when(F.size("ranks") > 0, 1.0 / F.array_min("ranks")).otherwise(0.0).alias("rr")]


    def within(k: int):
        return F.filter("ranks", lambda h: h <= k)

    for k in k_values:
        top = F.slice("got", 1, k)
        found = F.size(F.array_intersect(F.array_distinct(top), F.col("gold")))
        shown = within(k)
        gain = F.aggregate(shown, F.lit(0.0), lambda s, h: s + 1.0 / F.log2(h + 1.0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(n_gold, F.lit(k))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
        out += [
            F.when(n_gold > 0, found / n_gold).otherwise(0.0).alias(f"recall_{k}"),
            F.when(F.size("got") > 0, F.size(shown) / F.size(top)).otherwise(0.0).alias(f"precision_{k}"),
            F.when(n_gold > 0, gain / ideal).otherwise(0.0).alias(f"ndcg_{k}"),
        ]
    return rows.select(*out)


def by_segment(scores: DataFrame) -> DataFrame:
    """Means over the questions of a system (segment ``overall``) and of each of its segments, in one pass of grouping sets."""
    measures = [c for c in scores.columns if c.split("_")[0] in ("recall", "precision", "ndcg", "rr")]
    whole = F.when(F.grouping("query_type") == 1, "overall").otherwise(F.col("query_type"))
    means = [F.avg(c).alias("mrr" if c == "rr" else c) for c in measures]
    sets = scores.groupingSets([["system"], ["system", "query_type"]], "system", "query_type")
    return sets.agg(F.count(F.lit(1)).alias("n"), whole.alias("segment"), *means).select("system", "segment", "n", *["mrr" if c == "rr" else c for c in measures])


def deltas(report: DataFrame, baseline: str, enhanced: str, primary_k: int = 5) -> DataFrame:
    """Enhanced minus baseline by segment; a segment that one system lacks is held against that system's overall figure."""
    keep = ["segment", f"recall_{primary_k}", "mrr"]
    side = lambda name, tag: report.filter(F.col("system") == name).select(*[F.col(c).alias(c if c == "segment" else f"{c}_{tag}") for c in keep])
    b, e = side(baseline, "b"), side(enhanced, "e")
    whole = b.filter("segment = 'overall'").drop("segment").crossJoin(e.filter("segment = 'overall'").drop("segment"))
    whole = whole.select(*[F.col(c).alias("all_" + c) for c in whole.columns])
    both = b.join(e, "segment", "full").crossJoin(F.broadcast(whole))  # one row
    gap = lambda m: F.round(F.coalesce(f"{m}_e", f"all_{m}_e") - F.coalesce(f"{m}_b", f"all_{m}_b"), 4)
    return both.select("segment", gap(f"recall_{primary_k}").alias(f"recall_{primary_k}"), gap("mrr").alias("mrr"))


def citation_validity(cited: DataFrame, known: DataFrame, *by: str) -> DataFrame:
    """Mean share of known ids among an answer's citations, over answers that cite: from (answer_id, citations) and (id).

    Known ids may be very many, so only those that are cited are made distinct.
    """
    each = cited.select(*by, "answer_id", F.explode("citations").alias("id"))
    met = known.select("id").join(_few(each.select("id").distinct()), "id", "left_semi").distinct()
    marked = each.join(met.withColumn("known", F.lit(1)), "id", "left")
    share = marked.groupBy(*by, "answer_id").agg((F.count("known") / F.count(F.lit(1))).alias("share"))
    return share.groupBy(*by).agg(F.count(F.lit(1)).alias("n_citing"), F.avg("share").alias("citation_validity"))


def interval(scores: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean with a 95% normal interval inside [0, 1]; a single score is its own interval, none gives zeros."""
    n, mean = F.count(value), F.coalesce(F.avg(value), F.lit(0.0))
    margin = F.coalesce(1.96 * F.stddev_samp(value) / F.sqrt(n), F.lit(0.0))
    margin = F.when(F.isnan(margin), 0.0).otherwise(margin)
    return scores.groupBy(*by).agg(
        n.alias("n"),
        F.round(mean, 4).alias("mean"),
        F.round(F.greatest(F.lit(0.0), mean - margin), 4).alias("ci95_low"),
        F.round(F.least(F.lit(1.0), mean + margin), 4).alias("ci95_high"),
    )
