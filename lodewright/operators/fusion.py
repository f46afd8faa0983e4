"""Rank fusion: reciprocal ranks, deduplication, interleaving of modalities, region mapping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from . import checks

#: Places that a query draws, times k: with more items than that, some k of them differ but for a chance below 1e-9 at k = 5.
DRAWS = 16


def reciprocal_rank(rankings: Sequence[DataFrame], k: int = 60, weights: Sequence[float] | None = None, top_n: int | None = None) -> DataFrame:
    """Sum of weight / (k + rank) for each query and item over rankings of (query_id, item_id, modality, rank).

    Ties go to the item seen first (by ranking, then rank).  The modality names the ones that
    found the item, in the order seen.  One shuffle by query and item, one by query.
    """
    checks.positive("k", k)
    weights = [1.0] * len(rankings) if weights is None else weights
    checks.aligned("weights and rankings", len(weights), len(rankings))
    parts = [
        r.select("query_id", "item_id", "modality", "rank", F.lit(float(w)).alias("w"), F.lit(i).alias("source"))
        for i, (r, w) in enumerate(zip(rankings, weights, strict=True))
    ]
    seen = F.struct("source", "rank", "modality")
    items = reduce(DataFrame.unionByName, parts).groupBy("query_id", "item_id").agg(
        F.sum(F.col("w") / (F.lit(k) + F.col("rank"))).alias("score"), F.min(seen).alias("first"), F.sort_array(F.collect_list(seen)).alias("all")
    )
    names = F.array_join(F.array_distinct(F.transform("all", lambda x: x["modality"])), "+")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.col("first.source"), F.col("first.rank"), F.col("item_id"))
    out = items.select("query_id", "item_id", "score", F.concat(F.lit("fused:"), names).alias("modality"), F.row_number().over(order).alias("rank"))
    return out if top_n is None else out.filter(F.col("rank") <= top_n)


def best_of_each(ranking: DataFrame) -> DataFrame:
    """The best-ranked row of each query and item."""
    order = Window.partitionBy("query_id", "item_id").orderBy(F.col("rank").asc_nulls_last())
    return ranking.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def interleaved(text: DataFrame, visual: DataFrame) -> DataFrame:
    """Round robin of two rankings, text first at each place, items once: (query_id, item_id, place)."""
    parts = []
    for i, r in enumerate((text, visual)):
        order = Window.partitionBy("query_id").orderBy(F.col("rank").asc_nulls_last(), "item_id")
        parts.append(r.select("query_id", "item_id", F.row_number().over(order).alias("turn"), F.lit(i).alias("modality")))
    first = parts[0].unionByName(parts[1]).groupBy("query_id", "item_id").agg(F.min(F.struct("turn", "modality")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at")
    return first.select("query_id", "item_id", F.row_number().over(order).alias("place"))


def as_regions(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items as regions: a chunk stands for its regions, other ids for themselves; each region once, at its first place."""
    known = chunks.select(F.col("chunk_id").alias("item_id"), "source_region_ids")
    joined = places.join(known, "item_id", "left")
    opened = joined.select("query_id", "place", F.posexplode(F.coalesce("source_region_ids", F.array("item_id"))).alias("inner", "region_id"))
    first = opened.groupBy("query_id", "region_id").agg(F.min(F.struct("place", "inner")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "region_id")
    return first.select("query_id", "region_id", F.row_number().over(order).alias("rank"))


def ranked_list(regions: DataFrame) -> DataFrame:
    """(query_id, retrieved): the regions in order as one array."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "region_id")))
    return regions.groupBy("query_id").agg(F.transform(listed, lambda x: x["region_id"]).alias("retrieved"))


def seeded(seed: int, *parts) -> Column:
    """A number from 0 to 2**60 that follows from the seed and the parts, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def random_floor(items: DataFrame, queries: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``k`` distinct items for each query, chosen by seeded hashes; the same in every run and at every size.

    Items lie in the order of their hash, then id.  A query draws places in that order and takes the
    items there, so the work is queries times draws.  Places are counted within buckets of the hash, of
    which there are as many at any size, so no task holds all items.  Of few items all are taken, in an order of the query's own.
    """
    checks.positive("k", k)
    placed = stage(items.select("item_id", seeded(seed, F.col("item_id")).alias("h")).withColumn("b", F.shiftright("h", 44)), "random-items")
    sizes = placed.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))  # 65,536 buckets
    sizes = sizes.select("b", F.coalesce(before, F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("b").orderBy("h", "item_id"))
    placed = placed.withColumn("inner", inner).join(sizes, "b").select("item_id", (F.col("before") + F.col("inner") - 1).alias("at"))
    n = placed.count()
    if not n:
        return items.sparkSession.createDataFrame([], "query_id string, item_id string, score double, modality string, rank int")
    k = min(k, n)
    if n > DRAWS * k:
        turns = F.sequence(F.lit(0), F.lit(DRAWS * k - 1))
        drawn = queries.select("query_id", F.explode(turns).alias("i")).withColumn("at", seeded(seed, F.col("query_id"), F.col("i").cast("string")) % n)
    else:
        drawn = queries.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("at"))
        drawn = drawn.withColumn("i", seeded(seed, F.col("query_id"), F.col("at").cast("string")))
    drawn = drawn.groupBy("query_id", "at").agg(F.min("i").alias("i"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("i", "at"))
    taken = drawn.withColumn("rank", rank).filter(F.col("rank") <= k).join(placed, "at")
    return taken.select("query_id", "item_id", F.lit(0.0).alias("score"), F.lit("random").alias("modality"), "rank")
