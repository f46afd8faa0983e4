"""The knowledge graph: build, link, expand, paths, regions, description.

Nodes and edges are tables.  Hops are unrolled joins (bounded), over edges in both directions;
the frontier is deduplicated after each hop so that it never outgrows the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import spread
from . import checks

#: Mentions that a task sorts at a time.
TASK_MENTIONS = 500_000
MAX_ENTITIES, MIN_NAME, MAX_NAME, MAX_PATHS, MAX_EDGES = 5, 3, 60, 5, 20


def build_nodes(mentions: DataFrame, provenance: str = "first_only") -> DataFrame:
    """(id, name, entity_type, source_region_ids) from mentions; the first mention in corpus order names a node.

    ``first_only`` keeps the region of that mention, ``accumulate`` all regions in order.
    """
    mentions = spread(mentions, "region_id", rows=TASK_MENTIONS)
    first = F.min(F.struct("region_id", "ord", "name", "entity_type"))
    regions = F.sort_array(F.collect_set("region_id")) if provenance == "accumulate" else F.array(F.col("m.region_id"))
    if provenance == "accumulate":
        out = mentions.groupBy("node_id").agg(first.alias("m"), regions.alias("source_region_ids"))
    else:
        out = mentions.groupBy("node_id").agg(first.alias("m")).withColumn("source_region_ids", regions)
    return out.select(F.col("node_id").alias("id"), "m.name", "m.entity_type", "source_region_ids")


def build_edges(relations: DataFrame, nodes: DataFrame, keep: str = "first") -> DataFrame:
    """Distinct (head, tail, relation_type) whose ends are nodes, with the region of the first or last statement."""
    pick = F.min("source_region_id") if keep == "first" else F.max("source_region_id")
    out = relations.groupBy("head", "tail", "relation_type").agg(pick.alias("source_region_id"))
    ids = nodes.select("id")
    return out.join(ids, F.col("head") == F.col("id"), "left_semi").join(ids, F.col("tail") == F.col("id"), "left_semi")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n): nodes by entity type and edges by relation type."""
    a = nodes.groupBy(F.col("entity_type").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    b = edges.groupBy(F.col("relation_type").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "type", "n")
    return a.unionByName(b)


def regions_of(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, region_id, pos) of the nodes asked for."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.posexplode("source_region_ids").alias("pos", "region_id"))


def link(queries: DataFrame, nodes: DataFrame, limit: int = MAX_ENTITIES, min_name: int = MIN_NAME) -> DataFrame:
    """(query_id, node_id, rank): nodes whose name stands in the query between word boundaries, longest first.

    A query's substrings between boundaries are its join keys, so names are matched by equality.
    """
    low = F.regexp_replace(F.lower("question"), r"\s+", " ")
    q = queries.select("query_id", low.alias("q"))
    word = lambda c: c.rlike(r"^\w$")
    places = F.sequence(F.lit(1), F.length("q"))
    begins = F.filter(places, lambda i: (i == 1) | ~word(F.substring(F.col("q"), i - 1, F.lit(1))))
    ends = F.filter(places, lambda i: (i == F.length("q")) | ~word(F.substring(F.col("q"), i + 1, F.lit(1))))
    q = q.filter(F.length("q") > 0).select("query_id", "q", F.explode(begins).alias("b"), ends.alias("ends"))
    q = q.select("query_id", "q", "b", F.explode(F.expr(f"filter(ends, e -> e - b + 1 between {min_name} and {MAX_NAME})")).alias("e"))
    keys = q.select("query_id", F.substring(F.col("q"), F.col("b"), F.col("e") - F.col("b") + 1).alias("key")).distinct()
    name = F.lower(F.trim("name"))
    known = nodes.select(F.col("id").alias("node_id"), name.alias("key")).filter(F.length("key") >= min_name)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.length("key")), "node_id")
    return keys.join(known, "key").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "node_id", "rank")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("head").alias("u"), F.col("tail").alias("v")).union(edges.select("tail", "head")).filter("u <> v").distinct()


def expand(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(query_id, node_id, depth): nodes within ``hops`` undirected edges of a query's seeds that exist."""
    checks.not_negative("hops", hops)
    reached = seeds.select("query_id", "node_id").join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    reached = reached.select("query_id", "node_id").distinct().withColumn("depth", F.lit(0))
    ways = _both_ways(edges)
    frontier = reached
    for depth in range(1, hops + 1):
        further = frontier.join(ways, F.col("node_id") == F.col("u")).select("query_id", F.col("v").alias("node_id")).distinct()
        frontier = further.join(reached, ["query_id", "node_id"], "left_anti").withColumn("depth", F.lit(depth))
        reached = reached.unionByName(frontier)
    return reached


def paths(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 1, limit: int = MAX_PATHS) -> DataFrame:
    """(query_id, n, path): shortest paths from each seed (in rank order) to each node in reach (by id).

    Of several shortest paths the one whose nodes come first is taken.
    """
    checks.not_negative("hops", hops)
    start = seeds.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    best = start.select("query_id", F.col("rank").alias("seed_rank"), F.col("node_id").alias("target"), F.array("node_id").alias("path"))
    ways, frontier = _both_ways(edges), best
    for _ in range(hops):
        further = frontier.join(ways, F.col("target") == F.col("u")).filter(~F.array_contains("path", F.col("v")))
        further = further.select("query_id", "seed_rank", F.col("v").alias("target"), F.concat("path", F.array("v")).alias("path"))
        further = further.groupBy("query_id", "seed_rank", "target").agg(F.min("path").alias("path"))
        frontier = further.join(best, ["query_id", "seed_rank", "target"], "left_anti")
        best = best.unionByName(frontier)
    order = Window.partitionBy("query_id").orderBy("seed_rank", "target")
    return best.filter(F.size("path") > 1).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).select("query_id", "n", "path")


def expansion_regions(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 1, limit: int = 5) -> DataFrame:
    """(query_id, region_id, rank): regions of reached nodes, of nodes beyond the seeds first, each once."""
    reached = expand(seeds, nodes, edges, hops)
    own = seeds.select("query_id", "node_id").withColumn("is_seed", F.lit(1)).distinct()
    reached = reached.join(own, ["query_id", "node_id"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(0)))
    listed = reached.join(nodes, reached["node_id"] == nodes["id"]).select("query_id", "is_seed", "node_id", F.posexplode("source_region_ids").alias("pos", "region_id"))
    first = listed.groupBy("query_id", "region_id").agg(F.min(F.struct("is_seed", "node_id", "pos")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "region_id", "rank")


def describe(reached: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = MAX_EDGES) -> DataFrame:
    """(query_id, description): the first edges among a query's nodes, a line each, or a note that there are none."""
    ends = lambda c: reached.select("query_id", F.col("node_id").alias(c))
    inside = edges.join(ends("head"), "head").join(ends("tail"), ["query_id", "tail"])
    names = nodes.select("id", "name")
    inside = inside.join(names.toDF("head", "head_name"), "head", "left").join(names.toDF("tail", "tail_name"), "tail", "left")
    order = Window.partitionBy("query_id").orderBy("source_region_id", "relation_type", "head", "tail")
    line = F.concat(F.lit("- "), F.coalesce("head_name", "head"), F.lit(" --"), F.col("relation_type"), F.lit("--> "), F.coalesce("tail_name", "tail"))
    lines = inside.select("query_id", line.alias("line"), F.row_number().over(order).alias("n")).filter(F.col("n") <= limit)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    told = lines.groupBy("query_id").agg(text.alias("description"))
    asked = reached.select("query_id").distinct()
    return asked.join(told, "query_id", "left").withColumn("description", F.coalesce("description", F.lit("(no graph relations found)")))
