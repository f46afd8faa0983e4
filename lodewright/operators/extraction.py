"""Entities and relations from region texts, by rule or by a language model's replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_object
from ..schema import ENTITY_TYPES
from ..staging import spread, stage
from . import lexicon, models

MIN_TEXT = 40
MAX_NAME = 60
#: Regions that a task takes at a time; it holds some ten mentions of each.
TASK_REGIONS = 50_000


def node_id(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.lower(F.trim(name)))


def _named(raw: Column) -> Column:
    return F.btrim(F.regexp_replace(raw, r"\s+", " "), F.lit(" .,;:"))


def _usable(regions: DataFrame) -> DataFrame:
    text = F.trim("text")
    return regions.filter(F.length(text) >= MIN_TEXT).select("region_id", text.alias("text"))


def mentions(regions: DataFrame) -> DataFrame:
    """(region_id, entity_type, ord, name, node_id), the first mention of each node in a region.

    ``ord`` orders mentions as found: methods by pattern, metrics, figure references, datasets, findings.
    Regions are dealt by their id before they are opened, so that mentions meet where they are found, some at a time.
    """
    base = spread(_usable(regions), "region_id", rows=TASK_REGIONS)
    found = lambda pattern, group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    groups = [("method", found(p, 0)) for p in lexicon.METHOD_PATTERNS]
    groups += [("metric", found(lexicon.METRIC_PATTERN, 1)), ("figure_ref", found(lexicon.FIGURE_PATTERN, 0)), ("dataset", found(lexicon.DATASET_PATTERN, 1))]
    metric, value = found(lexicon.FINDING_PATTERN, 1), found(lexicon.FINDING_PATTERN, 2)
    groups.append(("finding", F.zip_with(metric, value, lambda m, v: F.concat(m, F.lit(" = "), F.trim(v)))))

    def numbered(g: int, kind: str, names: Column) -> Column:
        return F.transform(names, lambda n, i: F.struct(F.lit(kind).alias("entity_type"), F.lit(g).alias("g"), i.alias("i"), n.alias("raw")))

    each = [numbered(g, kind, names) for g, (kind, names) in enumerate(groups)]
    rows = base.select("region_id", F.explode(F.concat(*each)).alias("m")).select("region_id", "m.entity_type", F.struct("m.g", "m.i").alias("ord"), _named(F.col("m.raw")).alias("name"))
    rows = rows.filter((F.col("name") != "") & (F.length("name") <= MAX_NAME)).withColumn("node_id", node_id(F.col("entity_type"), F.col("name")))
    return rows.groupBy("region_id", "node_id").agg(F.min(F.struct("ord", "name", "entity_type")).alias("m")).select("region_id", "node_id", "m.entity_type", "m.name", "m.ord")


def relations(regions: DataFrame, found: DataFrame) -> DataFrame:
    """(head, tail, relation_type, source_region_id): method evaluated_by metric, metric has_value finding, both reported_in figures."""
    kind = lambda *k: found.filter(F.col("entity_type").isin(*k))
    pair = lambda heads, tails, name: heads.alias("h").join(tails.alias("t"), F.col("h.region_id") == F.col("t.region_id")).select(
        F.col("h.node_id").alias("head"), F.col("t.node_id").alias("tail"), F.lit(name).alias("relation_type"), F.col("h.region_id").alias("source_region_id")
    )
    metric = F.regexp_extract_all("text", F.lit(lexicon.FINDING_PATTERN), F.lit(1))
    value = F.regexp_extract_all("text", F.lit(lexicon.FINDING_PATTERN), F.lit(2))
    stated = spread(_usable(regions), "region_id", rows=TASK_REGIONS).select("region_id", F.explode(F.arrays_zip(metric.alias("m"), value.alias("v"))).alias("f"))
    name = _named(F.concat(F.col("f.m"), F.lit(" = "), F.trim(F.col("f.v"))))
    valued = stated.filter(F.length(name) <= MAX_NAME).select(
        F.concat(F.lit("metric:"), F.lower(F.trim("f.m"))).alias("head"),
        node_id(F.lit("finding"), name).alias("tail"),
        F.lit("has_value").alias("relation_type"),
        F.col("region_id").alias("source_region_id"),
    )
    parts = [pair(kind("method"), kind("metric"), "evaluated_by"), valued, pair(kind("method", "metric"), kind("figure_ref"), "reported_in")]
    return reduce(DataFrame.unionByName, parts)


def from_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and the number of dropped rows, from (region_id, reply) of a language model.

    Entities need a known type and a short name; the ends of a relation must be entities of the same reply.
    """
    parsed = replies.select("region_id", json_object(F.col("reply")).alias("o"))
    get = lambda path: F.trim(F.try_variant_get("e", path, "string"))
    listed = lambda name: parsed.select("region_id", F.posexplode(F.try_variant_get("o", f"$.{name}", "array<variant>")).alias("pos", "e"))
    raw = listed("entities").select("region_id", "pos", get("$.name").alias("name"), F.lower(get("$.type")).alias("entity_type"))
    good = (F.col("name") != "") & (F.length("name") <= MAX_NAME) & F.col("entity_type").isin(*ENTITY_TYPES)
    entities = raw.filter(good).withColumn("node_id", node_id(F.col("entity_type"), F.col("name")))
    named = entities.groupBy("region_id", F.lower("name").alias("n")).agg(F.min(F.struct("pos", "node_id"))["node_id"].alias("node"))
    claimed = listed("relations").select("region_id", F.lower(get("$.head")).alias("h"), F.lower(get("$.tail")).alias("t"), get("$.type").alias("relation_type"))
    ends = lambda c, out: named.select("region_id", F.col("n").alias(c), F.col("node").alias(out))
    kept = claimed.join(ends("h", "head"), ["region_id", "h"]).join(ends("t", "tail"), ["region_id", "t"])
    kept = kept.select("head", "tail", F.coalesce("relation_type", F.lit("related_to")).alias("relation_type"), F.col("region_id").alias("source_region_id"))
    dropped = raw.filter(~F.coalesce(good, F.lit(False))).groupBy("region_id").agg(F.count(F.lit(1)).alias("dropped"))
    return entities, kept, dropped


def batches(regions: DataFrame, size: int = 5, chars: int = 1500, order: str = "region_id") -> DataFrame:
    """Regions numbered into batches for one model call each: (batch, index, region_id, excerpt)."""
    spread = F.pmod(F.xxhash64(order), F.lit(1024))
    number = F.row_number().over(Window.partitionBy(spread).orderBy(order)) - 1
    rows = regions.select(F.col("region_id"), F.substring("text", 1, chars).alias("excerpt"), spread.alias("spread"), number.alias("n"))
    return rows.select(F.format_string("%d-%d", "spread", F.floor(F.col("n") / size)).alias("batch"), (F.col("n") % size).alias("index"), "region_id", "excerpt")


def split_batch_replies(asked: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies of batches (batch, reply) as replies of regions, and the regions to ask for one by one.

    A result needs an index of the batch; of repeated ones the first counts; regions without any are left over.
    """
    parsed = replies.select("batch", F.posexplode(F.try_variant_get(json_object(F.col("reply")), "$.results", "array<variant>")).alias("pos", "r"))
    by_index = parsed.select("batch", "pos", F.try_variant_get("r", "$.index", "int").alias("index"), F.to_json("r").alias("reply"))
    first = by_index.groupBy("batch", "index").agg(F.min(F.struct("pos", "reply"))["reply"].alias("reply"))
    return asked.join(first, ["batch", "index"]).select("region_id", "reply"), asked.join(first, ["batch", "index"], "left_anti").select("region_id", "excerpt")


ONE_PROMPT = (
    "Extract entities and relations from the scientific excerpt below. Return ONLY valid JSON of the form "
    '{"entities": [{"name": "...", "type": "..."}], "relations": [{"head": "...", "tail": "...", "type": "..."}]}. '
    "Types of entities: " + ", ".join(ENTITY_TYPES) + ". Heads and tails are names of listed entities. Leave out what the excerpt does not state.\n\nExcerpt:\n%s"
)
MANY_PROMPT = (
    "Extract entities and relations from each numbered excerpt below, apart from the others. Return ONLY valid JSON of the form "
    '{"results": [{"index": 0, "entities": [{"name": "...", "type": "..."}], "relations": [{"head": "...", "tail": "...", "type": "..."}]}]}, '
    "with one result for each excerpt. Types of entities: " + ", ".join(ENTITY_TYPES) + ". Heads and tails are names of entities of the same result.\n\nExcerpts:\n%s"
)
ONE_CHARS, MANY_CHARS = 4000, 1500


def from_model(regions: DataFrame, cache: DataFrame, model: models.Model, backend: str = "stub", name: str = "stub", size: int = 5, **options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities, relations, dropped counts, and new cache rows, of a language model asked about regions (region_id, text).

    Regions go in batches of ``size``; those that a batch's reply leaves out are asked for one by one.
    """
    usable = regions.filter(F.length(F.trim("text")) >= MIN_TEXT)
    asked = stage(batches(usable, size, MANY_CHARS), "extraction-batches")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("index", "excerpt"))), lambda x: F.concat(F.lit("["), x["index"].cast("string"), F.lit("] "), x["excerpt"]))
    prompts = models.keyed(asked.groupBy("batch").agg(F.format_string(MANY_PROMPT, F.array_join(lines, "\n\n")).alias("prompt")), backend, name)
    first = stage(models.complete(prompts, cache, model, **options), "extraction-replies")
    known = cache.select("key", "reply").unionByName(first).dropDuplicates(["key"])
    replies, left = split_batch_replies(asked, prompts.join(known, "key").select("batch", "reply"))
    singles = usable.join(left.select("region_id"), "region_id", "left_semi").select("region_id", F.format_string(ONE_PROMPT, F.substring(F.trim("text"), 1, ONE_CHARS)).alias("prompt"))
    singles = stage(models.keyed(singles, backend, name), "extraction-singles")
    second = stage(models.complete(singles, known, model, **options), "extraction-replies")
    known = known.unionByName(second)
    whole = stage(replies.unionByName(singles.join(known, "key").select("region_id", "reply")), "extraction-whole")
    return *from_replies(whole), first.unionByName(second)
