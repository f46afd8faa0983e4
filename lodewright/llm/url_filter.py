"""URL filters by a temporal list join (operator 2).

Lists change over time: an entry is added on one date and removed on another.  Dated entries
become validity intervals (each addition holds until the entry's next event), and an as-of
join tests every capture against the entries that were active when it was fetched.

A capture has keys: its host, each domain above it, and its host with each path prefix.  The
keys are joined to the intervals by equality, with the time as a condition, so a popular host
is only a skewed join key, which adaptive execution splits; matches are then grouped.

Defined results: a null or unparsable url and a null fetch time match nothing and are allowed;
an entry with a null pattern or date is void; an addition and a removal at the same time count
as a removal; repeated rows are judged one by one; empty lists allow everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.rtrim(F.lower(host), F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """Array of (kind, pattern): ``host``, ``domain`` (the host and all above it), ``prefix`` (host and leading path segments)."""
    host = host_of(url)
    labels, steps = F.split(host, r"\."), F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    key = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    prefixes = F.when(
        F.size(steps) > 0,
        F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: key("prefix", F.concat_ws("/", host, F.slice(steps, F.lit(1), i)))),
    )
    return F.when(host.isNotNull(), F.array_distinct(F.concat(F.array(key("host", host)), domains, F.coalesce(prefixes, F.array().cast("array<struct<kind:string,pattern:string>>")))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, kind, pattern, valid_from, valid_to) from entries (list_name, kind, pattern, action, effective_at)."""
    keys = ("list_name", "kind", "pattern")
    events = (
        entries.filter(F.col("pattern").isNotNull() & F.col("effective_at").isNotNull())
        .groupBy(*keys, "effective_at")
        .agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("removed"))
    )
    following = F.lead("effective_at").over(Window.partitionBy(*keys).orderBy("effective_at"))
    return events.withColumn("valid_to", following).filter("removed = 0").select(*keys, F.col("effective_at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``n_matches``, ``list_names`` (sorted, joined by commas) and ``blocked``."""
    asked = captures.select(F.col(url).alias("__u"), F.col(at).alias("__t")).filter("__u is not null and __t is not null").distinct()
    keyed = asked.select("__u", "__t", F.explode(keys_of(F.col("__u"))).alias("__k"))
    active = intervals(entries)
    on = (
        (F.col("__k.kind") == active["kind"])
        & (F.col("__k.pattern") == active["pattern"])
        & (F.col("__t") >= active["valid_from"])
        & (active["valid_to"].isNull() | (F.col("__t") < active["valid_to"]))
    )
    hits = keyed.join(active, on).groupBy("__u", "__t").agg(
        F.count(F.lit(1)).alias("n_matches"), F.array_join(F.sort_array(F.collect_set("list_name")), ",").alias("list_names")
    )
    rows = captures.drop("n_matches", "list_names", "blocked")
    out = rows.join(hits, (rows[url] == hits["__u"]) & (rows[at] == hits["__t"]), "left").drop("__u", "__t")
    return out.withColumns(
        {"n_matches": F.coalesce("n_matches", F.lit(0)).cast("long"), "list_names": F.coalesce("list_names", F.lit("")), "blocked": F.col("n_matches").isNotNull()}
    )
