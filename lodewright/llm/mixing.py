"""Mixing sources to target weights by weighted fair queueing (operator 3).

Every source is a flow of words.  Its documents, in a shuffled order, get virtual finish
times: words of the flow up to and with the document, divided by the flow's target.  A flow
whose target exceeds its size runs through its documents again, up to ``MAX_REPEATS`` times.
The copies are then range-sorted by finish time over all sources and cut at the total budget.
A word is the packet of this queue, so the copy that a flow's share ends in is taken in part.

Scale: nothing is grouped by source alone except sums.  The shuffled order is cut into
buckets by the hash that shuffles; running sums add up per (source, bucket), then inside a
bucket, so a source with a third of all rows spreads over all tasks.

Defined results: a null text has size 0; a null source is a source, the last one; documents
of size 0 are taken 0 times; an empty table gives an empty mix; equal rows are rows of their
own; reruns give the same result, as the order comes from a hash of doc_id, source, size and seed; a very
long text is one document like any other; other columns, whatever their names, are ignored by the schedule and pass through the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 20
ROWS_PER_BUCKET = 256
MAX_BUCKET_BITS = 16


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their place in code point order, null last."""
    order = (F.col("source").isNull(), F.col("source"))
    placed = common.range_sorted(sources, *order, name="mix-sources")
    return common.with_before(placed, "__before", F.lit(1)).withColumn("place", F.col("__before") + common.place_in_range()).drop("__before")


def targets(sources: DataFrame, budget: int) -> DataFrame:
    """(source, source_size, weight) with ``target``: shares of ``budget`` by weight, none above the repeats allowed.

    The level is the fixed point of resharing; each round is one sum over the source table.
    """
    most = (F.col("source_size") * MAX_REPEATS).cast("double")
    level, full = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > most
        row = sources.agg(
            F.sum(F.when(over, most)).alias("fixed"),
            F.sum(F.when(~over, F.col("weight"))).alias("open"),
            F.count_if(over).alias("full"),
        ).first()
        if not row["open"] or row["full"] == full:
            break
        level, full = (budget - (row["fixed"] or 0.0)) / row["open"], row["full"]
    share = F.col("weight") * F.lit(0.0 if level is None else level)
    return sources.withColumn("target", F.least(share, most))


def _weight(place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int")).cast("long")


def schedule(docs: DataFrame) -> DataFrame:
    """The mix, in order: a row for each copy of a document.

    Columns: doc_id, source, size, text_hash, source_size, target, copy (from 0; a document
    that the mix leaves out has one row with ``taken`` 0), taken (words of this copy),
    virtual_finish, words_before (words of the mix before this copy), bucket and place (with
    source, the key of a document's row).
    """
    spark = docs.sparkSession
    rows = common.stage(
        docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")),
        "mix-sizes",
    )
    n, budget = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = min(MAX_BUCKET_BITS, max(0, (n // ROWS_PER_BUCKET)).bit_length())
    order = F.xxhash64(F.lit(SEED), "doc_id", "source", "size")
    bucket = F.shiftrightunsigned(order, 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumns({"order": order, "bucket": bucket})

    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    sources = common.stage(
        _numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).select(
            "source", "source_size", _weight(F.col("place")).alias("weight")
        ),
        "mix-weights",
    )
    flows = targets(sources, budget).withColumn("quota", F.floor(F.col("target") + 1e-6).cast("long"))

    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", "text_hash")
    rows = rows.withColumns(
        {
            "place": F.row_number().over(inside),
            "inner": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
        }
    )
    parts, flows = parts.withColumnRenamed("source", "__s"), flows.withColumnRenamed("source", "__f")
    rows = rows.join(parts.withColumnRenamed("bucket", "__b"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    rows = rows.join(flows, F.col("source").eqNullSafe(F.col("__f"))).withColumn("start", F.col("offset") + F.col("inner"))

    copies = F.greatest(F.lit(1), F.ceil((F.col("quota") - F.col("start")) / F.nullif(F.col("source_size"), F.lit(0))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)).cast("int") - 1)))
    first = F.col("copy") * F.col("source_size") + F.col("start")
    rows = rows.withColumns(
        {
            "taken": F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - first)).cast("long"),
            "virtual_finish": F.coalesce((first + F.col("size")) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0)),
        }
    )
    keep = ["doc_id", "source", "size", "text_hash", "source_size", "target", "copy", "taken", "virtual_finish", "bucket", "place"]
    order = [F.col(c) for c in ("virtual_finish", "source", "bucket", "place", "copy")]
    queue = common.range_sorted(rows.select(*keep), *order, name="mix-queue")
    running = Window.partitionBy(common.range_of()).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.col("__before") + F.sum("taken").over(running) - F.col("taken")
    queue = common.with_before(queue, "__before", F.col("taken")).withColumn("words_before", ahead).drop("__before")
    left = F.greatest(F.lit(0), F.lit(budget) - F.col("words_before"))
    return queue.withColumn("taken", F.least(F.col("taken"), left).cast("long")).drop("__at")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each copy a row in the columns of ``docs``, a partly taken copy cut after its words."""
    plan = schedule(docs.select("doc_id", "source", "text")).filter("taken > 0")
    plan = plan.select(
        F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), "size", "taken", F.dense_rank().over(
            Window.partitionBy("doc_id", "text_hash").orderBy("source", "bucket", "place")).alias("__k"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__d2"), F.xxhash64("text").alias("__h2"))
    whole = whole.withColumn("__k2", F.row_number().over(Window.partitionBy("__d2", "__h2").orderBy("__row.source")))
    # Equal rows meet by their number.
    same = F.col("__d").eqNullSafe(F.col("__d2")) & (F.col("__h") == F.col("__h2")) & (F.col("__k") == F.col("__k2"))
    out = whole.join(plan, same)
    parts = F.regexp_extract_all(F.col("__row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("taken") < F.col("size"), F.array_join(F.slice(parts, F.lit(1), F.col("taken").cast("int")), "")).otherwise(F.col("__row.text"))
    out = out.withColumn("__text", text)
    own = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*[own.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def words_taken(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target and the words that the mix takes of it."""
    mix = schedule(docs).groupBy("source", "bucket", "place")
    return mix.agg(
        F.first("doc_id").alias("doc_id"),
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum("taken").alias("taken"),
    ).select("doc_id", "size", "source_size", "target", "taken", "source")
