"""Page annotations to regions, chunks of their text, and checks of the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import Chunking, Ingest
from ..functions import boxes
from ..functions.text import clean_ocr
from ..schema import CATEGORIES, TEXTUAL, VISUAL


class CorpusError(ValueError):
    """A corpus breaks at least one rule."""


_USUAL = "annotations array<struct<bbox array<double>, category_id bigint, format string>>"


def _objects(payload: Column) -> Column:
    """The annotation objects of a JSON payload as variants; the list is the payload itself or under one of its names."""
    parsed = F.try_parse_json(payload)
    lists = [F.try_variant_get(parsed, f"$.{n}", "array<variant>") for n in ("annotations", "regions", "objects", "boxes")]
    whole = F.coalesce(*lists, F.try_variant_get(parsed, "$", "array<variant>"))
    return F.filter(whole, lambda a: F.schema_of_variant(a).startswith("OBJECT"))


def annotations(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each annotation object of a page's JSON payload: all columns but the payload, ``idx`` and ``annotation``."""
    return pages.select(*[c for c in pages.columns if c != payload], F.posexplode(_objects(F.col(payload))).alias("idx", "annotation"))


def _read(pages: DataFrame, payload: str) -> DataFrame:
    """(..., idx, region_type, raw) of all annotation objects.

    A payload whose annotations all have the usual shape is read by that schema; only others are read as variants.
    """
    pages = pages.withColumn("__usual", F.from_json(payload, _USUAL)["annotations"])
    fits = lambda a: a.isNotNull() & a["category_id"].isNotNull() & a["format"].isNull() & (F.size("__usual") > 0) & (F.size(a["bbox"]) >= 4) & F.forall(a["bbox"], lambda x: x.isNotNull())
    usual = F.coalesce(F.forall("__usual", lambda a: F.coalesce(fits(a), F.lit(False))), F.lit(False))
    row = lambda kind, raw: F.struct(kind.alias("region_type"), raw.alias("raw"))
    by_schema = F.transform(
        "__usual",
        lambda a: row(
            F.when(a["category_id"].between(min(CATEGORIES), max(CATEGORIES)), boxes.category_name(a["category_id"])),
            boxes.box(*[F.get(a["bbox"], F.lit(i)) for i in range(4)]),
        ),
    )
    by_variant = F.transform(_objects(F.col(payload)), lambda a: row(boxes.category(a), boxes.annotation_box(a)))
    listed = F.posexplode(F.when(usual, by_schema).otherwise(by_variant)).alias("idx", "a")
    return pages.select(*[c for c in pages.columns if c not in (payload, "__usual")], listed).select("*", "a.*").drop("a")


def parse(pages: DataFrame, settings: Ingest = Ingest(), payload: str = "payload") -> DataFrame:  # noqa: B008
    """Regions of pages (key, width, height, payload): unknown types, missing and degenerate boxes go."""
    found = _read(pages.select("key", "width", "height", payload), payload).filter("region_type is not null and raw is not null")
    found = found.withColumn("bbox", boxes.bound(F.col("raw"), lambda r: boxes.clipped(r, F.col("width"), F.col("height"))))
    found = found.filter(~boxes.degenerate(F.col("bbox"), settings.min_region_side_px))
    parts = boxes.key_parts(F.col("key"))
    return found.select(
        F.format_string("%s#r%03d", "key", "idx").alias("region_id"), parts["doc_id"].alias("doc_id"), parts["page_id"].alias("page_id"), "region_type", "bbox"
    )


def parse_statistics(pages: DataFrame, regions: DataFrame, payload: str = "payload") -> DataFrame:
    total = _read(pages.select(payload), payload).agg(F.count(F.lit(1)).alias("total"))
    kept = regions.agg(F.count(F.lit(1)).alias("kept"))
    return total.crossJoin(kept).select("total", "kept", (F.col("total") - F.col("kept")).alias("dropped"))


def is_textual(kind: Column) -> Column:
    return kind.isin(*TEXTUAL)


def is_visual(kind: Column) -> Column:
    return kind.isin(*VISUAL)


def indexable(regions: DataFrame, min_chars: int = 20) -> DataFrame:
    return regions.filter(is_textual(F.col("region_type")) & (F.length(F.trim("text")) >= min_chars))


def visual_with_text(regions: DataFrame) -> DataFrame:
    return regions.filter(is_visual(F.col("region_type")) & (F.trim("text") != ""))


def visual_with_image(regions: DataFrame) -> DataFrame:
    return regions.filter(is_visual(F.col("region_type")) & F.col("image_path").isNotNull())


def graph_input(regions: DataFrame, limit: int, order: str = "region_id") -> DataFrame:
    """The first textual regions with text, in corpus order."""
    return regions.filter(is_textual(F.col("region_type")) & (F.col("text") != "")).orderBy(order).limit(limit)


def read_text(regions: DataFrame, cache: DataFrame, engine=None) -> DataFrame:
    """Regions with the text and confidence of a cache (region_id, text, confidence); ``engine`` makes (region_id, text, confidence) of the rest."""
    known = cache.select("region_id", F.col("text").alias("__t"), F.col("confidence").alias("__c"))
    bare = regions.drop("text", "ocr_confidence")
    hits = bare.join(known, "region_id")
    if engine is not None:
        missing = bare.join(known, "region_id", "left_anti")
        read = engine(missing).select("region_id", F.col("text").alias("__t"), F.col("confidence").alias("__c"))
        hits = hits.unionByName(missing.join(read, "region_id"))
    return hits.withColumns({"text": clean_ocr(F.col("__t")), "ocr_confidence": F.col("__c")}).drop("__t", "__c")


def reading_statistics(regions: DataFrame, *by: str, min_chars: int = 20) -> DataFrame:
    """Attempted, empty and short regions, rates, mean confidence (of textual regions that have text)."""
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    tried = regions.filter(is_textual(F.col("region_type")))
    n = F.count(F.lit(1))
    empty, short = F.count_if(size == 0), F.count_if((size > 0) & (size < min_chars))
    return tried.groupBy(*by).agg(
        n.alias("attempted"),
        empty.alias("empty"),
        short.alias("below_min_chars"),
        F.round(empty / n, 4).alias("empty_rate"),
        F.round((n - empty - short) / n, 4).alias("usable_rate"),
        F.round(F.avg(F.when(size > 0, F.col("ocr_confidence"))), 4).alias("mean_confidence"),
    )


def region_chunks(regions: DataFrame, settings: Chunking = Chunking(), min_ocr_chars: int = 20) -> DataFrame:  # noqa: B008
    text = F.trim("text")
    usable = indexable(regions, min_ocr_chars).filter(F.length(text) >= settings.min_chunk_chars)
    return usable.select(F.concat("region_id", F.lit("#c0")).alias("chunk_id"), "doc_id", "page_id", text.alias("text"), F.array("region_id").alias("source_region_ids"))


def spans(regions: DataFrame, min_ocr_chars: int = 20) -> DataFrame:
    """Text regions with their character span on the page's joined text, in reading order."""
    page = Window.partitionBy("doc_id", "page_id").orderBy("bbox.y", "bbox.x", "region_id")
    text = F.trim("text")
    earlier = page.rowsBetween(Window.unboundedPreceding, -1)
    usable = indexable(regions, min_ocr_chars).select("doc_id", "page_id", "region_id", "bbox", text.alias("text"))
    start = F.coalesce(F.sum(F.length("text") + 1).over(earlier), F.lit(0))
    return usable.withColumn("start", start.cast("int")).withColumn("end", F.col("start") + F.length("text"))


def window_chunks(regions: DataFrame, settings: Chunking = Chunking(), min_ocr_chars: int = 20) -> DataFrame:  # noqa: B008
    """Sliding character windows over each page's text, with the regions that they touch.

    A page's spans travel with its text in one row, so the overlap of windows and regions needs no join.
    """
    step = settings.window_chars - settings.overlap_chars
    parts = F.sort_array(F.collect_list(F.struct("start", "end", "region_id", "text")))
    pages = spans(regions, min_ocr_chars).groupBy("doc_id", "page_id").agg(parts.alias("parts"))
    pages = pages.withColumn("whole", F.array_join(F.transform("parts", lambda p: p["text"]), " "))
    pages = pages.withColumn("parts", F.transform("parts", lambda p: p.dropFields("text")))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.length("whole")) - 1, F.lit(step))
    # Windows are cut before they are opened: a row of a window carries neither its page's text nor its page's spans.
    cut = F.transform(starts, lambda f, i: F.struct(i.alias("i"), f.alias("from"), F.substring(F.col("whole"), f + 1, F.lit(settings.window_chars)).alias("window")))
    cut = pages.withColumn("windows", F.filter(cut, lambda w: F.length(F.trim(w["window"])) >= settings.min_chunk_chars))
    touched = F.expr(
        "transform(windows, w -> struct(w.i as i, trim(w.window) as text,"
        " transform(filter(parts, p -> p.start < w.from + length(w.window) and p.end > w.from), p -> p.region_id) as source_region_ids))"
    )
    opened = cut.select("doc_id", "page_id", F.explode(touched).alias("w"))
    name = F.format_string("%s_%s#w%03d", "doc_id", "page_id", "w.i")
    return opened.select(name.alias("chunk_id"), "doc_id", "page_id", F.col("w.text").alias("text"), F.col("w.source_region_ids").alias("source_region_ids"))


def violations(regions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule, n) for each rule of a corpus: its number of offenders."""
    twice = lambda df, c: df.groupBy(c).count().filter("count > 1")
    sources = chunks.select("chunk_id", F.explode("source_region_ids").alias("region_id"))
    rules = {
        "duplicate region ids": twice(regions, "region_id"),
        "duplicate chunk ids": twice(chunks, "chunk_id"),
        "dangling source regions": sources.join(regions.select("region_id"), "region_id", "left_anti"),
        "degenerate boxes": regions.filter(boxes.degenerate(F.col("bbox"), 2.0)),
        "blank chunks": chunks.filter(F.trim(F.coalesce("text", F.lit(""))) == ""),
    }
    counted = [df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n")) for rule, df in rules.items()]
    empty = regions.agg(F.lit("no regions").alias("rule"), (F.count(F.lit(1)) == 0).cast("long").alias("n"))
    return reduce(DataFrame.unionByName, [empty, *counted])


def validate(regions: DataFrame, chunks: DataFrame) -> None:
    """Raise once, with all rules that fail."""
    failed = violations(regions, chunks).filter("n > 0").collect()
    if failed:
        raise CorpusError("; ".join(f"{r['rule']}: {r['n']}" for r in failed))


def summary(regions: DataFrame, chunks: DataFrame) -> DataFrame:
    a = regions.agg(
        F.count(F.lit(1)).alias("regions"),
        F.countDistinct("doc_id").alias("documents"),
        F.countDistinct("doc_id", "page_id").alias("pages"),
        F.count_if(is_visual(F.col("region_type"))).alias("visual_regions"),
    )
    return a.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))
