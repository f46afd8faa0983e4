"""Boxes of page regions: area, corners, clipping, crops; keys and categories of annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CATEGORIES


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))])


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["w"]) * F.greatest(F.lit(0.0), b["h"])


def corners(b: Column) -> Column:
    """Whole corner coordinates; halves round to even."""
    whole = lambda c: F.bround(c, 0).cast("int")
    return F.struct(whole(b["x"]).alias("x0"), whole(b["y"]).alias("y0"), whole(b["x"] + b["w"]).alias("x1"), whole(b["y"] + b["h"]).alias("y1"))


def clipped(b: Column, width: Column, height: Column) -> Column:
    """The part of a box on its page; sides are never negative."""
    on = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))
    x0, y0, x1, y1 = on(b["x"], width), on(b["y"], height), on(b["x"] + b["w"], width), on(b["y"] + b["h"], height)
    return box(x0, y0, F.greatest(F.lit(0.0), x1 - x0), F.greatest(F.lit(0.0), y1 - y0))


def degenerate(b: Column, min_side: float = 2.0) -> Column:
    return (b["w"] < min_side) | (b["h"] < min_side)


def crop(b: Column, width: Column, height: Column) -> Column:
    """Corner coordinates of the pixels to cut, null if there are none."""
    c = corners(b)
    x0, y0 = F.greatest(F.lit(0), c["x0"]), F.greatest(F.lit(0), c["y0"])
    x1, y1 = F.least(width.cast("int"), c["x1"]), F.least(height.cast("int"), c["y1"])
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def upscaled(width: Column, height: Column, min_height: int) -> Column:
    """Size that a crop is brought to before it is read: at least ``min_height`` high; 0 leaves it."""
    factor = F.lit(float(min_height)) / height
    grown = F.struct(F.greatest(F.lit(1), (width * factor).cast("int")).alias("width"), F.lit(min_height).alias("height"))
    same = F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))
    return F.when((F.lit(min_height) > 0) & (height > 0) & (height < min_height), grown).otherwise(same)


def crop_name(region_id: Column) -> Column:
    return F.concat(F.replace(region_id, F.lit("#"), F.lit("_")), F.lit(".png"))


def key_parts(key: Column) -> Column:
    """struct(doc_id, page_id) of a sample key, split at its last underscore; without one the page is 0."""
    k = F.trim(key)
    split = k.rlike("(?s)^.+_[^_]*$")
    return F.struct(
        F.when(split, F.regexp_extract(k, "(?s)^(.+)_[^_]*$", 1)).otherwise(k).alias("doc_id"),
        F.when(split, F.regexp_extract(k, "(?s)^.+_([^_]*)$", 1)).otherwise(F.lit("0")).alias("page_id"),
    )


def category_name(number: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair]), number.cast("int"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as the variable of a function over a one-element array."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def category(annotation: Column) -> Column:
    """The region type of a variant annotation: the first key there is of category_id, category and label decides."""
    raw = F.coalesce(*[F.try_variant_get(annotation, f"$.{k}", "variant") for k in ("category_id", "category", "label")])

    def named(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        text = F.lower(F.trim(F.try_variant_get(v, "$", "string")))
        number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double").cast("int"))
        digits = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
        name = F.when(text.isin(list(CATEGORIES.values())), text)
        return F.when(kind == "STRING", F.coalesce(name, category_name(digits))).otherwise(category_name(number))

    return bound(raw, named)


def annotation_box(annotation: Column) -> Column:
    """The box of a variant annotation: a list of four numbers or a mapping, under any of its names."""
    corner = F.coalesce(F.try_variant_get(annotation, "$.format", "string") == "xyxy", F.lit(False))

    def listed(v: Column) -> Column:
        x, y, w, h = (F.get(v, F.lit(i)) for i in range(4))
        whole = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
        return F.when(whole, F.when(corner & (w > x) & (h > y), box(x, y, w - x, h - y)).otherwise(box(x, y, w, h)))

    def mapped(v: Column) -> Column:
        side = [F.try_element_at(v, F.lit(n)) for n in ("x", "y", "w", "h")]
        return F.when(side[0].isNotNull() & side[1].isNotNull() & side[2].isNotNull() & side[3].isNotNull(), box(*side))

    def read(raw: Column) -> Column:
        return F.coalesce(
            bound(F.try_variant_get(raw, "$", "array<double>"), listed),
            bound(F.try_variant_get(raw, "$", "map<string,double>"), mapped),
        )

    given = F.try_variant_get(annotation, "$.bbox", "variant")
    other = F.coalesce(*[F.try_variant_get(annotation, f"$.{k}", "variant") for k in ("box", "bounding_box", "bbox_xywh")])
    return bound(F.when(given.isNotNull() & ~F.is_variant_null(given), given).otherwise(other), read)
