"""Vector expressions: norms, normalisation, products, hashing embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def embedding_tokens(text: Column) -> Column:
    """Lower-case words without anything but letters and digits, empty ones left out."""
    bare = F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")


def slot(token: Column, dim: int) -> Column:
    """MD5 modulo a power of two: its last bits."""
    if dim & (dim - 1) or not 0 < dim <= 1 << 28:
        raise ValueError("the dimension must be a power of two")
    return F.conv(F.substring(F.md5(token), 25, 8), 16, 10).cast("long").bitwiseAND(F.lit(dim - 1)).cast("int")


def hash_slots(text: Column, dim: int = 64) -> Column:
    return F.transform(embedding_tokens(text), lambda t: slot(t, dim))
