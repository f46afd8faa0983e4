"""Embedders behind one protocol: a function from a batch of texts to vectors, run as an Arrow-batched UDF.

The offline default hashes tokens.  A learned model is given as a factory, which each Python
worker calls once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Embed = Callable[[Sequence[str]], np.ndarray]
#: Words whose slot a worker remembers, and bytes of texts that become strings at a time.
KNOWN_WORDS, SLICE_BYTES = 100_000, 1 << 20


def hashing(dim: int = 64) -> Callable[[], Embed]:
    """Counts of tokens (letters and digits of white-space separated words) by MD5 modulo ``dim``."""

    def load() -> Embed:
        known: dict[str, int] = {}

        def place(word: str) -> int:
            """The slot of a word, -1 if it has neither letters nor digits."""
            if word not in known:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                token = "".join(c for c in word if c.isalnum())
                known[word] = int(hashlib.md5(token.encode()).hexdigest(), 16) % dim if token else -1
            return known[word]

        def embed(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, text in enumerate(texts):
                slots = np.fromiter(map(place, text.lower().split()), np.int64)
                out[i] = np.bincount(slots[slots >= 0], minlength=dim)
            return out

        return embed

    return load


def embedded(text: Column, load: Callable[[], Embed]) -> Column:
    """Vectors of a text column; null texts are empty."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = load()
        for batch in batches:
            yield pa.array([], pa.list_(pa.float32())) if not len(batch) else pa.concat_arrays(list(_lists(batch, embed)))

    return run(text)


def _lists(texts: pa.Array, embed: Embed) -> Iterator[pa.Array]:
    """Vectors of texts, some bytes of them at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        vectors = np.asarray(embed([x or "" for x in texts.slice(at, to - at).to_pylist()]), np.float32)
        offsets = np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32)
        yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))
        at = to


EmbedImages = Callable[[Sequence[bytes]], np.ndarray]


def hashing_images(dim: int = 64) -> Callable[[], EmbedImages]:
    """The offline default: an image counts as one token, its bytes, so equal images have equal vectors."""

    def load() -> EmbedImages:
        def embed(images: Sequence[bytes]) -> np.ndarray:
            out = np.zeros((len(images), dim), np.float32)
            for i, image in enumerate(images):
                if image:
                    out[i, int(hashlib.md5(image).hexdigest(), 16) % dim] = 1
            return out

        return embed

    return load


def embedded_images(image: Column, load: Callable[[], EmbedImages]) -> Column:
    """Vectors of a column of image bytes; null images are empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for batch in batches:
            yield pd.Series(list(embed([b"" if x is None else bytes(x) for x in batch])))

    return run(image)
