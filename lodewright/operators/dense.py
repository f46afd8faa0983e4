"""Exact dense retrieval: cosine similarity of all items with a set of queries, best k.

Queries are few by nature.  Both sides are packed into blocks of vectors; the blocks of queries go
to all tasks (as many at a time as a byte limit allows), and a task multiplies them with its blocks of items and
keeps the best k of each query, so what is shuffled is k rows for each task and query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm, normalised
from ..staging import stage
from . import checks

QUERY_BLOCK, ITEM_BLOCK = 256, 4096
#: Bytes of query vectors that go to every task at once.
SENT_BYTES = 64 << 20


def unit(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn(vector, normalised(F.col(vector)))


def norms(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn("norm", norm(F.col(vector)))


def _packed(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """Blocks (ids, dim, matrix) of rows (id, vector): unit vectors, a zero vector stays zero; null ids, null vectors and vectors with nulls are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
            for i in range(0, whole.num_rows, size):
                ids, vectors = whole.column(0).slice(i, size), whole.column(1).slice(i, size)
                dims = vectors.value_lengths().to_numpy()
                flat = vectors.flatten()
                values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
                # A vector that holds a null is left out like one that is null.
                bad = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
                good = np.ones(len(ids), bool)
                good[np.searchsorted(np.cumsum(dims), bad, "right")] = False
                for dim in np.unique(dims[good]):
                    at = np.flatnonzero(good & (dims == dim))
                    m = values[(np.cumsum(dims) - dims)[at][:, None] + np.arange(dim)]
                    length = np.sqrt((m * m).sum(1, keepdims=True))
                    m = m / np.where(length == 0, 1, length)
                    columns = [pa.array([ids.take(pa.array(at)).to_pylist()], pa.list_(ids.type)), pa.array([dim], pa.int32()), pa.array([m.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["ids", "dim", "matrix"])

    return rows.mapInArrow(run, f"ids array<{kind}>, dim int, matrix binary")


class _Best:
    """The best ``k`` items so far of each query of a block."""

    def __init__(self, queries: list, k: int):
        self.queries, self.k = queries, k
        self.scores = np.empty((len(queries), 0))
        self.ids = np.empty((len(queries), 0), object)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of all queries (rows) with items in ascending order of their ids."""
        top = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, : self.k]
        scores = np.concatenate([self.scores, np.take_along_axis(scores, top, 1)], 1)
        names = np.concatenate([self.ids, ids[top]], 1)
        by_id = np.argsort(names, axis=1, kind="stable")
        scores, names = np.take_along_axis(scores, by_id, 1), np.take_along_axis(names, by_id, 1)
        top = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, : self.k]
        self.scores, self.ids = np.take_along_axis(scores, top, 1), np.take_along_axis(names, top, 1)


def _searched(pairs: DataFrame, k: int, query_type: str, item_type: str) -> DataFrame:
    """(query_id, item_id, score): the best k items of each query in each task, from (items, dim, matrix, queries, query_dim, query_matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        types = None
        for batch in batches:
            types = [batch.schema.field(c).type.value_type for c in ("queries", "items")]
            for row in range(batch.num_rows):
                items, dim, matrix, number, queries, query_dim, query_matrix = (c[row].as_py() for c in batch.columns)
                if dim != query_dim:
                    raise ValueError(f"vectors of different dimensions: {dim} and {query_dim}")
                names = np.empty(len(items), object)
                names[:] = items
                order = np.argsort(names, kind="stable")
                m, q = (np.frombuffer(x).reshape(-1, dim) for x in (matrix, query_matrix))
                if number not in best:
                    best[number] = _Best(queries, k)
                best[number].add(q @ m[order].T, names[order])
        for b in best.values():
            width = b.ids.shape[1]
            asked = [q for q in b.queries for _ in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(asked, types[0]), pa.array(b.ids.ravel().tolist(), types[1]), pa.array(b.scores.ravel())], names=["query_id", "item_id", "score"])

    return pairs.mapInArrow(run, f"query_id {query_type}, item_id {item_type}, score double")


def top_k(items: DataFrame, queries: DataFrame, k: int, id_col: str = "item_id", vector: str = "embedding") -> DataFrame:
    """Ranking (query_id, item_id, score, rank) by cosine similarity; ties go to the smaller id.

    ``queries`` has (query_id, vector).  Null ids, null vectors and vectors that hold a null take no part;
    vectors of different dimensions raise an error.
    """
    checks.positive("k", k)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (items, id_col))]
    raw = stage(queries.select("query_id", vector), "dense-vectors")
    full = raw.repartition(-(-raw.count() // QUERY_BLOCK) or 1)
    asked = stage(_packed(full, QUERY_BLOCK, kinds[0]).withColumn("number", F.monotonically_increasing_id()), "dense-queries")
    size = asked.agg(F.sum(F.length("matrix"))).first()[0] or 0
    parts = -(-size // SENT_BYTES) or 1
    known = _packed(items.select(F.col(id_col), vector), ITEM_BLOCK, kinds[1])
    if parts > 1:  # the items are read once for each part
        known = stage(known, "dense-items")
    known = known.select(F.col("ids").alias("items"), "dim", "matrix")
    named = asked.select("number", F.col("ids").alias("queries"), F.col("dim").alias("query_dim"), F.col("matrix").alias("query_matrix"))
    part = lambda i: named.filter(F.pmod("number", F.lit(parts)) == i) if parts > 1 else named
    scored = reduce(DataFrame.unionByName, [_searched(known.crossJoin(F.broadcast(part(i))), k, *kinds) for i in range(parts)])
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

