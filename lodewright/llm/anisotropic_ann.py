"""Approximate maximum inner product search with score-aware quantisation (operator 1).

Vectors are coded by four bits for each pair of dimensions.  The codebooks are trained so that
the error along a vector costs more than the error across it (anisotropic loss): for a large
inner product only the parallel part of the error changes the score.  A search sums table
entries by code for all rows and reranks by exact inner products in double precision: first the rows
of the best sums, then all rows whose sum, with ``SURE`` times the error that sums have (measured for each query and scaled
by what a row's code leaves of it), reaches the last of the ``k`` best so far.  How many that are follows from the rows, so close
clusters, lengths of many orders and directions of little spread keep their recall; where sums tell nothing, all rows are reranked.

The index codes every row.  The codebooks are fitted on at most ``SAMPLE`` rows, those of the
smallest hash of their id, so the choice is the same in every run and its size is bounded.

Scale: rows are coded where they are read, into small blocks of codes and vectors that are dealt into groups of at most
``GROUP_ROWS`` rows and ``GROUP_BYTES`` of vectors, and of as many groups as the session has partitions if they are worth it.  Queries
are sent to the groups, not rows to the queries: a task holds one group, query blocks stream by it, and it gives ``k`` rows for each
query.  What is shuffled is the rows once, the queries once for each group, and these results.  The scan of all rows for all
queries grows with their product, as the fixed query set asks; its unit is one table lookup for two codes.  The number of
rows that are reranked first grows with the square root of the table.

Defined results: vectors that are null, all zero, or hold a null or non-finite component take
no part, neither do those of another length than the commonest one (ties: the smaller length);
a null id takes no part; rows that repeat an id are one candidate with the best of their
scores, and a query asks with each of its vectors; with fewer candidates than ``k`` all are
returned; an empty table gives no rows.  Ties go to the smaller vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE = 16_384
CENTERS = 16
PAIR = 2
THRESHOLD = 0.2
ROUNDS = 8
#: Rows that are reranked first for each query of a table of ``KEEP_ROWS`` rows or fewer.
KEEP, KEEP_ROWS = 400, 50_000
QUERIES_PER_BLOCK = 128
GROUP_ROWS, GROUP_BYTES, BLOCK_ROWS = 1 << 20, 64 << 20, 4096
#: Rows below which a table is not split into more groups.
LEAST_ROWS = 8192
#: Rows of a group by which the error of sums is measured for each query, and how many times that error a sum may be off.
PROBES, SURE = 256, 4.0


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class Codebook:
    """Centers of each pair of dimensions, and the weight of the parallel error."""

    def __init__(self, dim: int, threshold: float = THRESHOLD):
        self.dim = dim
        self.parts = -(-dim // PAIR)
        self.parts += self.parts % 2  # two codes make a byte
        # Ratio of the parallel to the orthogonal weight for scores above the threshold (ScaNN, theorem 3.4).
        self.excess = max(0.0, (dim - 1) * threshold**2 / (1 - threshold**2) - 1.0)
        self.centers = np.zeros((self.parts, CENTERS, PAIR), np.float32)

    def _split(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.parts * PAIR), np.float32)
        wide[:, : self.dim] = x
        return wide.reshape(len(x), self.parts, PAIR)

    def fit(self, x: np.ndarray) -> Codebook:
        rng = np.random.default_rng(5)
        v = self._split(x)
        for m in range(self.parts):
            c = v[rng.choice(len(v), CENTERS, replace=len(v) < CENTERS), m]
            for _ in range(6):
                near = ((v[:, m, None] - c) ** 2).sum(2).argmin(1)
                n = np.bincount(near, minlength=CENTERS)
                total = np.stack([np.bincount(near, v[:, m, j], CENTERS) for j in range(PAIR)], 1)
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
            self.centers[m] = c
        unit = v / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None].astype(np.float32)
        for _ in range(ROUNDS):
            codes = self.encode(x)
            error = v - self.centers[np.arange(self.parts), codes]
            along = (error * unit).sum((1, 2))
            for m in range(self.parts):
                u, at = unit[:, m], codes[:, m]
                others = along - (error[:, m] * u).sum(1)
                want = v[:, m] + self.excess * u * (others + (u * v[:, m]).sum(1))[:, None]
                outer = self.excess * u[:, :, None] * u[:, None, :]
                n = np.bincount(at, minlength=CENTERS)
                rhs = np.stack([np.bincount(at, want[:, j], CENTERS) for j in range(PAIR)], 1)
                lhs = np.stack([[np.bincount(at, outer[:, i, j], CENTERS) for j in range(PAIR)] for i in range(PAIR)])
                lhs = np.moveaxis(lhs, 2, 0) + np.eye(PAIR) * np.maximum(n, 1e-9)[:, None, None]
                solved = np.linalg.solve(lhs, rhs[:, :, None])[:, :, 0].astype(np.float32)
                self.centers[m] = np.where(n[:, None] > 0, solved, self.centers[m])
                error[:, m] = v[:, m] - self.centers[m][at]
                along = others + (error[:, m] * u).sum(1)
        return self

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes (rows by parts), by coordinate descent on the anisotropic loss."""
        v = self._split(x)
        unit = v / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None].astype(np.float32)
        codes = np.empty((len(x), self.parts), np.uint8)
        for m in range(self.parts):
            codes[:, m] = ((v[:, m, None] - self.centers[m]) ** 2).sum(2).argmin(1)
        error = v - self.centers[np.arange(self.parts), codes]
        along = (error * unit).sum((1, 2))
        for _ in range(passes):
            for m in range(self.parts):
                others = along - (error[:, m] * unit[:, m]).sum(1)
                miss = v[:, m, None] - self.centers[m]
                loss = (miss**2).sum(2) + self.excess * (others[:, None] + (miss * unit[:, m, None]).sum(2)) ** 2
                codes[:, m] = loss.argmin(1)
                error[:, m] = v[:, m] - self.centers[m][codes[:, m]]
                along = others + (error[:, m] * unit[:, m]).sum(1)
        return codes

    @staticmethod
    def packed(codes: np.ndarray) -> np.ndarray:
        """Two codes in a byte, part-major, so that a scan reads one run for each pair of parts."""
        return np.ascontiguousarray((codes[:, 0::2] << 4 | codes[:, 1::2]).T)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Scores of all byte values for each query: (queries, bytes, 256)."""
        single = np.einsum("qmj,mcj->qmc", self._split(q), self.centers)
        return (single[:, 0::2, :, None] + single[:, 1::2, None, :]).reshape(len(q), self.parts // 2, CENTERS * CENTERS)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Single precision for coding; numbers beyond it are clipped (only the order of candidates depends on them)."""
    return np.clip(x, -1e18, 1e18).astype(np.float32)


def _reach(book: Codebook, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Length of what the codes leave of each row; it bounds, with the query's length, how far a table sum can be off."""
    coded = book.centers[np.arange(book.parts), codes].reshape(len(x), -1)[:, : book.dim]
    with np.errstate(over="ignore"):
        left = np.sqrt(((x - coded) ** 2).sum(1)) + 1e-6 * np.sqrt((x * x).sum(1))  # the rest is for rounding of the sums
        return np.maximum(left, 1e-30).astype(np.float32)


class Group:
    """Codes and vectors of some rows, and the search among them."""

    def __init__(self, book: Codebook, ids: np.ndarray, packed: np.ndarray, reach: np.ndarray, vectors: np.ndarray):
        self.book, self.ids, self.packed, self.reach, self.vectors = book, ids, packed, reach, vectors
        self.largest = float(np.abs(vectors).max())
        self.probes = np.unique(np.linspace(0, len(ids) - 1, PROBES).astype(np.int64))
        self.probed = vectors[self.probes].astype(np.float64)

    def _exact(self, q: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Inner products, added up from the first component to the last."""
        out = np.zeros(len(places))
        with np.errstate(over="ignore", invalid="ignore"):
            for i in range(0, len(places), BLOCK_ROWS):
                part = self.vectors[places[i : i + BLOCK_ROWS]].T.astype(np.float64)
                for j, x in enumerate(q):
                    out[i : i + BLOCK_ROWS] += part[j] * x
        return out

    def _best(self, places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` ids with the best score of each."""
        order = np.lexsort((self.ids[places], -np.where(np.isnan(scores), np.inf, scores), ~np.isnan(scores)))
        places, scores = places[order], scores[order]
        first = np.sort(np.unique(self.ids[places], return_index=True)[1])[:k]
        return places[first], scores[first]

    def near(self, asker: int, q: np.ndarray, table: np.ndarray, k: int, pool: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best ``k`` ids; ``table`` is of the query's direction."""
        n, largest = len(self.ids), float(np.abs(q).max())
        unit = q / largest
        unit = unit / np.sqrt((unit * unit).sum())
        if n > 4 * pool and self.largest * largest * len(q) < 1e300:
            total = table[0][self.packed[0]]
            for b in range(1, len(self.packed)):
                total += table[b][self.packed[b]]
            first = np.argpartition(total, n - pool)[n - pool :]
            direct = self.vectors[first].astype(np.float64) @ unit
            other = self.ids[first] != asker
            top = self._best(first[other], direct[other], k)[1]
            if len(top) == k:
                # How far sums were off, for rows anywhere and for those near the query.
                off = [(self.probed @ unit - total[self.probes]) / self.reach[self.probes], (direct - total[first]) / self.reach[first]]
                with np.errstate(all="ignore"):
                    margin = SURE * max(0.5 / math.sqrt(len(q)), *(math.sqrt(float((x * x).mean())) for x in off))
                    places = np.flatnonzero(~(total + np.float32(margin) * self.reach < np.float32(top[-1] - abs(top[-1]) * 1e-6)))
                places = places[self.ids[places] != asker]
                scores = np.concatenate([self.vectors[places[i : i + BLOCK_ROWS]].astype(np.float64) @ unit for i in range(0, len(places), BLOCK_ROWS)])
                places = places[scores >= top[-1] - 1e-12 * self.largest * len(q) ** 1.5]  # rounding depends on the order of addition
                best = self._best(places, self._exact(q, places), k)
                if len(best[1]) == k and abs(best[1][-1]) > 1e-290:
                    return best
        places = np.flatnonzero(self.ids != asker)
        return self._best(places, self._exact(q, places), k)


def kept(n: int) -> int:
    """How many rows are reranked first for a query of a table of ``n`` rows."""
    return max(KEEP, math.ceil(KEEP * math.sqrt(n / KEEP_ROWS)))


def search(vectors: DataFrame, is_query: Column, k: int = 20, keep: int | None = None) -> DataFrame:
    """The ``k`` nearest of all other rows for each query row of (vec_id, embedding): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"))
    commonest = sizes.orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if commonest is None or not commonest["q"]:
        return spark.createDataFrame([], schema)
    dim, n, n_queries = commonest
    rows = rows.filter(F.size("embedding") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    book = Codebook(dim).fit(_scaled(_matrix(sample.column(0), dim)))

    # Single precision holds vectors that came in it; they are widened before they are multiplied.
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    query_blocks = -(-n_queries // QUERIES_PER_BLOCK)
    group_rows = max(1, min(GROUP_ROWS, GROUP_BYTES // (dim * np.dtype(kind).itemsize)))
    groups = max(-(-n // group_rows), min(common.partitions(spark), -(-n // LEAST_ROWS)))
    block_rows = max(64, min(BLOCK_ROWS, n // (4 * groups)))
    pool = max(4 * k, -(-(kept(n) if keep is None else keep) // groups))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() * 7919  # blocks go to the groups in turn, from another one in each task
        for batch in batches:
            for i in range(0, batch.num_rows, block_rows):
                ids = batch.column(0).slice(i, block_rows).to_numpy(zero_copy_only=False).astype("<i8")
                exact = _matrix(batch.column(1).slice(i, block_rows), dim)
                codes = book.encode(_scaled(exact))
                held = (ids, book.packed(codes), _reach(book, exact, codes).astype("<f4"), exact.astype(kind))
                yield pa.RecordBatch.from_arrays([pa.array([at % groups], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in held]], schema=_CODED)
                at += 1

    def asked(part: pa.Table) -> pa.Table:
        q = _matrix(part.column("embedding").combine_chunks(), dim).astype("<f8")
        ids = part.column("vec_id").to_numpy().astype("<i8")
        return pa.table({"qb": [part.column("qb")[0].as_py()], "queries": [ids.tobytes()], "vectors": [q.tobytes()]}, schema=_ASKED)

    blocks = common.stage(rows.select("vec_id", "embedding").mapInArrow(coded, "g long, ids binary, codes binary, reach binary, vectors binary"), "ann-codes")
    asks = rows.filter("asks").select("vec_id", "embedding", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(query_blocks)).cast("int").alias("qb"))
    asks = common.stage(asks.groupBy("qb").applyInArrow(asked, "qb int, queries binary, vectors binary"), "ann-queries")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, group = None, [], None
        for batch in batches:
            for row in range(batch.num_rows):
                read = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)  # noqa: B023, E731
                if batch.column(0)[row].as_py() != at:
                    at, parts, group = batch.column(0)[row].as_py(), [], None
                if batch.column(1)[row].as_py() == 0:
                    ids = read(2, "<i8").copy()
                    parts.append((ids, read(3, np.uint8).reshape(-1, len(ids)).copy(), read(4, "<f4").copy(), read(5, kind).reshape(-1, dim).copy()))
                    continue
                if group is None and parts:
                    ids, codes, reach, held = zip(*parts, strict=True)
                    group, parts = Group(book, np.concatenate(ids), np.concatenate(codes, 1), np.concatenate(reach), np.concatenate(held)), []
                    del ids, codes, reach, held
                if group is not None:
                    queries, q = read(2, "<i8"), read(5, "<f8").reshape(-1, dim)
                    found = [group.near(i, v, table, k, pool) for i, v, table in zip(queries.tolist(), q, book.tables(_directions(q)), strict=True)]
                    places, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                    asker = np.repeat(queries, [len(x[0]) for x in found])
                    yield pa.RecordBatch.from_arrays([pa.array(asker), pa.array(group.ids[places]), pa.array(scores)], names=["query_id", "vec_id", "score"])

    # A cell is a group of rows; its blocks come first, then all queries stream by.
    nothing = F.lit(None).cast("binary")
    cells = blocks.select(F.col("g").alias("cell"), F.lit(0).alias("kind"), F.col("ids").alias("a"), "codes", "reach", "vectors")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("cell")
    cells = cells.unionByName(asks.select(each, F.lit(1).alias("kind"), F.col("queries").alias("a"), nothing.alias("codes"), nothing.alias("reach"), "vectors"))
    cells = cells.repartitionByRange(groups, "cell").sortWithinPartitions("cell", "kind")
    found = cells.mapInArrow(scanned, "query_id long, vec_id long, score double")
    scored = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_CODED = pa.schema([("g", pa.int64()), *[(c, pa.binary()) for c in ("ids", "codes", "reach", "vectors")]])
_ASKED = pa.schema([("qb", pa.int32()), ("queries", pa.binary()), ("vectors", pa.binary())])


def _directions(q: np.ndarray) -> np.ndarray:
    """Queries of length 1, which have the order of their own length's scores."""
    unit = q / np.abs(q).max(1, keepdims=True)
    return (unit / np.sqrt((unit * unit).sum(1, keepdims=True))).astype(np.float32)


def query_ids(vec_id: Column) -> Column:
    """The fixed query set: ids divisible by 20."""
    return vec_id % 20 == 0
