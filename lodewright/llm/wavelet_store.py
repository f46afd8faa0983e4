"""Token ids as wavelet matrices, one file for each shard (operator 4).

A shard's ids are kept as bit-planes: plane 0 holds the ids' highest bits in order; each next
plane holds the next bits after a stable sort by the bit before.  With counts of ones (rank) and
their search (select) a single file answers: the id at a place, how often an id occurs before a
place, and where its n-th occurrence is, without decoding the rest.

File format (little endian): magic ``LWM2``, bits (u32), number of ids n (u64), number of
documents (u64), zeros of each plane (u64 each); the rank directory, for each plane the ones before each
of its blocks (u64 each); the sizes of all frames (u32 each: the documents' id counts, then the blocks of each
plane); the frames (zstd).  A block is ``BLOCK`` places of a plane, first place in the highest bit.
Counts are u32.  Opening reads the head alone; a question decompresses the blocks that it touches.

``write`` ranges the documents by doc_id, encodes them, and stores each shard's file as one row
of a table in the shared folder, through Spark's own writer: a lost executor's shards are
written again, and no path outside the shared folder is touched.  A shard closes when it has
``SHARD_IDS`` ids, so memory in a task is bounded by that and one document.

Defined results: a null or empty text is its end id alone; rows of equal doc_id follow each
other in the order of their texts' hashes; a null doc_id comes first; a very long text is one document in one shard; an empty table has no shards; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, pretokens

MAGIC = b"LWM2"
SHARD_IDS = 1 << 20
BLOCK = 1 << 16


def encode_shard(ids: np.ndarray, counts: np.ndarray, bits: int, level: int = 1) -> bytes:
    """The file of a shard; ``counts`` are the ids of each document."""
    packer = zstandard.ZstdCompressor(level=level)
    frames, zeros, ranks, now = [packer.compress(counts.astype("<u4").tobytes())], [], [], ids
    for b in range(bits - 1, -1, -1):
        bit = (now & now.dtype.type(1 << b)) != 0
        plane = np.packbits(bit)
        frames += [packer.compress(plane[i : i + BLOCK // 8].tobytes()) for i in range(0, len(plane), BLOCK // 8)]
        ones = np.array([np.count_nonzero(bit[i : i + BLOCK]) for i in range(0, len(bit), BLOCK)], np.int64)
        ranks.append((np.cumsum(ones) - ones).astype("<u8"))
        zeros.append(len(bit) - int(ones.sum()))
        if b:  # places are gathered: a mask's own way is slow where zeros and ones change often
            now = np.concatenate([now.take(np.flatnonzero(~bit)), now.take(np.flatnonzero(bit))])
    head = MAGIC + struct.pack("<IQQ", bits, len(ids), len(counts)) + np.array(zeros, "<u8").tobytes() + np.concatenate(ranks).tobytes()
    return head + np.array([len(f) for f in frames], "<u4").tobytes() + b"".join(frames)


class Shard:
    """A shard's file, opened."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        self.data = data
        self.bits, self.n, _ = struct.unpack_from("<IQQ", data, 4)
        self.blocks = -(-self.n // BLOCK)
        at = 24
        self.zeros = np.frombuffer(data, "<u8", self.bits, at).astype(np.int64)
        at += 8 * self.bits
        self.ranks = np.frombuffer(data, "<u8", self.bits * self.blocks, at).astype(np.int64).reshape(self.bits, self.blocks)
        at += 8 * self.ranks.size
        sizes = np.frombuffer(data, "<u4", 1 + self.ranks.size, at).astype(np.int64)
        self.places = at + 4 * len(sizes) + np.append(0, np.cumsum(sizes))
        self.opener = zstandard.ZstdDecompressor()
        self.opened: dict[int, np.ndarray] = {}

    def _frame(self, i: int) -> bytes:
        return self.opener.decompress(self.data[self.places[i] : self.places[i + 1]])

    @functools.cached_property
    def counts(self) -> np.ndarray:
        return np.frombuffer(self._frame(0), "<u4")

    def _block(self, plane: int, block: int) -> np.ndarray:
        i = 1 + plane * self.blocks + block
        if i not in self.opened:
            self.opened[i] = np.frombuffer(self._frame(i), np.uint8)
        return self.opened[i]

    def _ones(self, plane: int, place: int) -> int:
        """Ones of a plane before a place."""
        block, rest = divmod(place, BLOCK)
        if not rest:
            return int(self.ranks[plane, block]) if block < self.blocks else self.n - int(self.zeros[plane])
        bits = self._block(plane, block)
        ones = int(np.bitwise_count(bits[: rest // 8]).sum())
        if rest % 8:
            ones += (int(bits[rest // 8]) >> (8 - rest % 8)).bit_count()
        return int(self.ranks[plane, block]) + ones

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for k in range(self.bits):
            block, rest = divmod(place, BLOCK)
            bit = int(self._block(k, block)[rest >> 3] >> (7 - rest % 8) & 1)
            ones = self._ones(k, place)
            place = int(self.zeros[k]) + ones if bit else place - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, place: int) -> tuple[int, int]:
        lo, hi = 0, place
        for k in range(self.bits):
            a, b = self._ones(k, lo), self._ones(k, hi)
            if token >> (self.bits - 1 - k) & 1:
                lo, hi = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, place: int | None = None) -> int:
        """Occurrences of an id before a place (of all, without one)."""
        if token >> self.bits:
            return 0
        lo, hi = self._range(token, self.n if place is None else min(place, self.n))
        return hi - lo

    def occurrence(self, token: int, k: int) -> int:
        """The place of the ``k``-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        place = self._range(token, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            place = self._select(level, bit, place - (int(self.zeros[level]) if bit else 0))
        return place

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the ``k``-th zero or one of a plane, by halving on rank."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes' sorts from the last one up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            plane = b"".join(self._frame(1 + k * self.blocks + i) for i in range(self.blocks))
            bit = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n).view(bool)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~bit)] = now[: self.zeros[k]]
            up[np.flatnonzero(bit)] = now[self.zeros[k] :] | kind(1 << (self.bits - 1 - k))
            now = up
        return now


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode all documents into shards; returns the table of shards (part, place, doc_ids, n_ids, file), read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pretokens.encoder(tokenizer)
        bits = max(1, int(max(encoder.library.get_vocab_size() - 1, end_id)).bit_length())
        ids, counts, docs_in, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            data = encode_shard(np.concatenate(ids), np.array(counts, np.int64), bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([docs_in], pa.list_(pa.int64())), pa.array([held], pa.int64()), pa.array([data], pa.binary())], names=["doc_ids", "n_ids", "file"]
            )

        for names, part in pretokens.slices(batches):
            doc_ids = names.to_pylist()
            got, n = encoder.encode(part, end=end_id)
            # A slice may end a shard in its midst: cut where the running sum passes the limit.
            at = begin = 0
            for stop in np.cumsum(n).tolist():
                if held + stop - begin >= shard_ids:
                    ids.append(got[begin:stop])
                    last = int(np.searchsorted(np.cumsum(n), stop, "left")) + 1
                    counts += n[at:last].tolist()
                    docs_in += doc_ids[at:last]
                    held += stop - begin
                    yield shard()
                    ids, counts, docs_in, held = [], [], [], 0
                    at, begin = last, stop
            if at < len(n):
                ids.append(got[begin:])
                counts += n[at:].tolist()
                docs_in += doc_ids[at:]
                held += len(got) - begin
        if counts:
            yield shard()

    spark = docs.sparkSession
    order = [F.col("doc_id"), F.col("__h")]
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("__h"))
    placed = placed.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = placed.mapInArrow(run, "doc_ids array<long>, n_ids long, file binary")
    return common.stage(shards.withColumn("__at", F.monotonically_increasing_id()), "shards")


def read(shards: DataFrame) -> DataFrame:
    """Documents read back from the shards' files: doc_id, start, n_tokens, ids_crc32."""
    earlier = Window.partitionBy(common.range_of()).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))
    starts = common.with_before(shards.select("__at", "n_ids"), "before", F.col("n_ids")).select("__at", first.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, base, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(data.as_py())
                ids, counts = shard.decode().astype("<u4"), shard.counts.astype(np.int64)
                stops = np.cumsum(counts)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((stops - counts).tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids.as_py(), pa.int64()), pa.array(base + stops - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = shards.select("__at", "doc_ids", "file").join(F.broadcast(starts) if _few(shards) else starts, "__at")
    return files.select("doc_ids", "first", "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _few(shards: DataFrame, most: int = 100_000) -> bool:
    return shards.count() <= most
