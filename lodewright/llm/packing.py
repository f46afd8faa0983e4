"""Cost-balanced packing of documents into training sequences (operator 7).

The cost of a sequence is estimated as linear plus quadratic: each piece of ``n`` tokens that
stands in it costs ``n + n * n / QUADRATIC``, as attention stays inside a piece.  Documents in
descending length go to the sequence of lowest cost that still has room for them; a document
that no sequence can hold whole is cut.  The room of a group's sequences is exactly its tokens:
as many full sequences as they fill, and the rest in sequences of powers of two, which need no
padding.

Scale: one narrow pass, no shuffle.  A task packs groups of ``GROUP_TOKENS`` tokens in the
order of its rows and holds one group at a time.  Sequence numbers carry the partition, so they
are unique and, for input that reads back in the same order, the same in every run.

Defined results: a null or empty text is its end token alone; repeated rows are packed row by
row; a null doc_id is kept; an empty table has no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import pretokens

CAPACITY = 2048
GROUP_TOKENS = 2048 * 1024
#: Bytes of text that are encoded at once; the arrays of a pass take some 80 times as much (40 MB).
SLICE_BYTES = 512 << 10
QUADRATIC = 1024
_SEQUENCE_BITS = 36
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
)
_FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]


def capacities(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Room of the sequences for a group: full ones, then the rest by its binary digits."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cost(n: int) -> float:
    return n + n * n / QUADRATIC


def assign(sizes: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, length, sequence) for documents of the given sizes."""
    room = capacities(int(sizes.sum()), capacity)
    pieces = []
    order = np.argsort(-sizes, kind="stable").tolist()
    length = sizes.tolist()
    full = sum(1 for r in room if r == capacity)
    whole, used = {}, 0
    # A document's full stretches take sequences of their own: nothing else would fit beside them.
    for d in order:
        at = 0
        while length[d] - at >= capacity and used < full:
            pieces.append((d, at, capacity, used))
            room[used] = 0
            used, at = used + 1, at + capacity
        whole[d] = at
    rests = sorted(((length[d] - at, -d) for d, at in whole.items() if length[d] > at), reverse=True)
    room, cost = np.array(room, np.int64), np.zeros(len(room))
    for n, d in rests:
        d, at = -d, whole[-d]
        fits = np.flatnonzero(room >= n)
        if len(fits):
            taken = [(int(fits[np.argmin(cost[fits])]), n)]
        else:  # cut: fill the sequences with the most room
            taken, left = [], n
            for s in np.argsort(-room, kind="stable").tolist():
                taken.append((s, min(left, int(room[s]))))
                left -= taken[-1][1]
                if not left:
                    break
        for s, k in taken:
            pieces.append((d, at, k, s))
            at, room[s], cost[s] = at + k, room[s] - k, cost[s] + _cost(k)
    return pieces


class _Group:
    """Documents of one group: their ids, and then their pieces."""

    def __init__(self) -> None:
        self.doc, self.ids, self.tokens = [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc.append(doc_id)
        self.ids.append(ids.astype("<u4"))
        self.tokens += len(ids)

    def packed(self, base: int) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in self.ids], np.int64)
        rows = sorted(assign(sizes), key=lambda x: x[3])
        out = {f: [] for f in _FIELDS}
        at, last = 0, -1
        begin = 0
        for d, start, n, s in rows:
            if s != last:
                for _ in range(len(out["doc_id"]) - begin):
                    out["sequence_length"].append(at)
                begin, at, last = len(out["doc_id"]), 0, s
            out["doc_id"].append(self.doc[d])
            out["start"].append(start)
            out["length"].append(n)
            out["ids_crc32"].append(zlib.crc32(self.ids[d][start : start + n]))
            out["doc_tokens"].append(len(self.ids[d]))
            out["sequence_id"].append(base + s)
            out["offset"].append(at)
            at += n
        out["sequence_length"] += [at] * (len(out["doc_id"]) - begin)
        return pa.RecordBatch.from_arrays([pa.array(out[f], pa.int64()) for f in _FIELDS], names=_FIELDS)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """The pieces of all documents: see ``SCHEMA``; ``tokenizer`` is the path of a ``tokenizers`` file on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pretokens.encoder(tokenizer)
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << _SEQUENCE_BITS
        group, number = _Group(), 0
        for names, run_of in pretokens.slices(batches, SLICE_BYTES):
            ids, counts = encoder.encode(run_of, end=end_id)
            at = 0
            for doc_id, n in zip(names.to_pylist(), counts.tolist(), strict=True):
                group.add(doc_id, ids[at : at + n])
                at += n
                if group.tokens >= GROUP_TOKENS:
                    out = group.packed(base + number)
                    number += max(1, len(capacities(group.tokens)))
                    group = _Group()
                    yield out
        if group.doc:
            yield group.packed(base + number)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
