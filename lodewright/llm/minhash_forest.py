"""Near-duplicate documents by an LSH forest over MinHash signatures (operator 6).

Documents with equal shingle sets form a class first; the rest works on one document of each.
A tree of the forest is an order: classes sorted by their MinHash slots, in an order of slots
of the tree's own.  Classes that share ``PREFIX`` slots form a region.  In a small region all
are candidates of each other, filtered by deeper slots, then by their signatures, and confirmed
on their full shingle sets.  A crowded region, and one on the border of a range, goes on with
full sets at once: it is dealt into blocks, and a task counts the shared shingles of all pairs
of a block and gives out a spanning forest of the links that it finds, not the pairs.

Crowded regions are closed in turns of some trees.  A turn leaves out the regions whose members
the links so far have brought into one component.  A region of several blocks then meets its
hubs (in each block the member with most links, the best of them for the region); what stays
outside its largest component meets all of the region, block by block.  So no pair of a region
is left out but inside a component, where no link changes it.

Components are kept as labels in tables in the shared folder.  New links are first brought to the
components that they connect, so what has to be united is small; it is united in one task up to a
checked number of links, and by label propagation with pointer jumping beyond it.

Scale: the orders are range-partitioned by their full keys, and the blocks of a region spread
over many tasks, so a group with a third of all rows has no task of its own.  Copies of one text are
one class after a partial aggregation.  Pairs inside a component are never rows.  The only work
that grows with the square of a region is that of the members outside its largest component.

Defined results: null and empty texts, and texts without words, have 0 shingles, are linked
with nothing and are their own component; very long texts are taken whole, one of more shingles than a block holds
makes up a block; rows are compared by their texts, also those that share a doc_id or have none; ties between ids cannot arise,
equal ids are one name; a null doc_id takes the smallest id of its component (null if all are null) and is kept only then; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, pretokens
from .span_hash import SpanHasher, mix

SLOTS = 128
TREES = 25
PREFIX = 5
DEPTH = 16
#: A region of more classes is crowded.
SMALL = 9
#: Crowded regions of trees before each of these are closed together.
TURNS = (2, TREES)
#: Bytes of text that are sketched at once: a worker may hold a tokenizer's tables of another stage beside them.
SLICE_BYTES = 512 << 10
#: Members of a block, and bytes of their sets, on average.
BLOCK = 512
BLOCK_BYTES = 2 << 20
HUBS = 4
#: Links between components that one task unites.
LOCAL_LINKS = 1_000_000
ROWS_PER_RANGE = 1 << 20
#: Rows of ids and labels that are broadcast, of about 110 bytes each there: 22 MB.
BROADCAST_IDS = 200_000
#: A candidate passes its signatures if they agree in this much less than the similarity asked for.
SLACK = 0.14
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in common.SPACES]] = True


class Shingles:
    """The distinct shingles of some texts: ``hash`` and ``check`` by text and hash, ``sizes`` of the sets."""

    def __init__(self, texts: list[str], width: int, hasher: SpanHasher):
        raw = [t.encode("utf-8") for t in texts]
        buf = _LOWER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        begins = np.cumsum(sizes) - sizes
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[buf], [True]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        doc = np.searchsorted(begins, starts, "right") - 1
        words = np.bincount(doc, minlength=len(texts))
        hashes = hasher(buf, starts, ends) if len(starts) else (np.zeros(0, np.uint64),) * 2
        count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
        owner = np.repeat(np.arange(len(texts)), count)
        first = np.repeat(np.cumsum(words) - words, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(words, width)[owner]
        made = []
        with np.errstate(over="ignore"):
            for h in hashes:
                s = np.full(len(owner), np.uint64(0x2545F4914F6CDD1D)) * length.astype(np.uint64)
                for k in range(width):
                    at = np.flatnonzero(length > k)
                    s[at] = mix(s[at] * np.uint64(0x9E3779B97F4A7C15) + h[first[at] + k])
                made.append(s)
        order = np.lexsort((made[0], owner))
        owner, a, b = owner[order], made[0][order], made[1][order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])
        self.hash, self.check = a[new], b[new]
        self.sizes = np.bincount(owner[new], minlength=len(texts)).astype(np.int64)


    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each set, the same for equal sets."""
        stops, out = np.cumsum(self.sizes), []
        for values in (self.hash, self.check):
            total = np.append(np.uint64(0), np.cumsum(mix(values), dtype=np.uint64))
            out.append((total[stops] - total[stops - self.sizes]).view(np.int64))
        return out[0], out[1]


def signatures(s: Shingles) -> np.ndarray:
    """A row of ``SLOTS`` 16-bit MinHash slots for each text with shingles (others: zeros)."""
    out = np.zeros((len(s.sizes), SLOTS), np.uint16)
    filled = np.flatnonzero(s.sizes)
    if not len(filled):
        return out
    begins = (np.cumsum(s.sizes) - s.sizes)[filled]
    rng = np.random.default_rng(11)
    seeds = rng.integers(0, 1 << 63, (SLOTS, 2), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SLOTS):
            h = (s.hash ^ seeds[k, 0]) * (seeds[k, 1] | np.uint64(1))
            least = np.minimum.reduceat(h, begins)
            out[filled, k] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, class_a and class_b (a 128-bit digest of the set), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for ids, texts in pretokens.slices(batches, SLICE_BYTES):
            s = Shingles(texts, width, hasher)
            columns = [ids, pa.array(s.sizes), *map(pa.array, s.digests()), pa.array([r.tobytes() for r in signatures(s)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "class_a", "class_b", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, class_a long, class_b long, signature binary")


def _slots_of(tree: int) -> np.ndarray:
    return (tree * PREFIX + np.arange(DEPTH)) % SLOTS


def trees(classes: DataFrame) -> DataFrame:
    """The rows of all orders: tree, key (``DEPTH`` slots, highest byte first), node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(node), 4096):
                raw = b"".join(x.as_py() for x in batch.column(1)[i : i + 4096])
                rows = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).astype(">u2")
                for t in range(TREES):
                    keys = np.ascontiguousarray(rows[:, _slots_of(t)])
                    packed = pa.Array.from_buffers(pa.binary(2 * DEPTH), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
                    columns = [pa.array(np.full(len(keys), t, np.int32)), packed, pa.array(node[i : i + 4096])]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "key", "node"])

    return classes.select("node", "signature").mapInArrow(run, "tree int, key binary, node long")


def _regions(batches: Iterator[pa.RecordBatch], least_agreeing: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of the small regions of one range of the orders, and the rows (a, tree, region) of the others.

    The first and the last region of a range may go on in the next range, so they count as crowded.
    """
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    whole = pa.Table.from_batches(tables)
    tree = whole.column(0).to_numpy()
    node = whole.column(2).to_numpy()
    raw = np.frombuffer(b"".join(whole.column(1).to_pylist()), np.uint8).reshape(-1, 2 * DEPTH)
    keys = raw.view(">u2").astype(np.uint16)
    apart = np.ones(len(node), bool)
    apart[1:] = (tree[1:] != tree[:-1]) | (keys[1:, :PREFIX] != keys[:-1, :PREFIX]).any(1)
    region = np.cumsum(apart) - 1
    crowded = np.bincount(region) > SMALL
    crowded[[0, -1]] = True
    small = ~crowded[region]
    found = []
    for k in range(1, SMALL):
        i = np.flatnonzero((region[k:] == region[:-k]) & small[k:])
        i = i[(keys[i, PREFIX:] == keys[i + k, PREFIX:]).sum(1) >= least_agreeing]
        found.append(np.stack([np.minimum(node[i], node[i + k]), np.maximum(node[i], node[i + k])], 1))
    pairs = np.unique(np.concatenate(found), axis=0)
    names = ["a", "b", "tree", "region"]
    for i in range(0, len(pairs), 10_000):
        a, b = (pa.array(c.copy()) for c in pairs[i : i + 10_000].T)
        yield pa.RecordBatch.from_arrays([a, b, pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], names=names)
    rows = np.flatnonzero(~small)
    for i in range(0, len(rows), 10_000):
        at = rows[i : i + 10_000]
        prefix = np.concatenate([tree[at, None].astype(np.uint8), raw[at, : 2 * PREFIX]], 1)
        columns = [pa.array(node[at]), pa.nulls(len(at), pa.int64()), pa.array(tree[at]), pa.array([x.tobytes() for x in prefix], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def candidates(classes: DataFrame, n_classes: int, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of classes in small regions; (tree, region, node) of crowded ones."""
    ranges = max(common.partitions(classes.sparkSession), n_classes * TREES // ROWS_PER_RANGE + 1)
    least = (DEPTH - PREFIX) // 2 + 1
    orders = trees(classes).repartitionByRange(ranges, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = scratch.stage(orders.mapInArrow(lambda batches: _regions(batches, least), "a long, b long, tree int, region binary"), "near-found")
    pairs = found.filter("region is null").select("a", "b").distinct()
    return pairs, found.filter("region is not null").select("tree", "region", F.col("a").alias("node"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree nearly as much as asked for."""
    left = classes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = classes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    least = int((percent / 100 - SLACK) * SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SLOTS) for i in (2, 3))
            good = pa.array((sa == sb).sum(1) >= least)
            yield batch.select([0, 1]).filter(good)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, set): the shingle set (sorted 64-bit hashes) of each wanted class (node, rep, class_a, class_b), once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = SpanHasher(), set()
        for _, texts in pretokens.slices(batches, SLICE_BYTES):
            s = Shingles(texts, width, hasher)
            a, b = s.digests()
            stops = np.cumsum(s.sizes)
            new = [i for i, d in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if s.sizes[i] and not (d in seen or seen.add(d))]
            sets = [s.hash[stops[i] - s.sizes[i] : stops[i]].tobytes() for i in new]
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(sets, pa.binary())], names=["class_a", "class_b", "set"])

    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    named = docs.select("doc_id", "text").join(_few(ids), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    made = named.mapInArrow(run, "class_a long, class_b long, set binary")
    return made.join(wanted.drop("rep"), ["class_a", "class_b"]).groupBy("node").agg(F.first("set").alias("set"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


class Block:
    """Some members of a region: ``node``, their ``component`` so far, and their sets one after the other, ``sizes`` long."""

    def __init__(self, node: np.ndarray, component: np.ndarray, sizes: np.ndarray, values: np.ndarray):
        self.node, self.component, self.sizes, self.values = node, component, sizes, values

    @classmethod
    def of(cls, rows: list[tuple[int, int, bytes]]) -> Block:
        sets = [r[2] for r in rows]
        sizes = np.array([len(x) // 8 for x in sets], np.int64)
        return cls(*(np.array([r[k] for r in rows], np.int64) for k in (0, 1)), sizes, np.frombuffer(b"".join(sets), np.uint64))

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.node, self.component, self.sizes, self.values)]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Block:
        return cls(*(np.frombuffer(p, kind) for p, kind in zip(parts, (np.int64, np.int64, np.int64, np.uint64), strict=True)))

    def set_of(self, i: int) -> bytes:
        stop = int(self.sizes[: i + 1].sum())
        return self.values[stop - int(self.sizes[i]) : stop].tobytes()


def shared(x: Block, y: Block) -> np.ndarray:
    """How many shingles each member of ``x`` shares with each of ``y``: by matrix products for frequent ones, pair by pair for rare ones."""
    nx, ny = len(x.node), len(y.node)
    ox, oy = (np.repeat(np.arange(len(b.node)), b.sizes) for b in (x, y))
    _, at = np.unique(np.concatenate([x.values, y.values]), return_inverse=True)
    ix, iy = at[: len(x.values)], at[len(x.values) :]
    n = int(at.max()) + 1 if len(at) else 0
    fx, fy = np.bincount(ix, minlength=n), np.bincount(iy, minlength=n)
    frequent = fx * fy > 256
    out = np.zeros((nx, ny))
    column = np.cumsum(frequent) - 1
    for first in range(0, int(frequent.sum()), 2048):
        sides = []
        for i, o, m in ((ix, ox, nx), (iy, oy, ny)):
            here = frequent[i] & (column[i] >= first) & (column[i] < first + 2048)
            side = np.zeros((m, 2048), np.float32)
            side[o[here], column[i[here]] - first] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    here = np.flatnonzero(~frequent[ix] & (fy[ix] > 0))
    times = fy[ix[here]]
    begin = (np.cumsum(fy) - fy)[ix[here]]
    place = np.repeat(begin - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
    other = oy[np.argsort(iy, kind="stable")][place]
    return (out + np.bincount(np.repeat(ox[here], times) * ny + other, minlength=nx * ny).reshape(nx, ny)).astype(np.int64)


def linked(x: Block, y: Block, percent: int) -> np.ndarray:
    """Which members of ``x`` are similar enough to which of ``y``."""
    both = shared(x, y)
    return 100 * both >= percent * (x.sizes[:, None] + y.sizes - both)


def spanning(links: np.ndarray, x: Block, y: Block) -> pa.RecordBatch:
    """Links (a, b) that connect all that ``links`` connects, without those inside a component."""
    rows, columns, found = np.ones(len(x.node), bool), np.ones(len(y.node), bool), []
    for seed in range(len(rows)):
        if not rows[seed]:
            continue
        rows[seed], todo = False, [seed]
        while todo:
            i = todo.pop()
            js = np.flatnonzero(links[i] & columns)
            columns[js] = False
            found += [(i, j) for j in js.tolist()]
            for j in js.tolist():
                more = np.flatnonzero(links[:, j] & rows)
                rows[more] = False
                found += [(k, j) for k in more.tolist()]
                todo += more.tolist()
    i, j = np.array(found, np.int64).reshape(-1, 2).T
    new = x.component[i] != y.component[j]
    a, b = x.node[i[new]], y.node[j[new]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


_PARTS = ["nodes", "components", "sizes", "sets"]
_BLOCK_SCHEMA = "a long, b long, region binary, block long, nodes binary, components binary, sizes binary, sets binary, hub long, hub_set binary, degree long"


def _blocks(members: DataFrame, sets: DataFrame, percent: int | None) -> DataFrame:
    """Blocks of the members (region, block, blocks, node, component), a row each; with ``percent`` links too.

    With ``percent`` a block's own links come as rows (a, b), a block that is the only one of its region is
    not given out, and the others name their hub.  Without it, all blocks are given out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(w.split()[0], pa.binary() if w.endswith("binary") else pa.int64()) for w in _BLOCK_SCHEMA.split(", ")])
        key, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            whole = Block.of(rows)
            said = dict.fromkeys(schema.names)
            if percent is not None:
                links = linked(whole, whole, percent)
                tied = spanning(links, whole, whole)
                yield pa.RecordBatch.from_arrays([*tied.columns, *(pa.nulls(len(tied), f.type) for f in list(schema)[2:])], schema=schema)
                degree = links.sum(1)
                hub = int(degree.argmax())
                said |= {"hub": int(whole.node[hub]), "hub_set": whole.set_of(hub), "degree": int(degree[hub])}
            if percent is None or key[2] > 1:
                said |= {"region": key[0], "block": key[1]} | dict(zip(_PARTS, whole.packed(), strict=True))
                yield pa.RecordBatch.from_pylist([said], schema=schema)

        for batch in batches:
            for row in range(batch.num_rows):
                region, block, blocks, node, component, values = (c[row].as_py() for c in batch.columns)
                if key is not None and key[:2] != (region, block):
                    yield from done()
                    rows = []
                key = (region, block, blocks)
                rows.append((node, component, values))
        if rows:
            yield from done()

    dealt = members.join(sets, "node").select("region", "block", "blocks", "node", "component", "set")
    dealt = dealt.repartition(common.partitions(members.sparkSession), "region", "block").sortWithinPartitions("region", "block")
    return dealt.mapInArrow(run, _BLOCK_SCHEMA)


def _opened(members: DataFrame, labels: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Members of the regions that hold several components, with ``component``, ``main`` (the region's largest), ``blocks`` and ``block``."""
    named = members.join(labels.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left")
    named = scratch.stage(named.select("region", "node", "n_shingles", F.coalesce("component", "node").alias("component")), "near-members")
    parts = named.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    main = F.max_by("component", F.struct(F.col("n"), -F.col("component"))).alias("main")
    several = parts.groupBy("region").agg(main, F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("s") * 8 / BLOCK_BYTES)).alias("blocks")
    several = scratch.stage(several.select("region", "main", blocks), "near-regions")
    return named.join(_few(several), "region").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))


def _met(pairs: DataFrame, left: list[str], right: list[str], percent: int) -> DataFrame:
    """Links between the two blocks of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (Block.unpacked([batch.column(k + i)[row].as_py() for i in range(4)]) for k in (0, 4))
                yield spanning(linked(x, y, percent), x, y)

    return pairs.select(*left, *right).mapInArrow(run, "a long, b long")


def closed(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, scratch: common.Scratch) -> list[DataFrame]:
    """Links after which no two members of a crowded region (tree, region, node, n_shingles) are both unmet and in different components."""
    opened = scratch.stage(_opened(members, labels, scratch), "near-open")
    if not opened.head(1):
        return []
    found = scratch.stage(_blocks(opened, sets, percent), "near-blocks")
    links = [found.filter("a is not null").select("a", "b")]
    blocks = found.filter("region is not null")
    several = opened.filter("blocks > 1")
    if not blocks.head(1):
        return links
    best = Window.partitionBy("region").orderBy(F.desc("degree"), "hub")
    hubs = blocks.select("region", "hub", "hub_set", "degree").withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= HUBS)
    # The hubs go to every block of their region, one hub a row: a region's rows are its blocks times HUBS at most.
    joined = several.select("region", "block").distinct().join(hubs.select("region", "hub", "hub_set"), "region")
    joined = joined.join(blocks.select("region", "block", *_PARTS), ["region", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = Block.of([(batch.column(0)[row].as_py(), -1, batch.column(1)[row].as_py())])
                y = Block.unpacked([batch.column(2 + i)[row].as_py() for i in range(4)])
                yield spanning(linked(x, y, percent), x, y)

    links.append(scratch.stage(joined.select("hub", "hub_set", *_PARTS).mapInArrow(run, "a long, b long").filter("a < b"), "near-links"))
    now = relabelled(labels, links[0].unionByName(links[1]), scratch)
    rest = scratch.stage(_opened(several.select("region", "node", "n_shingles"), now, scratch).filter("component != main"), "near-rest")
    if not rest.head(1):
        return links
    # The rest is dealt into fewer blocks, each of which meets all blocks of its region.
    share = rest.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    fewer = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("s") * 8 / BLOCK_BYTES))
    share = scratch.stage(share.select("region", fewer.alias("blocks")), "near-share")
    rest = rest.select("region", "node", "component", F.col("blocks").alias("of")).join(_few(share), "region")
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    packed = scratch.stage(_blocks(dealt, sets, None).select("region", *[F.col(c).alias(f"rest_{c}") for c in _PARTS]), "near-rest-blocks")
    meeting = packed.join(_few(rest.select("region", "of").distinct()), "region")
    meeting = meeting.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1))).drop("of")
    meeting = meeting.join(blocks.select("region", "block", *_PARTS), ["region", "block"])
    links.append(scratch.stage(_met(meeting, [f"rest_{c}" for c in _PARTS], _PARTS, percent), "near-links"))
    return links


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links in one task: smallest labels, sent and jumped until nothing changes."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    a, b = (np.concatenate([t.column(i).to_numpy() for t in tables]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    for i in range(0, len(nodes), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 10_000]), pa.array(nodes[label[i : i + 10_000]])], names=["node", "component"])


def components(links: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.  Up to ``LOCAL_LINKS`` links are united in one task, more by label propagation."""
    links = scratch.stage(links.select("a", "b"), "near-edges")
    if links.count() <= LOCAL_LINKS:
        return scratch.stage(links.coalesce(1).mapInArrow(_united, "node long, component long"), "near-labels")
    both = links.union(links.select("b", "a")).toDF("u", "v")
    labels = scratch.stage(both.groupBy("u").agg(F.min("v").alias("l")).select(F.col("u").alias("node"), F.least("u", "l").alias("component")), "near-labels")
    while True:
        sent = both.join(labels, both["u"] == labels["node"]).groupBy("v").agg(F.min("component").alias("got"))
        told = labels.join(sent, labels["node"] == sent["v"]).select("node", F.col("component").alias("old"), F.least("component", "got").alias("near"))
        jump = told.select(F.col("node").alias("at"), F.col("near").alias("further"))
        labels = told.join(jump, told["near"] == jump["at"], "left").select("node", "old", F.least("near", "further").alias("component"))
        labels = scratch.stage(labels, "near-labels")
        if not labels.filter("component < old").head(1):
            return labels.select("node", "component")
        labels = labels.drop("old")


def relabelled(labels: DataFrame, links: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Labels (node, component) with more links: only components and new nodes are joined up, links inside a component count for nothing."""
    of = lambda c: labels.select(F.col("node").alias(f"__{c}"), F.col("component").alias(f"__c{c}"))
    named = links.join(of("a"), F.col("a") == F.col("__a"), "left").join(of("b"), F.col("b") == F.col("__b"), "left")
    named = named.select(F.coalesce("__ca", "a").alias("x"), F.coalesce("__cb", "b").alias("y")).filter("x <> y")
    found = components(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), scratch)
    old = labels.join(found.toDF("__n", "__c"), F.col("component") == F.col("__n"), "left").select("node", F.coalesce("__c", "component").alias("component"))
    new = found.join(labels.select("node"), "node", "left_anti")
    return scratch.stage(old.unionByName(new), "near-labels")


def link(docs: DataFrame, width: int = 3, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all documents, classes (node, rep, class keys, n_shingles, signature), and (node, component) of the linked ones."""
    spark = docs.sparkSession
    rows = common.stage(sketch(docs, width), "near-sketches")
    grouped = rows.filter("n_shingles > 0").groupBy("class_a", "class_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    classes = common.stage(grouped.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    with common.Scratch(spark) as scratch:
        pairs, members = candidates(classes, classes.count(), scratch)
        alike = scratch.stage(_alike(pairs, classes, percent), "near-alike")
        wanted = alike.select("a").union(alike.select("b")).union(members.select("node")).distinct().toDF("node")
        wanted = scratch.stage(wanted.join(classes.select("node", "rep", "class_a", "class_b", "n_shingles"), "node"), "near-wanted")
        sets = scratch.stage(_sets(docs, wanted.drop("n_shingles"), width), "near-sets")
        links = confirmed(alike, sets, percent)
        members = members.join(_few(wanted.select("node", "n_shingles")), "node")
        labels, first = components(links, scratch), 0
        for stop in TURNS:
            more = closed(members.filter((F.col("tree") >= first) & (F.col("tree") < stop)), sets, labels, percent, scratch)
            if more:
                labels = relabelled(labels, _all(more), scratch)
            first = stop
        labels = common.stage(labels, "near-components")
    return rows, classes, labels


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def groups(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    rows, classes, labels = link(docs, width, percent)
    named = classes.join(labels.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").withColumn("component", F.coalesce("component", "node"))
    least = common.stage(named.groupBy("component").agg(F.min("rep").alias("least")), "near-least")
    named = named.join(least, "component").select(F.col("class_a").alias("ka"), F.col("class_b").alias("kb"), F.col("n_shingles").alias("kn"), "least")
    named = common.stage(named, "near-named")
    rows = rows.select("doc_id", "n_shingles", "class_a", "class_b")
    same = (rows["class_a"] == named["ka"]) & (rows["class_b"] == named["kb"]) & (rows["n_shingles"] == named["kn"])
    out = rows.join(named, same, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, in the columns of ``docs``: of each group the row of the smallest id, a null id last.

    Rows are compared by their texts under a staged row number, so null and repeated ids are rows like others.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.monotonically_increasing_id().alias("__key"))
    whole = common.stage(whole, "near-documents")
    parts = groups(whole.select(F.col("__key").alias("doc_id"), F.col("__row.text").alias("text")), width, percent)
    named = whole.select("__key", F.col("__row.doc_id").alias("__id")).join(parts.select(F.col("doc_id").alias("__key"), "component_id"), "__key")
    first = F.min_by("__key", F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__key")))
    kept = common.stage(named.groupBy("component_id").agg(first.alias("__key")).select("__key"), "near-kept")
    return whole.join(_few(kept), "__key", "left_semi").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
