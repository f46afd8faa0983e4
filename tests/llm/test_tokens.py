"""Token stores, packing and token counts against the libraries themselves."""

import tracemalloc
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from lodewright.llm import minhash_forest, packing, pretokens, span_hash, token_count, wavelet_store  # noqa: E402

BYTES, PLAIN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aabbstrevmldSTREL'''   \n\t12.,!é ßñ 　中字́İΣ<|>"
TEXTS = ["", " ", "\n\n", "it's  we'll ''re 're", "a<|endoftext|>b", "<|startoftext|>", "x" * 9000, "é" * 500, "İ ΣaΣ", "é", "\U0001f600 ok", "  x", "Ა"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), max_size=8))
@pytest.mark.parametrize("path", [BYTES, PLAIN])
def test_pieces_give_the_librarys_ids(path, texts):
    e = pretokens.encoder(path)
    for batch in (texts + TEXTS, texts, [t for t in texts + TEXTS if t.isascii()]):
        ids, counts = e.encode(batch, end=3)
        want = [e.library.encode(t, add_special_tokens=False).ids + [3] for t in batch]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("path", [BYTES, PLAIN])
def test_new_pieces_cost_the_model_alone(path):
    texts = TEXTS + ["".join(map(chr, range(0x250))), "Überzucht einöß\0 thtieser 12.5%"]
    want = [pretokens.encoder(path).library.encode(t, add_special_tokens=False).ids for t in texts]
    e = pretokens.Encoder(path)
    e.library = SimpleNamespace(model=e.library.model, encode=e.library.encode)  # whole texts, but no pieces
    ids, counts = e.encode(texts)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    e = pretokens.Encoder(path)
    e.letters = False  # a tokenizer without a byte-level vocabulary
    assert e.encode(texts)[0].tolist() == ids.tolist()


def test_byte_letters_are_the_librarys():
    from tokenizers.pre_tokenizers import ByteLevel

    assert set(map(chr, pretokens.byte_letters())) == set(ByteLevel.alphabet())
    for c in (0, 32, 127, 160, 173, 255):  # the last byte of each character
        text = bytes([0xC2 + (c >> 6 & 1), c & 0xBF | 0x80]).decode() if c > 127 else chr(c)
        said = "".join(chr(pretokens.byte_letters()[b]) for b in text.encode())
        assert ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0] == said


def test_hashes_tell_spans_apart_wherever_they_lie():
    rng = np.random.default_rng(2)
    spans = [bytes([b]) * n for b in (0, 97) for n in range(1, 300)]
    spans += [rng.integers(0, 2, n).astype(np.uint8).tobytes() for n in (1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 264, 5000) for _ in range(20)]
    spans += [bytes(a) + b"x" + bytes(b) for a in range(20) for b in range(20)]
    spans = [spans[i] for i in rng.permutation(len(spans) * 2) % len(spans)]
    ends = np.cumsum([len(x) for x in spans])
    one, two = span_hash.short_hashes(np.frombuffer(b"".join(spans), np.uint8), ends - [len(x) for x in spans], ends)
    both = len(set(zip(one.tolist(), two.tolist(), spans, strict=True)))
    assert len(set(spans)) == len(set(one.tolist())) == len(set(two.tolist())) == both


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), max_size=8))
def test_transducers_count_as_the_library(texts):
    c = token_count.counter(BYTES)
    for batch in (texts + TEXTS, texts, [t for t in texts + TEXTS if t.isascii()]):
        assert c.count(batch).tolist() == [len(c.library.encode(t, add_special_tokens=False).ids) for t in batch]


def test_chunk_maps_compose():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 10, 5000)
    symbols[::97] += 10
    symbols[0] = 13
    whole = token_count.starts(symbols, 1 << 13)
    for chunk in (1, 7, 256):
        assert (token_count.starts(symbols, chunk) == whole).all()
    maps = rng.integers(0, 5, (5, 13))
    got, now = token_count.scan(maps), np.arange(5)
    for k in range(13):
        now = maps[now, k]
        assert (got[:, k] == now).all()


def test_states_stay_finite():
    t = token_count.MergeTransducer(BYTES)
    t.count(b"ab" * 50)
    n = len(t.state)
    assert t.count(b"ab" * 5000) > 0 and len(t.state) < n + 50


def test_restart_keeps_counts(monkeypatch):
    t = token_count.MergeTransducer(BYTES)
    want = [t.count(w) for w in (b" hello", b"world", b" hello")]
    monkeypatch.setattr(token_count, "MAX_STATES", 3)
    assert [t.count(w) for w in (b" hello", b"world", b" hello")] == want


@pytest.mark.parametrize(("n", "block"), [(0, 64), (1, 64), (7, 1 << 16), (513, 64), (1024, 64), (4000, 256), (4000, 1 << 16)])
def test_wavelet_shards(n, block, monkeypatch):
    monkeypatch.setattr(wavelet_store, "BLOCK", block)
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 300, n).astype(np.uint16)
    counts = np.array([n // 3, n - n // 3])
    s = wavelet_store.Shard(wavelet_store.encode_shard(ids, counts, 16))
    assert (s.decode() == ids).all() and s.counts.tolist() == counts.tolist()
    for place in range(0, n, 97):
        assert s.access(place) == ids[place]
    for token in (0, 5, 299, 300, 1 << 17):
        places = np.flatnonzero(ids == token)
        assert s.count(token) == len(places) and s.count(token, n // 2) == (places < n // 2).sum()
        for k in range(0, len(places), 5):
            assert s.occurrence(token, k) == places[k]
    with pytest.raises(IndexError):
        s.access(n)


def test_a_question_opens_few_blocks(monkeypatch):
    monkeypatch.setattr(wavelet_store, "BLOCK", 256)
    ids = (np.arange(50_000) * 7919 % 300).astype(np.uint16)
    s = wavelet_store.Shard(wavelet_store.encode_shard(ids, np.array([len(ids)]), 9))
    assert s.access(31_000) == ids[31_000] and len(s.opened) <= 2 * 9


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start long")


ROWS = [(7, "hello there, world"), (3, None), (5, ""), (3, "again"), (None, "no id"), (9, "word " * 9000), (1, TEXTS[3])]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_round_trip(spark, monkeypatch):
    df = frame(spark, ROWS)
    shards = wavelet_store.write(df, BYTES, end_id=0, shard_ids=50)
    assert shards.count() > 1
    got = wavelet_store.read(shards).collect()
    lib = pretokens.encoder(BYTES).library
    want = sorted((-1 if i is None else i, crc(lib.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in ROWS)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids_crc32"]) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1].tolist()
    assert [r["doc_id"] for r in ordered] == [None, 1, 3, 3, 5, 7, 9]
    assert wavelet_store.read(wavelet_store.write(frame(spark, []), BYTES)).count() == 0


def test_packing(spark):
    df = frame(spark, ROWS + [(100 + i, "some words " * (i % 40)) for i in range(300)])
    pieces = packing.pack(df.coalesce(1), PLAIN, end_id=1).collect()
    lib = pretokens.encoder(PLAIN).library
    want = defaultdict(list)
    for r in df.collect():
        want[r["doc_id"]].append(lib.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    assert sum(p["length"] for p in pieces) == sum(len(x) for v in want.values() for x in v)
    sequences = defaultdict(list)
    for p in pieces:
        assert any(p["doc_tokens"] == len(x) and p["ids_crc32"] == crc(x[p["start"] : p["start"] + p["length"]]) for x in want[p["doc_id"]])
        sequences[p["sequence_id"]].append(p)
    short = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and all(p["sequence_length"] == at for p in s)
        short += at != 2048
        assert at & (at - 1) == 0  # a power of two: no padding
    assert short <= 11
    assert packing.pack(frame(spark, []), PLAIN).count() == 0


def test_assignment_balances_cost():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1500, 900)
    pieces = packing.assign(sizes)
    used, cost = defaultdict(int), defaultdict(float)
    for _, _, n, s in pieces:
        used[s] += n
        cost[s] += packing._cost(n)
    assert sum(used.values()) == sizes.sum()
    full = [cost[s] for s, n in used.items() if n == 2048]
    assert np.std(full) / np.mean(full) < 0.35
    assert packing.assign(np.zeros(0, np.int64)) == []


def test_counts_query(spark):
    got = {(r["doc_id"], r["n_bytes"]): r for r in token_count.count_tokens(frame(spark, ROWS), BYTES).collect()}
    assert got[3, 0]["n_tokens"] == 0 and got[9, 45000]["over_limit"] and not got[7, 18]["over_limit"]
    assert token_count.count_tokens(frame(spark, []), BYTES).count() == 0


class _Worker:
    """Stands for a table of documents: gives out the function that a Python worker would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


@pytest.mark.parametrize("operator", [lambda docs: packing.pack(docs, PLAIN), lambda docs: minhash_forest.sketch(docs, 5)])
def test_a_pipeline_worker_holds_little_beside_its_batch(operator):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in row) for row in rng.integers(0, 5000, (400, 4000)).tolist()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    run = operator(_Worker())
    for _ in run(iter([batch.slice(0, 50)])):  # the tokenizer's tables are there
        pass
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < 60
