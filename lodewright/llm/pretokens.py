"""Cutting texts into the pieces that a BPE model sees, and encoding each distinct piece once.

A byte-pair tokenizer first cuts a text by a pattern and then encodes each piece by itself.
``Encoder`` finds the cuts of a whole Arrow column with a few passes of numpy over its bytes,
hashes the pieces, and asks the ``tokenizers`` library only for pieces that it has not met
before; ids of known pieces are gathered from one flat table.  The ids are those that the
library gives for the whole text.

The cuts are local: they follow from the classes (letter, digit, space, other) of neighbouring
characters.  Texts for which that is not certain are encoded whole by the library: those with
characters whose class depends on the Unicode version, with special token strings, and, for a
normalising tokenizer, those not in the composed form that it would bring them to.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .span_hash import short_hashes

LETTER, DIGIT, OTHER, BLANK, SPACE, UNSURE = 0, 1, 2, 3, 4, 5
#: Bytes of text that one numpy pass works on, and distinct pieces that a worker remembers.
SLICE_BYTES = 2 << 20
MAX_KNOWN = 1_000_000
_SLOT_BITS = 20
_APOSTROPHE = ord("'")
_LOWER_BY_CONTEXT = "\u0130\u03a3"


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point; UNSURE unless Unicode 3.2 and the present data agree on it."""
    old = unicodedata.ucd_3_2_0
    out = np.full(0x110000, UNSURE, np.uint8)
    for c in range(0x30000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind != old.category(ch) or kind in ("Cn", "Cs", "Co"):
            continue
        out[c] = LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else OTHER
        if 9 <= c <= 13 or c in (0x85, 0x20) or kind in ("Zs", "Zl", "Zp"):
            out[c] = BLANK
    out[0x20] = SPACE
    out[[0x180E, 0x200B]] = UNSURE  # spaces in some versions only
    return out


@functools.lru_cache(maxsize=1)
def byte_letters() -> np.ndarray:
    """The code point that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 up."""
    prints = np.zeros(256, bool)
    prints[0x21:0x7F] = prints[0xA1:0xAD] = prints[0xAE:] = True
    return np.where(prints, np.arange(256), 255 + np.cumsum(~prints)).astype("<u4")


class Pieces:
    """The pieces of some texts: ``buf`` (bytes), ``starts`` and ``ends`` (byte places), ``doc`` (text of each)."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray):
        self.buf, self.starts, self.ends, self.doc = buf, starts, ends, doc


def char_classes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Class of each character, its byte place (None if all are ASCII), and its code point (None likewise)."""
    table = classes()
    high = buf >= 0x80
    if not high.any():
        return table[:128][buf], None, None
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    first = buf[lead].astype(np.uint32)
    code = first.copy()
    wide = np.flatnonzero(first >= 0x80)
    at, b0 = lead[wide], first[wide]
    n = 1 + (b0 >= 0xE0) + (b0 >= 0xF0)
    value = np.where(n == 1, b0 & 0x1F, np.where(n == 2, b0 & 0x0F, b0 & 0x07))
    last = len(buf) - 1
    for k in (1, 2, 3):
        value = np.where(n >= k, (value << 6) | (buf[np.minimum(at + k, last)] & 0x3F), value)
    code[wide] = value
    return table[code], lead, code


def cut(cls: np.ndarray, code: np.ndarray, fresh: np.ndarray, joins_space: bool, single_digits: bool) -> np.ndarray:
    """Whether a piece starts at each character.

    ``fresh``: characters that begin a text.  ``joins_space``: a space goes with the run after it
    and other blanks are pieces; else blanks only part pieces.  ``single_digits``: each digit is a piece.
    """
    n = len(cls)
    kind = np.where(cls == SPACE, np.uint8(BLANK), cls)
    start = np.empty(n, bool)
    start[:1] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= fresh
    if single_digits:
        start |= kind == DIGIT
    blank = kind == BLANK
    after = np.zeros(n, bool)  # the run before this character is blank and of the same text
    after[1:] = blank[:-1]
    after &= ~fresh
    quote = (code == _APOSTROPHE) & start
    if joins_space:
        spaced = np.zeros(n, bool)
        spaced[1:] = cls[:-1] == SPACE
        spaced &= ~fresh
        entry = after & ~blank  # first character of a run that a blank stands before
        at = np.flatnonzero(entry)
        start[at - 1] = True  # the last blank parts from those before it
        start[at] = ~spaced[at]  # and a space goes with the run
        quote &= ~spaced
    at = np.flatnonzero(quote)
    if len(at):
        limit = np.append(np.flatnonzero(fresh), n)
        end = limit[np.searchsorted(limit, at, "right")]
        get = lambda k: np.where(at + k < end, code[np.minimum(at + k, n - 1)].astype(np.int64), 0)
        one, two = get(1), get(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = one * 128 + two
        long = np.isin(pair, [ord(a) * 128 + ord(b) for a, b in ("re", "ve", "ll")]) & (two < 128)
        for taken, where in ((2, at[short]), (3, at[long & ~short])):
            start[where + 1] = False
            if taken == 3:
                start[where + 2] = False
            follow = where + taken
            follow = follow[follow < n]
            start[follow] = True
    return start


class Encoder:
    """Ids by the ``tokenizers`` library for a tokenizer file, piece by piece."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.normal = spec["normalizer"] is not None
        self.joins_space = not self.normal
        last = spec["pre_tokenizer"] or {}
        last = last.get("pretokenizers", [last])[-1]
        #: Whether a piece, its bytes as letters, is a word of the library's model.
        self.letters = last.get("type") == "ByteLevel" and not last["add_prefix_space"]
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.n = 0
        self.key = np.zeros(1 << 16, np.uint64)
        self.check = np.zeros(1 << 16, np.uint64)
        self.at = np.zeros((1 << 16) + 1, np.int64)  # place of each piece's ids in flat
        self.flat = np.zeros(1 << 18, self.kind)
        self.slot = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.order = np.zeros(0, np.int64)
        self.sorted = np.zeros(0, np.uint64)

    def plain(self, text: str) -> bool:
        """Whether the local cuts hold for a text, as far as its characters' classes do not tell."""
        if "<" in text and any(s in text for s in self.special):
            return False
        if not self.normal or text.isascii():
            return True
        return not any(c in text for c in _LOWER_BY_CONTEXT) and unicodedata.is_normalized("NFC", text)

    def starts(self, cls: np.ndarray, code: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        return cut(cls, code, fresh, self.joins_space, self.normal)

    def pieces(self, texts: list[str]) -> tuple[Pieces, list[int]]:
        """Pieces of the texts, and the places of texts that the library must encode whole."""
        whole = [i for i, t in enumerate(texts) if not self.plain(t)]
        skip = set(whole)
        parts = [b"" if i in skip else (t.lower() if self.normal else t).encode("utf-8") for i, t in enumerate(texts)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        buf = np.frombuffer(b"".join(parts), np.uint8)
        begins = np.cumsum(sizes) - sizes
        cls, place, code = char_classes(buf)
        if place is not None and (odd := cls == UNSURE).any():
            bad = np.unique(np.searchsorted(begins, place[odd], "right") - 1)
            # Texts of no bytes share their begin with the next; the last one at a place owns the bytes.
            again = set(bad.tolist()) | skip
            rest = ["" if i in again else t for i, t in enumerate(texts)]
            inner, more = self.pieces(rest)
            return inner, sorted(again | set(more))
        filled = begins[sizes > 0]
        fresh = np.zeros(len(cls), bool)
        fresh[filled if place is None else np.searchsorted(place, filled)] = True
        start = self.starts(cls, buf if code is None else code, fresh)
        blank = (cls == BLANK) | (cls == SPACE)
        stops = np.flatnonzero(start if self.joins_space else start | blank)
        if not self.joins_space:
            start &= ~blank
        chars = stops if self.joins_space else np.flatnonzero(start)
        limits = np.append(chars, len(cls))[1:] if self.joins_space else np.append(stops, len(cls))[np.searchsorted(stops, chars, "right")]
        starts, ends = (chars, limits) if place is None else (place[chars], np.append(place, len(buf))[limits])
        doc = np.repeat(np.arange(len(sizes)), np.diff(np.append(np.searchsorted(starts, begins), len(starts))))
        return Pieces(buf, starts, ends, doc), whole

    def find(self, p: Pieces) -> np.ndarray:
        """The number of each piece in the table of known pieces; new ones are encoded by the library."""
        key, check = short_hashes(p.buf, p.starts, p.ends)
        slot = (key >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        known = self.slot[slot]
        hit = known >= 0
        hit &= (self.key[known] == key) & (self.check[known] == check)
        miss = np.flatnonzero(~hit)
        if len(miss):
            uniq, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            found = np.full(len(uniq), -1, np.int64)
            if len(self.sorted):
                at = np.minimum(np.searchsorted(self.sorted, uniq), len(self.sorted) - 1)
                same = self.sorted[at] == uniq
                found[same] = self.order[at[same]]
            new = np.flatnonzero(found < 0)
            if len(new):
                where = miss[first[new]]
                found[new] = self._learn(p, where, key[where], check[where])
            known[miss] = found[back]
            self.slot[slot[miss]] = known[miss]
            clash = np.flatnonzero(self.check[known] != check)
            if clash.size:  # pieces that share the first hash with another one stay out of the index
                known[clash] = self._learn(p, clash, key[clash], check[clash], indexed=False)
        return known

    def _learn(self, p: Pieces, where: np.ndarray, key: np.ndarray, check: np.ndarray, indexed: bool = True) -> np.ndarray:
        raw = p.buf.tobytes() if len(where) > 1000 else p.buf
        n, m = self.n, len(where)
        while n + m > len(self.key):
            self.key, self.check = np.append(self.key, self.key * 0), np.append(self.check, self.check * 0)
            self.at = np.append(self.at, self.at[:-1] * 0)
        self.key[n : n + m], self.check[n : n + m] = key, check
        sizes = self._fill(int(self.at[n]), [bytes(raw[a:b]) for a, b in zip(p.starts[where].tolist(), p.ends[where].tolist(), strict=True)])
        self.at[n + 1 : n + m + 1] = self.at[n] + np.cumsum(sizes)
        self.n = n + m
        if indexed:  # the new keys come in order
            at = np.searchsorted(self.sorted, key)
            self.sorted = np.insert(self.sorted, at, key)
            self.order = np.insert(self.order, at, np.arange(n, n + m))
        return np.arange(n, n + m)

    def _fill(self, size: int, pieces: list[bytes]) -> np.ndarray:
        """Put the pieces' ids at place ``size`` of the flat table; returns how many each has."""
        if self.letters:  # the pieces are cut: what remains is the model, which the library also runs by itself
            said = byte_letters()[np.frombuffer(b"".join(pieces), np.uint8)].tobytes().decode("utf-32-le")
            model, stops = self.library.model.tokenize, list(itertools.accumulate(map(len, pieces), initial=0))
            ids = [[t.id for t in model(said[a:b])] for a, b in itertools.pairwise(stops)]
        else:
            texts = [x.decode("utf-8") for x in pieces]
            ids = [e.ids for i in range(0, len(texts), 4096) for e in self.library.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        while size + int(sizes.sum()) > len(self.flat):
            self.flat = np.append(self.flat, self.flat * 0)
        self.flat[size : size + int(sizes.sum())] = np.fromiter((x for e in ids for x in e), self.kind, int(sizes.sum()))
        return sizes

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        if self.n > MAX_KNOWN:
            self._forget()
        p, whole = self.pieces(texts)
        known = self.find(p)
        counts = np.bincount(p.doc, weights=self.at[known + 1] - self.at[known], minlength=len(texts)).astype(np.int64)
        for i in whole:
            counts[i] = len(self.library.encode(texts[i], add_special_tokens=False).ids)
        return counts

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of ids of each; ``end`` is added to each."""
        if self.n > MAX_KNOWN:
            self._forget()
        p, whole = self.pieces(texts)
        known = self.find(p)
        first, n_ids = self.at[known], self.at[known + 1] - self.at[known]
        add = 0 if end is None else 1
        lone = {i: self.library.encode(texts[i], add_special_tokens=False).ids for i in whole}
        counts = np.bincount(p.doc, weights=n_ids, minlength=len(texts)).astype(np.int64)
        for i, x in lone.items():
            counts[i] = len(x)
        counts += add
        stops = np.cumsum(counts)
        begins = stops - counts
        out = np.empty(int(stops[-1]) if len(stops) else 0, self.kind)
        # The pieces' ids follow each other; they pass over the end ids and the texts that stand by themselves.
        before = np.cumsum(n_ids) - n_ids
        inner = np.repeat(first - before, n_ids)
        inner += np.arange(len(inner))
        free = np.ones(len(out), bool)
        if add:
            free[stops - 1] = False
        for i in lone:
            free[begins[i] : stops[i]] = False
        out[free] = self.flat[inner]
        for i, x in lone.items():
            out[begins[i] : begins[i] + len(x)] = x
        if end is not None and len(stops):
            out[stops - 1] = end
        return out, counts


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) runs of about ``limit`` bytes of batches of (id, text); nulls are empty.  Only a run at a time becomes Python strings."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            done = int(size[first - 1]) if first else 0
            stop = max(first + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.column(0).slice(first, stop - first), [t or "" for t in batch.column(1).slice(first, stop - first).to_pylist()]
            first = stop


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file in a worker process."""
    return Encoder(path)
