"""Token counts by compiled finite-state transducers (operator 9).

Two deterministic transducers stand for a byte-level BPE tokenizer:

* The cutting pattern becomes eleven states over classes of characters; a transition
  emits whether a piece starts at this character or at the one before.  A batch of texts is run
  in fixed chunks side by side.  For each chunk the map from every entry state to its exit
  state is computed (the maps of all chunks advance together and soon agree for all entries);
  a parallel prefix scan composes the maps, which gives each chunk its true entry state, and a
  second pass emits.
* The merges become a transducer over the bytes of a piece, whose transitions carry the change
  of the token count.  For BPE the last token of every prefix is the only token that ends there
  and stands beside the last token before it (the two re-encode to themselves).  A state is the
  longest suffix that begins some token, with the last token and relative count at each place in
  it, so there are finitely many.  States are compiled when first met and then only looked up.

Counts of pieces met before are remembered, so the second transducer runs over new pieces only.
Texts with special token strings, or with characters whose class differs between Unicode
versions, are counted by the library itself.

Scale: one narrow pass, no shuffle.  Memory in a worker is bounded by the slice of text at work,
``MAX_KNOWN`` pieces and ``MAX_STATES`` states; beyond those it starts afresh.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted row by
row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretokens

LIMIT = 1024
CHUNK = 256
MAX_STATES = 150_000

# ----------------------------------------------------------------- the cutting transducer

_STATES = ("letters", "digits", "others", "space", "spaces", "blank", "blanks", "quote", "quote_rv", "quote_l", "short")
_KINDS = ("letter", "stmd", "rv", "e", "l", "digit", "other", "quote", "space", "blank")
_LETTERS = frozenset(("letter", "stmd", "rv", "e", "l"))
HERE, BEFORE = 1, 2


def _entered(kind: str) -> str:
    """The state after a piece starts with a character of this kind."""
    if kind in _LETTERS:
        return "letters"
    return {"digit": "digits", "other": "others", "quote": "quote", "space": "space", "blank": "blank"}[kind]


def _step(state: str, kind: str) -> tuple[str, int]:
    letter, blank = kind in _LETTERS, kind in ("space", "blank")
    goes_on = {"letters": letter, "digits": kind == "digit", "others": kind in ("other", "quote")}
    if state in goes_on:
        return (state, 0) if goes_on[state] else (_entered(kind), HERE)
    if state in ("space", "spaces", "blank", "blanks"):
        if blank:
            return ("spaces" if kind == "space" else "blanks"), 0
        split = BEFORE if state in ("spaces", "blanks") else 0  # a run's last blank parts from it
        if state in ("space", "spaces"):  # and a space goes with what follows
            return ("others" if kind == "quote" else _entered(kind)), split
        return _entered(kind), split | HERE
    if state == "quote":
        follow = {"stmd": "short", "rv": "quote_rv", "l": "quote_l", "other": "others", "quote": "others"}
        return (follow[kind], 0) if kind in follow else (_entered(kind), HERE)
    if state in ("quote_rv", "quote_l"):
        if kind == ("e" if state == "quote_rv" else "l"):
            return "short", 0
        return ("letters", BEFORE) if letter else (_entered(kind), BEFORE | HERE)
    return _entered(kind), HERE  # after a shortened form


@functools.lru_cache(maxsize=1)
def compile_cuts() -> tuple[np.ndarray, np.ndarray]:
    """Next states (times the number of symbols) and outputs; the second half of the symbols begin a text."""
    n = 2 * len(_KINDS)
    after, out = np.zeros((len(_STATES), n), np.intp), np.zeros((len(_STATES), n), np.uint8)
    for i, state in enumerate(_STATES):
        for k, kind in enumerate(_KINDS):
            to, emitted = _step(state, kind)
            after[i, k], out[i, k] = _STATES.index(to) * n, emitted
            after[i, k + n // 2] = _STATES.index(_entered(kind)) * n
            out[i, k + n // 2] = HERE | (BEFORE if state.startswith("quote_") else 0)
    return after.ravel(), out.ravel()


@functools.lru_cache(maxsize=1)
def _ascii_kinds() -> np.ndarray:
    """Kinds of ASCII characters by code; other characters have the kind of their class."""
    of = {pretokens.LETTER: "letter", pretokens.DIGIT: "digit", pretokens.OTHER: "other", pretokens.BLANK: "blank", pretokens.SPACE: "space", pretokens.UNSURE: "other"}
    by_class = np.array([_KINDS.index(of[c]) for c in range(6)], np.intp)
    table = by_class[pretokens.classes()[:128]]
    for chars, kind in (("stmd", "stmd"), ("rv", "rv"), ("e", "e"), ("l", "l"), ("'", "quote")):
        table[[ord(c) for c in chars]] = _KINDS.index(kind)
    return np.concatenate([table, by_class])


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (states by chunks), by doubling."""
    step = 1
    while step < maps.shape[1]:
        maps = np.concatenate([maps[:, :step], np.take_along_axis(maps[:, step:], maps[:, :-step], axis=0)], axis=1)
        step *= 2
    return maps


def starts(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a piece starts at each symbol, by chunk state maps and a scan."""
    after, out = compile_cuts()
    n, width, states = len(symbols), 2 * len(_KINDS), len(_STATES)
    lanes = n // chunk + 1
    grid = np.full(lanes * chunk, width // 2, np.intp)  # what fills the last chunk begins a text: it closes the one before
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
    now = np.repeat((np.arange(states) * width)[:, None], lanes, 1)
    merged = False
    for k in range(chunk):
        now = after[now + grid[k]]
        if not merged and k % 8 == 7 and (now == now[:1]).all():
            now, merged = now[:1], True
    maps = scan(np.broadcast_to(now, (states, lanes)) // width)
    entry = np.append(0, maps[0, :-1]) * width
    emitted = np.empty((chunk, lanes), np.uint8)
    for k in range(chunk):
        at = entry + grid[k]
        emitted[k] = out[at]
        entry = after[at]
    emitted = emitted.T.ravel()
    found = (emitted & HERE).astype(bool)
    found[:-1] |= (emitted[1:] & BEFORE).astype(bool)
    return found[:n]


# ------------------------------------------------------------------- the merge transducer


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, then those from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTransducer:
    """Token counts of pieces under a list of merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_alphabet()
        spelled = lambda t: bytes(letters[c] for c in t)
        self.ids = {spelled(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.spelling = {i: b for b, i in self.ids.items()}
        self.rank = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (spelled(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[self.ids[a], self.ids[b]] = (r, self.ids[a + b])
        self.prefixes = {t[:k] for t in self.ids for k in range(1, len(t) + 1)}
        self._beside: dict[tuple[int, int], bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.number = {(b"", ((-1, 0),)): 0}
        self.state = [(b"", ((-1, 0),))]
        self.next: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, raw: bytes) -> list[int]:
        """The ids of some bytes, by merging (used to compile only)."""
        out = [self.ids[raw[i : i + 1]] for i in range(len(raw))]
        while len(out) > 1:
            best = min(range(len(out) - 1), key=lambda i: self.rank.get((out[i], out[i + 1]), (1 << 60, 0))[0])
            found = self.rank.get((out[best], out[best + 1]))
            if found is None:
                break
            out[best : best + 2] = [found[1]]
        return out

    def beside(self, a: int, b: int) -> bool:
        """Whether token ``b`` can follow ``a`` (-1: nothing) in an encoding."""
        known = self._beside.get((a, b))
        if known is None:
            if len(self._beside) > 2 * MAX_STATES:
                self._beside.clear()
            want = [b] if a < 0 else [a, b]
            known = self._beside[a, b] = self.merged(b"".join(self.spelling[t] for t in want)) == want
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: (state, change of the count)."""
        suffix, places = self.state[state]
        suffix += bytes((byte,))
        for k in range(len(places)):
            token = self.ids.get(suffix[k:])
            if token is not None and self.beside(places[k][0], token):
                count = places[k][1] + 1
                break
        else:
            raise ValueError(f"no token ends after {suffix!r}")
        places = (*places, (token, count))
        while suffix not in self.prefixes:
            suffix = suffix[1:]
        places = tuple((t, n - count) for t, n in places[-len(suffix) - 1 :])
        to = self.number.get((suffix, places))
        if to is None:
            to = self.number[suffix, places] = len(self.state)
            self.state.append((suffix, places))
            self.next.append({})
        self.next[state][byte] = to, count
        return to, count

    def count(self, piece: bytes) -> int:
        if len(self.state) > MAX_STATES:
            self._restart()
        state = total = 0
        for byte in piece:
            step = self.next[state].get(byte)
            if step is None:
                step = self.compile(state, byte)
            state, change = step
            total += change
        return total


class Counter(pretokens.Encoder):
    """Counts by the two transducers; the library stands by for texts that they leave to it."""

    def __init__(self, path: str):
        super().__init__(path)
        if self.normal:
            raise ValueError("a byte-level tokenizer without a normaliser is needed")
        self.transducer = MergeTransducer(path)

    def starts(self, cls: np.ndarray, code: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        symbols = _ascii_kinds()[np.where(code < 128, code, 128 + cls)]
        symbols[fresh] += len(_KINDS)
        return starts(symbols)

    def _fill(self, size: int, pieces: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.transducer.count, pieces), np.int64, len(pieces))


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document; ``tokenizer`` is the path of the file on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for names, texts in pretokens.slices(batches):
            n = count(texts)
            size = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([names, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
