"""Hashes of many spans of a byte buffer at once."""

from __future__ import annotations

import hashlib

import numpy as np

_BLOCK = 1 << 12
#: Eight-byte words of a span that are hashed word by word; longer spans are hashed one by one.
_WORDS = 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    up = np.full(n, np.uint64(seed))
    down = np.full(n, np.uint64(pow(seed, -1, 1 << 64)))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all of them."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class SpanHasher:
    """Two independent 64-bit hashes of each span: polynomials over its bytes, modulo 2**64."""

    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        self.powers = [_powers(_BLOCK, s) for s in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)]
        self.values = [rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, n = [], len(buf)
        full = n - n % _BLOCK
        place = starts % _BLOCK
        crossing = np.flatnonzero(starts // _BLOCK != (ends - 1) // _BLOCK).tolist()
        size = (ends - starts).astype(np.uint64) << np.uint64(48)
        with np.errstate(over="ignore"):
            for (up, down), value in zip(self.powers, self.values, strict=True):
                terms = value[buf]  # powers count from the start of a block
                terms[:full].reshape(-1, _BLOCK)[:] *= up
                terms[full:] *= up[: n - full]
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(terms, out=total[1:])
                h = (total[ends] - total[starts]) * down[place]
                for i in crossing:  # a span over a block's end is hashed by itself
                    h[i] = self._long(buf[starts[i] : ends[i]], value, up)
                out.append(mix(h ^ size))
        return out[0], out[1]

    @staticmethod
    def _long(span: np.ndarray, value: np.ndarray, up: np.ndarray) -> np.uint64:
        total, scale, step = np.uint64(0), np.uint64(1), up[-1] * up[1]
        for i in range(0, len(span), _BLOCK):
            block = value[span[i : i + _BLOCK]]
            total += (block * up[: len(block)]).sum(dtype=np.uint64) * scale
            scale *= step
        return total


def short_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span, made for many short ones: the spans' eight-byte words are mixed in, one after the other."""
    padded = np.zeros(len(buf) + 15, np.uint8)
    padded[: len(buf)] = buf
    words = np.ndarray(len(buf) + 8, "<u8", padded, strides=(1,))  # the word at each byte
    size = ends - starts
    word = words[starts] & _MASKS[np.minimum(size, 8)]
    with np.errstate(over="ignore"):
        length = size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        one, two = mix(word + length), mix((word * np.uint64(0x9FB21C651E98DF25)) ^ length)
        more, at = np.flatnonzero(size > 8), 8
        while len(more) and at < 8 * _WORDS:
            rest = size[more] - at
            word = words[starts[more] + at] & _MASKS[np.minimum(rest, 8)]
            one[more] = mix(one[more] + word * np.uint64(0xD1342543DE82EF95))
            two[more] = mix(two[more] ^ (word * np.uint64(0x9E3779B97F4A7C15)))
            more, at = more[rest > 8], at + 8
    for i in more.tolist():
        digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        one[i], two[i] = np.frombuffer(digest, "<u8")
    return one, two
