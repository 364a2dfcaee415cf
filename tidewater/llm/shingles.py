"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(71)
#: A random odd number for each byte, and the base whose powers weigh a byte's place in its word.
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, A-Z lowered, and the index of each word's text."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text_of = np.searchsorted(np.cumsum(sizes), starts, side="right")
    at = np.flatnonzero(inside)
    word_of = np.cumsum(first)[at] - 1
    place = at - starts[word_of]
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(place.max()), BASE, np.uint64)]))
    hashes = np.add.reduceat(BYTE[data[at]] * powers[place], np.flatnonzero(first[at]))
    return mix(hashes), text_of


def sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``k``-word shingles of each text: hashes ascending within a text, and how many each text has.

    A text with fewer words has one shingle, of all of them; one without words has none.
    """
    hashes, text_of = words(texts)
    n = np.bincount(text_of, minlength=len(texts))
    with np.errstate(over="ignore"):
        weigh = mix(np.arange(1, k + 1, dtype=np.uint64) * BASE)
        full = np.zeros(max(len(hashes) - k + 1, 0), dtype=np.uint64)
        for i in range(k):
            full += hashes[i : len(hashes) - k + 1 + i] * weigh[i] if len(full) else np.uint64(0)
        same = text_of[: len(full)] == text_of[k - 1 :] if len(full) else np.zeros(0, bool)
        few = np.flatnonzero((n > 0) & (n < k))
        ends = np.cumsum(n)
        short = np.array([(hashes[ends[t] - n[t] : ends[t]] * weigh[: n[t]]).sum(dtype=np.uint64) + np.uint64(n[t]) for t in few], dtype=np.uint64)
    h = mix(np.concatenate([full[same], short]))
    t = np.concatenate([text_of[: len(full)][same], few])
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], np.bincount(t[new], minlength=len(texts))
