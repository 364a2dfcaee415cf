"""Content-chosen anchors: every window of a text has one, and equal windows have it at the same place."""

from __future__ import annotations

import numpy as np

from tidewater.llm.shingles import BASE, mix

#: Bytes in the string that is hashed at an anchor.
GRAM = 32
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Windows:
    """Hashes of all substrings of one length after another, from one prefix sum of weighed bytes."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), BASE), dtype=np.uint64)])
            self.back = powers(len(data) + 1, _INVERSE)

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from ``start`` to ``stop``, end exclusive; they depend on the bytes alone."""
        with np.errstate(over="ignore"):
            return mix((self.total[stop] - self.total[start]) * self.back[start] + (stop - start).astype(np.uint64))


def least_of(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` successive values, by running minima of blocks from either side."""
    n = len(v) - w + 1
    padded = np.concatenate([v, np.full(-len(v) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor, first, last, content hash) of each run of window starts that have the same anchor.

    A window's anchor is its ``GRAM``-byte string of least hash, the leftmost among equal ones. The content hash covers all
    bytes of the run's windows and where the anchor lies in them. Texts shorter than a window have no runs.
    """
    n = len(data) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    hashes = Windows(data)
    starts = np.arange(len(data) - GRAM + 1)
    grams = hashes.at(starts, starts + GRAM)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    least = least_of(grams >> bits << bits | starts.astype(np.uint64), window - GRAM + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    anchor = anchor[first]
    with np.errstate(over="ignore"):
        content = mix(hashes.at(first, last + window) + (anchor - first).astype(np.uint64) * BASE)
    return grams[anchor], anchor, first, last, content
