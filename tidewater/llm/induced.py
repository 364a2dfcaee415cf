"""Suffix and common-prefix order of a text by external induced sorting."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import islice

#: Tuples that a queue holds in memory; beyond, sorted runs go to disk. Tuples read from a run at once.
MEMORY, BLOCK = 2_000_000, 4_096


class Queue:
    """A priority queue of tuples: the smallest half-filled heap in memory, the rest as sorted runs on disk.

    Tuples may be pushed while others are popped, so long as none is less than what was popped. Runs are unnamed
    temporary files, which the system drops when the task ends, however it ends.
    """

    def __init__(self, memory: int = 0):
        self.memory = memory or MEMORY
        self.heap: list = []
        self.heads: list = []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.memory:
            self.heap.sort()
            run = stored(self.heap)
            self.heap = []
            head = next(run)
            heapq.heappush(self.heads, (head, id(run), run))

    def top(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            head, key, run = self.heads[0]
            after = next(run, None)
            if after is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (after, key, run))
            return head
        return heapq.heappop(self.heap)


def stored(items: Sequence) -> Iterator:
    """``items``, written to disk now and read back as they are asked for."""
    file = tempfile.TemporaryFile()
    for at in range(0, len(items), BLOCK):
        pickle.dump(items[at : at + BLOCK], file, pickle.HIGHEST_PROTOCOL)
    file.seek(0)

    def read() -> Iterator:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    return read()


class Least:
    """The least of the latest values, asked from any earlier place on: a stack of rising values."""

    def __init__(self):
        self.places: list[int] = []
        self.values: list[int] = []

    def add(self, place: int, value: int) -> None:
        while self.values and self.values[-1] >= value:
            self.values.pop()
            self.places.pop()
        self.places.append(place)
        self.values.append(value)

    def after(self, place: int) -> int:
        return self.values[bisect_right(self.places, place)]


def suffixes(text: Sequence[int], memory: int = 0) -> Iterator[tuple[int, int]]:
    """(start, common) of all suffixes in descending order; ``common`` is the prefix shared with the one before (greater).

    A suffix that ends sorts before one that goes on. Suffixes are less (L) or greater (S) than the next one; an S after an
    L is a seed. Seeds are put in order by sorting the strings between them, and by recursion where those repeat, common
    prefixes included. Then, in ascending order, each suffix read puts the L suffix before it into a queue under its
    first letter and the reading's number; in descending order likewise the S suffixes. Two suffixes queued under
    one letter share that letter and the least common prefix between the two that queued them.
    """
    n = len(text)
    if not n:
        return
    small = bytearray(n)  # 1: S
    run = [1] * n
    for i in range(n - 2, -1, -1):
        if text[i] < text[i + 1]:
            small[i] = 1
        elif text[i] == text[i + 1]:
            small[i] = small[i + 1]
            run[i] = run[i + 1] + 1
    seeds = [i for i in range(1, n) if small[i] and not small[i - 1]]
    order = seed_order(text, small, seeds, memory)

    # Ascending: L suffixes. The last suffix is L and nothing follows it.
    queue, least, ahead, place = Queue(memory), Least(), {}, 0
    queue.push((text[n - 1], -1, n - 1, 0))
    ahead[text[n - 1]] = -1
    larges: list[tuple[int, int]] = []
    kept: list[Iterator] = []
    letter = before = -1
    tail = 0  # the run of the latest L suffix read under this letter
    seed = next(order, None)
    while True:
        head = queue.top()
        if head is None and seed is None:
            break
        if seed is None or head is not None and head[0] <= text[seed[0]]:
            c, _, i, common = queue.pop()
            shared = common if c == letter else 0
            letter, tail, before = c, run[i], -1
            larges.append((i, common))
            if len(larges) >= (memory or MEMORY):
                kept.append(stored(larges))
                larges = []
        else:
            i, between = seed
            c = text[i]
            shared = (between if before >= 0 else min(tail, run[i])) if c == letter else 0
            letter, before = c, i
            seed = next(order, None)
        least.add(place, shared)
        if i and not small[i - 1]:
            c = text[i - 1]
            by = ahead.get(c)
            queue.push((c, place, i - 1, 0 if by is None else 1 if by < 0 else 1 + least.after(by)))
            ahead[c] = place
        place += 1
    if larges:
        kept.append(stored(larges))
        larges = []

    # Descending: S suffixes, and the L suffixes again.
    downward = backwards(kept)
    queue, least, ahead, place = Queue(memory), Least(), {}, 0
    large = next(downward, None)
    letter, kind, above, tail = -1, 0, 0, 0
    while True:
        head = queue.top()
        if head is None and large is None:
            return
        if large is None or head is not None and -head[0] >= text[large[0]]:
            c, _, i, shared = queue.pop()
            c = -c
            letter, kind, tail = c, 1, run[i]
        else:
            i, common = large
            c = text[i]
            shared = 0 if c != letter else min(tail, run[i]) if kind else above
            letter, kind, above = c, 0, common
            large = next(downward, None)
        yield i, shared
        least.add(place, shared)
        if i and small[i - 1]:
            c = text[i - 1]
            by = ahead.get(c)
            queue.push((-c, place, i - 1, 0 if by is None else 1 + least.after(by)))
            ahead[c] = place
        place += 1


def backwards(blocks: list[Iterator]) -> Iterator:
    """The stored blocks' items, last first; one block is in memory at a time."""
    while blocks:
        yield from reversed(list(blocks.pop()))


def seed_order(text: Sequence[int], small: bytearray, seeds: list[int], memory: int) -> Iterator[tuple[int, int]]:
    """(start, common) of the seeds' suffixes in ascending order, ``common`` with the one before."""
    n, m = len(text), len(seeds)
    if not m:
        return iter(())
    ends = [*(s + 1 for s in seeds[1:]), n]
    queue = Queue(memory)
    for k, i in enumerate(seeds):
        queue.push(([2 * text[j] + small[j] for j in range(i, ends[k])], k))
    names, name, before = [0] * m, -1, None
    while queue.top() is not None:
        piece, k = queue.pop()
        if piece != before or ends[k] == n:
            name += 1
        names[k], before = name, piece if ends[k] < n else None
    if name + 1 == m:
        ranked = [0] * m
        for k, x in enumerate(names):
            ranked[x] = k
        ascending = iter([(k, 0) for k in ranked])
    else:
        upward = list(suffixes(names, memory))[::-1]  # a recursion has half the length at most
        ascending = iter([(k, upward[at - 1][1] if at else 0) for at, (k, _) in enumerate(upward)])

    def placed() -> Iterator[tuple[int, int]]:
        last = None
        for k, same in ascending:
            common = 0
            if last is not None:
                a, b = last + same, k + same  # the first seeds' strings that differ
                x = seeds[a] if a < m else n
                y = seeds[b] if b < m else n
                while x < n and y < n and text[x] == text[y]:
                    x, y = x + 1, y + 1
                common = y - seeds[k]
            yield seeds[k], common
            last = k

    return placed()


def repeats(text: Sequence[int], ends: Sequence[int], window: int, memory: int = 0) -> Iterator[list[int]]:
    """Lists of two starts or more at which the same ``window`` letters stand, none of them across a piece's end.

    ``ends[i]`` is where the piece of letter i ends; the text is the pieces after one another.
    """
    group: list[int] = []
    for start, common in suffixes(text, memory):
        if common < window and group:
            if len(group) > 1:
                yield group
            group = []
        if ends[start] - start >= window:
            group.append(start)
    if len(group) > 1:
        yield group


def ascending(text: Sequence[int], memory: int = 0) -> list[tuple[int, int]]:
    """(start, common with the one before) of all suffixes in ascending order."""
    down = list(islice(suffixes(text, memory), None))
    return [(down[k][0], down[k + 1][1] if k + 1 < len(down) else 0) for k in range(len(down))][::-1]
