"""Removal of repeated passages, found by external induced sorting of the texts that can hold them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import anchors, induced
from tidewater.llm.common import discard, numbered, tidied, written

#: Bytes of text that a Python worker looks at together, and bytes of contexts that make a shard, about.
CHUNK, SHARD = 3_000_000, 1_000_000
#: Bytes of contexts of one anchor from which on its windows are compared as rows of their own.
CROWD = 4_000_000
#: Other bytes for bytes, for a second hash.
OTHER = np.random.default_rng(41).permutation(256).astype(np.uint8)


def ordered(docs: DataFrame) -> DataFrame:
    """(oid, doc_id, text): ``oid`` ascends as documents come: by doc_id, nulls first, then by the text's hash.

    Where doc_ids are all there and unique they serve themselves; otherwise rows are numbered.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, ids = docs.count(), docs.groupBy("doc_id").agg(F.lit(1)).filter("doc_id is not null").count()
    if rows == ids:
        return docs.select(F.col("doc_id").cast("long").alias("oid"), "doc_id", "text")
    kept = written(docs.withColumn("row_id", F.monotonically_increasing_id()))
    places, _ = numbered(kept.select("doc_id", F.xxhash64("text").alias("tie"), "row_id"), ["doc_id", "tie", "row_id"], "oid")
    return kept.join(places.select("row_id", "oid"), "row_id").select("oid", "doc_id", "text")


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover, touching ones together; ``start`` ascends."""
    reach = np.maximum.accumulate(stop)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))[: len(start)]
    return start[first], reach[np.concatenate([first[1:] - 1, [len(start) - 1]])[: len(first)]]


def later(group: np.ndarray, oid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows aren't the first, by (oid, at), of their group."""
    order = np.lexsort((at, oid, group))
    out = np.zeros(len(group), bool)
    out[order[1:]] = group[order[1:]] == group[order[:-1]]
    return out


def intervals(oid: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intervals with those of one document that overlap or touch put together."""
    if not len(oid):
        return oid, start, stop
    order = np.lexsort((start, oid))
    oid, start, stop = oid[order], start[order], stop[order]
    shift = np.cumsum(np.concatenate([[0], oid[1:] != oid[:-1]])) << 40  # documents apart; none has 2**40 bytes
    reach = np.maximum.accumulate(stop + shift)
    first = np.flatnonzero(np.concatenate([[True], (oid[1:] != oid[:-1]) | (start[1:] + shift[1:] > reach[:-1])]))
    last = np.concatenate([first[1:], [len(oid)]]) - 1
    return oid[first], start[first], reach[last] - shift[last]


ANCHORED = pa.schema([("deal", pa.int64()), ("content", pa.int64()), ("oid", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def anchored(docs: DataFrame, window: int) -> DataFrame:
    """(deal, content, oid, start, stop): runs of windows with one anchor, ``deal`` being the anchor's hash; and, where
    ``content`` is 0, stretches to be removed, because the same runs begin earlier in the same chunk of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            oids, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary())
            sizes = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))
            for part in np.split(np.arange(len(oids)), np.searchsorted(sizes, np.arange(CHUNK, int(sizes[-1]) + 1, CHUNK)) + 1 if len(sizes) else []):
                made = [(anchors.runs(np.frombuffer(texts[int(i)].as_buffer(), np.uint8), window), oids[i]) for i in part]
                if not made:
                    continue
                anchor, first, last, content = (np.concatenate([m[0][k] for m in made]) for k in (0, 2, 3, 4))
                oid = np.repeat(np.array([m[1] for m in made], np.int64), [len(m[0][0]) for m in made])
                content |= np.uint64(1)
                _, group = np.unique(np.stack([anchor, content]), axis=1, return_inverse=True) if len(anchor) else (0, np.zeros(0, int))
                again = later(group.ravel(), oid, first)
                once = ~again
                gone = intervals(oid[again], first[again], last[again] + window)
                signed = lambda x: np.ascontiguousarray(x).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[once])), pa.array(signed(content[once])), pa.array(oid[once]), pa.array(first[once]), pa.array(last[once] + window)], schema=ANCHORED)
                yield pa.RecordBatch.from_arrays([pa.array(gone[0] * 7 + gone[1]), pa.array(np.zeros(len(gone[0]), np.int64)), *(pa.array(g.astype(np.int64)) for g in gone)], schema=ANCHORED)

    return docs.select("oid", "text").mapInArrow(tidied(run), "deal long, content long, oid long, start long, stop long")


def sorted_out(rows: DataFrame) -> DataFrame:
    """(deal, oid, start, stop, open): stretches to be removed (not open), and runs whose anchor has other contents too (open).

    Of runs with the same anchor and content the first stays and the others are to be removed; the first ones of an anchor
    with several contents are open. Spark deals rows by anchor and sorts them, spilling as it must; a task holds one batch
    and the row before it. A group's copies were put together by chunk before.
    """
    names = ["deal", "oid", "start", "stop", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (deal, content) of the last row
        held = np.zeros((5, 0), np.int64)  # the last run that was the first of its content: deal, oid, start, stop, and whether it has kin
        for batch in batches:
            deal, content, oid, start, stop = (batch.column(i).to_numpy() for i in range(5))
            known = content == 0
            gone = [np.flatnonzero(known)]
            some = np.flatnonzero(~known)
            if len(some):
                d, c = deal[some], content[some]
                same = np.concatenate([[before == (d[0], c[0])], (d[1:] == d[:-1]) & (c[1:] == c[:-1])])
                before = (d[-1], c[-1])
                gone.append(some[same])
                once = some[~same]
                firsts = np.concatenate([held, np.stack([deal[once], oid[once], start[once], stop[once], np.zeros(len(once), np.int64)])], axis=1)
                pair = firsts[0, 1:] == firsts[0, :-1]
                firsts[4, 1:] |= pair
                firsts[4, :-1] |= pair
                held, wide = firsts[:, -1:], firsts[:, :-1][:, firsts[4, :-1] == 1]
                yield pa.RecordBatch.from_arrays([*map(pa.array, wide[:4]), pa.array(np.ones(wide.shape[1], bool))], names=names)
            at = np.concatenate(gone)
            a, b, c = intervals(oid[at], start[at], stop[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int64)), pa.array(a), pa.array(b), pa.array(c), pa.array(np.zeros(len(a), bool))], names=names)
        wide = held[:, held[4] == 1]
        yield pa.RecordBatch.from_arrays([*map(pa.array, wide[:4]), pa.array(np.ones(wide.shape[1], bool))], names=names)

    dealt = rows.repartition("deal").sortWithinPartitions("deal", "content", "oid", "start")
    return dealt.mapInArrow(tidied(run), "deal long, oid long, start long, stop long, open boolean")


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(deal, oid, start, data) of the ``wanted`` (deal, oid, start, stop). A document's share is bounded by its length."""
    lists = wanted.groupBy("oid").agg(F.collect_list(F.struct("deal", "start", "stop")).alias("w"))
    joined = docs.select("oid", F.col("text").cast("binary").alias("data")).join(lists, "oid")
    cut = joined.select("oid", "data", F.explode("w").alias("w")).select("w.deal", "oid", "w.start", F.expr("substring(data, cast(w.start + 1 as int), cast(w.stop - w.start as int))").alias("data"))
    return cut


class Pieces:
    """The stretches of ``joined`` in which every window's hash occurs more than once, and which of them are equal.

    ``begin`` and ``sizes`` are the texts that ``joined`` holds one after another; windows of texts with different
    ``salt`` are never the same.
    """

    def __init__(self, joined: np.ndarray, begin: np.ndarray, sizes: np.ndarray, salt: np.ndarray, window: int):
        per = sizes - window + 1
        of = np.repeat(np.arange(len(sizes)), per)
        start = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
        hashes = anchors.Windows(joined)
        _, back, count = np.unique(hashes.at(start, start + window) ^ salt[of], return_inverse=True, return_counts=True)
        many = np.flatnonzero(count[back] > 1)
        first = np.concatenate([[True], (many[1:] != many[:-1] + 1) | (of[many[1:]] != of[many[:-1]])])[: len(many)]
        self.of, self.where = of[many[first]], start[many[first]]
        self.spread = np.diff(np.concatenate([np.flatnonzero(first), [len(many)]])) if len(many) else np.zeros(0, np.int64)
        self.width = self.spread + window - 1
        _, self.lead, self.piece = np.unique(hashes.at(self.where, self.where + self.width), return_index=True, return_inverse=True)
        self.sizes = self.width[self.lead]
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.text = b"".join(joined[self.where[i] : self.where[i] + self.width[i]].tobytes() for i in self.lead)
        self.run = np.repeat(np.arange(len(self.spread)), self.spread)
        self.step = np.arange(len(self.run)) - np.repeat(np.cumsum(self.spread) - self.spread, self.spread)


def repeated(data: list[bytes], deal: np.ndarray, oid: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(oid, start) of the windows in the contexts that also begin earlier, by external induced sorting.

    Windows whose hash is alone among the contexts can't repeat; the others form pieces, of which equal ones are taken
    once. Among those, again, only windows whose hash isn't alone can be shared by different pieces; they are sorted. In
    the order of their suffixes, neighbours with ``window`` letters in common are the same window.
    """
    sizes = np.array([len(d) for d in data])
    begin = np.cumsum(sizes) - sizes
    all_ = Pieces(np.frombuffer(b"".join(data), np.uint8), begin, sizes, deal.view(np.uint64), window)
    same = np.arange(len(all_.text))
    shared = Pieces(np.frombuffer(all_.text, np.uint8), all_.begin, all_.sizes, np.zeros(len(all_.sizes), np.uint64), window)
    if shared.text:
        group_of = np.arange(len(shared.text))
        ends = shared.begin + shared.sizes
        for group in induced.repeats(shared.text, np.repeat(ends, shared.sizes).tolist(), window):
            group_of[group] = min(group)
        same[shared.where[shared.run] + shared.step] = len(same) + group_of[shared.begin[shared.piece[shared.run]] + shared.step]
    source = oid[all_.of][all_.run]
    start = (at[all_.of] + all_.where - begin[all_.of])[all_.run] + all_.step
    gone = later(same[all_.begin[all_.piece[all_.run]] + all_.step], source, start)
    return source[gone], start[gone]


def decided(cut: DataFrame, window: int) -> DataFrame:
    """(oid, start, stop) to be removed, of contexts dealt by anchor and taken in shards that keep anchors whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, deal, oid, at, size = [], [], [], [], 0

        def done() -> pa.RecordBatch:
            a, b = repeated(data, np.array(deal), np.array(oid), np.array(at), window)
            a, b, c = intervals(a, b, b + window)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, c)], names=["oid", "start", "stop"])

        for batch in batches:
            for d, o, s, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size > SHARD and d != deal[-1]:
                    yield done()
                    data, deal, oid, at, size = [], [], [], [], 0
                data.append(x)
                deal.append(d)
                oid.append(o)
                at.append(s)
                size += len(x)
        if data:
            yield done()

    dealt = cut.select("deal", "oid", "start", "data").repartition("deal").sortWithinPartitions("deal")
    return dealt.mapInArrow(tidied(run), "oid long, start long, stop long")


def by_window(cut: DataFrame, window: int) -> DataFrame:
    """(oid, start, stop) to be removed of contexts of crowded anchors: each window is a row by itself, dealt by its content.

    No task holds such an anchor's contexts, however many differ; windows are the same if 128 bits of their hashes are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for oid, at, data in zip(*(batch.column(i) for i in range(3))):
                bytes_ = np.frombuffer(data.as_buffer(), np.uint8)
                start = np.arange(len(bytes_) - window + 1)
                both = [anchors.Windows(x).at(start, start + window).view(np.int64) for x in (bytes_, OTHER[bytes_])]
                yield pa.RecordBatch.from_arrays([*map(pa.array, both), pa.array(np.full(len(start), oid.as_py())), pa.array(start + at.as_py())], names=["w", "w2", "oid", "start"])

    rows = written(cut.select("oid", "start", "data").mapInArrow(tidied(run), "w long, w2 long, oid long, start long"))
    first = rows.groupBy("w", "w2").agg(F.min(F.struct("oid", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later_ = rows.join(first, ["w", "w2"]).filter(F.struct("oid", "start") != F.col("first"))
    return later_.select("oid", "start", (F.col("start") + window).alias("stop"))


def removals(docs: DataFrame, window: int = 100) -> DataFrame:
    """(oid, start, stop): the bytes of ``docs`` (oid, text) that a ``window``-byte string covers which also starts earlier.

    Equal windows have equal anchors, so windows are compared within their anchor's group only. Groups in which all
    runs of windows have one content are settled by its hash; the distinct contents of the others are sorted, but for
    anchors with more than ``CROWD`` bytes of them.
    """
    out = written(sorted_out(anchored(docs, window)))
    wanted = out.filter("open").select("deal", "oid", "start", "stop")
    crowds = written(wanted.groupBy("deal").agg(F.sum(F.col("stop") - F.col("start")).alias("bytes")).filter(F.col("bytes") > CROWD).select("deal"))
    gone = out.filter("not open").select("oid", "start", "stop")
    if not crowds.isEmpty():
        crowded = written(contexts(docs, wanted.join(crowds, "deal", "left_semi")))
        gone = gone.union(written(by_window(crowded, window)))
        discard(crowded)
        wanted = wanted.join(crowds, "deal", "left_anti")
    open_ = written(contexts(docs, wanted))
    done = written(decided(open_, window))
    discard(open_, crowds)
    return gone.union(done)


def cut(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the documents without the stretches ``gone``."""
    lists = gone.groupBy("oid").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    both = docs.join(lists, "oid", "left").select("doc_id", "text", "gone.start", "gone.stop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, start, stop in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.array(start or [], np.int64), np.array(stop or [], np.int64)
                order = np.argsort(a, kind="stable")
                a, b = merged(a[order], b[order]) if len(a) else (a, b)
                edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
                made.append((len(text), len(text) - len(kept), len(a), kept))
            cols = [pa.array([m[i] for m in made], pa.int64()) for i in range(3)] + [pa.array([m[3] for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_documents(docs: DataFrame, window: int = 100) -> DataFrame:
    """What is removed of each document, and the digest of what stays; a null text is empty, a short one stays whole."""
    placed = ordered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = cut(placed, removals(placed, window))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, bytes]], window: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """The same rows from a set of all strings seen so far; for tests."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        gone = bytearray(len(text))
        for i in range(len(text) - window + 1):
            if text[i : i + window] in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(text[i : i + window])
        kept = bytes(c for c, g in zip(text, gone) if not g)
        out[doc_id] = (len(text), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
    return out
