"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import plainly, tidied, tidy, written

#: Lengths of n-grams, in characters, and the bits of a feature number.
LENGTHS, BITS = (3, 4, 5, 6), 20
#: The most labelled documents that a model is fitted on: those with the least hash of doc_id.
MAX_TRAIN = 20_000
#: A feature counts if so many documents have it, and the least ratio of a log ratio to its error; all such are kept.
LEAST_DOCS, SURE = 5, 4.0
THRESHOLD = 0.3
#: Characters that a Python worker hashes at once.
CHUNK = 400_000
#: Entries of the sample's matrix that the driver works on at once.
ENTRIES = 1 << 20


def features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature numbers of all n-grams of the lower-cased texts, a space put on both ends, for each of ``LENGTHS``, and where each text begins.

    An n-gram's hash goes on from that of the n-gram one character shorter, so all lengths cost as much as the longest.
    """
    coded = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in coded], dtype=np.int64)
    data = np.concatenate(coded) if coded else np.zeros(0, np.uint32)
    starts = np.cumsum(sizes) - sizes
    h, found = np.full(len(data), 2166136261, dtype=np.uint32), []
    for n in range(1, max(LENGTHS) + 1):
        h = h[: max(len(data) - n + 1, 0)] ^ data[n - 1 :]
        h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        if n not in LENGTHS:
            continue
        f = np.zeros(len(data), np.uint32)
        f[: len(h)] = ((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        for back in range(1, n):  # those that would run on into the next text
            f[(starts + sizes - back)[sizes >= back]] = 0
        found.append(f)
    return found, starts


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > CHUNK:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def presence(texts: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (text, feature) pairs, each once, of ``wanted`` features, by text; feature 0 never is one.

    A feature's occurrences in a text write their places to one table; the one whose place stays there counts.
    """
    each, starts = features(texts)
    held = []
    for f in each:
        at = np.flatnonzero(wanted[f])
        held.append((f[at], np.searchsorted(at, np.append(starts, len(f)))))
    last, order, out = np.zeros(1 << BITS, np.int32), np.arange(sum(len(f) for f, _ in held), dtype=np.int32), []
    for t in range(len(texts)):
        mine = np.concatenate([f[cuts[t] : cuts[t + 1]] for f, cuts in held])
        last[mine] = order[: len(mine)]
        out.append(mine[last[mine] == order[: len(mine)]])
    sizes = np.array([len(x) for x in out], np.int64)
    return np.repeat(np.arange(len(texts)), sizes), np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def training(docs: DataFrame, labels: DataFrame, held_out: int = 2) -> DataFrame:
    """(text, toxic) of at most ``MAX_TRAIN`` labelled documents, none whose crc32(doc_id) mod 4 is ``held_out``.

    Labels that are null or name no document are left out; of repeated labels for a document the largest counts.
    """
    usable = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != held_out)
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")))


def fit(train: DataFrame) -> tuple[np.ndarray, float]:
    """Weights of all feature numbers, and the bias.

    A feature is an n-gram's presence in a document. Its value is the log of its smoothed share of documents among
    toxic ones over that among others; logistic regression on these values (for all sure features) gives the
    weights. Feature counts are summed by Spark; what reaches the driver, four bytes for each feature of each document
    of the sample, is bounded by the sample and the constants.
    Without documents of both labels the model is the prior alone.
    """
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sum(n for t, n in sizes.items() if t != 1)
    weights = np.zeros(1 << BITS, np.float32)
    if not n1 or not n0:
        return weights, 4.0 if n1 else -4.0
    every = np.ones(1 << BITS, bool)
    every[0] = False

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist()) == 1
            for a, b in chunks(texts):
                text, f = presence(texts[a:b], every)
                for label in (0, 1):
                    sums[label] += np.bincount(f[toxic[a + text] == bool(label)], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(sums.any(axis=0))
        for at in range(0, len(some), 50_000):
            part = some[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(sums[1, part]), pa.array(sums[0, part])], names=["f", "p", "q"])

    counted = train.mapInArrow(tidied(count), "f int, p int, q int").groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    ratio = F.log(((F.col("p") + 1) / (n1 + 2)) / ((F.col("q") + 1) / (n0 + 2)))
    sure = F.abs(ratio) / F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))
    best = counted.filter(F.col("p") + F.col("q") >= LEAST_DOCS).select("f", ratio.alias("r"), sure.alias("s")).filter(F.col("s") > SURE)
    rows = best.select("f", "r").toArrow().sort_by("f")
    if not rows.num_rows:
        return weights, float(np.log(n1 / n0))
    kept, ratios = rows["f"].to_numpy(), rows["r"].to_numpy()
    mask = np.zeros(1 << BITS, bool)
    mask[kept] = True

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                text, f = presence(texts[a:b], mask)
                cuts = np.cumsum(np.bincount(text, minlength=b - a))[:-1]
                found = pa.array([np.sort(x).tobytes() for x in np.split(f.astype("<i4"), cuts)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), found], names=["toxic", "f"])

    sample = train.mapInArrow(tidied(encode), "toxic int, f binary").groupBy("toxic", "f").count().toArrow()
    sample = sample.sort_by([("toxic", "ascending"), ("f", "ascending")])
    cuts = np.concatenate([[0], np.cumsum(pc.binary_length(sample["f"]).to_numpy().astype(np.int64) // 4)])
    place = np.zeros(1 << BITS, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    col = np.empty(cuts[-1], np.int32)
    for i, f in enumerate(sample["f"]):
        col[cuts[i] : cuts[i + 1]] = place[np.frombuffer(f.as_buffer(), "<i4")]
    y = (sample["toxic"].to_numpy() == 1).astype(float)
    times = sample["count"].to_numpy().astype(float)
    del sample
    w, b = logistic(cuts, col, ratios, y, times)
    weights[kept] = w * ratios
    del col, y, times, cuts
    tidy()
    return weights, b


def logistic(cuts, col, ratios, y, times, l2: float = 3e-4, steps: int = 50, inner: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows: Newton steps, solved by conjugate gradients to a tenth of the slope; deterministic.

    Row i has the features ``col[cuts[i] : cuts[i + 1]]``, each with its ratio as value. Rows are taken some at a time.
    """
    n, n_features, total = len(y), len(ratios), times.sum()
    ends = [0]
    while ends[-1] < n:
        ends.append(max(ends[-1] + 1, int(np.searchsorted(cuts, cuts[ends[-1]] + ENTRIES, side="right")) - 1))
    parts = [(a, b, col[cuts[a] : cuts[b]], np.diff(cuts[a : b + 1])) for a, b in zip(ends, ends[1:])]

    def rows(v):
        scaled, out = ratios * v[:-1], np.zeros(n)
        for a, b, c, sizes in parts:
            out[a:b] = np.bincount(np.repeat(np.arange(b - a, dtype=np.int32), sizes), weights=scaled[c], minlength=b - a)
        return out + v[-1]

    def columns(e):
        out = np.zeros(n_features)
        for a, b, c, sizes in parts:
            out += np.bincount(c, weights=np.repeat(e[a:b], sizes), minlength=n_features)
        return np.append(ratios * out, e.sum())

    ridge = np.append(np.full(n_features, l2), 0.0)
    w = np.zeros(n_features + 1)
    w[-1] = np.log((times * y).sum() / (times * (1 - y)).sum())

    def loss(v):
        z = np.clip(rows(v), -40, 40)
        return (times * (np.logaddexp(0, z) - y * z)).sum() / total + (ridge * v * v).sum() / 2

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows(w), -40, 40)))
        g = columns(times * (p - y) / total) + ridge * w
        curve = times * np.maximum(p * (1 - p), 1e-6) / total
        x, r = np.zeros_like(w), -g
        d, rr = r.copy(), r @ r
        enough = max(0.01 * rr, 1e-16)
        for _ in range(inner):
            if rr < enough:
                break
            hd = columns(curve * rows(d)) + ridge * d
            a = rr / (d @ hd)
            x, r = x + a * d, r - a * hd
            d, rr = r + (r @ r) / rr * d, r @ r
        rate = 1.0
        while rate > 1e-3 and loss(w + rate * x) > now:
            rate /= 2
        w, before, now = w + rate * x, now, loss(w + rate * x)
        if before - now < 1e-7:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, weights: np.ndarray, bias: float, keep: list[str]) -> DataFrame:
    """``keep`` of ``docs`` with ``score`` (0 to 1) and ``predicted`` of the whole text; a null text counts as empty.

    The weights (four bytes for each of 2**BITS features) go along with the tasks.
    """
    spark = docs.sparkSession
    source = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        wanted = w != 0
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in chunks(texts):
                text, f = presence(texts[a:b], wanted)
                z = np.bincount(text, weights=w[f], minlength=b - a) + bias
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                head = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*head, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(tidied(run), f"{types}, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights, bias = fit(training(docs, labels))
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    return score(docs, weights, bias, ["doc_id"]).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those whose text scores ``THRESHOLD`` or more."""
    weights, bias = fit(training(docs, labels))
    return plainly(docs, lambda d: score(d, weights, bias, d.columns).filter("predicted = 0"))
