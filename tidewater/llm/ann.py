"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewater.llm.common import written

TABLES, SEED = 4, 97
#: Cells of a projection (which is about standard normal for unit vectors scaled to length sqrt(d)), and a cell's width.
CELLS, WIDTH = 4, 1.0
#: Hashes in a bucket's key: at least, at most; in between, buckets number about the square root of the rows.
LEAST_HASHES, MOST_HASHES = 4, 10
#: Sampled queries that set how far to probe, the share of their neighbours that must be found, and the least share
#: that must be found of each of ``LEVELS`` parts of them, from the farthest neighbours to the nearest.
SAMPLE, WANTED, LEAST_WANTED, LEVELS = 128, 0.96, 0.9, 4
#: Rows of one bucket, and queries, that meet in one task at once.
CELL_ROWS, CELL_QUERIES = 1_024, 1_024


@lru_cache(maxsize=8)
def hashing(dim: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal (2-stable) directions and uniform offsets of every table."""
    rng = np.random.default_rng([SEED, dim, hashes])
    return rng.normal(size=(TABLES, dim, hashes)), rng.uniform(0, WIDTH, size=(TABLES, 1, hashes))


def projections(x: np.ndarray, hashes: int) -> np.ndarray:
    """Each table's projections of the rows of ``x``, their lengths made sqrt(d): (tables, rows, hashes)."""
    a, b = hashing(x.shape[1], hashes)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit @ a + b


def buckets(x: np.ndarray, hashes: int) -> np.ndarray:
    """Each table's bucket of the rows of ``x``: floors of the projections, outer cells taken together, as one number."""
    cell = np.clip(np.floor(projections(x, hashes) / WIDTH) + CELLS // 2, 0, CELLS - 1).astype(np.int64)
    return cell @ (CELLS ** np.arange(hashes, dtype=np.int64))


def phi(x: np.ndarray) -> np.ndarray:
    """The standard normal distribution function, nearly."""
    return 1 / (1 + np.exp(-np.clip(0.07056 * x**3 + 1.5976 * x, -60, 60)))


def cell_chances(x: np.ndarray, hashes: int, levels: list[float]) -> np.ndarray:
    """Estimated chance of each cell of each projection for a neighbour at one of the cosines ``levels``: (tables, rows, hashes, cells).

    A neighbour's projection is normal about its cosine times the query's, with variance 1 - cosine**2.
    """
    _, b = hashing(x.shape[1], hashes)
    p = projections(x, hashes)
    edges, out = (np.arange(1, CELLS) - CELLS // 2) * WIDTH, 0
    for near in levels:
        centre, spread = (p - b) * near + b, max(math.sqrt(1 - near * near), 0.02)
        below = phi((edges - centre[..., None]) / spread)
        out = out + np.diff(np.concatenate([np.zeros_like(below[..., :1]), below, np.ones_like(below[..., :1])], axis=-1), axis=-1)
    return np.maximum(out / len(levels), 1e-15)


class Probes:
    """The buckets of one table in the order of a query's estimated chances, without a list of all buckets.

    A bucket's chance is the product of its cells'. The cells of the first and of the second half of the hashes have few
    combinations each (the square root of the number of buckets); both are put in order once. How much chance the buckets
    above a limit have is then a search in one half for each entry of the other, and so are the buckets themselves.
    """

    def __init__(self, cells: np.ndarray):
        hashes = len(cells)
        self.cut = CELLS ** (hashes // 2)
        self.halves, self.codes = [], []
        for part in (cells[: hashes // 2], cells[hashes // 2 :]):
            chance = np.ones(1)
            for c in part:  # bucket numbers have the first hash as lowest digit
                chance = (c[:, None] * chance[None, :]).ravel()
            order = np.argsort(-chance, kind="stable")
            self.halves.append(chance[order])
            self.codes.append(order)
        self.upto = np.concatenate([[0.0], np.cumsum(self.halves[1])])

    def counts(self, limit: float) -> np.ndarray:
        """For each entry of the first half, how many of the second make a chance of ``limit`` or more."""
        low, high = self.halves
        return np.searchsorted(-high, -(limit / low), side="right")

    def above(self, limit: float) -> float:
        """The chance of all buckets whose own is ``limit`` or more."""
        return float(self.halves[0] @ self.upto[self.counts(limit)])

    def chance(self, bucket: int) -> float:
        low, high = (int(np.flatnonzero(c == b)[0]) for c, b in zip(self.codes, (bucket % self.cut, bucket // self.cut)))
        return float(self.halves[0][low] * self.halves[1][high])

    def first(self, mass: float) -> np.ndarray:
        """The fewest buckets, likeliest first, whose chances sum to ``mass``, about."""
        no, yes = (math.log(h) for h in (self.halves[0][0] * self.halves[1][0] * 1.001, self.halves[0][-1] * self.halves[1][-1] * 0.999))
        for _ in range(40):
            half = (no + yes) / 2
            no, yes = (no, half) if self.above(math.exp(half)) >= mass else (half, yes)
        n = self.counts(math.exp(yes))
        low = np.repeat(np.arange(len(n)), n)
        high = np.arange(len(low)) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(-(self.halves[0][low] * self.halves[1][high]), kind="stable")
        return (self.codes[0][low] + self.codes[1][high] * self.cut)[order]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as rows of doubles."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part: whole, finite and not zero, with an id.

    Components stay floats if they are, and else become doubles; scores are in doubles, which hold floats exactly.
    """
    v = F.col(vector).cast(f"array<{component(df, vector)}>")
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    bad = "exists(v, x -> x is null or isnan(x) or abs(x) = cast('Infinity' as double))"
    return out.filter(f"not {bad} and exists(v, x -> x != 0)").withColumn("dim", F.size("v"))


def component(df: DataFrame, vector: str) -> str:
    return "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"


def best(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of each query's ``k`` best rows and those that tie with the last, its own id aside."""
    if not len(queries) or not len(rows):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    ql, rl = np.sqrt((queries * queries).sum(axis=1)), np.sqrt((rows * rows).sum(axis=1))
    s = (queries / ql[:, None]) @ (rows / rl[:, None]).T
    s[ids[:, None] == row_ids[None, :]] = -9
    last = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -5.0)
    q, r = np.nonzero((s >= last[:, None] - 1e-9) & (s > -5))
    return q, r, (queries[q] * rows[r]).sum(axis=1) / (ql[q] * rl[r])


def calibrate(rows: DataFrame, queries: DataFrame, hashes: int, k: int) -> tuple[list[float], float]:
    """(levels, mass): cosines of typical neighbours, far to near, and how much chance to visit in each table.

    At most ``SAMPLE`` queries (those with the least id hash) are held against all rows in blocks; the mass is the
    least of a fixed ladder that finds ``WANTED`` of their neighbours in some table, and ``LEAST_WANTED`` of each
    level's: near copies, however many, don't stand for the others. The ladder ends with every bucket.
    """
    spark = rows.sparkSession
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    dim = max({r["dim"] for r in sample}, key=[r["dim"] for r in sample].count)
    sample = [r for r in sample if r["dim"] == dim]
    q, ids = np.array([r["v"] for r in sample]), np.array([r["vec_id"] for r in sample])
    shared = spark.sparkContext.broadcast((q, ids))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids = shared.value
        for batch in batches:
            a, b, s = nearest(q, ids, matrix(batch.column(1)), batch.column(0).to_numpy(), k)
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), batch.column(0).take(pa.array(b)), pa.array(s), batch.column(1).take(pa.array(b))], names=["q", "vec_id", "score", "v"])

    found = rows.filter(F.col("dim") == dim).select("vec_id", "v").mapInArrow(search, f"q int, vec_id long, score double, v {rows.schema['v'].dataType.simpleString()}")
    true = best(found, ["q"], k).collect()
    if not true:
        return [0.5], 1.0
    scores = np.array([r["score"] for r in true])
    parts = [p for p in np.array_split(np.argsort(scores, kind="stable"), LEVELS) if len(p)]
    levels = [float(np.clip(np.median(scores[p]), 0.05, 0.999)) for p in parts]
    cells = cell_chances(q, hashes, levels)
    home = buckets(np.array([r["v"] for r in true]), hashes)
    needed = np.ones(len(true))
    for t in range(TABLES):
        probes = [Probes(c) for c in cells[t]]
        for i, r in enumerate(true):
            order = probes[r["q"]]
            needed[i] = min(needed[i], order.above(order.chance(int(home[t, i])) * (1 + 1e-9)))
    for mass in [0.02, 0.05, *np.arange(0.1, 1.0, 0.04), 0.99, 0.995, 0.999]:
        hit = needed < mass
        if hit.mean() >= WANTED and min(hit[p].mean() for p in parts) >= LEAST_WANTED:
            return levels, float(mass)
    return levels, 1.0


def search(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, its ``k`` nearest found by cosine.

    Vectors of different length are never compared. Of equal vectors only the k + 1 least ids can be in an answer, so
    only they are indexed. Each table puts a vector in one bucket; a query visits buckets in order of their estimated
    chance of holding a neighbour. A bucket's rows and its visitors are cut into parts of bounded size, and each pair of
    parts meets in one task, so neither a hot bucket nor a crowd of queries is gathered. The best of each meeting
    are merged; scores are taken from the original vectors in double precision. Queries for which fewer than ``k`` are
    found visit every bucket.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector)
    least = Window.partitionBy("v").orderBy("vec_id")
    rows = written(rows.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1).drop("n"))
    n = rows.count()
    # A query that equals k + 1 smaller ids isn't indexed but still asks.
    queries = written(usable(vectors.filter(F.col(id_col) % every == 0), id_col, vector))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n or queries.isEmpty():
        return empty
    hashes = min(MOST_HASHES, max(LEAST_HASHES, round(math.log(max(n, 2), CELLS) / 2)))
    levels, mass = calibrate(rows, queries, hashes, k)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                part = batch.take(at)
                for t, b in enumerate(buckets(matrix(part.column(1)), hashes)):
                    yield pa.RecordBatch.from_arrays([part.column(2), pa.array(np.full(len(b), t, np.int32)), pa.array(b), part.column(0), part.column(1)], names=["dim", "t", "b", "vec_id", "v"])

    def probe(batches: Iterator[pa.RecordBatch], mass: float) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for start in range(0, len(part), 64):
                    some = part.slice(start, 64)
                    # Each table has every vector, so one is enough where all buckets are visited.
                    tables = cell_chances(matrix(some.column(1)), hashes, levels) if mass < 1 else [None]
                    for t, q in ((t, q) for t in range(len(tables)) for q in range(len(some))):
                        b = Probes(tables[t][q]).first(mass) if mass < 1 else np.arange(CELLS**hashes)
                        q = pa.array(np.full(len(b), q))
                        yield pa.RecordBatch.from_arrays([some.column(2).take(q), pa.array(np.full(len(q), t, np.int32)), pa.array(b), some.column(0).take(q), some.column(1).take(q)], names=["dim", "t", "b", "vec_id", "v"])

    shape, cell = f"dim int, t int, b long, vec_id long, v array<{component(vectors, vector)}>", ["dim", "t", "b"]
    made = written(rows.select("vec_id", "v", "dim").mapInArrow(index, shape))
    # One row for each bucket in use: far fewer than rows.
    parts = made.groupBy(*cell).agg(F.ceil(F.count("*") / CELL_ROWS).cast("long").alias("parts"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        rows, row_ids = matrix(left.column("v").combine_chunks()), left.column("vec_id").to_numpy()
        out = []
        q, ids = matrix(right.column("v").combine_chunks()), right.column("vec_id").to_numpy()
        for at in range(0, len(q), 512):
            a, b, s = nearest(q[at : at + 512], ids[at : at + 512], rows, row_ids, k)
            out.append(pa.table({"query_id": ids[at : at + 512][a], "vec_id": row_ids[b], "score": s}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def answers(some: DataFrame, mass: float) -> DataFrame:
        """(query_id, rank, vec_id, score) of the queries ``some``."""
        asked = written(some.select("vec_id", "v", "dim").mapInArrow(lambda batches: probe(batches, mass), shape))
        crowds = asked.groupBy(*cell).agg(F.ceil(F.count("*") / CELL_QUERIES).cast("long").alias("crowds"))
        sizes = parts.join(crowds, cell)
        dealt = made.join(sizes, cell).select(*cell, F.pmod(F.xxhash64("vec_id"), "parts").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("crowds") - 1)).alias("c"), "vec_id", "v")
        guests = asked.join(sizes, cell).select(*cell, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"), F.pmod(F.xxhash64("vec_id"), "crowds").alias("c"), "vec_id", "v")
        keys = [*cell, "p", "c"]
        found = dealt.groupBy(*keys).cogroup(guests.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best(once, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    out = answers(queries, mass)
    if mass >= 1:
        return out
    out = written(out)
    full = out.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = written(queries.join(full, "vec_id", "left_anti"))
    if short.isEmpty():
        return out
    return out.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").union(answers(short, 1.0))


def brute_force(vectors: list[tuple[int, list[float]]], every: int, k: int) -> list[tuple[int, int, int, float]]:
    """What ``search`` would return if it visited every bucket; for tests and for measuring recall."""
    ok = [(i, np.array(v, dtype=float)) for i, v in vectors if v is not None and len(v) and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = []
    for i, v in ok:
        if i % every == 0:
            s = [(-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), j) for j, w in ok if j != i and len(w) == len(v)]
            out += [(i, rank, j, -c) for rank, (c, j) in enumerate(sorted(s)[:k], 1)]
    return out
