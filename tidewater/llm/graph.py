"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, tidied, written

#: Edges up to which one task connects all of a table's nodes: some 20 MB there, whatever the input.
AT_ONCE = 200_000


def connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), ascending, and the smallest node reachable from each.

    Of two roots that an edge joins the larger one goes to the smaller, then every node to its root's root, until no edge joins two.
    """
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def together(e: DataFrame) -> DataFrame:
    """(node, component) of few edges (u, v), by one task instead of a row of joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            both = pa.Table.from_batches(held)
            nodes, low = connected(*(both.column(i).to_numpy() for i in range(2)))
            kind = both.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(low, kind)], names=["node", "component"])

    kind = e.schema["u"].dataType.simpleString()
    return written(e.select("u", "v").repartition(1).mapInArrow(tidied(run), f"node {kind}, component {kind}"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of ``edges`` and the smallest node reachable from it.

    Large-star and small-star steps in turn: every node links its larger neighbours, then its smaller ones,
    to its least neighbour, until the edges are stars. Steps are about the logarithm of the longest path. The
    least neighbour is an aggregate with partial sums, so a hub's neighbours are never gathered. Once there are
    ``AT_ONCE`` edges at most, one task does the rest: each step is six shuffles, which cost the driver memory however few the edges.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    if e.count() <= AT_ONCE:
        return together(e)
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        old, e = e, written(small.filter("u != v").distinct())
        discard(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] <= AT_ONCE:
            return together(e)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = now
