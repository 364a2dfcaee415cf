"""Document fingerprints by one-permutation MinHash with optimal densification and packed low bits. Native."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewater.llm.common import WORD

#: Words in a shingle, bins, and low bits kept of each bin's least hash: 16 bins fill one long.
SHINGLE, BINS, BITS = 5, 256, 4
#: Bins probed for an empty bin before the walk over all of them.
FIRST_PROBES = 6
#: Documents put in order together, and the most such groups there are (their first rows are broadcast).
BUCKET_ROWS, MAX_BUCKETS = 2_000, 50_000
REST = (1 << 56) - 1


def probes() -> tuple[list[int], list[int]]:
    """For each bin a random start and odd stride: start + t * stride visits every bin as t runs over BINS values."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, BINS, BINS).tolist(), (2 * rng.integers(0, BINS // 2, BINS) + 1).tolist()


def fingerprints(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with ``into``: the fingerprint of ``text`` as an array of longs; empty for a text without words.

    Each shingle of ``SHINGLE`` words is hashed once; the top eight bits choose its bin and a bin keeps its
    least hash. One greatest value per bin is put among the hashes, so that after one sort the first value
    of each bin stands for it and an empty bin shows by that value. An empty bin takes the value of the
    first filled bin on its own pseudo-random walk (optimal densification; a walk covers all bins, so one
    filled bin suffices). Of each value ``BITS`` low bits stay. A text of fewer words has one shingle: all of them.
    """
    start, stride = (f"array({', '.join(map(str, x))})" for x in probes())
    marks = f"transform(sequence(0, {BINS - 1}), b -> shiftleft(cast(b as bigint), 56) | {REST}L)"
    df = df.withColumn("_w", F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    parts = ", ".join(f"_w[i + {k}]" for k in range(SHINGLE))
    shingles = f"transform(sequence(0, size(_w) - {SHINGLE}), i -> xxhash64({parts}))"
    few = "array(aggregate(_w, 42L, (a, x) -> xxhash64(a, x)))"
    df = df.withColumn("_h", F.expr(f"case when size(_w) = 0 then array() when size(_w) < {SHINGLE} then {few} else {shingles} end"))
    df = df.withColumn("_h", F.expr(f"sort_array(concat(_h, {marks}))"))
    df = df.withColumn("_m", F.expr("filter(_h, (x, i) -> i = 0 or shiftrightunsigned(x, 56) != shiftrightunsigned(_h[greatest(i - 1, 0)], 56))"))
    df = df.withColumn("_m", F.expr(f"transform(_m, x -> if((x & {REST}L) = {REST}L, null, x))"))
    df = df.withColumns({"_start": F.expr(start), "_stride": F.expr(stride)})
    walk = "aggregate(sequence({0}, {1}), cast(null as bigint), (a, t) -> coalesce(a, _m[(_start[b] + t * _stride[b]) & {2}]))"
    fill = f"transform(_m, (x, b) -> coalesce(x, {walk.format(0, FIRST_PROBES - 1, BINS - 1)}, {walk.format(FIRST_PROBES, BINS - 1, BINS - 1)}))"
    df = df.withColumn("_m", F.when(F.size("_w") > 0, F.expr(fill)))
    # The filled bins are bound to a variable: written in place, they would be filled anew for every bin that is packed.
    pack = "aggregate(sequence(0, 15), 0L, (a, k) -> shiftleft(a, 4) | (m[16 * w + k] & 15))"
    packed = f"transform(array(_m), m -> transform(sequence(0, {BINS // 16 - 1}), w -> {pack}))[0]"
    df = df.withColumn(into, F.when(F.size("_w") > 0, F.expr(packed)).otherwise(F.array().cast("array<bigint>")))
    return df.drop("_w", "_h", "_m", "_start", "_stride")


def shown(fingerprint: str) -> str:
    """SQL for a fingerprint as lower-case hexadecimal, one digit a bin."""
    return f"array_join(transform({fingerprint}, x -> lpad(lower(hex(x)), 16, '0')), '')"


def likeness(a: str, b: str) -> str:
    """SQL for the estimated Jaccard similarity: the share of equal bins less what equals by chance.

    Two texts without words are alike (1); one without words is unlike any other (0).
    """
    odd = "zip_with({0}, {1}, (x, y) -> x ^ y)".format(a, b)
    unlike = f"aggregate(transform({odd}, x -> bit_count((x | shiftrightunsigned(x, 1) | shiftrightunsigned(x, 2) | shiftrightunsigned(x, 3)) & {0x1111111111111111}L)), 0, (s, n) -> s + n)"
    chance = 1 / (1 << BITS)
    estimate = f"greatest(0D, (1D - {unlike} / {BINS}D - {chance}D) / {1 - chance}D)"
    return f"case when size({a}) = 0 and size({b}) = 0 then 1D when size({a}) = 0 or size({b}) = 0 then 0D else {estimate} end"


def cuts(docs: DataFrame, rows: int, most: int) -> tuple[DataFrame, DataFrame]:
    """One row with the ascending array ``cuts`` of ids at which groups of about ``rows`` rows begin, and (heavy, parts).

    A range exchange of the ids alone finds the quantiles, however uneven the ids are. An id that more than ``rows`` rows
    have, or null, is heavy: it is a group by itself, to be divided into ``parts``. There are at most ``most`` groups and as
    many heavy ids, so both tables can be broadcast.
    """
    n = docs.count()
    rows = max(rows, -(-n // most))
    heavy = docs.groupBy(F.col("doc_id").alias("heavy")).agg(F.ceil(F.count("*") / rows).alias("parts")).filter("parts > 1")
    ids = docs.select("doc_id").filter("doc_id is not null").repartitionByRange(max(1, n // rows), "doc_id")
    found = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("cut")).select("cut")
    found = found.union(heavy.select(F.explode(F.array(F.col("heavy"), F.col("heavy") + 1)))).filter("cut is not null")
    return found.agg(F.sort_array(F.collect_set("cut")).alias("cuts")), heavy


def with_next(docs: DataFrame, extra: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, ``extra``) with the next document's columns as ``next_*``; the first follows the last.

    Order: doc_id ascending (nulls first), then the text's hash. Documents are put into buckets of consecutive ids
    (see ``cuts``; a heavy id's rows by ranges of the text's hash), each found by binary search among the cuts; the first
    document of a bucket also goes to the bucket before, so one exchange of the texts serves all and no window spans buckets.
    """
    at_cut, heavy = cuts(docs, BUCKET_ROWS, MAX_BUCKETS)
    docs = docs.withColumn("_tie", F.xxhash64("text"))
    halve = (
        "aggregate(sequence(0, cast(log2(size(cuts) + 1) as int)), named_struct('lo', 0, 'hi', size(cuts)), (a, k) -> if(a.lo >= a.hi, a, "
        "if(cuts[(a.lo + a.hi) div 2] <= doc_id, named_struct('lo', cast((a.lo + a.hi) div 2 + 1 as int), 'hi', a.hi), named_struct('lo', a.lo, 'hi', cast((a.lo + a.hi) div 2 as int)))), a -> a.lo)"
    )
    part = F.shiftright((F.shiftright("_tie", 44) + (1 << 19)) * F.col("parts"), 20)
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(F.expr(halve)).cast("long")
    placed = docs.crossJoin(F.broadcast(at_cut)).withColumn("_at", place).drop("cuts")
    placed = placed.join(F.broadcast(heavy), F.col("doc_id").eqNullSafe(F.col("heavy")), "left")
    placed = placed.withColumn("_b", F.col("_at") * (1 << 32) + F.coalesce(part, F.lit(0))).drop("_at", "heavy", "parts")
    firsts = placed.groupBy("_b").agg(F.min(F.struct("doc_id", "_tie")).alias("f"))
    order = Window.orderBy("_b")
    last = firsts.agg(F.max("_b").alias("_end"))
    firsts = firsts.withColumn("_before", F.lag("_b").over(order)).crossJoin(F.broadcast(last))
    firsts = firsts.select(F.col("_b").alias("f_b"), F.col("f.doc_id").alias("f_id"), F.col("f._tie").alias("f_tie"), F.coalesce("_before", "_end").alias("f_to"))
    on = (F.col("_b") == F.col("f_b")) & F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("_tie") == F.col("f_tie"))
    sent = placed.join(F.broadcast(firsts), on, "left")
    both = F.when(F.col("f_to").isNull(), F.array(F.col("_b"))).otherwise(F.array(F.col("_b"), F.col("f_to")))
    sent = sent.select("doc_id", "text", *extra, "_tie", F.posexplode(both).alias("_copy", "_to"))
    w = Window.partitionBy("_to").orderBy("_copy", "doc_id", "_tie")
    out = sent.select("doc_id", "text", *extra, "_copy", *[F.lead(c).over(w).alias(f"next_{c}") for c in ["text", *extra]])
    return out.filter("_copy = 0").drop("_copy")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness; a null text counts as empty.

    Edited: the last floor(n/2) code points give way to as many (or all) first ones of the next document.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(fingerprints(docs, "text", "f"), ["f"])
    half = "cast(floor(length(text) / 2) as int)"
    near = near.withColumn("edited", F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half}))"))
    near = near.select("doc_id", F.length("text").cast("long").alias("n_chars"), "f", "next_f", "edited")
    near = fingerprints(near, "edited", "e")
    return near.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.expr(shown("f")).alias("fingerprint"), F.expr(shown("e")).alias("edited_fingerprint"),
        F.expr(likeness("f", "e")).alias("near_edited"), F.expr(likeness("f", "next_f")).alias("near_next"),
    )
