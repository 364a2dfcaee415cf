"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewater.llm.common import WORD, plainly, written

GOLDEN = (math.sqrt(5) - 1) / 2
#: Slots that a schedule has about; the most words of a block follow from it and from MIN_BLOCK.
SLOTS, MIN_BLOCK = 1 << 20, 64
#: Rows that are put in order together, and slots that are ranked together.
BUCKET_ROWS, CHUNK = 2_000, 8_192
MAX_EPOCHS = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, epochs: int = MAX_EPOCHS) -> list[float]:
    """Words to take of each source: ``share`` of all words by weight, none above ``epochs`` times its size.

    What a capped source leaves over is dealt again by weight among the others until none is above.
    """
    out, open_, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}, share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > epochs * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(epochs * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def mix(docs: DataFrame, pattern: list[float], share: float, seed: int = 11, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``size`` in words, ``source_size``, ``target`` of its source, and what the mix takes.

    ``taken`` = ``copies`` whole passes plus the first ``extra`` words once more. Sources are weighted by
    ``pattern``, repeating, in ascending code-point order with a null source last.

    Schedule: a source's blocks are equal stretches of its words, its documents laid end to end in a seeded
    shuffle; it needs as many slots as bring it to its target, the last of which may take part of a block only.
    Slot k carries the point frac((k + 1/2) / golden ratio); cumulative shares of needed slots map it to a
    source; the slot's rank among that source's slots, modulo its block count, names a block. Points beyond a
    source's need take nothing, and slots that the points leave out come last, so a source of any size gets its
    target to the word. No target is above ``MAX_EPOCHS`` times the source, so no document is taken more than that.

    Only per-source totals reach the driver (one row a source). Slots number about ``SLOTS``, and a few a source
    more, whatever the input. A hot source is laid out by buckets of documents and its slots are ranked by chunks, both joined
    by prefix sums of small totals. Documents without words are never taken; equal rows are separate rows.
    """
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    named = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col("source").alias("m_source"), words(F.col("text")).alias("size"))
    rows = written(named.withColumns({"rid": F.monotonically_increasing_id(), "h": F.xxhash64(F.lit(seed), *[f"k_{c}" for c in keep[:1]], "size")}))
    totals = sorted(
        rows.groupBy("m_source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect(),
        key=lambda r: (r["m_source"] is None, (r["m_source"] or "").encode()),
    )
    sizes = [r["words"] for r in totals]
    goal = targets(sizes, [pattern[i % len(pattern)] for i in range(len(sizes))], share)
    total = sum(goal)
    block = max(MIN_BLOCK, round(total / SLOTS))
    blocks = [max(1, -(-size // block)) for size in sizes]
    plans = [needed(round(g), size, b) for g, size, b in zip(goal, sizes, blocks)]
    facts = spark.createDataFrame(
        [(i, r["m_source"], r["words"], goal[i], blocks[i], *plans[i]) for i, r in enumerate(totals)],
        "s int, f_source string, source_size long, target double, blocks long, need long, part long, stop long",
    )

    buckets = max(1, sum(r["rows"] for r in totals) // BUCKET_ROWS)
    laid = rows.join(F.broadcast(facts), F.col("m_source").eqNullSafe(F.col("f_source"))).withColumn("b", F.pmod("h", F.lit(buckets)).cast("int"))
    ends = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("s", "b").agg(F.sum("size").alias("w")).select("s", "b", F.coalesce(F.sum("w").over(ends), F.lit(0)).alias("before"))
    inside = Window.partitionBy("s", "b").orderBy("h", "rid").rowsBetween(Window.unboundedPreceding, 0)
    placed = laid.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["s", "b"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    placed = written(placed.select("rid", *[f"k_{c}" for c in keep], "s", "size", "source_size", "target", "start", "blocks", "part", "stop"))

    taken = takes(spark, [p[0] for p in plans], facts)
    # Block j of B begins at word j * W div B of the source's W words.
    pieces = placed.filter("size > 0").withColumn("end", F.col("start") + F.col("size")).withColumn("w", F.greatest("source_size", F.lit(1)))
    pieces = pieces.withColumn("block", F.explode(F.expr("sequence(((start + 1) * blocks - 1) div w, (end * blocks - 1) div w)")))
    pieces = pieces.withColumns({"lo": F.expr("greatest(start, block * w div blocks)"), "hi": F.expr("least(end, (block + 1) * w div blocks)")})
    got = pieces.join(taken, ["s", "block"], "left").withColumn("takes", F.coalesce("takes", F.lit(0)))
    once_more = F.when(F.col("block") == F.col("part"), F.greatest(F.lit(0), F.least("hi", "stop") - F.col("lo"))).otherwise(0)
    per = got.groupBy("rid").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("takes") + once_more).alias("taken"))
    out = placed.join(per, "rid", "left").fillna(0, ["taken"]).withColumn("copies", F.expr("taken div greatest(size, 1)"))
    return out.select(
        *[F.col(f"k_{c}").alias(c) for c in keep], "size", "source_size", "target", F.col("taken").cast("long").alias("taken"),
        F.col("copies").cast("int").alias("copies"), (F.col("taken") - F.col("copies") * F.col("size")).cast("long").alias("extra"),
    )


def needed(goal: int, size: int, blocks: int) -> tuple[int, int, int]:
    """(need, part, stop): slots that take whole blocks, and a block taken once more up to word ``stop``, or -1.

    Of ``size`` words in ``blocks`` blocks ``goal`` are taken, pass after pass from the first word on.
    """
    if not size:
        return 0, -1, 0
    passes, rest = divmod(goal, size)
    part = ((rest + 1) * blocks - 1) // size
    return passes * blocks + part, part if rest > part * size // blocks else -1, rest


def takes(spark, need: list[int], facts: DataFrame) -> DataFrame:
    """(s, block, takes) of a schedule of as many slots as the sources need."""
    n_slots, upto, cum = sum(need), 0, []
    for n in need:
        upto += n
        cum.append(upto / max(n_slots, 1))
    slots = spark.range(n_slots).withColumn("p", ((F.col("id") + 0.5) * F.lit(GOLDEN)) % F.lit(1.0))
    bounds = F.array(*[F.lit(c) for c in cum[:-1]]).cast("array<double>")
    slots = slots.select("id", F.size(F.filter(bounds, lambda c: c <= F.col("p"))).alias("s"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = slots.groupBy("s", "chunk").agg(F.count("*").alias("c")).select("s", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead"))
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("s", "chunk").orderBy("id")) - 1).join(counts, ["s", "chunk"])
    ranked = ranked.join(F.broadcast(facts.select("s", "blocks", "need")), "s").withColumn("rank", F.col("ahead") + F.col("r"))
    once = ranked.filter(F.col("rank") < F.col("need")).select("s", "blocks", "rank")
    have = once.groupBy("s").agg(F.count("*").alias("have"))
    short = facts.join(F.broadcast(have), "s", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))).filter("have < need")
    once = once.union(short.select("s", "blocks", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank")))
    return once.groupBy("s", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("takes"))


def mixed_documents(docs: DataFrame, pattern: list[float], share: float, seed: int = 11) -> DataFrame:
    """The mixed corpus with ``docs``' columns: whole copies, and for a document cut by the mix its first words, spaced as they were."""
    return plainly(docs, lambda d: _mixed(d, pattern, share, seed))


def _mixed(docs: DataFrame, pattern: list[float], share: float, seed: int) -> DataFrame:
    key = F.xxhash64("doc_id", "text", "source")  # places in the shuffle follow what a row holds, not where it lies
    numbered = written(docs.withColumns({"_row": F.monotonically_increasing_id(), "_key": key}))
    plan = mix(numbered, pattern, share, seed, keep=["_key", "_row"]).filter("taken > 0").select("_row", "copies", "extra")
    both = numbered.join(plan, "_row")
    each = both.withColumn("_part", F.explode(F.expr("concat(array_repeat(-1L, copies), if(extra > 0, array(extra), array()))")))
    first = lambda c: F.slice(c, F.lit(1), F.col("_part").cast("int"))
    spaced = F.zip_with(first(F.split("text", WORD, -1)), first(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), lambda gap, word: F.concat(gap, word))
    cut = F.array_join(spaced, "")
    out = each.withColumn("text", F.when(F.col("_part") < 0, F.col("text")).otherwise(cut))
    return out.withColumn("n_chars", F.length("text").cast("long"))
