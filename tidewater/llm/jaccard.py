"""N-gram Jaccard join by parity sketches, and the classes of documents that its links connect."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewater.llm import shingles
from tidewater.llm.common import discard, plainly, tidied, written
from tidewater.llm.graph import components

#: Bytes of text that a Python worker hashes at once.
CHUNK = 1_500_000
#: Rows up to which a side is broadcast.
SMALL = 500_000
#: Sketch blocks for each element by which linked sets can differ, and one.
SPARE = 1.5
#: Sketches of a side of a cell, about; members that a hub meets in a task; classes of a bucket that are paired directly.
BLOCK, HOT, FEW = 512, 500, 32
#: Hubs that a set meets, those it shares most of its keys with; what doesn't link by them meets in cells.
HUBS = 4
EMPTY = np.uint64(0x5851F42D4C957F2D)


class Bands:
    """Overlapping ranges of set sizes for a similarity of ``percent``/100 or more.

    Linked sets differ in size by a factor of 100/percent at most. Range j begins at that factor to the power
    2j and reaches one factor into range j + 1, so two linked sets share the smaller one's range. ``apart[j]`` is
    the most elements by which linked sets of the range can differ: (1 - t)/(1 + t) of their sizes' sum.
    """

    def __init__(self, percent: int, largest: int):
        self.step = 2 * math.log(100 / percent)
        n = int(math.log(max(largest, 1)) / self.step) + 2
        self.start = np.exp(self.step * np.arange(n + 1))
        top = np.floor(self.start[1:] * math.exp(self.step / 2) * (1 + 1e-9)).astype(np.int64)
        self.apart = (100 - percent) * 2 * top // (100 + percent)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, range) memberships: each nonempty set's own range, and the one before if it reaches that far."""
        some = np.flatnonzero(sizes > 0)
        own = np.searchsorted(self.start * (1 - 1e-9), sizes[some], side="right") - 1
        near = (own > 0) & (sizes[some] <= self.start[own] * math.exp(self.step / 2) * (1 + 1e-9))
        member, band = np.concatenate([some, some[near]]), np.concatenate([own, own[near] - 1])
        order = np.argsort(member, kind="stable")
        return member[order], band[order]


def sketch_keys(h: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each set's parity sketch: (keys, membership of each key, set, second, slack of each membership).

    In a range where linked sets differ in at most D elements, a sketch has B = SPARE (D + 1) blocks; an element
    belongs to one block by its hash, and a block is the XOR of its elements' hashes. Each differing element
    changes one block, so linked sets agree in B - D blocks at least. Hence, in any one order of all blocks' values, they
    share one of their first D + 1 (pigeonhole). The order is ascending in how many sets hold a value, empty blocks last
    by place; so an empty block is a key only of sets with fewer than D + 1 others. ``slack`` is by how many a
    membership's keys exceed D + 1; ``second`` marks memberships of the range before a set's own.
    """
    bands = Bands(percent, int(n.max(initial=1)))
    member, band = bands.of(n)
    if not len(member):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none.astype(bool), none
    prefix = bands.apart[band] + 1
    blocks = np.floor(SPARE * prefix).astype(np.int64)
    base = np.cumsum(blocks) - blocks
    ends = np.cumsum(n)
    size = n[member]
    row = np.repeat(np.arange(len(member)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[member] - size, size)
    with np.errstate(over="ignore"):
        mixed = shingles.mix(h)
        at = base[row] + ((h[place] >> np.uint64(32)) * blocks[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total = int(base[-1] + blocks[-1])
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        value = np.full(total, EMPTY, np.uint64)
        value[at[first]] = np.bitwise_xor.reduceat(mixed[place], first)
        held = np.zeros(total, bool)
        held[at[first]] = True
        row_of = np.repeat(np.arange(len(member)), blocks)
        filled = np.bincount(row_of[held], minlength=len(member))
        empty = np.cumsum(~held)
        empty -= np.repeat(empty[base] - ~held[base], blocks)
        use = np.flatnonzero(held | (empty <= (prefix - filled)[row_of]))
        row_of = row_of[use]
        label = shingles.mix(band[row_of].astype(np.uint64) << np.uint64(40) | (use - base[row_of]).astype(np.uint64))
        keys = shingles.mix(value[use] ^ label)
    second = np.concatenate([[False], member[1:] == member[:-1]])
    return keys, row_of, member, second, np.maximum(filled - prefix, 0)


def bit_sketches(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's bits, in bytes on end, and how many bytes each has.

    An element flips the bit that its hash's low bits number, so the Hamming distance of two sketches is a lower
    bound on the sets' symmetric difference. A sketch has a power of two bits, at least twice the elements and 64;
    one folded in two by XOR is the sketch of half as many bits, so sketches of any two lengths compare.
    """
    bits = 64 << np.maximum(np.ceil(np.log2(np.maximum(n, 1) / 32)), 0).astype(np.int64)
    base = np.cumsum(bits) - bits
    owner = np.repeat(np.arange(len(n)), n)
    at = base[owner] + (h & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.zeros(int(bits.sum()), np.uint8)
    np.bitwise_xor.at(odd, at, np.uint8(1))
    return np.packbits(odd, bitorder="little"), bits // 8


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > CHUNK:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def first_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, text) with one row for each distinct nonempty text, and the table that tells copies apart, to be discarded.

    ``node`` is a 63-bit hash of the text. Rows that repeat both the id and the text can come twice.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("text").bitwiseAND(F.lit(-2)).alias("node")).filter("text is not null and text != ''")
    copies = written(hashed.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).filter("n > 1"))
    alone = hashed.join(side(copies), "node", "left").filter(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("low")))
    return alone.select("node", "text"), copies


def sketches(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, n_shingles, sketch, slack0, slack1, keys0, keys1, shared) of (node, text).

    ``keys0`` and ``keys1`` are the keys of the set's own range and of the one before. A key that several sets of a
    chunk hold is in ``shared`` instead, once, with all its members (``node``, or ``node`` + 1 in the range before): what
    a large group shares enters the shuffle once a chunk.
    """
    longs = pa.list_(pa.int64())
    shared = pa.list_(pa.struct([("key", pa.int64()), ("members", longs)]))
    schema = pa.schema([("node", pa.int64()), ("n_shingles", pa.int64()), ("sketch", pa.binary()), ("slack0", pa.int64()), ("slack1", pa.int64()), ("keys0", longs), ("keys1", longs), ("shared", shared)])

    def offsets(owner: np.ndarray, n: int) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32))

    def part(node: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        h, n = shingles.sets(texts, k)
        keys, row, member, second, slack = sketch_keys(h, n, percent)
        order = np.argsort(keys, kind="stable")
        keys, row = keys[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        count = np.diff(np.concatenate([first, [len(keys)]]))
        m, single = len(n), np.repeat(count == 1, count)
        cols = [pa.array(node), pa.array(n.astype(np.int64)), binaries(*bit_sketches(h, n))]
        for again in (False, True):
            out = np.zeros(m, np.int64)
            out[member[second == again]] = slack[second == again]
            has = np.isin(np.arange(m), member[second == again])
            cols.append(pa.array(out, mask=~has))
        for again in (False, True):
            some = np.flatnonzero(single & (second[row] == again))
            some = some[np.argsort(member[row[some]], kind="stable")]
            cols.append(pa.ListArray.from_arrays(offsets(member[row[some]], m), pa.array(signed(keys[some]))))
        many = np.flatnonzero(count > 1)
        many = many[np.argsort(member[row[first[many]]], kind="stable")]
        at = np.repeat(first[many] - (np.cumsum(count[many]) - count[many]), count[many]) + np.arange(int(count[many].sum()))
        ids = node[member[row[at]]] + second[row[at]]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[many])]).astype(np.int32)), pa.array(ids))
        pairs = pa.StructArray.from_arrays([pa.array(signed(keys[first[many]])), lists], names=["key", "members"])
        cols.append(pa.ListArray.from_arrays(offsets(member[row[first[many]]], m), pairs))
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, node = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(0).to_numpy()
            for start, stop in chunks(data):
                yield part(node[start:stop], data[start:stop])

    ddl = "node long, n_shingles long, sketch binary, slack0 long, slack1 long, keys0 array<long>, keys1 array<long>, shared array<struct<key: long, members: array<long>>>"
    return texts.select("node", "text").mapInArrow(tidied(run), ddl)


def buckets(made: DataFrame) -> DataFrame:
    """(key, node, held): the first keys, by rarity, of each set; ``held`` is how many sets have the key at all.

    Of keys that no other set has only their number counts, and that is known: what is left of D + 1 after them is chosen
    among the others. A set that has D + 1 keys for itself can't link and drops out here.
    """
    none = F.lit(None).cast("array<long>")
    tokens = made.select(F.explode("keys0").alias("key"), F.col("node").alias("member"), none.alias("members"))
    tokens = tokens.union(made.select(F.explode("keys1"), F.col("node") + 1, none))
    tokens = tokens.union(made.select(F.explode("shared").alias("s")).select("s.key", F.lit(None).cast("long"), "s.members"))
    held = F.sum(F.coalesce(F.when(F.col("members").isNotNull(), F.size("members")), F.lit(1))).over(Window.partitionBy("key"))
    common = tokens.withColumn("held", held).filter("held > 1")
    common = common.select("key", "held", F.explode(F.coalesce("members", F.array("member"))).alias("member"))
    slack = made.select(F.col("node").alias("member"), F.col("slack0").alias("slack")).union(made.select(F.col("node") + 1, "slack1"))
    slack = slack.filter("slack is not null").groupBy("member").agg(F.max("slack").alias("slack"))
    mine = Window.partitionBy("member")
    ranked = common.join(slack, "member").withColumn("n", F.count("*").over(mine)).filter("n > slack")
    ranked = ranked.withColumn("rank", F.row_number().over(mine.orderBy("held", "key"))).filter("rank <= n - slack")
    return ranked.select("key", F.col("member").bitwiseAND(F.lit(-2)).alias("node"), "held")


def with_key(rows: DataFrame, per_key: DataFrame) -> DataFrame:
    """``rows`` (key, held, ...) joined with ``per_key`` (key, held, ...) on the key, keys that many hold in parts."""
    parts = F.ceil(F.col("held") / HOT)
    left = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts))
    right = per_key.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("held")
    return left.join(right, ["key", "part"]).drop("part")


def side(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it is small, else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, n, payload) of (node, text): the set's hashes ascending, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).cast(pa.binary()).to_pylist()
            for start, stop in chunks(data):
                h, n = shingles.sets(data[start:stop], k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(n.astype(np.int64)), binaries(h.view(np.uint8), n * 8)], names=["node", "n", "payload"])

    return texts.select("node", "text").mapInArrow(tidied(run), "node long, n long, payload binary")


def folded(x: bytes, size: int) -> int:
    """The sketch of ``size`` bytes of which ``x`` is one of more."""
    value, bits = int.from_bytes(x, "little"), len(x) * 8
    while bits > size * 8:
        bits //= 2
        value = value >> bits ^ value & (1 << bits) - 1
    return value


def may_link(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """Whether sets of ``n`` and ``m`` elements with these sketches can link."""
    size = min(len(x), len(y))
    return 100 * min(n, m) >= percent * max(n, m) and (folded(x, size) ^ folded(y, size)).bit_count() * (100 + percent) <= (100 - percent) * (n + m)


def link(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """Whether the sets link."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (n + m - common)


def meet(pairs: DataFrame, table: DataFrame, test: Callable[..., bool], percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, cell) that pass ``test`` on their rows of ``table`` (node, n, payload).

    b's row is sent once a cell, and each a's to it; a worker holds one b and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, payload = None, 0, b""
        for batch in batches:
            out = []
            b, cell, a, size, data = (batch.column(i).to_pylist() for i in range(5))
            for i in range(batch.num_rows):
                if a[i] is None:
                    now, n, payload = (b[i], cell[i]), size[i], data[i]
                elif now == (b[i], cell[i]) and test(n, payload, size[i], data[i], percent):
                    out.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    each = pairs.join(table, F.col("a") == F.col("node")).select("b", "cell", "a", "n", "payload")
    hubs = pairs.select("b", "cell").distinct().join(table, F.col("b") == F.col("node")).select("b", "cell", F.lit(None).cast("long").alias("a"), "n", "payload")
    dealt = each.union(hubs).repartition("b", "cell").sortWithinPartitions("b", "cell", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(tidied(run), "a long, b long")


def across(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different classes in a cell that can link by their sketches.

    ``cells``: (kind, id, i, j, side, node, class, n, payload); side 0 meets side 1, each ``BLOCK`` rows about.
    """

    def compared(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        by = {}
        for r in rows:
            by.setdefault((r[0], len(r[4])), []).append(r)
        for (s, size), left in by.items():
            for (t, other), right in by.items():
                if s or not t:
                    continue
                width = min(size, other)
                words = [np.stack([np.frombuffer(r[4], np.uint64).reshape(-1, width // 8) for r in rows]) for rows in (left, right)]
                x, y = (np.bitwise_xor.reduce(w, axis=1) for w in words)
                (a, c, n), (b, d, m) = (np.array([(r[1], r[2], r[3]) for r in rows], np.int64).T for rows in (left, right))
                for i in range(len(a)):
                    far = np.bitwise_count(x[i] ^ y).sum(axis=1, dtype=np.int64)
                    ok = (far * (100 + percent) <= (100 - percent) * (n[i] + m)) & (c[i] != d) & (100 * np.minimum(n[i], m) >= percent * np.maximum(n[i], m))
                    yield from ((int(a[i]), int(q)) for q in b[ok])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            out = list(compared(held))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(9)]
            for *cell, s, node, of, n, payload in zip(*cols):
                if cell != now:
                    if held:
                        yield done()
                    now, held = cell, []
                held.append((s, node, of, n, payload))
        if held:
            yield done()

    place = ["kind", "id", "i", "j"]
    dealt = cells.select(*place, "side", "node", "class", "n", "payload").repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(tidied(run), "a long, b long")


def blocks_of(n: str) -> F.Column:
    return F.ceil(F.col(n) / BLOCK)


def upto(n: F.Column) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def crowded(many: DataFrame) -> DataFrame:
    """(id, i, j, node, class, side): cells in which all members of each bucket of ``many`` (key, node, class, rows) meet.

    Crowded buckets that hold the same classes over and over are put together into one group, so that its members meet
    once, where that takes fewer rows than a group for each bucket.
    """
    group = written(components(many.select("key", "class").distinct(), "key", "class"))
    of = lambda c: group.select(F.col("node").alias(c), F.col("component").alias("id"))
    whole = written(many.select("node", "class").distinct().join(of("class"), "class"))
    keys = many.groupBy("key").agg(F.max("rows").alias("rows")).join(of("key"), "key")
    apart = keys.groupBy("id").agg(F.sum(F.col("rows") * blocks_of("rows")).alias("apart"))
    counts = whole.groupBy("id").agg(F.count("*").alias("rows")).join(apart, "id").withColumn("together", F.col("rows") * blocks_of("rows") <= F.col("apart"))
    counts = written(counts)
    met = whole.join(counts.filter("together").select("id", "rows"), "id").select("id", "node", "class", "rows")
    single = keys.join(counts.filter("not together").select("id"), "id", "left_semi").select("key")
    single = many.join(single, "key", "left_semi").select(F.col("key").alias("id"), "node", "class", "rows")
    met = met.union(single).withColumn("block", F.pmod(F.xxhash64("node", "id"), blocks_of("rows"))).withColumn("other", upto(blocks_of("rows")))
    met = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    sides = F.when(F.col("block") == F.col("other"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("block") > F.col("other")).cast("int")))
    return met.select("id", "i", "j", "node", "class", F.explode(sides).alias("side"))


def remaining(first: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) that share a bucket, are of different classes by now, and can link by their sketches: all such pairs.

    Where a bucket has few classes, each two are related, whatever bucket says so, and the members of the smaller
    one meet those of the larger, together with all others that are related to it. Where it has many, its members
    meet one another (see ``crowded``). Either way in cells of two blocks of sketches.
    """
    classed = first.join(labels, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    per = classed.groupBy("key", "class").agg(F.max("held").alias("held"), F.count("*").alias("rows"))
    keys = written(per.groupBy("key").agg(F.max("held").alias("held"), F.sum("rows").alias("rows"), F.count("*").alias("classes")).filter("classes > 1"))
    sizes = labels.groupBy(F.col("component").alias("class")).agg(F.count("*").alias("size"))
    few = per.drop("rows").join(keys.filter(F.col("classes") <= FEW).select("key"), "key").join(sizes, "class", "left")
    few = few.groupBy("key").agg(F.collect_list(F.struct(F.coalesce("size", F.lit(1)).alias("size"), "class")).alias("c"))
    two = few.select(F.explode(F.expr("flatten(transform(c, x -> transform(filter(c, y -> y < x), y -> struct(x as big, y as small))))")).alias("p"))
    two = written(two.select(F.col("p.big.class").alias("id"), F.col("p.big.size").alias("size"), F.col("p.small.class").alias("class")).distinct())

    members = first.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("class"))
    small = written(two.select("id", "size", "class").join(members, "class"))
    count = small.groupBy("id").agg(F.count("*").alias("smalls"))
    small = small.join(count, "id").withColumn("j", F.pmod(F.xxhash64("node"), blocks_of("smalls"))).withColumn("i", upto(blocks_of("size")))
    big = two.groupBy("id").agg(F.max("size").alias("size")).join(count, "id").join(members.withColumnRenamed("class", "id"), "id")
    big = big.withColumn("i", F.pmod(F.xxhash64("node"), blocks_of("size"))).withColumn("j", upto(blocks_of("smalls"))).withColumn("class", F.col("id"))
    form = ["id", "i", "j", "node", "class"]
    cells = big.select(F.lit(0).alias("kind"), *form, F.lit(0).alias("side")).union(small.select(F.lit(0), *form, F.lit(1)))

    many = written(with_key(classed, keys.filter(F.col("classes") > FEW).select("key", "held", "rows")))
    if not many.isEmpty():
        cells = cells.union(crowded(many).select(F.lit(1), *form, "side"))
    return across(cells.join(nodes, "node"), percent)


def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` (node, component) after the links ``found`` (a, b), which join whole classes: only classes are connected."""
    class_of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"class_{c}"))
    of = found.join(class_of("a"), "a", "left").join(class_of("b"), "b", "left")
    upper = components(of.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")))
    old = labels.select("node", F.col("component").alias("class")).join(upper.select(F.col("node").alias("class"), "component"), "class", "left")
    new = upper.join(labels, "node", "left_anti").select("node", "component")
    return written(old.select("node", F.coalesce("component", "class").alias("component")).union(new))


def links(docs_texts: DataFrame, made: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(node, n, payload) with the sketches of all sets, and (node, component) of those that link, None if none does.

    All pairs that share a bucket are tested, but those that links join already. Each bucket has two hubs: its least node
    and another. First each set meets the hub it shares most of its keys with, then the next ``HUBS`` - 1 that are not of
    its class yet; then what is left of all pairs meets in cells.
    """
    nodes = written(made.groupBy("node").agg(F.max("n_shingles").alias("n"), F.max("sketch").alias("payload")))
    first = written(buckets(made))
    discard(made)
    by = F.min(F.struct(F.xxhash64("node", "key"), "node"))
    hubs = first.groupBy("key").agg(F.max("held").alias("held"), F.min("node").alias("low"), by.getField("node").alias("other"), F.count("*").alias("n")).filter("n > 1")
    hubs = written(hubs)
    met = with_key(first, hubs).select(F.col("node").alias("a"), F.explode(F.array("low", "other")).alias("b"), F.ceil(F.col("held") / HOT).alias("cells"))
    stars = met.filter("a != b").groupBy("a", "b").agg(F.count("*").alias("w"), F.max("cells").alias("cells"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), F.desc("b")))
    stars = stars.withColumn("rank", rank).filter(F.col("rank") <= HUBS)
    stars = written(stars.select("a", "b", F.pmod(F.xxhash64("a"), "cells").alias("cell"), "rank"))
    if stars.isEmpty():
        discard(first, hubs, stars)
        return nodes, None
    # All that share a bucket: whoever meets no hub is both hubs of its own ones.
    some = stars.select(F.col("a").alias("node")).union(hubs.select("low")).distinct()
    sets = written(shingle_sets(docs_texts.join(side(some), "node", "left_semi"), k).dropDuplicates(["node"]))

    def tested(pairs: DataFrame) -> DataFrame:
        near = written(meet(pairs, nodes, may_link, percent).withColumn("cell", F.pmod(F.xxhash64("a"), F.lit(16))))
        found = written(meet(near, sets, link, percent))
        discard(near)
        return found

    labels = written(components(tested(stars.filter("rank = 1").select("a", "b", "cell"))))
    class_of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"class_{c}"))
    apart = ~F.coalesce(F.col("class_a"), F.col("a")).eqNullSafe(F.coalesce(F.col("class_b"), F.col("b")))
    rest = stars.filter("rank > 1").join(class_of("a"), "a", "left").join(class_of("b"), "b", "left").filter(apart)
    rest = written(rest.select("a", "b", "cell"))
    more = tested(rest)
    discard(hubs, stars, rest)
    if not more.isEmpty():
        labels, old = merged(labels, more), labels
        discard(old)
    left = remaining(first, labels, nodes, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    last = tested(written(left.withColumn("cell", F.lit(0).cast("long"))))
    if not last.isEmpty():
        labels = merged(labels, last)
    discard(sets, first)
    return nodes, labels


def near_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, tie, n_shingles, node, root, component) of every document; ``tie`` is the text's hash.

    Links: sets of distinct ``k``-word shingles (A-Z lowered) with 100 * intersection >= percent * union. A null
    or empty text has no shingles and links with nothing. ``component`` is the smallest doc_id reachable by
    links, itself included; ids can be null or repeated, so it doesn't name the class. ``root``, the class's least
    node, does. Texts and shingles are told apart by hashes of 63 and 64 bits.

    Equal texts are one node. Nodes that share one of their sketches' rarest keys are candidates; every linked pair is.
    Their bit sketches, then their exact sets, are held against each other before anything is connected.
    """
    texts, copies = first_texts(docs)
    made = written(sketches(texts, k, percent))
    nodes, labels = links(texts, made, k, percent)
    discard(copies)
    each = docs.select("doc_id", F.xxhash64("text").alias("tie")).withColumn("node", F.col("tie").bitwiseAND(F.lit(-2)))
    each = each.join(nodes.select("node", F.col("n").alias("n_shingles")), "node", "left").withColumn("n_shingles", F.coalesce("n_shingles", F.lit(0).cast("long")))
    if labels is None:
        labels = nodes.select("node", F.col("node").alias("component")).limit(0)
    each = each.join(labels, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    lowest = each.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    out = each.join(side(lowest), "root", "left")
    return out.select("doc_id", "tie", "n_shingles", "node", "root", F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component"))


def join_documents(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    return near_classes(docs, k, percent).select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each class of near copies: the smallest doc_id, then the least text hash.

    Documents without words are in no class and all stay. Of equal rows in a class one stays.
    """
    return plainly(docs, lambda d: _keep_one(d, k, percent))


def _keep_one(docs: DataFrame, k: int, percent: int) -> DataFrame:
    tagged = docs.withColumns({"_tie": F.xxhash64("text"), "_empty": ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")})
    found = near_classes(docs, k, percent).filter("n_shingles > 0")
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "tie")).alias("f")).select(F.col("f.doc_id").alias("k_id"), F.col("f.tie").alias("k_tie"))
    kept = written(kept)
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("_tie") == F.col("k_tie"))
    # Rows that share the kept one's id and text are repeats of it; one of each group stays, whatever else they hold.
    chosen = tagged.filter("not _empty").join(side(kept), same, "left_semi")
    if kept.count() != chosen.count():
        chosen = chosen.dropDuplicates(["doc_id", "_tie"])
    return chosen.union(tagged.filter("_empty")).drop("_tie", "_empty")
