"""Shared plumbing: the cluster's shared folder, written intermediates, global row numbers, prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: What separates words: the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: While an intermediate is written: its shuffle files go with it, and batches for Python workers have so many rows at most.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors both see.

    It lies under ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder that goes
    at exit; a cluster must set it, since a machine-local folder would be invisible to executors.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"/tmp/checkpoints/tidewater-{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Seconds between two collections of the driver's garbage, at least, and as a multiple of what one takes.
RELIEVED = {"seconds": 5.0, "times": 20.0}
_relieved = [0.0]


def relieve(spark: SparkSession) -> None:
    """Lets the driver's JVM collect its garbage and give the heap that it doesn't need back to the system.

    An operator of many small queries leaves their plans, tasks and broadcasts behind, and the JVM rather takes all the heap that it may
    than to collect them. It doesn't while the last collection is recent, so a large heap isn't collected all the time.
    """
    if time.monotonic() >= _relieved[0]:
        began = time.monotonic()
        spark._jvm.System.gc()
        took = time.monotonic() - began
        _relieved[0] = began + took + max(RELIEVED["seconds"], RELIEVED["times"] * took)


def written(df: DataFrame) -> DataFrame:
    """``df``, written once as Parquet in the shared folder and read back: lineage ends here.

    The shuffle files that made it aren't needed any more and go at once rather than when the driver collects garbage.
    What else it left in the driver goes from time to time (see ``relieve``).
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    relieve(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of ``written`` frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy() -> None:
    """Gives memory that is free in this process back to the system: a worker that waits for its next task, or the driver, holds none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What operators keep in a Python worker from task to task, by operator: how to let it go; and how long an idle worker keeps it.
KEPT: dict[str, Callable[[], None]] = {}
IDLE_SECONDS = 1.0
_waiting: list[threading.Timer] = []


def release(keeps: str = "") -> None:
    for operator in [k for k in list(KEPT) if k != keeps]:
        KEPT.pop(operator, lambda: None)()
    gc.collect()
    tidy()


def tidied(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """``run``, a task's function of batches, that leaves little memory in its worker.

    Workers serve any operator's tasks: what others than ``keeps`` have kept in this one goes first, and all that is kept, with
    what the last task held to its end, when the worker has had nothing to do for a while.
    """

    def tidy_run(batches: Iterator) -> Iterator:
        while _waiting:
            _waiting.pop().cancel()
        if set(KEPT) - {keeps}:
            release(keeps)
        try:
            yield from run(batches)
        finally:
            tidy()
            # The last batches are let go only after this; a worker that stays idle gives them back too.
            later = threading.Timer(IDLE_SECONDS, release)
            later.daemon = True
            _waiting.append(later)
            later.start()

    return tidy_run


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever its columns are called."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[str], row: str = "row") -> tuple[DataFrame, int]:
    """``df`` written in ascending ``order`` with gapless global row numbers from 0, and its row count.

    One range exchange sorts the rows; row numbers are the partition's offset plus the place in the
    partition, so no window runs over all rows. Repeated rows are told apart by their place in the input,
    which also lets the range exchange split a large group of them. Only one offset per shuffle partition
    is broadcast.
    """
    spark = df.sparkSession
    part, place, tie, shift = (fresh(df, c) for c in ("_part", "_place", "_tie", "_shift"))
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order, tie)
    kept = written(
        ranged.sortWithinPartitions(*order, tie).drop(tie).withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()})
    )
    ends = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy(part).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    offsets = sizes.select(part, (F.coalesce(F.sum("_n").over(ends), F.lit(0)) - F.col("_first")).alias(shift))
    total = kept.count()
    return kept.join(F.broadcast(offsets), part).withColumn(row, F.col(place) + F.col(shift)).drop(part, place, shift), total


def running(values: str) -> str:
    """SQL for the inclusive prefix sums of an array expression, by doubling: n log n steps, no growing lists."""
    return (
        f"aggregate(sequence(0, cast(ceil(log2(greatest(size({values}), 1))) as int)), {values}, "
        "(a, k) -> transform(a, (x, i) -> x + if(i >= shiftleft(1, k), a[greatest(i - shiftleft(1, k), 0)], 0)))"
    )


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def plainly(docs: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``f`` of ``docs`` with columns that ``f`` doesn't know under names that can't clash; they get theirs back after."""
    known = {"doc_id", "text", "lang", "source", "n_chars"}
    names = {c: c if c in known else f"extra_{i}" for i, c in enumerate(docs.columns)}
    out = f(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
