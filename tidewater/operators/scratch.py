"""Intermediate tables in the shared folder, and global row numbers without a window over all rows."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local master gets a folder that goes at exit; a cluster must set it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"/tmp/checkpoints/tidewater-{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: what follows reads the same rows in the same partitions, whatever is lost."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, row: str = "row") -> tuple[DataFrame, int]:
    """``df`` with gapless numbers from 0 in ``order``, and the row count.

    One range exchange; a row's number is its partition's offset plus its place there. Only one offset a partition is
    broadcast.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first")).orderBy("_part").collect()
    upto, shifts = 0, []
    for r in sizes:
        shifts.append((r["_part"], upto - r["_first"]))
        upto += r["_n"]
    offsets = df.sparkSession.createDataFrame(shifts, "_part int, _shift long")
    return kept.join(F.broadcast(offsets), "_part").withColumn(row, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift"), upto
