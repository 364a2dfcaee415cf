"""Writers: idempotent partition loads, layouts that let readers skip, whole databases, Arrow IPC."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite_partitions(df: DataFrame, path: str, by: list[str], max_records: int = 0) -> None:
    """Replaces the partitions that ``df`` has rows of, whole, and leaves the others: a repeated load changes nothing.

    Rows of one partition go to a few writers by a rebalance, which also splits a partition that is much larger.
    """
    out = df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    (out.option("maxRecordsPerFile", max_records) if max_records else out).parquet(path)


def write_sorted(df: DataFrame, path: str, by: list[str], files: int, group_rows: int = 122_880, bloom: dict[str, int] | None = None) -> None:
    """Files that cover successive ranges of ``by``, sorted, in row groups of ``group_rows``: their statistics are selective.

    ``bloom`` gives columns a Bloom filter for so many distinct values.
    """
    out = df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite").option("parquet.block.row.count.limit", group_rows)
    for column, ndv in (bloom or {}).items():
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", ndv)
    out.parquet(path)


def reorganize(df: DataFrame, path: str, value: str, key: str, bands: int, group_rows: int = 50_000, files: int = 8) -> DataFrame:
    """Writes ``df`` in ``bands`` equal ranges of ``value``, a folder each, ordered by (value, key); returns what was written.

    Where all values are equal there is one band.
    """
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bands
    band = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bands - 1))).otherwise(0).cast("int")
    put = df.crossJoin(F.broadcast(ends)).withColumn("band", band).drop("_lo", "_hi")
    ordered = put.repartitionByRange(files, "band", value, key).sortWithinPartitions("band", value, key)
    ordered.write.mode("overwrite").partitionBy("band").option("parquet.block.row.count.limit", group_rows).parquet(path)
    return df.sparkSession.read.parquet(path)


def disorder(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """The share of successive rows in ``order`` whose value falls; ``order`` names a file or band first, and each is looked at apart."""
    from pyspark.sql import Window

    w = Window.partitionBy(order[0]).orderBy(*order[1:])
    return df.select((F.col(value) < F.lag(value).over(w)).cast("double").alias("d")).agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("disorder"))


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_database(spark: SparkSession, names: list[str], views: dict[str, str], path: str) -> None:
    """Every table in ``names`` as Parquet, and the text of ``views``, which hold no rows of their own."""
    for n in names:
        spark.table(n).write.mode("overwrite").parquet(f"{path}/{n}")
    text = spark.createDataFrame([(json.dumps({"tables": names, "views": views}),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/_catalog")


def import_database(spark: SparkSession, path: str) -> list[str]:
    """Temporary views of an exported database: tables read their files, views run their text, in the order given."""
    catalog = json.loads(spark.read.text(f"{path}/_catalog").first()[0])
    for n in catalog["tables"]:
        spark.read.parquet(f"{path}/{n}").createOrReplaceTempView(n)
    for n, sql in catalog["views"].items():
        spark.sql(sql).createOrReplaceTempView(n)
    return [*catalog["tables"], *catalog["views"]]


def live_view(spark: SparkSession, name: str, path: str) -> None:
    """A view that lists ``path`` anew for each query, so it sees files that come later."""
    spark.sql(f"create or replace temporary view {name} as select * from parquet.`{path}`")


def ipc_bytes(df: DataFrame, stream: bool = False) -> DataFrame:
    """(content): each Arrow batch of ``df`` as an IPC file (or stream), for a binary column or for files."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sink = pa.BufferOutputStream()
            with (pa.ipc.new_stream if stream else pa.ipc.new_file)(sink, batch.schema) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["content"])

    return df.mapInArrow(run, "content binary")


class CountedWriter:
    """Writes frames under one folder as they come and tells at the end where, and how many rows.

    Rows are counted by the write itself (an observed metric). A folder that can't be made is an error at once; ending twice
    or writing after the end is one too.
    """

    def __init__(self, spark: SparkSession, path: str, max_records: int = 0):
        self.spark, self.path, self.max_records, self.rows, self.ended = spark, path.rstrip("/"), max_records, 0, False
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at):
            raise OSError(f"can't make {self.path}")

    def add(self, df: DataFrame) -> None:
        from pyspark.sql import Observation

        if self.ended:
            raise RuntimeError("the writer has ended")
        seen = Observation()
        out = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append")
        (out.option("maxRecordsPerFile", self.max_records) if self.max_records else out).parquet(self.path)
        self.rows += seen.get["rows"]

    def finish(self) -> tuple[str, int]:
        if self.ended:
            raise RuntimeError("the writer has ended")
        self.ended = True
        return self.path, self.rows
