"""Streaming forms (extensions): windows over event time, and running spend kept per customer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidewater.operators.windows import GOLD_AT, SILVER_AT, TIERS


def events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream; its time column becomes a zoned timestamp, which watermarks ask for."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Count and value by window and type; rows later than ``late`` are dropped and closed windows leave the state."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


class RunningSpend(StatefulProcessor):
    """The cumulative spend and tier of each row, the total kept in the state store between batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", StructType([StructField("total", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        total = self.total.get()[0] if self.total.exists() else 0.0
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        spend = total + frame["value"].cumsum()
        tiers = pd.cut(spend, [-float("inf"), SILVER_AT, GOLD_AT, float("inf")], right=False, labels=list(TIERS)).astype(str)
        self.total.update((float(spend.iloc[-1]),))
        yield pd.DataFrame({"user_id": key[0], "event_id": frame["event_id"], "cumulative_spend": spend, "customer_tier": tiers})

    def close(self) -> None:
        pass


def running_spend(stream: DataFrame) -> DataFrame:
    """(user_id, event_id, cumulative_spend, customer_tier); needs the RocksDB state store."""
    out = StructType([StructField("user_id", LongType()), StructField("event_id", LongType()), StructField("cumulative_spend", DoubleType()), StructField("customer_tier", StringType())])
    return stream.groupBy("user_id").transformWithStateInPandas(RunningSpend(), outputStructType=out, outputMode="append", timeMode="none")


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all input that is there, batch after batch, kept in ``path``; in complete mode the last state."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
