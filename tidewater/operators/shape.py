"""Selection, cleaning and conditional building of filters."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window


def rows_between(df: DataFrame, order: list[Column], start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop`` (end exclusive) in ``order``: a top-k of ``stop`` rows, then an offset."""
    return df.orderBy(*order).limit(stop).offset(start)


def numeric_columns(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])


def filter_by(df: DataFrame, **wanted: Any) -> DataFrame:
    """Rows whose columns equal the given values; None leaves a column out. Values are literals, never SQL text."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return df


#: Distinct values that are put in order on the driver at most, and the precision of the brackets before.
FEW, PRECISION = 100_000, 10_000


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The exact ``q`` quantile of the column's values, interpolated between the two nearest; null if there are none.

    Approximate quantiles bracket it, and counts say what lies below; the bracket narrows, some thousand times a
    pass, until few values are left. Only counts and those few reach the driver.
    """
    x = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    n = x.count()
    if not n:
        return None
    rank, below, low, high, left = (n - 1) * q, 0, None, None, n
    while left > FEW:
        at = [(math.floor(rank) - below) / left - 2 / PRECISION, (math.ceil(rank) - below + 1) / left + 2 / PRECISION]
        a, b = x.agg(F.percentile_approx("v", [min(max(f, 0.0), 1.0) for f in at], PRECISION)).first()[0]
        if (a, b) == (low, high):
            break
        low, high = a, b
        more, left = x.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        below, x = below + more, x.filter(F.col("v").between(low, high))
    values = [(r["v"], r["n"]) for r in x.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()]

    def at_rank(k: int) -> float:
        k -= below
        for v, count in values:
            if k < count:
                return v
            k -= count
        return values[-1][0]

    low, high = at_rank(math.floor(rank)), at_rank(math.ceil(rank))
    return low + (high - low) * (rank - math.floor(rank))


def fill_median(df: DataFrame, column: str) -> DataFrame:
    """Nulls of ``column`` become its exact median, found in bounded memory."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(exact_quantile(df, column, 0.5)).cast(df.schema[column].dataType)))


def not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """SQL's NOT IN over the one column of ``values``: no rows if it holds a null, all rows if it is empty.

    Two counts of the list, in one row, decide the null cases; the rest is an anti join on the key.
    """
    name = values.columns[0]
    facts = values.agg(F.count("*").alias("_n"), F.count_if(F.col(name).isNull()).alias("_nulls"))
    kept = df.crossJoin(F.broadcast(facts)).filter((F.col("_n") == 0) | (F.col("_nulls") == 0) & F.col(column).isNotNull()).drop("_n", "_nulls")
    some = values.select(F.col(name).alias("_v")).filter("_v is not null").distinct()
    return kept.join(some, F.col(column) == F.col("_v"), "left_anti")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row in ``order`` of each ``keys``; ``order`` must end in a unique key to be deterministic."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def clean_orders(df: DataFrame) -> DataFrame:
    """Drops rows without a key, fills missing totals with 0 and writes priorities in one form."""
    return df.na.drop(subset=["o_orderkey", "o_custkey"]).na.fill({"o_totalprice": 0.0}).withColumn("o_orderpriority", F.replace(F.upper("o_orderpriority"), F.lit("_"), F.lit("-")))
