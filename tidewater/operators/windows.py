"""Ranking, frames and running state as windows over a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewater.operators.scratch import numbered

#: Upper ends of the first two spend tiers, and the tiers' names (fixed values).
SILVER_AT, GOLD_AT = 500.0, 2000.0
TIERS = ("bronze", "prata", "ouro")


def qualify(df: DataFrame, condition: str, **named: Column) -> DataFrame:
    """SQL's QUALIFY: keeps rows by windows, given by name, that don't stay in the result."""
    return df.withColumns(named).filter(condition).drop(*named)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key. Spark keeps ``n`` rows a key and task before the exchange."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def moving_average(value: str, keys: list[str], order: list[str], n: int, full: bool = False) -> Column:
    """Mean of the last ``n`` rows; with ``full``, null until there are ``n``."""
    if n < 1:
        raise ValueError("the window must hold a row at least")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w)) if full else F.avg(value).over(w)


def tier(total: Column, silver: float = SILVER_AT, gold: float = GOLD_AT) -> Column:
    if silver > gold:
        raise ValueError("the silver limit must not be above the gold limit")
    return F.when(total < silver, TIERS[0]).when(total < gold, TIERS[1]).when(total.isNotNull(), TIERS[2])


def running_spend(df: DataFrame, customer: str, amount: str, order: list[str], silver: float = SILVER_AT, gold: float = GOLD_AT) -> DataFrame:
    """``df`` with ``cumulative_spend`` and ``customer_tier`` by customer in ``order``.

    A row without customer or amount gets nulls and doesn't add to the total; it goes round the window, so rows without
    customer, however many, don't meet in one task. One exchange by customer.
    """
    w = Window.partitionBy(customer).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col(customer).isNotNull() & F.col(amount).isNotNull()
    summed = df.filter(known).withColumn("cumulative_spend", F.sum(amount).over(w))
    rest = df.filter(~known).withColumn("cumulative_spend", F.lit(None).cast(summed.schema["cumulative_spend"].dataType))
    return summed.unionByName(rest).withColumn("customer_tier", tier(F.col("cumulative_spend"), silver, gold))


def place(df: DataFrame, keys: list[str], order: list[Column], into: str = "place") -> DataFrame:
    """``df`` with each row's number from 1 within its keys, for keys that are few and groups that are large.

    All rows are numbered in the order of keys, then ``order``; a group's first number is taken off. No task holds a group.
    """
    rows, _ = numbered(df, [*[F.col(k) for k in keys], *order], "_row")
    first = rows.groupBy(*keys).agg(F.min("_row").alias("_first")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(first, same).withColumn(into, F.col("_row") - F.col("_first") + 1).drop("_row", "_first", *[f"_k{i}" for i in range(len(keys))])


def max_running_balance(df: DataFrame, account: str, amount: str, order: list[str]) -> DataFrame:
    """The highest running balance of each account, 0 at least."""
    w = Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = df.withColumn("_b", F.sum(amount).over(w))
    kind = running.schema["_b"].dataType
    return running.groupBy(account).agg(F.greatest(F.max("_b"), F.lit(0).cast(kind)).alias("max_balance"))
