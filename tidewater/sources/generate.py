"""Deterministic tables of any size: a small star schema and a ledger, made from row numbers by hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATES, KINDS = ("open", "paid", "sent"), ("book", "lamp", "rope", "seed")


def pick(seed: int, label: str, n: int, row: str = "id") -> Column:
    """A number from 0 to n - 1 that depends on the row's number, the seed and the label alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(label), row), F.lit(n).cast("long"))


def star(spark: SparkSession, orders: int, seed: int = 42) -> dict[str, DataFrame]:
    """``customers``, ``products``, ``sales`` (facts) of ``orders`` rows; every reference has its row, amounts are decimals."""
    people, goods = max(1, orders // 10), max(1, orders // 100)
    customers = spark.range(people).select(F.col("id").alias("customer"), F.concat(F.lit("customer "), "id").alias("name"))
    products = spark.range(goods).select(
        F.col("id").alias("product"), F.element_at(F.array(*map(F.lit, KINDS)), (pick(seed, "kind", len(KINDS)) + 1).cast("int")).alias("kind"),
        ((pick(seed, "price", 99_000) + 1_000).cast("decimal(14,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(12,2)").alias("price"),
    )
    sales = spark.range(orders).select(
        F.col("id").alias("sale"), pick(seed, "customer", people).alias("customer"), pick(seed, "product", goods).alias("product"),
        (pick(seed, "quantity", 9) + 1).cast("int").alias("quantity"), F.date_add(F.lit("2024-01-01").cast("date"), pick(seed, "day", 366).cast("int")).alias("day"),
        F.element_at(F.array(*map(F.lit, STATES)), (pick(seed, "state", len(STATES)) + 1).cast("int")).alias("state"),
    )
    return {"customers": customers, "products": products, "sales": sales}


def ledger(spark: SparkSession, accounts: int, entries: int, seed: int = 42) -> DataFrame:
    """(account, entry, cents, amount): whole cents become decimal(12,2) without passing through floats."""
    rows = spark.range(accounts * entries).select(F.expr(f"id div {entries}").alias("account"), (F.col("id") % entries).alias("entry"), ((F.col("id") * 7919 + seed * 104729) % 200_001 - 100_000).alias("cents"))
    return rows.withColumn("amount", (F.col("cents").cast("decimal(14,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(12,2)"))
