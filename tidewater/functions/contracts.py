"""Loan contracts: interest over a Price-table schedule, tranches, margins, compound interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The share of the balance that stays for the next tranche (fixed value).
CARRY = 0.7


def required(c: Column, name: str, kind: str) -> Column:
    return F.when(c.isNull(), F.raise_error(F.lit(f"{name} must not be null")).cast(kind)).otherwise(c)


def revenue(principal: Column, rate: Column, months: Column) -> Column:
    """Interest of a loan repaid in equal instalments: n * instalment - principal; 0 without rate or term, null is an error."""
    p, r, n = required(principal.cast("double"), "principal", "double"), required(rate.cast("double"), "rate", "double"), required(months.cast("int"), "months", "int")
    instalment = p * r / (1 - F.pow(1 + r, -n.cast("double")))
    return F.when((r <= 0) | (n <= 0), F.lit(0.0)).otherwise(n * instalment - p)


def revenue_by_month(principal: Column, rate: Column, months: Column) -> Column:
    """The same month by month: each month's interest on what is still owed."""
    p, r, n = required(principal.cast("double"), "principal", "double"), required(rate.cast("double"), "rate", "double"), required(months.cast("int"), "months", "int")
    instalment = p * r / (1 - F.pow(1 + r, -n.cast("double")))
    start = F.struct(p.alias("owed"), F.lit(0.0).alias("sum"))
    month = lambda a, _: F.struct((a["owed"] - (instalment - a["owed"] * r)).alias("owed"), (a["sum"] + a["owed"] * r).alias("sum"))
    return F.when((r <= 0) | (n <= 0), F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, month, lambda a: a["sum"]))


def tranche_revenue(principal: Column, rates: Column, terms: Column) -> Column:
    """Interest summed over tranches: balance * ((1 + rate)**term - 1), the balance shrinking to ``CARRY`` of itself.

    Lists are paired up to the shorter one; empty lists give 0, null ones null.
    """
    n = F.least(F.size(rates), F.size(terms))
    pairs = F.slice(F.arrays_zip(rates.alias("r"), terms.alias("t")), F.lit(1), n)
    step = lambda a, x: F.struct((a["balance"] * CARRY).alias("balance"), (a["sum"] + a["balance"] * (F.pow(1 + x["r"], x["t"].cast("double")) - 1)).alias("sum"))
    return F.aggregate(pairs, F.struct(principal.cast("double").alias("balance"), F.lit(0.0).alias("sum")), step, lambda a: a["sum"])


def compound(principal: Column, rate: Column, periods: Column) -> Column:
    return principal * F.pow(1 + rate, periods)


def line_total(df: DataFrame, quantity: str = "quantity", price: str = "unit_price") -> DataFrame:
    """``df`` with ``line_total``; a null factor gives null, a missing column is an error."""
    return df.withColumn("line_total", F.col(quantity).cast("double") * F.col(price).cast("double"))


def product_margin(df: DataFrame, discount, price: str = "unit_price", cost: str = "unit_cost", sku: str = "sku") -> DataFrame:
    """``df`` with net price, margin, margin share and the SKU in hexadecimal, in exact decimals rounded half to even.

    ``discount`` must be a Decimal in [0, 1), the cost a decimal of scale 2. A net price of 0 has a null share.
    """
    from decimal import Decimal

    if not isinstance(discount, Decimal):
        raise TypeError("discount must be a Decimal")
    if not 0 <= discount < 1:
        raise ValueError("discount must be in [0, 1)")
    kind = df.schema[cost].dataType
    if not isinstance(kind, T.DecimalType) or kind.scale != 2:
        raise ValueError(f"{cost} must be a decimal of scale 2")
    exact = F.bround(F.col(price).cast("decimal(18,6)"), 2).cast("decimal(12,2)")
    net = F.bround(exact * F.lit(1 - discount).cast("decimal(18,6)"), 2).cast("decimal(12,2)")
    out = df.withColumn("net_price", net).withColumn("margin", (F.col("net_price") - F.col(cost)).cast("decimal(12,2)"))
    share = F.try_divide(F.col("margin").cast("double"), F.col("net_price").cast("double"))
    return out.withColumns({"margin_pct": share, "sku_hex": F.lower(F.hex(sku))})


def sum_decimal(df: DataFrame, column: str) -> DataFrame:
    """The exact sum of a decimal column, 0 without values; another type is an error."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.DecimalType):
        raise TypeError(f"{column} isn't a decimal")
    return df.agg(F.coalesce(F.sum(column).cast(f"decimal(38,{kind.scale})"), F.lit(0).cast(f"decimal(38,{kind.scale})")).alias(column))
