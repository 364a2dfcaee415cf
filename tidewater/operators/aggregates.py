"""Aggregates beyond one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def summarize(df: DataFrame) -> DataFrame:
    """One row a column: type, least and greatest value as text, approximate distinct count, percent null, count.

    One aggregate over the data, then its single row is turned into rows.
    """
    simple = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    parts = [F.count("*").alias("_n")]
    for i, f in enumerate(simple):
        parts += [F.min(f.name).cast("string").alias(f"l{i}"), F.max(f.name).cast("string").alias(f"g{i}"), F.approx_count_distinct(f.name).alias(f"d{i}"), F.count(f.name).alias(f"c{i}")]
    one = df.agg(*parts)
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"), F.col(f"l{i}").alias("min"), F.col(f"g{i}").alias("max"), F.col(f"d{i}").alias("approx_unique"), F.round(F.try_divide((F.col("_n") - F.col(f"c{i}")) * F.lit(100.0), F.col("_n")), 2).alias("null_percentage"), F.col("_n").alias("count")) for i, f in enumerate(simple)]
    return one.select(F.inline(F.array(*rows)))


def bucket(value: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the right-closed interval that ``value`` lies in; null outside all of them."""
    out = F.lit(None).cast("string")
    for low, high, label in list(zip(edges, edges[1:], labels))[::-1]:
        out = F.when((value > low) & (value <= high), F.lit(label)).otherwise(out)
    return out


def share_of(value: str, keys: list[str]) -> Column:
    from pyspark.sql import Window

    return F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*keys)))
