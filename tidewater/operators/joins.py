"""Joins that Spark has no operator for, or that need a check first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


class CardinalityError(ValueError):
    """A join's keys aren't as unique as the caller said."""


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], inner: bool = True) -> DataFrame:
    """Each left row with ``values`` of the latest right row of its keys at or before its time.

    Both sides are tagged and united, and one window per key carries the last right row on: one exchange, no
    inequality join. Of right rows at the same time the greatest values count. Left rows without a match go
    unless ``inner`` is false. Null keys or times never match.
    """
    cols = left.columns
    payload = F.struct(*[F.col(v) for v in values])
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_value"))
    b = right.filter(" and ".join(f"`{c}` is not null" for c in [*keys, right_time])).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), payload.alias("_value"))
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_t", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1")
    matched = F.col("_last").isNotNull() & F.col("_t").isNotNull()
    for i in range(len(keys)):
        matched &= F.col(f"_k{i}").isNotNull()
    if inner:
        out = out.filter(matched)
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in cols], *[F.when(matched, F.col(f"_last.{v}")).alias(v) for v in values])


def checked_join(left: DataFrame, right: DataFrame, on: list[str], validate: str = "many_to_one", how: str = "inner") -> DataFrame:
    """A join whose stated cardinality is checked first: one_to_one, one_to_many or many_to_one."""
    for side, name in ((left, "one_"), (right, "_one")):
        if (validate.startswith(name) if name == "one_" else validate.endswith(name)) and not side.groupBy(*on).count().filter("count > 1").isEmpty():
            raise CardinalityError(f"{on} isn't unique on the {'left' if name == 'one_' else 'right'} side of a {validate} join")
    return left.join(right, on, how)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is: Spark then shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def skewed_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16) -> DataFrame:
    """An inner join that cuts every key of the left side into ``salts`` parts; the right side is repeated for each."""
    a = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "_salt"]).drop("_salt")


def weighted_bridge(area: DataFrame, operation: DataFrame, bridge: DataFrame, contract: DataFrame, flow: DataFrame, after: str) -> DataFrame:
    """Flows after a date, of contracts with an open balance, shared out over areas by the bridge's factors."""
    flows = flow.filter(F.col("flow_date") > F.lit(after).cast("date"))
    open_ = contract.filter("balance > 0")
    joined = flows.join(open_, "contract_id").join(bridge, "contract_id").join(operation, "operation_id").join(area, "area_id")
    return joined.groupBy("area_name").agg(F.sum((F.col("amount") * F.col("factor")).cast("decimal(38,6)")).cast("decimal(38,4)").alias("total"))
