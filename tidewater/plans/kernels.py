"""Queries: contracts, margins, nested types, JSON, macros and user functions."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from tidewater.functions import contracts, documents
from tidewater.plans.registry import query

LOANS = "select o_orderkey, o_totalprice as principal, (o_orderkey % 5) / 200.0::double as rate, cast(o_orderkey % 37 * 10 as integer) as months from orders"
INSTALMENT = "principal * rate / (1 - power(1 + rate, -months))"


def loans(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.col("o_totalprice").alias("principal"), ((k % 5) / 200.0).alias("rate"), (k % 37 * 10).cast("int").alias("months"))


@query("select l_orderkey, l_linenumber, l_quantity * l_extendedprice as line_total from lineitem")
def line_total(t):
    return contracts.line_total(t.lineitem, "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", "line_total")


@query(f"select o_orderkey, round(case when rate <= 0 or months <= 0 then 0 else months * ({INSTALMENT}) - principal end, 2) as revenue from ({LOANS})")
def contract_revenue(t):
    return loans(t).select("o_orderkey", F.round(contracts.revenue(F.col("principal"), F.col("rate"), F.col("months")), 2).alias("revenue"))


@query(f"select o_orderkey, round(case when rate <= 0 or months <= 0 then 0 else months * ({INSTALMENT}) - principal end, 1) as revenue from ({LOANS})")
def contract_revenue_by_month(t):
    return loans(t).select("o_orderkey", F.round(contracts.revenue_by_month(F.col("principal"), F.col("rate"), F.col("months")), 1).alias("revenue"))


@query("""select o_orderkey, round(case when o_orderkey % 4 = 0 then 0 else o_totalprice * (power(1.01, o_orderkey % 12) - 1) + case when o_orderkey % 2 = 1 then o_totalprice * 0.7 * (power(1.02, 24) - 1) else 0 end end, 2) as revenue from orders""")
def nested_params_revenue(t):
    k = F.col("o_orderkey")
    rates = F.when(k % 4 == 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.01), F.lit(0.02), F.lit(0.03)))
    terms = F.when(k % 2 == 1, F.array((k % 12).cast("int"), F.lit(24))).otherwise(F.array((k % 12).cast("int")))
    return t.orders.select("o_orderkey", F.round(contracts.tranche_revenue(F.col("o_totalprice"), rates, terms), 2).alias("revenue"))


@query("select p_partkey, round(p_retailprice * power(1.01, p_size), 3) as value from part")
def compound_interest(t):
    return t.part.select("p_partkey", F.round(contracts.compound(F.col("p_retailprice"), F.lit(0.01), F.col("p_size")), 3).alias("value"))


@query("""select p_partkey, net as net_price, cast(net - cost as decimal(12,2)) as margin, round(cast(net - cost as double) / cast(net as double), 6) as margin_pct, sku_hex from (
select p_partkey, cast(round_even(cast(p_retailprice as decimal(12,2)) * 0.90, 2) as decimal(12,2)) as net, cast(p_size as decimal(12,2)) as cost, lower(hex(encode(p_brand))) as sku_hex from part)""")
def decimal_margin(t):
    parts = t.part.select("p_partkey", F.col("p_retailprice").alias("unit_price"), F.col("p_size").cast("decimal(12,2)").alias("unit_cost"), F.encode("p_brand", "UTF-8").alias("sku"))
    return contracts.product_margin(parts, Decimal("0.10")).select("p_partkey", "net_price", "margin", F.round("margin_pct", 6).alias("margin_pct"), "sku_hex")


@query("select cast(sum(cast(l_tax as decimal(12,2))) as decimal(38,2)) as tax from lineitem")
def sum_decimal_column(t):
    return contracts.sum_decimal(t.lineitem.select(F.col("l_tax").cast("decimal(12,2)").alias("tax")), "tax")


@query("select c_custkey as customer_id, 'city' || c_nationkey as city, case when c_custkey % 3 = 0 then 0 else 2 end as num_tags, case when c_custkey % 2 = 0 then 'email' end as canal, date '2025-01-01' - cast(c_nationkey as integer) as signup_day, c_nationkey as days_since_signup, c_acctbal > 0 as is_active from customer")
def flatten_profile(t):
    k = F.col("c_custkey")
    made = t.customer.select(
        k.alias("customer_id"), F.struct(F.concat(F.lit("city"), "c_nationkey").alias("city"), F.lit("x").alias("street")).alias("address"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("tags"),
        F.when(k % 2 == 0, F.create_map(F.lit("canal"), F.lit("email"))).otherwise(F.create_map(F.lit("idioma"), F.lit("pt"))).alias("preferences"),
        F.date_sub(F.lit("2025-01-01").cast("date"), F.col("c_nationkey")).cast("timestamp_ntz").alias("signup_ts"), (F.col("c_acctbal") > 0).alias("is_active"),
    )
    return documents.flatten_profile(made, "2025-01-01")


JSON = """select event_id, case event_id % 4 when 0 then '{"canal":"app","valor":1.1' || (event_id % 10) || ',"tags":["a","b"],"cliente":{"id":' || user_id || '}}' when 1 then '{"valor":null,"canal":null}' when 2 then '{"canal":"web"}' end as doc from events"""


def events_json(t):
    return documents.as_json(_docs(t), "doc")


def _docs(t):
    k = F.col("event_id")
    full = F.concat(F.lit('{"canal":"app","valor":1.1'), k % 10, F.lit(',"tags":["a","b"],"cliente":{"id":'), "user_id", F.lit("}}"))
    doc = F.when(k % 4 == 0, full).when(k % 4 == 1, F.lit('{"valor":null,"canal":null}')).when(k % 4 == 2, F.lit('{"canal":"web"}'))
    return t.events.select("event_id", doc.alias("doc"))


@query(f"""select event_id, doc ->> '$.canal' as canal, cast(cast(doc ->> '$.valor' as decimal(12,2)) as decimal(12,2)) as valor_exato, cast(doc ->> '$.valor' as double) as valor_float,
case event_id % 4 when 0 then 'presente' when 1 then 'nulo' else 'ausente' end as valor_estado, case when event_id % 4 = 0 then 2 end as num_tags, cast(doc ->> '$.cliente.id' as bigint) as cliente_id from ({JSON})""")
def json_shred(t):
    return documents.shred(events_json(t), "doc")


@query("""select event_id, case event_id % 4 when 0 then '{"canal":"app","cliente":{"id":' || user_id || '},"tags":["a","b"],"valor":' || case when event_id % 10 = 0 then '1.1' else '1.1' || (event_id % 10) end || '}' when 1 then '{"canal":null,"valor":null}' when 2 then '{"canal":"web"}' end as doc from events""")
def json_normalize(t):
    return documents.normalize(events_json(t), "doc").select("event_id", "doc")


DISCOUNT = "case when l_quantity >= 40 then 0.10 when l_quantity >= 20 then 0.05 else 0.0 end"
DISCOUNT_SQL = f"select l_returnflag, round(sum(l_extendedprice * (1 - {DISCOUNT}::double)), 2) as total from lineitem group by 1"


def discounted(t, rate):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - rate)), 2).alias("total"))


@query(DISCOUNT_SQL)
def macro_scalar(t):
    t.spark.sql("create or replace temporary function volume_discount(l_quantity double) returns double return case when l_quantity >= 40 then 0.10 when l_quantity >= 20 then 0.05 else 0.0 end")
    return discounted(t, F.call_function("volume_discount", F.col("l_quantity")))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'P' and o_totalprice > 100000")
def macro_table(t):
    t.orders.createOrReplaceTempView("macro_orders")
    t.spark.sql("create or replace temporary function big_orders(least double) returns table (o_orderkey bigint, o_totalprice double) return select o_orderkey, o_totalprice from macro_orders where o_orderstatus = 'P' and o_totalprice > least")
    return t.spark.sql("select * from big_orders(100000)")


@query(DISCOUNT_SQL)
def udf_discount_native(t):
    q = F.col("l_quantity")
    return discounted(t, F.when(q >= 40, 0.10).when(q >= 20, 0.05).otherwise(0.0))


@query(DISCOUNT_SQL)
def udf_discount_python(t):
    @F.udf("double")
    def rate(q):
        return None if q is None else 0.10 if q >= 40 else 0.05 if q >= 20 else 0.0

    return discounted(t, rate("l_quantity"))


@query(DISCOUNT_SQL)
def udf_discount_vectorized(t):
    @F.pandas_udf("double")
    def rate(q: pd.Series) -> pd.Series:
        return (q >= 20) * 0.05 + (q >= 40) * 0.05

    return discounted(t, rate("l_quantity"))


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1")
def group_apply(t):
    def largest(g: pd.DataFrame) -> pd.DataFrame:
        return g.sort_values(["o_totalprice", "o_orderkey"], ascending=[False, True]).head(1)

    return t.orders.select("o_custkey", "o_orderkey", "o_totalprice").groupBy("o_custkey").applyInPandas(largest, "o_custkey long, o_orderkey long, o_totalprice double")


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice > 150000.5 and o_orderdate >= date '1996-01-01'")
def parameterized_filter(t):
    t.orders.createOrReplaceTempView("param_orders")
    return t.spark.sql("select o_orderkey from param_orders where o_orderstatus = :status and o_totalprice > :least and o_orderdate >= :day", {"status": "F", "least": 150000.5, "day": date(1996, 1, 1)})


@query("select count(*) as n from orders where o_orderstatus = 'x'' or 1=1 --'")
def parameterized_injection(t):
    t.orders.createOrReplaceTempView("param_orders")
    return t.spark.sql("select count(*) as n from param_orders where o_orderstatus = ?", ["x' or 1=1 --"])


@query("select user_id, count(*) as n, round(sum(2 * value), 2) as doubled from events group by 1")
def batches_map_in_arrow(t):
    import pyarrow as pa
    import pyarrow.compute as pc

    def double(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(1), 2.0)], names=["user_id", "value"])

    return t.events.select("user_id", "value").mapInArrow(double, "user_id long, value double").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("doubled"))
