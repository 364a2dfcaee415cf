"""Queries: scans, projections, predicates and row shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import shape
from tidewater.operators.scratch import numbered
from tidewater.plans.registry import query


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def select_columns(t):
    return t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 20 offset 10")
def select_by_position(t):
    return shape.rows_between(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], 10, 30)


@query("select p_partkey, p_size, p_retailprice from part")
def select_by_dtype(t):
    return shape.numeric_columns(t.part)


@query("select * exclude (c_name, c_acctbal) from customer")
def select_exclude(t):
    return t.spark.sql("select * except (c_name, c_acctbal) from {c}", c=t.customer)


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net, cast(l_quantity as bigint) as quantity from lineitem")
def add_column(t):
    return t.lineitem.withColumns({"net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), "quantity": F.col("l_quantity").cast("long")}).select("l_orderkey", "l_linenumber", "net", "quantity")


@query("select p_partkey, upper(p_brand) as p_brand from part")
def set_column(t):
    return t.part.withColumn("p_brand", F.upper("p_brand")).select("p_partkey", "p_brand")


@query("select n_nationkey as nation_id, n_name as nation, n_regionkey from nation")
def rename_columns(t):
    return t.nation.withColumnsRenamed({"n_nationkey": "nation_id", "n_name": "nation"})


@query("select o_orderkey, cast(o_orderkey as varchar) as key_text, cast(o_totalprice as decimal(18,2)) as total, cast(o_orderdate as date) as day from orders")
def cast_column(t):
    return t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("key_text"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.col("o_orderdate").cast("date").alias("day"))


@query("select event_id, try_cast(substr(event_type, 1, 1) || event_id as bigint) as bad, try_cast(cast(event_id as varchar) as bigint) as good from events")
def try_cast_column(t):
    return t.events.select("event_id", F.expr("try_cast(concat(substr(event_type, 1, 1), event_id) as bigint)").alias("bad"), F.expr("try_cast(cast(event_id as string) as bigint)").alias("good"))


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 200000 and o_orderstatus = 'F'")
def filter_bool(t):
    return t.orders.filter((F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@query("select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def filter_isin(t):
    return shape.filter_by(t.customer, c_mktsegment=["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment")


@query("select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey where c.c_custkey between 100 and 120")
def filter_between(t):
    return t.orders.join(t.customer.filter(F.col("c_custkey").between(100, 120)), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("select p_partkey, p_name from part where p_type ilike '%brass%' or p_name ilike '%1'")
def filter_ilike(t):
    return t.part.filter(F.col("p_type").ilike("%brass%") | F.col("p_name").ilike("%1")).select("p_partkey", "p_name")


@query("select c_custkey from customer where c_name like (select substr(min(c_name), 1, 16) from customer) || '%'")
def filter_like_prefix(t):
    return t.spark.sql("select c_custkey from {c} where c_name like concat((select substr(min(c_name), 1, 16) from {c}), '%')", c=t.customer)


@query("select o_orderkey from orders where o_orderkey % 97 = 0")
def filter_modulo(t):
    return t.orders.filter(F.col("o_orderkey") % 97 == 0).select("o_orderkey")


@query("select event_id, user_id from events where event_type = 'purchase' and user_id = 7")
def filter_conditional_build(t):
    return shape.filter_by(t.events, event_type="purchase", user_id=7, value=None).select("event_id", "user_id")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def not_in_subquery(t):
    return shape.not_in(t.customer, "c_custkey", t.orders.select("o_custkey")).select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select case when o_orderkey % 100 <> 0 then o_custkey end from orders)")
def not_in_with_null(t):
    return shape.not_in(t.customer, "c_custkey", t.orders.select(F.when(F.col("o_orderkey") % 100 != 0, F.col("o_custkey")))).select("c_custkey")


@query("select c_custkey from customer where case when c_custkey % 2 = 0 then c_custkey end not in (select o_custkey from orders where o_orderkey < 0)")
def not_in_empty(t):
    even = t.customer.withColumn("k", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")))
    return shape.not_in(even, "k", t.orders.filter("o_orderkey < 0").select("o_custkey")).select("c_custkey")


@query("select p_partkey from part p where not exists (select 1 from lineitem l where l.l_partkey = p.p_partkey and l.l_quantity > 45)")
def exists_subquery(t):
    return t.part.join(t.lineitem.filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("select o_orderkey, o_totalprice from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)")
def scalar_subquery(t):
    return t.spark.sql("select o_orderkey, o_totalprice from {o} where o_totalprice > (select avg(o_totalprice) * 1.5 from {o})", o=t.orders)


@query("with m as (select month(o_orderdate) as m, count(*) as n from orders group by 1) select cast(m as bigint) as m, n from m where n > (select avg(n) from m)")
def cte(t):
    return t.spark.sql("with m as (select month(o_orderdate) as m, count(*) as n from {o} group by 1) select cast(m as bigint) as m, n from m where n > (select avg(n) from m)", o=t.orders)


@query("select l_orderkey, l_linenumber, case when l_quantity >= 40 then 'alta' when l_quantity >= 20 then 'media' else 'baixa' end as band from lineitem")
def case_when(t):
    band = F.when(F.col("l_quantity") >= 40, "alta").when(F.col("l_quantity") >= 20, "media").otherwise("baixa")
    return t.lineitem.select("l_orderkey", "l_linenumber", band.alias("band"))


NULLED = "select o_orderkey, case when o_orderkey % 5 = 0 then null else o_totalprice end as price, case when o_orderkey % 7 = 0 then null else o_orderpriority end as priority from orders"


def nulled(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"))


@query(f"select sum(case when price is null then 1 else 0 end)::bigint as price, sum(case when priority is null then 1 else 0 end)::bigint as priority from ({NULLED})")
def is_null_mask(t):
    return nulled(t).select(F.count_if(F.isnull("price")).alias("price"), F.count_if(F.isnull("priority")).alias("priority"))


@query(f"select * from ({NULLED}) where price is not null and priority is not null")
def drop_null(t):
    return nulled(t).na.drop("any")


@query(f"select o_orderkey, coalesce(price, 0) as price, coalesce(priority, 'none') as priority from ({NULLED})")
def fill_null_constant(t):
    return nulled(t).na.fill({"price": 0.0, "priority": "none"})


@query(f"select o_orderkey, round(coalesce(price, (select median(price) from ({NULLED}))), 4) as price, priority from ({NULLED})")
def fill_null_median(t):
    return shape.fill_median(nulled(t), "price").withColumn("price", F.round("price", 4))


@query("select distinct o_custkey, o_orderstatus from orders")
def drop_duplicates(t):
    return t.orders.select("o_custkey", "o_orderstatus").dropDuplicates()


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")
def drop_duplicates_keep_first(t):
    return shape.keep_first(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("select * from (values (1::bigint, 'a', 1.5::double), (2, null, null), (3, 'c', 2.0)) v(id, name, x)")
def build_from_rows(t):
    return t.spark.createDataFrame([(1, "a", 1.5), (2, None, None), (3, "c", 2.0)], "id long, name string, x double")


@query("select cast(i as bigint) as id, cast(i * i as bigint) as square from range(100) r(i)")
def scan_range(t):
    return t.spark.range(100).select("id", (F.col("id") * F.col("id")).alias("square"))


@query("select k, v from (values (1::bigint, 'x'), (2, 'y')) t(k, v)")
def scan_values_inline(t):
    return t.spark.sql("select cast(k as bigint) k, v from values (1, 'x'), (2, 'y') as t(k, v)")


@query("select count(*) as n, sum(l_orderkey)::bigint as keys from lineitem")
def scan_parquet(t):
    return t.lineitem.agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("select p_partkey, row_number() over (order by (p_partkey * 7919 + 42) % 1000003, p_partkey) - 1 as place from part")
def take_permutation(t):
    """A seeded permutation that depends on the keys alone, numbered by ranges."""
    rows, _ = numbered(t.part.select("p_partkey"), [(F.col("p_partkey") * 7919 + 42) % 1000003, F.col("p_partkey")], "place")
    return rows.select("p_partkey", "place")


@query()
def sample_rows(t):
    return t.orders.sample(fraction=0.1, seed=42)


@query()
def sample_block(t):
    return t.spark.sql("select * from {o} tablesample (1 percent) repeatable (42)", o=t.orders)


@query("select column_name, lower(case column_type when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' when 'INTEGER' then 'int' else column_type end) as column_type, \"null\" = 'YES' as nullable from (describe orders)")
def describe_schema(t):
    return t.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in t.orders.schema], "column_name string, column_type string, nullable boolean")
