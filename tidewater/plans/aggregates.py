"""Queries: aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import aggregates
from tidewater.plans.registry import query


@query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as mean, min(o_totalprice) as low, max(o_totalprice) as high from orders group by o_orderstatus")
def agg_count_sum_avg_min_max(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by all")
def agg_group_all(t):
    return t.spark.sql("select l_returnflag, l_linestatus, count(*) as n from {l} group by all", l=t.lineitem)


@query("select cast(year(o_orderdate) as bigint) as y, count(*) as n from orders group by 1 order by 1")
def agg_group_ordinal(t):
    return t.spark.sql("select cast(year(o_orderdate) as bigint) as y, count(*) as n from {o} group by 1 order by 1", o=t.orders)


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2")
def agg_multi_key(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderstatus", "o_orderpriority")


@query("select o_custkey, count(*) as n from orders group by 1 having count(*) >= 15")
def agg_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 15")


@query("select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by 1")
def agg_count_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("select l_linestatus, round(stddev_pop(l_quantity), 4) as sd from lineitem group by 1")
def agg_stddev_pop(t):
    return t.lineitem.groupBy("l_linestatus").agg(F.round(F.stddev_pop("l_quantity"), 4).alias("sd"))


@query("select o_orderstatus, count(*) filter (where o_totalprice > 100000) as big, count(*) filter (where o_orderpriority = '1-URGENT') as urgent from orders group by 1")
def agg_filter_clause(t):
    return t.spark.sql("select o_orderstatus, count(*) filter (where o_totalprice > 100000) as big, count(*) filter (where o_orderpriority = '1-URGENT') as urgent from {o} group by 1", o=t.orders)


@query("select n_regionkey, any_value(n_regionkey * 10)::bigint as v from nation group by 1")
def agg_any_value(t):
    return t.nation.groupBy("n_regionkey").agg(F.any_value(F.col("n_regionkey") * 10).cast("long").alias("v"))


@query("select user_id, array_to_string(list(distinct event_type order by event_type), ',') as kinds, cast(count(distinct event_type) as bigint) as n from events group by 1")
def agg_list_distinct(t):
    kinds = F.sort_array(F.collect_set("event_type"))
    return t.events.groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"), F.size(kinds).cast("long").alias("n"))


@query("select case when user_id % 11 = 0 then null else event_type end as kind, count(*) as n from events group by 1")
def agg_value_counts(t):
    return t.events.groupBy(F.when(F.col("user_id") % 11 != 0, F.col("event_type")).alias("kind")).agg(F.count("*").alias("n"))


@query("select distinct event_type from events")
def agg_unique(t):
    return t.events.select("event_type").distinct()


@query("select o_orderkey, round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 6) as share from orders")
def agg_transform_share(t):
    return t.orders.select("o_orderkey", F.round(aggregates.share_of("o_totalprice", ["o_custkey"]), 6).alias("share"))


@query("select p_brand, p_partkey, p_retailprice from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) = 1")
def agg_group_top1(t):
    best = F.max_by(F.struct("p_partkey", "p_retailprice"), F.struct("p_retailprice", -F.col("p_partkey")))
    return t.part.groupBy("p_brand").agg(best.alias("b")).select("p_brand", "b.p_partkey", "b.p_retailprice")


@query("select l_returnflag, cast(sum(cast(l_extendedprice as decimal(12,2))) as decimal(38,2)) as total from lineitem group by 1")
def agg_sum_decimal_exact(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(38,2)").alias("total"))


@query("select c_mktsegment, round(100.0 * count(*) filter (where c_acctbal > 0) / count(*), 1) as pct from customer group by 1")
def agg_pct_active(t):
    return t.customer.groupBy("c_mktsegment").agg(F.round(100.0 * F.count_if(F.col("c_acctbal") > 0) / F.count("*"), 1).alias("pct"))


@query("""select 'p_partkey' as column_name, min(p_partkey)::varchar as min, max(p_partkey)::varchar as max, 0::double as null_percentage, count(*) as count from part
union all select 'p_name', min(p_name), max(p_name), 0, count(*) from part union all select 'p_brand', min(p_brand), max(p_brand), 0, count(*) from part
union all select 'p_size', min(p_size)::varchar, max(p_size)::varchar, 0, count(*) from part""")
def agg_summarize(t):
    return aggregates.summarize(t.part.select("p_partkey", "p_name", "p_brand", "p_size")).select("column_name", "min", "max", F.col("null_percentage").cast("double").alias("null_percentage"), "count")


@query("select case when l_quantity > 0 and l_quantity <= 15 then 'low' when l_quantity > 15 and l_quantity <= 35 then 'mid' when l_quantity > 35 and l_quantity <= 50 then 'high' end as band, count(*) as n from lineitem group by 1")
def agg_bucket_cut(t):
    return t.lineitem.groupBy(aggregates.bucket(F.col("l_quantity"), [0, 15, 35, 50], ["low", "mid", "high"]).alias("band")).agg(F.count("*").alias("n"))


@query("""select tier, count(*) as n, count(distinct o_custkey) as customers, round(sum(o_totalprice), 2) as total from (
select *, case when o_totalprice < 50000 then 'bronze' when o_totalprice < 150000 then 'prata' else 'ouro' end as tier from orders) group by 1""")
def agg_tier_summary(t):
    from tidewater.operators.windows import tier

    tiers = t.orders.withColumn("tier", tier(F.col("o_totalprice"), 50_000, 150_000))
    return tiers.groupBy("tier").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select round(median(l_extendedprice), 4) as middle, round(quantile_cont(l_extendedprice, 0.95), 4) as p95 from lineitem")
def agg_percentiles(t):
    from tidewater.operators.shape import exact_quantile

    middle, p95 = (exact_quantile(t.lineitem, "l_extendedprice", q) for q in (0.5, 0.95))
    return t.spark.range(1).select(F.round(F.lit(middle), 4).alias("middle"), F.round(F.lit(p95), 4).alias("p95"))


@query("select r_name, n_name, grouping(r_name)::bigint as gr, grouping(n_name)::bigint as gn, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by grouping sets ((r_name, n_name), (r_name), ())")
def agg_grouping_sets(t):
    joined = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.spark.sql("select r_name, n_name, cast(grouping(r_name) as bigint) gr, cast(grouping(n_name) as bigint) gn, count(*) n from {j} group by grouping sets ((r_name, n_name), (r_name), ())", j=joined)
