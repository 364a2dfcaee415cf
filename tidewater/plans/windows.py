"""Queries: windows and running state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewater.operators import windows
from tidewater.plans.registry import query

DAILY = "select cast(ts as date) as day, cast(count(*) as bigint) as n, cast(sum(cast(value * 100 as bigint)) as bigint) as cents from events group by 1"


def daily(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query("select c_nationkey, c_custkey, c_acctbal from customer qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) <= 2")
def win_row_number_topn(t):
    return windows.top_n(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 2).select("c_nationkey", "c_custkey", "c_acctbal")


@query("select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2 qualify row_number() over (partition by o_custkey order by count(*) desc, o_orderstatus) = 1")
def win_qualify(t):
    grouped = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return windows.qualify(grouped, "place = 1", place=F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("n"), "o_orderstatus")))


@query(f"with d as (select cast(ts as date) as day, count(*) as n from events group by 1) select day, round(avg(n) over (order by day rows between 2 preceding and current row), 4) as mean from d")
def win_moving_avg(t):
    return daily(t).select("day", F.round(windows.moving_average("n", [], ["day"], 3), 4).alias("mean"))


@query("with d as (select cast(ts as date) as day, count(*) as n from events group by 1) select day, case when count(n) over w = 3 then round(avg(n) over w, 4) end as mean from d window w as (order by day rows between 2 preceding and current row)")
def win_rolling_full(t):
    return daily(t).select("day", F.round(windows.moving_average("n", [], ["day"], 3, full=True), 4).alias("mean"))


@query("select o_orderkey, lag(o_totalprice) over w as before, lead(o_totalprice) over w as after from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def win_lag_lead(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice").over(w).alias("after"))


@query("select quarter, count(*) as n, round(sum(p_retailprice), 2) as total from (select p_retailprice, cast(ntile(4) over (partition by p_brand order by p_retailprice, p_partkey) as bigint) as quarter from part) group by 1")
def win_ntile(t):
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return t.part.withColumn("quarter", F.ntile(4).over(w).cast("long")).groupBy("quarter").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("""select p_brand, p_partkey, first, share from (select p_brand, p_partkey, first_value(p_partkey) over w as first,
round(100 * p_retailprice / sum(p_retailprice) over (partition by p_brand), 1) as share, row_number() over w as n from part
window w as (partition by p_brand order by p_retailprice desc, p_partkey)) where n <= 2""")
def win_first_value_share(t):
    w, all_ = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"), Window.partitionBy("p_brand")
    out = t.part.select("p_brand", "p_partkey", F.first("p_partkey").over(w).alias("first"), F.round(100 * F.col("p_retailprice") / F.sum("p_retailprice").over(all_), 1).alias("share"), F.row_number().over(w).alias("n"))
    return out.filter("n <= 2").drop("n")


@query("""select l_orderkey, l_linenumber, q, sum(q) over (partition by l_orderkey order by d, l_linenumber, q rows unbounded preceding)::bigint as by_rows,
sum(q) over (partition by l_orderkey order by d range unbounded preceding)::bigint as by_range from (select l_orderkey, l_linenumber, cast(l_quantity as bigint) as q, month(l_shipdate) as d from lineitem)""")
def win_rows_vs_range(t):
    base = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.month("l_shipdate").alias("d"))
    rows = Window.partitionBy("l_orderkey").orderBy("d", "l_linenumber", "q").rowsBetween(Window.unboundedPreceding, 0)
    peers = Window.partitionBy("l_orderkey").orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
    return base.select("l_orderkey", "l_linenumber", "q", F.sum("q").over(rows).alias("by_rows"), F.sum("q").over(peers).alias("by_range"))


@query("""select o_orderkey, last_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as here,
last_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as last from orders""")
def win_last_value_full(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.last("o_orderkey").over(w).alias("here"), F.last("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))


@query("select l_returnflag, p_partkey, row_number() over (partition by l_returnflag order by total desc, p_partkey) as place from (select l_returnflag, l_partkey as p_partkey, sum(l_quantity) as total from lineitem group by 1, 2)")
def win_rank_unique(t):
    total = t.lineitem.groupBy("l_returnflag", F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("total"))
    return windows.place(total, ["l_returnflag"], [F.desc("total"), F.col("p_partkey")]).select("l_returnflag", "p_partkey", "place")


@query("select true as rejected")
def win_over_group_error(t):
    """Grouping by a window's result at the level that computes it is refused when the query is analysed."""
    t.orders.createOrReplaceTempView("grouped_orders")
    try:
        t.spark.sql("select row_number() over (order by o_orderkey) as r, count(*) from grouped_orders group by r")
    except AnalysisException:
        return t.spark.range(1).select(F.lit(True).alias("rejected"))
    return t.spark.range(1).select(F.lit(False).alias("rejected"))


@query("with d as (select cast(ts as date) as day, count(*) as n from events group by 1) select day, sum(n) over (order by day rows unbounded preceding)::bigint as upto from d")
def win_cumsum(t):
    return daily(t).select("day", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


@query("select event_id, sum(event_id) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as upto from events")
def win_cumsum_grouped(t):
    return t.events.select("event_id", F.sum("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


@query("select event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events")
def win_cumcount(t):
    return t.events.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"))


RUNNING = """select o_orderkey, round(total, 2) as cumulative_spend, case when round(total, 2) < 100000 then 'bronze' when round(total, 2) < 500000 then 'prata' else 'ouro' end as customer_tier from (
select o_orderkey, sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as total from orders)"""


@query(RUNNING)
def running_spend_tier(t):
    out = windows.running_spend(t.orders, "o_custkey", "o_totalprice", ["o_orderdate", "o_orderkey"], 100_000, 500_000)
    return out.select("o_orderkey", F.round("cumulative_spend", 2).alias("cumulative_spend"), windows.tier(F.round("cumulative_spend", 2), 100_000, 500_000).alias("customer_tier"))


@query("""select acct, greatest(max(b), 0)::decimal(38,2) as max_balance from (select l_suppkey as acct, sum(v) over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, v rows unbounded preceding) as b
from (select *, cast(case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end as decimal(12,2)) as v from lineitem)) group by 1""")
def max_running_balance(t):
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    moves = t.lineitem.select(F.col("l_suppkey").alias("acct"), "l_shipdate", "l_orderkey", "l_linenumber", signed.cast("decimal(12,2)").alias("v"))
    out = windows.max_running_balance(moves, "acct", "v", ["l_shipdate", "l_orderkey", "l_linenumber", "v"])
    return out.select("acct", F.col("max_balance").cast("decimal(38,2)").alias("max_balance"))


@query("""select user_id, count(*) as sessions, max(n)::bigint as longest from (select user_id, s, count(*) as n from (select user_id, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s
from (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as new from events)) group by 1, 2) group by 1""")
def session_windows(t):
    spans = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours")).agg(F.count("*").alias("n"))
    return spans.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
