"""Queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import joins
from tidewater.plans.registry import query

MONEY = "round(sum({}), 2)"


@query("""select r_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as lines
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, c_mktsegment""")
def join_star_chain(t):
    small = joins.broadcast_if_small(t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")))
    who = t.customer.join(small, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name")
    facts = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))
    return facts.groupBy("r_name", "c_mktsegment").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))


@query("select o_orderkey, o_custkey, c_name from orders join (select c_custkey as o_custkey, c_name from customer) using (o_custkey)")
def join_inner_using(t):
    return t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_orderkey", "o_custkey", "c_name")


@query("select s_suppkey, n_name from supplier s join nation n on s.s_nationkey = n.n_nationkey")
def join_inner_on(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("select c_custkey, count(o_orderkey) as orders, sum(case when o_orderkey is null then 1 else 0 end)::bigint as without from customer left join orders on c_custkey = o_custkey and o_totalprice > 250000 group by c_custkey")
def join_left_outer(t):
    big = t.orders.filter("o_totalprice > 250000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.count_if(F.isnull("o_orderkey")).alias("without"))


@query("select a.k as ak, b.k as bk from (select n_nationkey as k from nation where n_nationkey < 15) a right join (select n_nationkey as k from nation where n_nationkey >= 10) b on a.k = b.k")
def join_right_outer(t):
    k = t.nation.select(F.col("n_nationkey").alias("k"))
    a, b = k.filter("k < 15").withColumnRenamed("k", "ak"), k.filter("k >= 10").withColumnRenamed("k", "bk")
    return a.join(b, F.col("ak") == F.col("bk"), "right")


@query("select a.k as ak, b.k as bk from (select n_nationkey as k from nation where n_nationkey < 15) a full join (select n_nationkey as k from nation where n_nationkey >= 10) b on a.k = b.k")
def join_full_outer(t):
    k = t.nation.select(F.col("n_nationkey").alias("k"))
    a, b = k.filter("k < 15").withColumnRenamed("k", "ak"), k.filter("k >= 10").withColumnRenamed("k", "bk")
    return a.join(b, F.col("ak") == F.col("bk"), "full")


@query("select n_name, s_name as name, s_acctbal as n_acctbal from nation join supplier on n_nationkey = s_nationkey")
def join_by_index(t):
    return t.nation.join(t.supplier.withColumnsRenamed({"s_nationkey": "n_nationkey", "s_name": "name", "s_acctbal": "n_acctbal"}), "n_nationkey").select("n_name", "name", "n_acctbal")


@query("select l_orderkey, l_linenumber, p_brand from lineitem join part on l_partkey = p_partkey")
def join_validate_cardinality(t):
    dim = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return joins.checked_join(t.lineitem, dim, ["l_partkey"], "many_to_one").select("l_orderkey", "l_linenumber", "p_brand")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def join_semi(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select count(*) as orphans from (select l_orderkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 10 <> 0))")
def join_anti(t):
    return t.lineitem.join(t.orders.filter("o_orderkey % 10 <> 0"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("orphans"))


@query("""select p.event_id, p.user_id, v.view_id, v.view_value from (select event_id, user_id, ts from events where event_type = 'purchase') p
asof join (select user_id, ts, max(value) as view_value, max(view_id) as view_id from (select user_id, ts, value, event_id as view_id from events where event_type = 'view') group by user_id, ts) v
on p.user_id = v.user_id and p.ts >= v.ts""")
def join_asof(t):
    e = t.events
    views = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("view_value"), F.max("event_id").alias("view_id"))
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof_join(buys, views, ["user_id"], "ts", "ts", ["view_id", "view_value"]).select("event_id", "user_id", "view_id", "view_value")


BRIDGE = "select l_orderkey, l_suppkey, cast(l_quantity / sum(l_quantity) over (partition by l_orderkey) as decimal(5,4)) as factor from lineitem"


@query(f"""select n_name as area_name, cast(sum(cast(cast(o_totalprice as decimal(12,2)) * factor as decimal(38,6))) as decimal(38,4)) as total
from orders join ({BRIDGE}) on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey
where o_orderdate > date '1996-01-01' and o_totalprice > 1000 group by n_name""")
def join_nn_weighted(t):
    bridge = t.spark.sql(BRIDGE.replace("lineitem", "{l}"), l=t.lineitem).select(F.col("l_orderkey").alias("contract_id"), F.col("l_suppkey").alias("operation_id"), "factor")
    flow = t.orders.select(F.col("o_orderkey").alias("contract_id"), F.col("o_orderdate").alias("flow_date"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"))
    contract = t.orders.select(F.col("o_orderkey").alias("contract_id"), (F.col("o_totalprice") - 1000).alias("balance"))
    operation = t.supplier.select(F.col("s_suppkey").alias("operation_id"), F.col("s_nationkey").alias("area_id"))
    area = t.nation.select(F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("area_name"))
    return joins.weighted_bridge(area, operation, bridge, contract, flow, "1996-01-01")


@query("select o_orderstatus, v.label, count(*) as n from orders join (values ('F', 'finished'), ('O', 'open')) v(code, label) on o_orderstatus = v.code group by 1, 2")
def join_python_memory(t):
    names = t.spark.createDataFrame([("F", "finished"), ("O", "open")], "o_orderstatus string, label string")
    return t.orders.join(F.broadcast(names), "o_orderstatus").groupBy("o_orderstatus", "label").agg(F.count("*").alias("n"))


@query("select l_returnflag, count(*) as n, round(sum(o_totalprice), 2) as total from lineitem join orders on l_orderkey = o_orderkey group by 1")
def join_skewed(t):
    right = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return joins.skewed_join(t.lineitem, right, ["l_orderkey"], 4).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select a.r_name as x, b.r_name as y from region a cross join region b")
def join_cross_small(t):
    return t.region.select(F.col("r_name").alias("x")).crossJoin(F.broadcast(t.region.select(F.col("r_name").alias("y"))))


@query("select c_custkey, sk from (select c_custkey, c_name from customer) join (select c_name, row_number() over (order by c_name) as sk from customer) using (c_name)")
def join_natural_to_surrogate(t):
    from tidewater.operators import warehouse

    keyed, _ = warehouse.assign_keys(t.customer.select("c_name"), ["c_name"], 0)
    return t.customer.join(keyed, "c_name").select("c_custkey", "sk")
