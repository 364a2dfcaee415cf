"""Queries: sorts, set operations, hierarchies and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import reshape
from tidewater.plans.registry import query

STATUS = ["F", "O", "P"]


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def sort_top_k(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("select l_orderkey, l_linenumber, l_shipdate from lineitem")
def sort_multi_key(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber")


@query("select o_orderkey from orders order by o_orderkey limit 10 offset 100")
def limit_offset(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(110).offset(100)


@query("select c_custkey as key, c_acctbal as balance from customer union all select s_suppkey, s_acctbal from supplier")
def union_all(t):
    return t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")).unionByName(t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key")))


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_intersect(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("select o_custkey as k from orders except select o_custkey from orders where o_orderstatus = 'F'")
def set_except(t):
    return t.orders.select(F.col("o_custkey").alias("k")).subtract(t.orders.filter("o_orderstatus = 'F'").select("o_custkey"))


TREE = """with recursive nodes as (select 0::bigint as id, 'world' as name, null::bigint as parent_id union all select 100 + r_regionkey, r_name, 0 from region
union all select 1000 + n_nationkey, n_name, 100 + n_regionkey from nation),
tree as (select id, name, 0 as level, name as path, cast(id as varchar) as trail from nodes where parent_id is null
union all select n.id, n.name, t.level + 1, t.path || ' > ' || n.name, t.trail || ',' || n.id from tree t join nodes n on n.parent_id = t.id) """


def tree(t):
    nodes = t.spark.createDataFrame([(0, "world", None)], "id long, name string, parent_id long")
    nodes = nodes.union(t.region.select((F.col("r_regionkey") + 100).cast("long"), "r_name", F.lit(0).cast("long"))).union(t.nation.select((F.col("n_nationkey") + 1000).cast("long"), "n_name", (F.col("n_regionkey") + 100).cast("long")))
    return reshape.flatten_tree(nodes, nodes)


@query(TREE + "select id, name, cast(level as bigint) as level, path, trail from tree")
def recursive_hierarchy(t):
    return tree(t).select("id", "name", F.col("level").cast("long").alias("level"), "path", F.array_join("ancestors", ",").alias("trail"))


@query(TREE + "select id, name from tree where ',' || trail || ',' like '%,102,%'")
def subtree_filter(t):
    return reshape.subtree(tree(t), 102).select("id", "name")


@query(TREE + """, facts as (select 1000 + c_nationkey as id, c_acctbal as v from customer)
select a.name, count(*) as n, round(sum(v), 2) as total from tree a join tree d on ',' || d.trail || ',' like '%,' || a.id || ',%' join facts on facts.id = d.id group by 1""")
def subtree_totals(t):
    flat = tree(t)
    facts = t.customer.select((F.col("c_nationkey") + 1000).cast("long").alias("id"), F.col("c_acctbal").alias("v"))
    up = facts.join(F.broadcast(flat.select("id", F.explode("ancestors").alias("above"))), "id")
    names = flat.select(F.col("id").alias("above"), "name")
    return up.groupBy("above").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total")).join(names, "above").select("name", "n", "total")


PIVOT = ", ".join(f"round(sum(o_totalprice) filter (where o_orderstatus = '{s}'), 2) as \"{s}\"" for s in STATUS)


@query(f"select cast(month(o_orderdate) as bigint) as m, {PIVOT} from orders group by 1")
def pivot_dynamic(t):
    """The columns are the values that the data hold."""
    return reshape.pivot_found(t.orders.withColumn("m", F.month("o_orderdate").cast("long")), ["m"], "o_orderstatus", F.round(F.sum("o_totalprice"), 2))


@query("select o_orderpriority, s as status, count(o_orderkey) as n from (select distinct o_orderpriority from orders) cross join (select distinct o_orderstatus as s from orders) left join orders using (o_orderpriority) where o_orderstatus = s group by 1, 2")
def stack_back(t):
    wide = reshape.pivot_found(t.orders, ["o_orderpriority"], "o_orderstatus", F.count(F.lit(1)), fill=0)
    return reshape.stack(wide, ["o_orderpriority"], "status", "n").filter("n > 0")


@query("select o_orderpriority, count(*) as n from orders where o_orderstatus = 'F' and month(o_orderdate) = 3 group by 1")
def index_cross_section(t):
    """Rows of a grouped table by some of its key columns; the key columns are the index."""
    grouped = t.orders.groupBy("o_orderstatus", F.month("o_orderdate").alias("m"), "o_orderpriority").agg(F.count("*").alias("n"))
    return reshape.cross_section(grouped, o_orderstatus="F", m=3)


@query("select o_orderpriority, " + ", ".join(f"round(avg(o_totalprice) filter (where o_orderstatus = '{s}'), 2) as \"{s}\"" for s in STATUS) + " from orders group by 1")
def pivot_mean(t):
    return reshape.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", STATUS, F.round(F.avg("o_totalprice"), 2))


COUNTS = ", ".join(f"count(*) filter (where o_orderstatus = '{s}') as \"{s}\"" for s in STATUS)


@query(f"select o_orderpriority, {COUNTS}, count(*) as total from orders group by 1 union all select 'total', {COUNTS}, count(*) from orders")
def pivot_margins(t):
    return reshape.pivot_margins(t.orders, "o_orderpriority", "o_orderstatus", STATUS, F.count("*"))


@query("select r_regionkey, max(case when r_name = 'ASIA' then r_regionkey end) as \"ASIA\", max(case when r_name = 'EUROPE' then r_regionkey end) as \"EUROPE\" from region group by 1")
def pivot_unique(t):
    return reshape.pivot_unique(t.region.withColumn("v", F.col("r_regionkey")), "r_regionkey", "r_name", ["ASIA", "EUROPE"], "v")


@query("select c_mktsegment, " + ", ".join(f"round(coalesce(sum(c_acctbal) filter (where c_nationkey = {n}), 0), 2) as \"{n}\"" for n in (0, 1, 2)) + " from customer group by 1")
def pivot_manual(t):
    return reshape.pivot(t.customer, ["c_mktsegment"], "c_nationkey", [0, 1, 2], F.round(F.sum("c_acctbal"), 2), fill=0.0)


@query("select o_custkey, " + ", ".join(f"count(*) filter (where o_orderstatus = '{s}') as \"{s}\"" for s in [*STATUS, "X"]) + " from orders group by 1")
def unstack_fill(t):
    return reshape.pivot(t.orders, ["o_custkey"], "o_orderstatus", [*STATUS, "X"], F.count(F.lit(1)), fill=0)


WIDE = "select p_partkey, cast(p_size as double) as size, case when p_partkey % 3 = 0 then null else p_retailprice end as price from part"


def wide(t):
    return t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("price"))


@query(f"select * from (unpivot ({WIDE}) on size, price into name measure value amount)")
def unpivot(t):
    return reshape.unpivot(wide(t), ["p_partkey"], ["size", "price"], "measure", "amount", keep_nulls=False)


@query(f"select p_partkey, 'size' as measure, size as amount from ({WIDE}) union all select p_partkey, 'price', price from ({WIDE})")
def melt(t):
    return reshape.unpivot(wide(t), ["p_partkey"], ["size", "price"], "measure", "amount", keep_nulls=True)


@query("select p_partkey, unnest(string_split(p_type, ' ')) as word from part")
def unnest_list(t):
    return t.part.select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"))


@query("""with b as (select min(cast(ts as date)) as lo, max(cast(ts as date)) as hi from events where event_type = 'purchase'),
bins as (select cast(lo + cast(i * 3 as integer) as date) as bin from b, range(0, 1000) r(i) where lo + cast(i * 3 as integer) <= hi)
select bin, count(ts) as value from bins left join (select ts, cast(ts as date) as d from events where event_type = 'purchase') on d >= bin and d < bin + 3 group by 1""")
def resample_3d(t):
    days = t.events.filter("event_type = 'purchase'").select(F.to_date("ts").alias("d"))
    return reshape.resample_days(days, "d", 3, F.count("*"))
