"""Queries: tables, keys, loads, files and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.operators import scratch, warehouse
from tidewater.plans.registry import query
from tidewater.sources import readers, writers


def folder(t) -> str:
    return scratch.folder(t.spark)


@query("select p_name, row_number() over (order by p_name) + 1000 as sk from (select distinct p_name from part)")
def surrogate_keys(t):
    return warehouse.assign_keys(t.part.select("p_name").distinct(), ["p_name"], 1000)[0].select("p_name", "sk")


@query("select c_custkey, 'new' as state from customer where c_custkey > 100 union all select c_custkey, case when c_custkey % 2 = 0 then 'changed' else 'old' end from customer where c_custkey <= 100")
def upsert_result(t):
    old = t.customer.filter("c_custkey <= 100").select("c_custkey", F.lit("old").alias("state"))
    new = t.customer.filter("c_custkey > 100 or c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") > 100, "new").otherwise("changed").alias("state"))
    return warehouse.upsert(old, new, ["c_custkey"], ["state"])


@query("select s_name, 50 + row_number() over (order by s_name) as sk from supplier where s_suppkey > 50")
def incremental_antijoin(t):
    dim = t.supplier.filter("s_suppkey <= 50").select("s_name", F.col("s_suppkey").alias("sk"))
    return warehouse.load_new(t.supplier.select("s_name"), dim, ["s_name"])


@query("select 'price above 1000' as constraint, count(*) as rows from part where not p_retailprice > 1000 having count(*) > 0")
def constraint_violations(t):
    nations = (t.nation, "n_nationkey")
    cust = warehouse.violations(t.customer, not_null=["c_name"], unique=[["c_custkey"]], foreign={"c_nationkey": nations})
    return cust.unionByName(warehouse.violations(t.part, checks={"price above 1000": "p_retailprice > 1000"}))


@query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def sink_idempotent_reload(t):
    path = folder(t)
    orders = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    writers.overwrite_partitions(orders, path, ["o_orderstatus"])
    writers.overwrite_partitions(orders.filter("o_orderstatus = 'F'"), path, ["o_orderstatus"], max_records=1000)
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("with b as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) select cast(least(floor((o_totalprice - lo) / ((hi - lo) / 8)), 7) as integer) as band, count(*) as n from orders, b group by 1")
def sink_reorg_upstream(t):
    return writers.reorganize(t.orders.select("o_orderkey", "o_totalprice"), folder(t), "o_totalprice", "o_orderkey", 8).groupBy("band").agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey between 10 and 20")
def sink_sorted_layout(t):
    path = folder(t)
    writers.write_sorted(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), path, ["l_partkey"], 4, 10_000, bloom={"l_partkey": 2000})
    return t.spark.read.parquet(path).filter(F.col("l_partkey").between(10, 20))


@query("select c_custkey, c_name, c_acctbal from customer")
def sink_ndjson(t):
    path = folder(t)
    writers.write_ndjson(t.customer.select("c_custkey", "c_name", "c_acctbal"), path)
    return t.spark.read.schema("c_custkey long, c_name string, c_acctbal double").json(path)


@query("select n_nationkey, n_name from nation")
def arrow_ipc_round_trip(t):
    path = folder(t)
    writers.ipc_bytes(t.nation.select("n_nationkey", "n_name")).write.parquet(path)
    content = t.spark.read.parquet(path)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for data in b.column(0):
                r = pa.ipc.open_file(data.as_buffer())
                yield from (r.get_batch(i) for i in range(r.num_record_batches))

    return content.mapInArrow(run, "n_nationkey int, n_name string")


@query("select r_regionkey::bigint as id, r_name as name, null::varchar as note from region union all select n_nationkey, n_name, 'nation' from nation")
def scan_union_by_name(t):
    path = folder(t)
    t.region.select(F.col("r_regionkey").cast("int").alias("id"), F.col("r_name").alias("name")).write.parquet(f"{path}/a")
    t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("note")).write.parquet(f"{path}/b")
    return readers.union_by_name(t.spark, [f"{path}/a", f"{path}/b"])


@query("select 'b' as part, 'note' as \"column\", null::varchar as wanted, 'string' as found union all select 'b', 'id', 'int', 'bigint' union all select 'c', 'id', 'int', null")
def schema_drift(t):
    path = folder(t)
    t.region.coalesce(1).select(F.col("r_regionkey").cast("int").alias("id")).write.parquet(f"{path}/a")
    t.nation.coalesce(1).select(F.col("n_nationkey").cast("long").alias("id"), F.lit("x").alias("note")).write.parquet(f"{path}/b")
    t.region.coalesce(1).select(F.lit(1).alias("other")).write.parquet(f"{path}/c")
    out = readers.drift(t.spark, [f"{path}/a", f"{path}/b", f"{path}/c"], StructType.fromDDL("id int")).filter("column != 'other'")
    return out.select(F.element_at(F.split("path", "/"), -2).alias("part"), "column", "wanted", "found")


def dirty(t):
    path = folder(t)
    amount = F.when(F.col("o_orderkey") % 10 == 0, "abc").otherwise(F.col("o_totalprice").cast("string"))
    t.orders.select("o_orderkey", amount.alias("amount")).write.option("header", True).csv(path)
    return readers.csv_quarantine(t.spark, path, StructType.fromDDL("o_orderkey long, amount double"))


@query("select o_orderkey, o_totalprice as amount from orders where o_orderkey % 10 <> 0")
def csv_good_rows(t):
    return dirty(t)[0]


@query("select 'amount' as column_name, 'CAST' as error_type, 'abc' as value, o_orderkey || ',abc' as csv_line from orders where o_orderkey % 10 = 0")
def csv_rejects(t):
    return dirty(t)[1].select("column_name", "error_type", "value", "csv_line")


def ragged(t):
    path, k = folder(t), F.col("o_orderkey")
    line = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(",1.5,more"))).otherwise(F.concat(k.cast("string"), F.lit(",2.5")))
    t.orders.select(line).write.text(path)
    return readers.csv_quarantine(t.spark, path, StructType.fromDDL("k long, amount double"), header=False)


@query("select o_orderkey as k, 2.5::double as amount from orders where o_orderkey % 3 = 2")
def csv_ragged_good(t):
    return ragged(t)[0]


@query("""select o_orderkey::varchar as csv_line, 'amount' as column_name, 'MISSING COLUMNS' as error_type from orders where o_orderkey % 3 = 0
union all select o_orderkey || ',1.5,more', null, 'TOO MANY COLUMNS' from orders where o_orderkey % 3 = 1""")
def csv_ragged_rejects(t):
    return ragged(t)[1].select("csv_line", "column_name", "error_type")


@query("select 'l_orderkey' as \"column\", count(*) as rows from lineitem")
def parquet_footer_rows(t):
    return readers.parquet_footers(t.spark, f"{t.folder}/lineitem.parquet").filter("column = 'l_orderkey'").groupBy("column").agg(F.sum("rows").alias("rows"))


#: The SQL of these queries names the files themselves; views don't have footers.
FILES = "/root/testdata/sf0.01"


@query(f"""select row_group_id::int as row_group, row_group_num_rows as rows, path_in_schema as "column", type as physical, compression, total_compressed_size as compressed,
total_uncompressed_size as uncompressed, stats_null_count as nulls from parquet_metadata('{FILES}/orders.parquet')""")
def parquet_footers(t):
    return readers.parquet_footers(t.spark, f"{t.folder}/orders.parquet").select("row_group", "rows", "column", "physical", "compression", "compressed", "uncompressed", "nulls")


@query(f"select num_rows as rows, num_row_groups as row_groups, created_by, file_size_bytes::bigint as file_size, footer_size::bigint as footer_size from parquet_file_metadata('{FILES}/lineitem.parquet')")
def parquet_file_metadata(t):
    return readers.parquet_files(t.spark, f"{t.folder}/lineitem.parquet").select("rows", "row_groups", "created_by", "file_size", "footer_size")


@query(f"select decode(key) as key, octet_length(value) as length from parquet_kv_metadata('{FILES}/orders.parquet')")
def parquet_kv_metadata(t):
    return readers.parquet_key_values(t.spark, f"{t.folder}/orders.parquet").select("key", F.octet_length("value").cast("long").alias("length"))


@query(f"select name, type as physical, repetition_type as repetition from parquet_schema('{FILES}/documents.parquet') where type is not null")
def parquet_schema(t):
    return readers.parquet_columns(t.spark, f"{t.folder}/documents.parquet").select("name", "physical", "repetition")


@query("select count(*) as n from orders where o_custkey < 100")
def live_view(t):
    path = folder(t)
    t.orders.filter("o_custkey < 50").write.parquet(path)
    writers.live_view(t.spark, "live_orders", path)
    t.orders.filter("o_custkey >= 50 and o_custkey < 100").write.mode("append").parquet(path)
    return t.spark.sql("select count(*) as n from live_orders")


@query("select c_mktsegment, count(*) as n from customer group by 1")
def export_import(t):
    path = folder(t)
    t.customer.createOrReplaceTempView("exp_customer")
    writers.export_database(t.spark, ["exp_customer"], {"exp_segments": "select c_mktsegment, count(*) as n from exp_customer group by 1"}, path)
    writers.import_database(t.spark, path)
    return t.spark.table("exp_segments")


@query("select count(*) as n from orders where o_orderkey % 2 = 0")
def versioned_table(t):
    table = warehouse.VersionedTable(t.spark, folder(t))
    table.commit(t.orders)
    table.commit(table.read().filter("o_orderkey % 2 = 0"))
    return table.read().agg(F.count("*").alias("n"))
