"""Queries: scans of folders, partitions, sniffed files, batches and other stores."""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import functions as F

from tidewater.operators.relation import Relation
from tidewater.plans.registry import query
from tidewater.plans.storage import folder
from tidewater.sources import generate, readers, writers


def split_orders(t) -> str:
    path = folder(t)
    orders = t.orders.select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status"), F.month("o_orderdate").alias("month"))
    orders.repartition("status", "month").write.partitionBy("status", "month").parquet(path)
    return path


@query("select count(*) as n, round(sum(o_totalprice), 2) as total from orders where month(o_orderdate) between 10 and 12")
def scan_parquet_glob(t):
    found = readers.hive_partitioned(t.spark, split_orders(t), "status=*/month=1[0-2]")
    return found.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select o_orderkey, o_totalprice, o_orderstatus as status, month(o_orderdate)::int as month from orders where o_orderstatus = 'F' and month(o_orderdate) < 4")
def scan_hive_partitioned(t):
    return readers.hive_partitioned(t.spark, split_orders(t)).filter("status = 'F' and month < 4")


@query("select o_orderstatus || '/' || month(o_orderdate) as part, 1::bigint as files from orders group by 1")
def scan_file_list(t):
    listed = readers.files(t.spark, split_orders(t)).filter(F.col("path").endswith(".parquet"))
    part = F.concat(F.regexp_extract("path", "status=([^/]+)", 1), F.lit("/"), F.regexp_extract("path", "month=([^/]+)", 1))
    return listed.groupBy(part.alias("part")).agg(F.count("*").alias("files"))


@query("select c_custkey as id, c_name as name, c_acctbal as balance, case when c_custkey % 7 = 0 then 'n/a' else c_nationkey::varchar end as nation from customer")
def scan_csv_infer(t):
    path = folder(t)
    nation = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string"))
    t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), nation.alias("nation")).write.csv(path, sep="|", header=True)
    return readers.csv_infer(t.spark, path).select(F.col("id").cast("long").alias("id"), "name", "balance", "nation")


@query("select o_orderkey as id, o_orderstatus as status, o_totalprice as price, unnest([o_orderkey % 3, o_orderkey % 5]) as tag from orders")
def scan_json_infer(t):
    path = folder(t)
    nested = t.orders.select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).alias("info"), F.array(F.col("o_orderkey") % 3, F.col("o_orderkey") % 5).alias("tags"))
    writers.write_ndjson(nested, path)
    return readers.json_infer(t.spark, path).select("id", "info.status", "info.price", F.explode("tags").alias("tag"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def scan_sqlite(t):
    path = folder(t).removeprefix("file://")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with sqlite3.connect(f"{path}.db") as db:
        db.execute("create table nations (n_nationkey integer, n_name text, n_regionkey integer)")
        db.executemany("insert into nations values (?, ?, ?)", [tuple(r) for r in t.nation.select("n_nationkey", "n_name", "n_regionkey").toLocalIterator()])
    return readers.sqlite_rows(t.spark, f"{path}.db", "nations", "n_nationkey int, n_name string, n_regionkey int", 3)


@query("select (r - 1) // 1000 as batch, count(*) as n, sum(o_orderkey)::bigint as keys from (select o_orderkey, row_number() over (order by o_orderkey) as r from orders) group by 1")
def scan_batches_reader(t):
    """Batches of a lazy reader, enriched one after another; a reader without rows keeps its schema."""
    import pyarrow as pa
    import pyarrow.compute as pc

    reader = readers.BatchReader(t.orders.select("o_orderkey").orderBy("o_orderkey"), 1000)
    count = iter(range(1 << 60))
    total = lambda b: pa.RecordBatch.from_pydict({"batch": [next(count)], "n": [b.num_rows], "keys": [pc.sum(b.column(0)).as_py()]})
    _, batches = readers.enriched(reader, total)
    return t.spark.createDataFrame([tuple(r.values()) for b in batches for r in b.to_pylist()], "batch long, n long, keys long")


@query("select kind, n from (select count(*) as n from nation) cross join (values ('rows'), ('first'), ('pandas'), ('arrow'), ('batches')) k(kind)")
def result_formats(t):
    nations = Relation(t.nation)
    counts = {"rows": len(nations.fetchall()), "first": 0 if nations.fetchone() is None else len(nations.fetchall()), "pandas": len(nations.to_pandas()), "arrow": nations.to_arrow().num_rows, "batches": sum(b.num_rows for b in nations.to_batches(7))}
    return t.spark.createDataFrame(list(counts.items()), "kind string, n long")


@query("select way, n, round(total, 2) as total from (select count(*) as n, sum(s_acctbal) as total from supplier) cross join (values ('rows'), ('batches'), ('columns')) w(way)")
def write_path_compare(t):
    """The same rows written as single objects, as batches of values, and as columns: all end alike."""
    path, schema = folder(t), "s_suppkey long, s_acctbal double"
    rows = [tuple(r) for r in t.supplier.select("s_suppkey", "s_acctbal").toLocalIterator()]
    for at in range(0, len(rows), max(1, len(rows) // 3 + 1)):
        t.spark.createDataFrame(rows[at : at + max(1, len(rows) // 3 + 1)], schema).write.mode("append").parquet(f"{path}/way=batches")
    t.spark.createDataFrame([{"s_suppkey": k, "s_acctbal": v} for k, v in rows], schema).write.parquet(f"{path}/way=rows")
    t.supplier.select("s_suppkey", "s_acctbal").write.parquet(f"{path}/way=columns")
    return t.spark.read.parquet(path).groupBy("way").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("select true as bounded, count(*) as rows, true as several from orders")
def sink_file_size_split(t):
    path = folder(t)
    t.orders.select("o_orderkey").coalesce(1).write.option("maxRecordsPerFile", 700).parquet(path)
    files = t.spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return files.agg((F.max("n") <= 700).alias("bounded"), F.sum("n").alias("rows"), (F.count("*") > 1).alias("several"))


@query("select i // 50 as account, i % 50 as entry, (i * 7919 + 42 * 104729) % 200001 - 100000 as cents, (((i * 7919 + 42 * 104729) % 200001 - 100000)::decimal(14,0) * 0.01::decimal(2,2))::decimal(12,2) as amount from range(1000) r(i)")
def generate_ledger(t):
    return generate.ledger(t.spark, 20, 50)


@query("select 1000::bigint as sales, 100::bigint as customers, 10::bigint as products, 0::bigint as orphans")
def generate_star(t):
    made = generate.star(t.spark, 1000)
    whole = made["sales"].join(made["customers"], "customer").join(made["products"], "product")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(made["sales"], "sales").crossJoin(count(made["customers"], "customers")).crossJoin(count(made["products"], "products")).crossJoin(count(whole, "joined"))
    return out.select("sales", "customers", "products", (F.col("sales") - F.col("joined")).alias("orphans"))
