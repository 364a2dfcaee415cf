"""Queries: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.text import strip_accents
from tidewater.plans.registry import query


@query("select c_custkey, upper(c_mktsegment) as up, replace(c_name, '#', '-') as dashed, left(c_name, 8) as start, c_name || '/' || c_mktsegment as joined, regexp_extract(c_name, '([0-9]+)', 1) as digits from customer")
def string_functions(t):
    return t.customer.select("c_custkey", F.upper("c_mktsegment").alias("up"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("dashed"), F.left("c_name", F.lit(8)).alias("start"), F.concat("c_name", F.lit("/"), "c_mktsegment").alias("joined"), F.regexp_extract("c_name", "([0-9]+)", 1).alias("digits"))


@query("select doc_id, strip_accents(text) as bare from documents")
def accent_strip(t):
    return t.documents.select("doc_id", strip_accents("text").alias("bare"))


@query("select o_orderkey, cast(date_trunc('year', o_orderdate) as date) as year, cast(day(o_orderdate) as bigint) as d, cast(month(o_orderdate) as bigint) as m, cast(o_orderdate + interval 30 day as date) as later, date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as since from orders")
def date_functions(t):
    o = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.trunc(o, "year").alias("year"), F.day(o).cast("long").alias("d"), F.month(o).cast("long").alias("m"), F.date_add(o.cast("date"), 30).alias("later"), F.datediff(o.cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("since"))


@query("select cast(date_trunc('year', o_orderdate) as date) as year, count(*) as n from orders group by 1")
def date_trunc_year(t):
    return t.orders.groupBy(F.trunc("o_orderdate", "year").alias("year")).agg(F.count("*").alias("n"))


@query("select o_orderkey, cast((day(o_orderdate) - 1) // 7 + 1 as tinyint) as week from orders")
def week_of_month(t):
    return t.orders.select("o_orderkey", (F.floor((F.day("o_orderdate") - 1) / 7) + 1).cast("byte").alias("week"))


@query("select event_id, cast(hour(ts) as bigint) as h, cast(dayofweek(ts) as bigint) as dow from events")
def timestamp_parts(t):
    return t.events.select("event_id", F.hour("ts").cast("long").alias("h"), (F.dayofweek("ts") - 1).cast("long").alias("dow"))


@query("select p_partkey, round(p_retailprice, 1) as r, cast(floor(p_retailprice) as bigint) as f, least(p_size, 25) as l, p_partkey % 7 as m, round(1000 * power(1.01, p_size), 4) as p from part")
def math_functions(t):
    price = F.col("p_retailprice")
    return t.part.select("p_partkey", F.round(price, 1).alias("r"), F.floor(price).cast("long").alias("f"), F.least("p_size", F.lit(25)).alias("l"), (F.col("p_partkey") % 7).alias("m"), F.round(1000 * F.pow(F.lit(1.01), "p_size"), 4).alias("p"))


@query("select p_partkey, len(w)::bigint as n, w[1] as first, w[9] as none, list_contains(w, 'BRASS') as brass from (select p_partkey, string_split(p_type, ' ') as w from part)")
def list_functions(t):
    w = F.split("p_type", " ")
    return t.part.select("p_partkey", F.size(w).cast("long").alias("n"), F.try_element_at(w, F.lit(1)).alias("first"), F.try_element_at(w, F.lit(9)).alias("none"), F.array_contains(w, "BRASS").alias("brass"))


@query("select s.seg as seg, count(*) as n, round(sum(s.bal), 2) as total from (select {'seg': c_mktsegment, 'bal': c_acctbal} as s from customer) group by 1")
def struct_access(t):
    boxed = t.customer.select(F.struct(F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal")).alias("s"))
    return boxed.groupBy("s.seg").agg(F.count("*").alias("n"), F.round(F.sum("s.bal"), 2).alias("total"))


@query("select event_id, m['kind'] as kind, m['missing'] as missing from (select event_id, map {'kind': event_type, 'user': user_id::varchar} as m from events)")
def map_lookup(t):
    m = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    boxed = t.events.select("event_id", m.alias("m"))
    return boxed.select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["missing"].alias("missing"))


@query("select c_custkey, hex(encode(c_name)) as h, cast(octet_length(encode(c_name)) as bigint) as n from customer")
def binary_functions(t):
    raw = F.encode("c_name", "UTF-8")
    return t.customer.select("c_custkey", F.hex(raw).alias("h"), F.octet_length(raw).cast("long").alias("n"))


@query("select event_id, cast(props ->> '$.k' as bigint) as k from events")
def json_path_extract(t):
    return t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query("select event_id, unnest(from_json(json_extract(j, '$.items[*].sku')::varchar, '[\"VARCHAR\"]')) as sku from (select event_id, '{\"items\":[{\"sku\":\"A' || user_id || '\"},{\"sku\":\"B' || event_id || '\"}]}' as j from events)")
def json_array_explode(t):
    doc = F.concat(F.lit('{"items":[{"sku":"A'), "user_id", F.lit('"},{"sku":"B'), "event_id", F.lit('"}]}'))
    found = F.from_json(F.get_json_object(doc, "$.items[*].sku"), "array<string>")
    return t.events.select("event_id", F.explode(found).alias("sku"))


@query("select event_id, array_to_string(json_keys(props), ',') as keys, cast(json_array_length('[1,2,' || user_id || ']') as bigint) as n from events")
def json_keys_length(t):
    return t.events.select("event_id", F.array_join(F.json_object_keys("props"), ",").alias("keys"), F.json_array_length(F.concat(F.lit("[1,2,"), "user_id", F.lit("]"))).cast("long").alias("n"))


@query("select case when typeof(o_orderkey) = 'BIGINT' then 'bigint' end as a, case when typeof(o_totalprice) = 'DOUBLE' then 'double' end as b from orders limit 1")
def type_introspection(t):
    return t.orders.limit(1).select(F.typeof("o_orderkey").alias("a"), F.typeof("o_totalprice").alias("b"))
