"""Queries: definitions, catalogs, transactions, sequences, attached databases and prepared statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import database, warehouse
from tidewater.operators.database import Database, Table
from tidewater.operators.warehouse import ConflictError, ConstraintError
from tidewater.plans.registry import query
from tidewater.plans.storage import folder


def shop(t) -> Database:
    """Customers by a definition with constraints, defaults and a computed column."""
    db = Database(t.spark, folder(t))
    spec = Table(
        {"id": "bigint", "name": "string", "balance": "double", "state": "string"}, not_null=["name"], primary_key=["id"], unique=[["name"]],
        checks={"balance": "balance > -100000"}, defaults={"state": "'new'"}, generated={"label": "concat(id, '/', state)"},
    )
    with db.transaction() as work:
        work.create("clients", spec)
        work.insert("clients", t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    return db


@query("select c_custkey as id, c_name as name, c_acctbal as balance, 'new' as state, c_custkey || '/new' as label from customer")
def create_table(t):
    return shop(t).table("clients")


@query("select c_mktsegment as segment, count(*) as n from customer where c_acctbal > 0 group by 1")
def create_table_as(t):
    db = Database(t.spark, folder(t))
    with db.transaction() as work:
        work.create_as("segments", t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")))
        work.create_as("segments", t.customer.limit(0), if_not_exists=True)
        work.create_as("segments", t.customer.filter("c_acctbal > 0").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")), or_replace=True)
    return db.table("segments")


@query("select c_nationkey as nation, count(*) as n from customer group by 1")
def create_view(t):
    db = Database(t.spark, folder(t))
    with db.transaction() as work:
        work.create_as("people", t.customer.select("c_custkey", "c_nationkey"))
        work.create_view("by_nation", "select c_nationkey as nation, count(*) as n from people group by 1")
    return db.table("by_nation")


@query("select c_custkey as id, case when c_custkey % 2 = 0 then 'old' else 'late' end as origin, case when c_custkey % 2 = 1 then null else 1 end::int as score from customer")
def alter_add_column(t):
    """Rows written before the column have its default; later ones their own value, nulls too."""
    db = Database(t.spark, folder(t))
    with db.transaction() as work:
        work.create("c", Table({"id": "bigint"}))
        work.insert("c", t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")))
        work.add_column("c", "origin", "string", "'old'")
        work.add_column("c", "score", "int", "1")
        work.insert("c", t.customer.filter("c_custkey % 2 = 1").select(F.col("c_custkey").alias("id"), F.lit("late").alias("origin"), F.lit(None).cast("int").alias("score")))
        work.create_index("c_origin", "c", ["origin"])
    return db.table("c")


@query("""select * from (values ('clients', 'CHECK', 'balance > -100000'), ('clients', 'INDEX', 'balance'), ('clients', 'NOT NULL', 'name'), ('clients', 'PRIMARY KEY', 'id'), ('clients', 'UNIQUE', 'name'),
('clients', 'column 1', 'id bigint'), ('clients', 'column 2', 'name string'), ('clients', 'column 3', 'balance double'), ('clients', 'column 4', 'state string'), ('clients', 'column 5', 'label generated'),
('clients', 'TABLE', '5'), ('rich', 'VIEW', 'select * from clients where balance > 9000'), ('keys', 'SEQUENCE', '9'), ('main', 'DATABASE', 'false'), ('archive', 'DATABASE', 'true')) v(name, kind, text)""")
def catalog_listing(t):
    db = shop(t)
    db.attach("archive", folder(t), read_only=True)
    with db.transaction() as work:
        work.create_view("rich", "select * from clients where balance > 9000")
        work.create_index("clients_balance", "clients", ["balance"])
        work.create_sequence("keys", 10)
    parts = [
        db.listing("constraints").select(F.col("table").alias("name"), "kind", "text"),
        db.listing("indexes").select("table", F.lit("INDEX"), "columns"),
        db.listing("columns").select("table", F.concat(F.lit("column "), "place"), F.concat("column", F.lit(" "), "type")),
        db.listing("tables").select("name", F.lit("TABLE"), F.col("columns").cast("string")),
        db.listing("views").select("name", F.lit("VIEW"), "sql"),
        db.listing("sequences").select("name", F.lit("SEQUENCE"), F.col("value").cast("string")),
        db.listing("databases").select("name", F.lit("DATABASE"), F.col("read_only").cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("select c_custkey as id, s_name as supplier from customer join supplier on c_nationkey = s_nationkey where s_suppkey <= 10")
def attach_database(t):
    """A join and a load across two databases; one attached for reading only refuses writes."""
    main, other = Database(t.spark, folder(t)), Database(t.spark, folder(t))
    with other.transaction() as work:
        work.create_as("suppliers", t.supplier)
    with main.transaction() as work:
        work.create_as("clients", t.customer)
    side = main.attach("store", other.root, read_only=True)
    try:
        with side.transaction() as work:
            work.drop("suppliers")
    except PermissionError:
        return main.sql("select c_custkey as id, s_name as supplier from clients join store.suppliers on c_nationkey = s_nationkey where s_suppkey <= 10")


@query("select c_custkey as id, c_acctbal + 1 as balance from customer")
def transactions(t):
    """Of four pieces of work one commits: one fails, one breaks a constraint, one began from a state that is gone."""
    db = Database(t.spark, folder(t))
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    with db.transaction() as work:
        work.create("a", Table({"id": "bigint", "balance": "double"}, primary_key=["id"]))
        work.create("b", Table({"id": "bigint", "balance": "double"}))
        work.insert("a", rows)
    late = db.begin()
    late.overwrite("a", rows.limit(1))
    try:
        with db.transaction() as work:
            work.overwrite("a", rows.limit(0))
            raise RuntimeError("changed my mind")
    except RuntimeError:
        pass
    try:
        with db.transaction() as work:
            work.insert("a", rows)
    except ConstraintError:
        pass
    with db.transaction() as work:  # both tables at once
        work.insert("b", work.table("a").withColumn("balance", F.col("balance") + 1))
        work.overwrite("a", rows.limit(0))
    try:
        late.commit()
    except ConflictError:
        return db.table("b").unionByName(db.table("a"))


@query("select * from (values (1::bigint, 5::bigint), (2, 6), (3, 7)) v(call, value)")
def sequences(t):
    db = Database(t.spark, folder(t))
    with db.transaction() as work:
        work.create_sequence("keys", 5)
    rows = [(i, db.nextval("keys")) for i in (1, 2, 3)]
    assert db.currval("keys") == rows[-1][1]
    return t.spark.createDataFrame(rows, "call long, value long")


@query("select 'F' as status, count(*) as n from orders where o_orderstatus = 'F' and o_totalprice > 100000 union all select 'O', count(*) from orders where o_orderstatus = 'O' and o_totalprice > 200000.5")
def prepare_execute(t):
    t.orders.createOrReplaceTempView("prepared_orders")
    ask = database.Prepared(t.spark, "select first(o_orderstatus) as status, count(*) as n from prepared_orders where o_orderstatus = ? and o_totalprice > ?")
    return ask.execute("F", 100_000.0).union(ask.execute("O", 200_000.5))


@query("select * from (values (1::bigint, 'one', 1.5::double), (2, null, 2.5), (3, 'it''s; drop', null)) v(id, name, x)")
def executemany(t):
    db = Database(t.spark, folder(t))
    with db.transaction() as work:
        work.create("v", Table({"id": "bigint", "name": "string", "x": "double"}))
        work.insert_many("v", [(1, "one", 1.5), (2, None, 2.5), (3, "it's; drop", None)])
    return db.table("v")


@query("select * from (values ('create table a (k bigint not null, primary key (k))', true), ('create table a (k bigint) partitioned by (k)', false), ('create table a (k bigint) stored as parquet', false), ('create table a (k bigint) location ''/x''', false), ('create table a (k bigint) clustered by (k) into 4 buckets', false), ('create table a (k bigint identity)', false), ('create table a (k bigint, d bigint generated always as (k * 2) stored)', false)) v(ddl, accepted)")
def portable_ddl(t):
    texts = ["create table a (k bigint not null, primary key (k))", "create table a (k bigint) partitioned by (k)", "create table a (k bigint) stored as parquet", "create table a (k bigint) location '/x'", "create table a (k bigint) clustered by (k) into 4 buckets", "create table a (k bigint identity)", "create table a (k bigint, d bigint generated always as (k * 2) stored)"]

    def accepted(text: str) -> bool:
        try:
            return bool(database.portable(text))
        except database.DefinitionError:
            return False

    return t.spark.createDataFrame([(x, accepted(x)) for x in texts], "ddl string, accepted boolean")


@query("select * from (values ('events', 'id', 'bigint'), ('events', 'at', 'timestamp'), ('people', 'id', 'bigint'), ('people', 'name', 'string')) v(\"table\", \"column\", type)")
def sink_create_all(t):
    db = Database(t.spark, folder(t))
    contracts = {"people": warehouse.contract([("id", "bigint", False, "who"), ("name", "string", True, "their name")]), "events": warehouse.contract([("id", "bigint", False, "what"), ("at", "timestamp", True, "when")])}
    database.create_all(db, contracts, {"people": ["id"]})
    return db.listing("columns").select("table", "column", "type")


@query("select n_nationkey, case n_regionkey when 0 then 'south' when 1 then 'west' when 2 then 'east' else 'other' end as side from nation")
def join_lookup_dict(t):
    sides = F.create_map(*[F.lit(x) for pair in {0: "south", 1: "west", 2: "east"}.items() for x in pair])
    return t.nation.select("n_nationkey", F.coalesce(F.try_element_at(sides, F.col("n_regionkey").cast("int")), F.lit("other")).alias("side"))


@query("select o_orderstatus as value, count(*) as n from orders group by 1")
def identifier_allowlist(t):
    column = warehouse.allowed("o_orderstatus", ["o_orderstatus", "o_orderpriority"])
    t.orders.createOrReplaceTempView("listed_orders")
    return t.spark.sql("select identifier(:c) as value, count(*) as n from listed_orders group by 1", {"c": column})
