"""Operators on small tables with values worked out by hand."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.functions import contracts, documents
from tidewater.operators import joins, reshape, warehouse, windows
from tidewater.operators.relation import Relation
from tidewater.plans import profile
from tidewater.sources import readers, writers
from tidewater.streaming import running


def values(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_asof(spark):
    prices = spark.createDataFrame([(1, date(2026, 1, 1), 100.0), (1, date(2026, 1, 10), 110.0), (None, date(2026, 1, 1), 5.0)], "pid int, since date, price double")
    orders = spark.createDataFrame([(1, date(2026, 1, d)) for d in (5, 10, 25)] + [(2, date(2026, 1, 5)), (1, date(2025, 1, 1)), (None, date(2026, 2, 1)), (1, None)], "pid int, day date")
    got = joins.asof_join(orders, prices, ["pid"], "day", "since", ["price"])
    assert sorted(values(got, "day", "price")) == [(date(2026, 1, 5), 100.0), (date(2026, 1, 10), 110.0), (date(2026, 1, 25), 110.0)]
    assert joins.asof_join(orders, prices, ["pid"], "day", "since", ["price"], inner=False).count() == 7


def test_checked_join(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert joins.checked_join(a, b, ["k"]).count() == 3
    with pytest.raises(joins.CardinalityError):
        joins.checked_join(b, a, ["k"], "many_to_one")


def test_weighted_bridge(spark):
    area = spark.createDataFrame([(0, "area_0"), (1, "area_1")], "area_id int, area_name string")
    operation = spark.createDataFrame([(1, 0), (2, 1)], "operation_id int, area_id int")
    contract = spark.createDataFrame([(1, 100), (2, -5)], "contract_id int, balance int")
    flow = spark.createDataFrame([(1, date(2026, 2, 1), Decimal("100.00")), (1, date(2020, 1, 1), Decimal("9.00")), (2, date(2026, 2, 1), Decimal("7.00"))], "contract_id int, flow_date date, amount decimal(12,2)")
    bridge = spark.createDataFrame([(1, 1, Decimal("0.3000")), (2, 1, Decimal("0.7000")), (1, 2, Decimal("1.0000"))], "operation_id int, contract_id int, factor decimal(5,4)")
    got = dict(values(joins.weighted_bridge(area, operation, bridge, contract, flow, "2026-01-01")))
    assert got == {"area_0": Decimal("30.0000"), "area_1": Decimal("70.0000")}


def test_running_spend(spark):
    df = spark.createDataFrame([(1, 1, 100.0), (1, 2, 450.0), (2, 3, 900.0), (1, 4, 1200.0), (None, 5, 50.0), (3, 6, None), (3, 7, 2000.0)], "c int, i int, v double")
    got = {r.i: (r.cumulative_spend, r.customer_tier) for r in windows.running_spend(df, "c", "v", ["i"]).collect()}
    assert got == {1: (100.0, "bronze"), 2: (550.0, "prata"), 3: (900.0, "prata"), 4: (1750.0, "prata"), 5: (None, None), 6: (None, None), 7: (2000.0, "ouro")}
    with pytest.raises(ValueError):
        windows.tier(F.lit(1), 5, 4)


def test_max_running_balance(spark):
    df = spark.createDataFrame([(1, 1, 100), (1, 2, -30), (1, 3, 50), (2, 1, 10), (2, 2, 5), (3, 1, -20), (3, 2, 5)], "a int, i int, v int").withColumn("v", F.col("v").cast("decimal(12,2)"))
    assert dict(values(windows.max_running_balance(df, "a", "v", ["i"]))) == {1: Decimal(120), 2: Decimal(15), 3: Decimal(0)}


@pytest.mark.parametrize("small", [20_000, 0])
def test_hierarchy(spark, small, monkeypatch):
    monkeypatch.setattr(reshape, "SMALL_TREE", small)
    tree = spark.createDataFrame([(10, "earth", None), (20, "alps", 10), (30, "peak", 20), (40, "mars", None), (50, "lost", 99), (60, "ring", 70), (70, "gnir", 60)], "id int, name string, parent_id int")
    flat = reshape.flatten_tree(tree, tree, sep="/")
    assert sorted(values(flat, "id", "level", "path")) == [(10, 0, "earth"), (20, 1, "earth/alps"), (30, 2, "earth/alps/peak"), (40, 0, "mars")]
    assert {r.id for r in reshape.subtree(flat, 20).collect()} == {20, 30}
    deep = spark.range(60).select("id", F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert reshape.flatten_tree(deep, deep).filter("id = 59").first().level == 59
    with pytest.raises(ValueError, match="levels"):
        reshape.flatten_tree(deep, deep, limit=40)


def test_pivot_unique_rejects(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6)], "r int, c string, v int")
    with pytest.raises(Exception, match="two values"):
        reshape.pivot_unique(df, "r", "c", ["a"], "v").collect()


def test_contracts(spark):
    df = spark.createDataFrame([(100000.0, 0.01, 120), (250000.0, 0.015, 240), (1.0, 0.0, 5), (1.0, 0.1, 0)], "p double, r double, n int")
    a, b = (F.col("p"), F.col("r"), F.col("n")), []
    for closed, loop, p, r, n in values(df.select(contracts.revenue(*a), contracts.revenue_by_month(*a), *a)):
        want = n * p * r / (1 - (1 + r) ** -n) - p if r > 0 and n > 0 else 0.0
        assert closed == pytest.approx(want, rel=1e-9) and loop == pytest.approx(want, rel=1e-9)
    with pytest.raises(Exception, match="must not be null"):
        spark.sql("select cast(null as double) p, 0.1D r, 3 n").select(contracts.revenue(*a)).collect()
    nested = spark.createDataFrame([(100.0, [0.01, 0.02], [12, 24, 99]), (100.0, [], [])], "p double, r array<double>, t array<int>")
    got = [x for (x,) in values(nested.select(contracts.tranche_revenue(F.col("p"), F.col("r"), F.col("t"))))]
    assert got == pytest.approx([100 * (1.01**12 - 1) + 70 * (1.02**24 - 1), 0.0])
    assert spark.range(1).select(F.round(contracts.compound(F.lit(1000.0), F.lit(0.01), F.lit(12)), 2)).first()[0] == 1126.83


def test_margin(spark):
    df = spark.createDataFrame([(8.0, Decimal("5.25"), bytearray(b"\x0a\x7f")), (42.6, Decimal("30.10"), bytearray(b"\xca\xfe\x00"))], "unit_price double, unit_cost decimal(12,2), sku binary")
    assert values(contracts.product_margin(df, Decimal(0)), "margin", "sku_hex") == [(Decimal("2.75"), "0a7f"), (Decimal("12.50"), "cafe00")]
    assert contracts.product_margin(df, Decimal("0.25")).first().margin == Decimal("0.75")
    with pytest.raises(TypeError):
        contracts.product_margin(df, 0.1)
    with pytest.raises(ValueError):
        contracts.product_margin(df, Decimal(1))


def test_all_types(spark):
    row = [("kelp", 6, 0.75, False, date(2025, 3, 15), datetime(2025, 7, 9, 8, 5), Decimal("80.00"), ["x", "yz"], ("reef", 9), {"tide": "low"}, bytearray(b"\x10\x20"))]
    df = spark.createDataFrame(row, "texto string, inteiro int, real double, logico boolean, dia date, instante timestamp_ntz, valor decimal(12,2), lista array<string>, estrutura struct<nome:string,n:int>, mapa map<string,string>, binario binary")
    out = documents.transform_types(df)
    assert [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    r = out.first()
    assert tuple(r)[:8] == ("KELP", 7, 1.5, True, date(2025, 4, 14), datetime(2025, 7, 9, 9, 5), Decimal("88.00"), ["X", "YZ"])
    assert (tuple(r.estrutura), r.mapa, bytes(r.binario)) == (("REEF", 18), {"tide": "LOW"}, b"\x20\x10")


def test_json(spark):
    docs = ['{"canal":"web","valor":12.34,"tags":["p","q","r"],"cliente":{"id":31}}', '{"canal":null,"valor":7.25}', '{"valor":null}', "{}", None]
    df = documents.as_json(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string"), "doc")
    got = [tuple(r)[1:] for r in documents.shred(df, "doc").orderBy("i").collect()]
    assert [(g[0], g[1], g[3], g[4], g[5]) for g in got] == [
        ("web", Decimal("12.34"), "presente", 3, 31), (None, Decimal("7.25"), "presente", None, None), (None, None, "nulo", None, None), (None, None, "ausente", None, None), (None, None, "ausente", None, None),
    ]
    with pytest.raises(ValueError):
        documents.normalize(spark.createDataFrame([("{}",)], "doc string"), "doc")
    for bad in ["[1]", "{oops", '{"valor":"x"}']:
        with pytest.raises(Exception):  # noqa: B017
            documents.shred(documents.as_json(spark.createDataFrame([(bad,)], "doc string"), "doc"), "doc").collect()


def test_upsert_and_keys(spark):
    old, new = spark.createDataFrame([(4, "ebb"), (5, "flow")], "k int, v string"), spark.createDataFrame([(4, "surge"), (6, "swell")], "k int, v string")
    assert dict(values(warehouse.upsert(old, new, ["k"], ["v"]))) == {4: "surge", 5: "flow", 6: "swell"}
    with pytest.raises(warehouse.ConstraintError):
        warehouse.upsert(old, new.union(new), ["k"], ["v"])
    keyed, high = warehouse.assign_keys(spark.range(1, 7).select(F.col("id").alias("n")), ["n"], 0)
    assert sorted(values(keyed, "n", "sk")) == [(i, i) for i in range(1, 7)] and high == 6
    added = warehouse.load_new(spark.createDataFrame([(3,), (999,)], "n long"), keyed, ["n"])
    assert values(added, "n", "sk") == [(999, 7)]


def test_versions(spark, tmp_path):
    table = warehouse.VersionedTable(spark, str(tmp_path / "t"))
    assert table.commit(spark.range(3)) == 1 and table.commit(spark.range(5)) == 2
    assert table.read().count() == 5 and table.read(1).count() == 3
    with pytest.raises(warehouse.ConflictError):
        table.commit(spark.range(1), based_on=1)
    assert table.read().count() == 5


def test_ddl():
    schema = warehouse.contract([("id", "long", False, "the key"), ("valor", "decimal(12,2)", True, "it's money")])
    text = warehouse.ddl("t", schema, ["id"])
    assert "id BIGINT NOT NULL" in text and "valor DECIMAL(12,2)" in text and "IS 'it''s money'" in text and "PRIMARY KEY (id)" in text


def test_csv_quarantine(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,valor\n1,10\n2,abc\n3,30\n")
    good, bad = readers.csv_quarantine(spark, str(tmp_path), StructType.fromDDL("id int, valor int"))
    assert values(good) == [(1, 10), (3, 30)] and values(bad) == [(2, "valor", "CAST", "abc", "2,abc")]


def test_reload_and_layout(spark, tmp_path):
    path, df = str(tmp_path / "p"), spark.range(100).select("id", (F.col("id") % 3).alias("m"))
    for _ in range(2):
        writers.overwrite_partitions(df, path, ["m"])
    writers.overwrite_partitions(df.filter("m = 1 and id < 50"), path, ["m"])
    assert dict(values(spark.read.parquet(path).groupBy("m").count())) == {0: 34, 1: 17, 2: 33}
    pruned = spark.read.parquet(path).filter("m = 1")
    assert any("m" in f for f in profile.pushed_filters(pruned)) and pruned.count() == 17
    rows = spark.range(100_000).select((F.col("id") % 100).alias("chave"), "id")
    sorted_, mixed = str(tmp_path / "s"), str(tmp_path / "u")
    writers.write_sorted(rows, sorted_, ["chave"], 2, 10_000)
    rows.repartition(2).write.option("parquet.block.row.count.limit", 10_000).parquet(mixed)
    skip = lambda p: readers.row_groups_skippable(readers.parquet_footers(spark, p), "chave", 42, 42).first()
    assert skip(sorted_).skippable >= skip(sorted_).groups - 2 and skip(mixed).skippable == 0


def test_reorganize(spark, tmp_path):
    df = spark.range(40_000).select("id", ((F.col("id") * 7919) % 10_007).cast("double").alias("x"))
    out = writers.reorganize(df, str(tmp_path / "r"), "x", "id", 8, 5_000)
    assert out.count() == 40_000 and out.agg(F.sum("x")).first() == df.agg(F.sum("x")).first()
    assert out.select("band").distinct().count() == 8
    assert writers.reorganize(df.withColumn("x", F.lit(1.0)), str(tmp_path / "one"), "x", "id", 8).select("band").distinct().count() == 1


def test_relation(spark, sf):
    r = Relation.parquet(spark, f"{sf}/orders.parquet")
    top = r.filter("o_totalprice > 1000").aggregate("count(*) as n", "o_orderstatus").order("n desc").limit(2)
    assert top.columns == ["o_orderstatus", "n"] and top.df.count() == 2
    assert r.query("o", "select count(*) as n from o").df.first().n == r.df.count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("o_")]


def test_streams(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = running.events(spark, str(tmp_path / "in"), 1)
    q = running.sessions(stream, late="400 days").writeStream.format("memory").queryName("gaps").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    gaps = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours")).agg(F.count("*").alias("n"))
    assert sorted(values(spark.table("gaps"))) == sorted(values(gaps.select("user_id", "session_window.start", "n")))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = running.running_spend(stream).writeStream.format("memory").queryName("spend").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("spend").groupBy("user_id").agg(F.max("cumulative_spend").alias("t"))
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.sum("value").alias("w"))
    assert last.join(want, "user_id").filter(F.abs(F.col("t") - F.col("w")) > 1e-6).count() == 0
    wrong = spark.table("spend").filter(F.col("customer_tier") != windows.tier(F.col("cumulative_spend")))
    assert wrong.isEmpty() and spark.table("spend").count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_plan_uses_native_operators(spark, sf):
    from tidewater.plans import registry

    names = profile.operators(registry.queries()["running_spend_tier"](spark, sf))
    assert "Window" in names and not any("Python" in n or "Pandas" in n for n in names)


def test_late_rows_are_dropped(spark, tmp_path):
    """Three batches: a row behind the watermark doesn't count, one within it does; closed windows come once."""
    rows = [[(1, "a", datetime(2025, 1, 1, 5), 1.0), (2, "a", datetime(2025, 1, 3, 5), 2.0)], [(3, "a", datetime(2025, 1, 1, 6), 100.0), (4, "a", datetime(2025, 1, 3, 4, 30), 4.0)], [(5, "a", datetime(2025, 1, 9), 8.0)]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, "event_id long, event_type string, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not i:
            stream = running.events(spark, str(tmp_path / "in"), 1)
        q = running.tumbling(stream, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(F.to_date("start").alias("d"), "n", "value")
    assert sorted(values(got)) == [(date(2025, 1, 1), 1, 1.0), (date(2025, 1, 3), 2, 6.0)]


def test_quantiles_and_places(spark, monkeypatch):
    from tidewater.operators import shape

    monkeypatch.setattr(shape, "FEW", 50)
    monkeypatch.setattr(shape, "PRECISION", 100)
    for rows in ([*range(5000)], [7.5] * 3000 + [1.0] * 2999, [1.0, 2.0], [float(i * i % 977) for i in range(4000)], [5.0]):
        df = spark.createDataFrame([(float(v),) for v in rows] + [(None,)], "v double")
        for q in (0.0, 0.25, 0.5, 0.95, 1.0):
            assert shape.exact_quantile(df, "v", q) == pytest.approx(df.agg(F.percentile("v", F.lit(q))).first()[0], rel=1e-12)
    assert shape.exact_quantile(df.limit(0), "v", 0.5) is None
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 % 10).alias("o"), "id")
    got = windows.place(df.unionByName(df.select(F.lit(None).cast("long").alias("k"), "o", "id")), ["k"], [F.desc("o"), F.col("id")])
    from pyspark.sql import Window

    assert got.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("o"), "id"))).filter("place != want").isEmpty() and got.count() == 2000


def test_footers_of_odd_files(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "none"))
    spark.range(1000).withColumn("x", F.array("id")).coalesce(1).write.parquet(str(tmp_path / "some"))
    assert readers.parquet_files(spark, str(tmp_path / "none")).agg(F.sum("rows")).first()[0] in (0, None)
    assert readers.parquet_files(spark, str(tmp_path / "some")).first().rows == 1000
    assert {(r.name, r.repetition) for r in readers.parquet_columns(spark, str(tmp_path / "some")).collect()} == {("id", "REQUIRED"), ("x.list.element", "REPEATED")}
    assert [r.column for r in readers.file_columns(spark, [str(tmp_path / "some")]).orderBy("place").collect()] == ["id", "x"]


def test_batch_reader(spark):
    import pyarrow as pa

    empty = readers.BatchReader(spark.range(0), 10)
    schema, batches = readers.enriched(empty, lambda b: b)
    assert schema.names == ["id"] and list(batches) == []
    calls = []
    schema, batches = readers.enriched(readers.BatchReader(spark.range(25), 10), lambda b: calls.append(b.num_rows) or pa.RecordBatch.from_pydict({"n": [b.num_rows]}))
    assert schema.names == ["n"] and calls == [10]
    assert [b.column(0)[0].as_py() for b in batches] == [10, 10, 5] and calls == [10, 10, 5]


def test_csv_sniffing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k;name\n1;x,y\n2;z\nn/a;w\n")
    got = readers.csv_infer(spark, str(tmp_path / "a.csv"))
    assert got.dtypes == [("k", "string"), ("name", "string")] and got.count() == 3
    (tmp_path / "b.csv").write_text("1,2.5\n2,3.5\n")
    assert [t for _, t in readers.csv_infer(spark, str(tmp_path / "b.csv")).dtypes] == ["int", "double"]
    (tmp_path / "c.csv").write_text("id,v\n1\n2,3,4\n3,\n4,\"x,y\"\n5,6\n")
    good, bad = readers.csv_quarantine(spark, str(tmp_path / "c.csv"), StructType.fromDDL("id int, v int"))
    assert sorted(values(good), key=str) == [(3, None), (5, 6)]
    assert sorted(values(bad, "line", "column_name", "error_type")) == [(1, "v", "MISSING COLUMNS"), (2, None, "TOO MANY COLUMNS"), (4, "v", "CAST")]


def test_database_rules(spark, tmp_path):
    from tidewater.operators.database import Database, DefinitionError, Table

    db = Database(spark, str(tmp_path / "db"))
    with db.transaction() as work:
        work.create("t", Table({"k": "int"}, primary_key=["k"]))
    for fault in (lambda w: w.create("t", Table({"k": "int"})), lambda w: w.create_index("i", "t", ["z"]), lambda w: w.add_column("t", "k", "int"), lambda w: w.insert("t", spark.range(1))):
        with pytest.raises(DefinitionError):
            with db.transaction() as work:
                fault(work)
    with pytest.raises(warehouse.ConstraintError, match="k"):
        with db.transaction() as work:
            work.insert("t", spark.createDataFrame([(1,), (1,)], "k int"))
    assert db.table("t").count() == 0 and db.version() == 1
    work = db.begin()
    work.insert("t", spark.createDataFrame([(5,)], "k int"))
    assert db.table("t").count() == 0 and work.table("t").count() == 1
    work.rollback()
    with pytest.raises(RuntimeError):
        work.commit()
    assert not [p for p in (tmp_path / "db" / "t").glob("*/*.parquet")]


def test_sessions_and_names(spark, sf):
    other = spark.newSession()
    a, b = Relation.parquet(spark, f"{sf}/nation.parquet"), Relation.parquet(other, f"{sf}/nation.parquet")
    with pytest.raises(ValueError, match="different sessions"):
        a.join(b, "n_nationkey")
    a.register("some_nations")
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        a.register("some_nations", replace=False)
    assert a.unregister("some_nations") and not a.unregister("some_nations")
    with pytest.raises(ValueError):
        warehouse.allowed("x; drop table y", ["x"])
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC" and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_bounded_writer(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    with pytest.raises(Exception):  # noqa: B017
        writers.CountedWriter(spark, str(tmp_path / "file" / "under"))
    sink = writers.CountedWriter(spark, str(tmp_path / "w"))
    sink.add(spark.range(7))
    assert sink.finish() == (str(tmp_path / "w"), 7)
    for again in (sink.finish, lambda: sink.add(spark.range(1))):
        with pytest.raises(RuntimeError):
            again()


def test_plan_reports(spark, sf, tmp_path):
    import json

    events = spark.read.parquet(f"{sf}/events.parquet")
    tree = profile.analyze(events.groupBy("event_type").count())
    assert json.loads(json.dumps(tree)) and any("Scan" in n["operator"] for n in profile.nodes(tree)) and tree["estimated_bytes"] > 0
    _, spill = profile.measured_spill(spark, lambda: events.repartition(3).count())
    assert spill["shuffle_written"] > 0 and spill["disk_spilled"] == 0
    assert profile.best_of(lambda: None) >= 0
    rows = spark.range(10_000).select((F.col("id") * 617 % 1009).alias("v"), (F.col("id") % 4).alias("f"), "id")
    assert writers.disorder(rows, "v", ["f", "id"]).first()[0] > 0.3 and writers.disorder(rows, "v", ["f", "v"]).first()[0] == 0.0
    writers.ipc_bytes(spark.range(5), stream=True).write.parquet(str(tmp_path / "ipc"))
    data = [bytes(r.content) for r in spark.read.parquet(str(tmp_path / "ipc")).collect()]
    for i, d in enumerate(data):
        (tmp_path / f"f{i}.arrow").write_bytes(d)
    assert sorted(r.id for r in readers.arrow_ipc(spark, str(tmp_path / "*.arrow"), "id long").collect()) == list(range(5))
