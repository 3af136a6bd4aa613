import io
import json
import math
import os

import pytest

from marlstone.cli import Prompt, main, render
from marlstone.config import EngineConfig
from marlstone.engine import Engine, equalities
from marlstone.errors import ExecutionError, InvalidConfigError, PlanningError, StorageError, UnsupportedError
from marlstone.functions import expr as E
from marlstone.functions.vector import cosine_similarity, dot_product, l2_distance
from marlstone.operators import retrieval
from marlstone.operators.relational import strategy_of
from marlstone.sources.catalog import Catalog, TableDef
from marlstone.sources.fixtures import made_documents, made_lineitem, made_orders
from marlstone.sources.tbl import convert_tbl
from marlstone.sources.writes import write_parquet


@pytest.fixture
def data(spark, tmp_path):
    frames = {
        "lineitem": spark.createDataFrame([(1, 10), (2, 20), (2, 21), (3, 30), (3, 31), (3, 32)], "l_orderkey long, l_partkey long"),
        "orders": spark.createDataFrame([(2, 100), (3, 200), (4, 300)], "o_orderkey long, o_custkey long"),
        "docs": spark.createDataFrame([(1, "doc-1", "en", [1.0, 0.0, 0.0]), (2, "doc-2", "en", [0.8, 0.2, 0.0]), (3, "doc-3", "de", [0.0, 1.0, 0.0])], "id long, title string, lang string, emb array<float>"),
    }
    for name, df in frames.items():
        write_parquet(df, str(tmp_path / name))
    return tmp_path


@pytest.fixture
def engine(spark, data):
    e = Engine(spark)
    for name in ("lineitem", "orders", "docs"):
        e.register_table(TableDef(name, uri=str(data / name)))
    yield e
    e.shutdown()


def values(frame):
    return sorted(map(tuple, frame.collect()))


def test_where_over_a_scan_is_applied(engine):
    assert values(engine.sql("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey = 2")) == [(2, 20), (2, 21)]


def test_join_and_aggregate(engine):
    j = engine.table("lineitem").join(engine.table("orders"), [("l_orderkey", "o_orderkey")])
    assert values(j.select("l_orderkey", "l_partkey", "o_custkey")) == [(2, 20, 100), (2, 21, 100), (3, 30, 200), (3, 31, 200), (3, 32, 200)]
    assert values(j.groupby("l_orderkey").agg(("count", "l_partkey", "n"))) == [(2, 2), (3, 3)]
    assert values(engine.table("lineitem").filter("l_orderkey = 9").agg(("count", "l_partkey", "n"), ("sum", "l_partkey", "s"))) == [(0, None)]


def test_null_keys_match_only_on_request(spark, engine):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k long, a long")
    b = spark.createDataFrame([(None, 3), (2, 4)], "j long, b long")
    from marlstone.engine import Frame

    left, right = Frame(engine, a), Frame(engine, b)
    assert values(left.join(right, [("k", "j")])) == [(2, 2, 2, 4)]
    assert len(left.join(right, [("k", "j")], null_safe=True).collect()) == 2
    with pytest.raises(PlanningError):
        left.join(right, [("k", "nowhere")])


def test_parameters(engine):
    assert len(engine.sql("SELECT l_partkey FROM lineitem WHERE l_partkey > :p LIMIT :k", {"p": 10, "k": 3}).collect()) == 3
    with pytest.raises(PlanningError):
        engine.sql("SELECT l_partkey FROM lineitem LIMIT :k")
    with pytest.raises(PlanningError):
        engine.sql("SELECT nowhere FROM lineitem")
    assert values(engine.sql("SELECT ':x' AS a FROM orders LIMIT 1")) == [(":x",)]


def test_grouped_aggregates(spark):
    rows = [(f"group_{g}", (j * (g + 3)) % 23 - 7) for g in range(7) for j in range(120)]
    df = spark.createDataFrame(rows, "k string, v long")
    from marlstone.operators.relational import aggregate

    got = sorted(map(tuple, aggregate(df, ["k"], [("count", "v", "n"), ("sum", "v", "s"), ("min", "v", "a"), ("max", "v", "b"), ("avg", "v", "m")]).collect()))
    assert [r[2] for r in got] == [455, 465, 475, 462, 472, 459, 469]
    assert {(r[1], r[3], r[4]) for r in got} == {(120, -7, 15)}
    assert [r[5] for r in got] == [r[2] / 120 for r in got]


def test_kernels(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [-1.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0]), (5, None)], "id long, v array<float>")
    assert [r[0] for r in df.orderBy("id").select(cosine_similarity(df.v, [1, 0, 0])).collect()] == [1, 0, -1, 0, None]
    two = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [-1.0, 0.0, 0.0])], "id long, v array<float>")
    assert [r[0] for r in two.orderBy("id").select(l2_distance(two.v, [1, 0, 0])).collect()] == pytest.approx([math.sqrt(13), 2])
    three = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [-1.0, 0.5, 0.0]), (3, None)], "id long, v array<float>")
    assert [r[0] for r in three.orderBy("id").select(dot_product(three.v, [1, -1, 0.5])).collect()] == [0.5, -1.5, None]
    with pytest.raises(Exception, match="dimension"):
        two.select(dot_product(two.v, [1, 2])).collect()


def test_topk(engine, spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None)], "id long, v array<float>")
    assert [r["id"] for r in retrieval.topk_similar(df, "v", [1, 0, 0], 2, tie="id").collect()] == [2, 1]
    assert [r["id"] for r in retrieval.topk_similar(df, "v", [1, 0, 0], 9, "l2", "id").collect()] == [1, 2, 3]
    assert retrieval.topk_similar(df, "v", [1, 0, 0], 0).collect() == []
    scored = engine.sql("SELECT id, cosine_similarity(emb, :q) AS s FROM docs WHERE lang = :l ORDER BY cosine_similarity(emb, :q) DESC LIMIT 1", {"q": [0.0, 1.0, 0.0], "l": "de"})
    assert values(scored) == [(3, 1.0)]
    found = engine.sql("SELECT id, title FROM docs ORDER BY cosine_similarity(emb, :q) DESC LIMIT 2", {"q": [1.0, 0.0, 0.0]})
    assert [r["id"] for r in found.collect()] == [1, 2]


INDEX = json.dumps([{"id": 2, "score": 0.99}, {"id": 1, "score": 0.95}, {"id": 3, "score": 0.1}])


def test_index_and_two_phase(engine, data):
    engine.register_table(TableDef("docs_idx", format="index", options={"vector.mock_rows_json": INDEX}))
    q = {"q": [1.0, 0.0, 0.0]}
    direct = engine.sql("SELECT id, score FROM docs_idx ORDER BY cosine_similarity(emb, :q) DESC LIMIT 2", q)
    assert [r["id"] for r in direct.collect()] == [2, 1] and "rewrite=index_applied" in direct.explain()
    engine.register_table(TableDef("docs", uri=str(data / "docs"), options={"vector.index_table": "docs_idx"}))
    two = engine.sql("SELECT id, title FROM docs WHERE lang = 'en' ORDER BY cosine_similarity(emb, :q) DESC LIMIT 1", q)
    assert [r["id"] for r in two.collect()] == [1] and "rewrite=two_phase" in two.explain()
    engine.register_table(TableDef("docs", uri=str(data / "docs"), options={"vector.index_table": "none"}))
    assert "rewrite=index_fallback" in engine.sql("SELECT id FROM docs ORDER BY cosine_similarity(emb, :q) DESC LIMIT 1", q).explain()
    with pytest.raises(UnsupportedError):
        engine.sql("SELECT title FROM docs_idx ORDER BY cosine_similarity(emb, :q) DESC LIMIT 1", q)
    assert (retrieval.prefetch_k(5), retrieval.prefetch_k(5, 4, 12), retrieval.prefetch_k(5, 4, 2), retrieval.prefetch_k(5, 0)) == (20, 12, 5, 5)


def test_equalities():
    assert equalities("lang = 'en' AND n = -3 and b = true") == [("lang", "en"), ("n", -3), ("b", True)]
    assert equalities("a > 3") is None and equalities("a = 'x' OR b = 1") is None


def test_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long").coalesce(1)
    folder = str(tmp_path / "t")
    write_parquet(df, folder)
    assert sorted(os.listdir(folder)) == ["part-00000.parquet"]
    write_parquet(df, folder, "append")
    assert sorted(os.listdir(folder)) == ["part-00000.parquet", "part-00001.parquet"]
    assert spark.read.parquet(folder).count() == 6
    write_parquet(df.limit(1), folder, "overwrite")
    assert spark.read.parquet(folder).count() == 1
    single = str(tmp_path / "one.parquet")
    write_parquet(df, single)
    assert os.path.isfile(single)
    with pytest.raises(UnsupportedError):
        write_parquet(df, single, "append")
    with pytest.raises(InvalidConfigError):
        write_parquet(df, folder, "upsert")


def test_overwrite_of_what_the_plan_reads_and_failure(spark, tmp_path):
    folder = str(tmp_path / "t")
    write_parquet(spark.range(5).toDF("a"), folder)
    write_parquet(spark.read.parquet(folder).where("a > 1"), folder)
    assert spark.read.parquet(folder).count() == 3
    bad = spark.read.parquet(folder).selectExpr("a", "if(a >= 2, raise_error('no'), 1) as b")
    with pytest.raises(Exception):
        write_parquet(bad, folder)
    assert spark.read.parquet(folder).count() == 3 and os.listdir(tmp_path) == ["t"]


def test_save_as_table_and_restart(spark, data, tmp_path):
    path = str(tmp_path / "catalog.json")
    e = Engine(spark, EngineConfig(catalog_path=path))
    e.register_table(TableDef("lineitem", uri=str(data / "lineitem")))
    e.table("lineitem").save_as_table("kept")
    e.table("lineitem").save_as_table("kept", "append")
    again = Engine(spark, EngineConfig(catalog_path=path))
    assert again.table("kept").df.count() == 12 and again.table_schema("kept")[0] == ("l_orderkey", "bigint")


def test_insert(spark, engine, tmp_path):
    folder = str(tmp_path / "target")
    write_parquet(spark.createDataFrame([(0, 0.5)], "a long, b double"), folder)
    engine.register_table(TableDef("target", uri=folder))
    engine.sql("INSERT INTO target SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey = 2")
    engine.sql("INSERT INTO target (b, a) SELECT l_partkey, l_orderkey FROM lineitem WHERE l_orderkey = 1")
    assert values(engine.table("target")) == [(0, 0.5), (1, 10.0), (2, 20.0), (2, 21.0)]
    for bad in ("INSERT INTO target SELECT l_orderkey FROM lineitem", "INSERT INTO target SELECT title, lang FROM docs", "INSERT INTO target (a, z) SELECT 1, 2"):
        with pytest.raises(PlanningError):
            engine.sql(bad)


def test_widening_and_strict(spark, tmp_path):
    write_parquet(spark.createDataFrame([(1,)], "v int"), str(tmp_path / "a.parquet"))
    write_parquet(spark.createDataFrame([(2**40,)], "v long"), str(tmp_path / "b.parquet"))
    paths = [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")]
    e = Engine(spark)
    e.register_table(TableDef("w", paths=paths))
    assert e.table_schema("w") == [("v", "bigint")] and values(e.table("w")) == [(1,), (2**40,)]
    with pytest.raises(PlanningError):
        Engine(spark, EngineConfig(schema_inference="strict")).register_table(TableDef("w", paths=paths))
    with pytest.raises(PlanningError):
        Engine(spark, EngineConfig(schema_inference="off")).register_table(TableDef("w", paths=paths))
    write_parquet(spark.createDataFrame([(1.5,)], "v float"), str(tmp_path / "c.parquet"))
    e.register_table(TableDef("x", paths=[paths[0], str(tmp_path / "c.parquet")]))
    assert values(e.table("x")) == [(1.0,), (1.5,)]
    with pytest.raises(StorageError):
        e.register_table(TableDef("gone", uri=str(tmp_path / "nothing")))


@pytest.mark.parametrize("policy", ["refresh", "fail"])
def test_drift(spark, tmp_path, policy):
    folder = str(tmp_path / "t")
    write_parquet(spark.createDataFrame([(1, "a")], "id long, name string"), folder)
    e = Engine(spark, EngineConfig(schema_drift=policy))
    e.register_table(TableDef("t", uri=folder))
    write_parquet(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, city string"), folder)
    if policy == "fail":
        with pytest.raises(PlanningError):
            e.sql("SELECT id FROM t")
    else:
        assert values(e.sql("SELECT id, city FROM t")) == [(1, "x"), (2, "y")]
        assert e.table_schema_with_origin("t")[1] == "inferred"


def test_catalog_files(tmp_path):
    for name in ("c.json", "c.toml"):
        c = Catalog()
        c.register(TableDef("t", uri="/x", schema=[("a", "bigint")], rows=3, options={"vector.index_table": "i"}))
        c.save(str(tmp_path / name))
        assert Catalog(str(tmp_path / name)).get("t") == c.get("t")
    (tmp_path / "bad.json").write_text('[{"name": "t", "uri": "/x", "format": "csv"}]')
    with pytest.raises(InvalidConfigError):
        Catalog(str(tmp_path / "bad.json"))
    with pytest.raises(PlanningError):
        Catalog().get("t")


def test_config_and_strategy(monkeypatch):
    monkeypatch.setenv("MARLSTONE_SCHEMA_DRIFT", "fail")
    assert EngineConfig().schema_drift == "fail"
    monkeypatch.setenv("MARLSTONE_SCHEMA_DRIFT", "maybe")
    with pytest.raises(InvalidConfigError):
        EngineConfig()
    assert (strategy_of(100, 10**7, 1000), strategy_of(10**7, 100, 1000), strategy_of(None, None, 1000), strategy_of(5, 5, 10)) == ("broadcast_left", "broadcast_right", "shuffle", "broadcast_left")


def test_errors_and_metrics(engine):
    with pytest.raises(ExecutionError):
        engine.sql("SELECT 1 / (l_orderkey - l_orderkey) AS x FROM lineitem").collect()
    engine.table("orders").collect()
    text = engine.prometheus_metrics()
    assert 'marlstone_rows_out_total{operator="collect"} 3' in text and "marlstone_failures_total" in text


def test_prompt_and_command(engine, capsys, spark, data, tmp_path):
    out = io.StringIO()
    Prompt(engine, io.StringIO("\\tables\n\\schema orders\n\\mode csv\nSELECT o_custkey FROM orders\nWHERE o_orderkey = 2;\n\\plan SELECT o_custkey FROM orders\n\\timing on\nSELECT nothing FROM orders;\n\\q\n"), out).cmdloop()
    text = out.getvalue()
    assert "lineitem" in text and "o_custkey bigint" in text and "o_custkey\n100" in text and "Physical Plan" in text and "PlanningError" in text
    assert render(["a"], [(None,)], "json") == '[{"a": "NULL"}]'
    path = str(tmp_path / "cat.json")
    Catalog().save(path)
    c = Catalog()
    c.register(TableDef("orders", uri=str(data / "orders")))
    c.save(path)
    assert main(["query", "--sql", "SELECT o_custkey FROM orders WHERE o_orderkey = 3", "--catalog", path, "--mode", "csv"]) == 0
    assert capsys.readouterr().out == "o_custkey\n200\n"
    assert main(["SELECT 1 AS one"]) == 0 and main(["--plan", "SELECT 1 AS one"]) == 0 and main(["SELECT nothing"]) == 1


def test_expressions_and_fixtures(spark, tmp_path):
    df = spark.range(3).where(E.and_(E.or_(E.eq(E.col("id"), E.lit_i64(1)), E.eq(E.col("id"), E.lit_i64(2))), E.not_(E.lit_bool(False))))
    assert [tuple(r) for r in df.select(E.div(E.col("id"), E.lit_f64(2)), E.lit_str("x")).collect()] == [(0.5, "x"), (1.0, "x")]
    assert made_orders(spark, 20, 5).collect() == made_orders(spark, 20, 5).collect()
    assert made_lineitem(spark, 30, 20).count() == 30
    row = made_documents(spark, 5).where("id = 5").first()
    assert len(row["emb"]) == 64 and row["lang"] == "de"
    assert row["emb"][0] == pytest.approx((math.sin(5 * 31 + 42) + math.cos(5 * 31 + 42)) / 2, abs=1e-6)


def test_tbl(spark, tmp_path):
    (tmp_path / "customer.tbl").write_text("1|Customer#1|addr|15|25-989|711.56|BUILDING|text|\n")
    (tmp_path / "orders.tbl").write_text("1|370|O|172799.49|1996-01-02|5-LOW|Clerk#1|0|text|\n")
    (tmp_path / "lineitem.tbl").write_text("1|155190|7706|1|17|21168.23|0.04|0.02|N|O|1996-03-13|1996-02-12|1996-03-22|DELIVER|TRUCK|text|\n")
    made = convert_tbl(spark, str(tmp_path), str(tmp_path / "out"))
    assert tuple(spark.read.parquet(made["customer"][0]).first()) == (1, "BUILDING")
    assert tuple(spark.read.parquet(made["orders"][0]).first()) == (1, 370, "1996-01-02", 0)
    assert tuple(spark.read.parquet(made["lineitem"][0]).first()) == (1, 17.0, 21168.23, 0.04, 0.02, "N", "O", "1996-03-13")


def test_tbl_is_converted_by_many_tasks(spark, tmp_path):
    """No task reads the whole text: each of its splits becomes a file."""
    (tmp_path / "orders.tbl").write_text("".join(f"{i}|{i % 7}|O|1.5|1996-01-02|5-LOW|Clerk#1|0|text|\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        made = convert_tbl(spark, str(tmp_path), str(tmp_path / "out"), ("orders",))["orders"]
        rows = spark.read.parquet(*made)
        assert len(made) > 3 and max(spark.read.parquet(p).count() for p in made) < 1000
        assert sorted(map(tuple, rows.collect())) == [(i, i % 7, "1996-01-02", 0) for i in range(2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_appending_to_a_table_that_lies_elsewhere_keeps_its_rows(spark, data, tmp_path):
    path = str(tmp_path / "catalog.json")
    e = Engine(spark, EngineConfig(catalog_path=path))
    e.register_table(TableDef("lineitem", uri=str(data / "lineitem")))
    for n in (9, 12):
        engine_rows = e.sql("SELECT * FROM lineitem WHERE l_orderkey = 3 LIMIT 3")
        engine_rows.save_as_table("lineitem", "append")
        assert len(e.table("lineitem").collect()) == n
        assert len(Engine(spark, EngineConfig(catalog_path=path)).table("lineitem").collect()) == n


def test_parameters_stay_out_of_quotes(engine):
    frame = engine.sql("SELECT title FROM docs WHERE title <> 'see :q now' AND lang = :l ORDER BY cosine_similarity(emb, :q) DESC LIMIT 1 -- :none", {"q": [1.0, 0.0, 0.0], "l": "de"})
    assert values(frame) == [("doc-3",)]
    assert values(engine.sql("SELECT ':a' AS x, `o_custkey` AS y FROM orders WHERE o_orderkey = :a", {"a": 2})) == [(":a", 100)]
    with pytest.raises(PlanningError):
        engine.sql("SELECT id FROM docs WHERE lang = :unknown ORDER BY cosine_similarity(emb, :q) DESC LIMIT 1", {"q": [1.0, 0.0, 0.0]})


@pytest.mark.parametrize(
    "text",
    [
        "SELECT id, title FROM docs d WHERE d.lang = 'en' ORDER BY cosine_similarity(d.emb, :q) DESC LIMIT 1",
        "select docs.id, docs.title from docs where lang = :l order by cosine_similarity(docs.emb, :q) desc limit :k;",
        "SELECT id, title, cosine_similarity(emb, :q) AS s FROM docs WHERE lang = 'en' ORDER BY s DESC LIMIT 1",
        "SELECT id, upper(title) AS title FROM docs AS x WHERE x.lang = 'en' ORDER BY cosine_similarity(x.emb, :q) DESC LIMIT 1",
    ],
)
def test_forms_of_a_vector_query(engine, data, text):
    engine.register_table(TableDef("docs_idx", format="index", options={"vector.mock_rows_json": INDEX}))
    engine.register_table(TableDef("docs", uri=str(data / "docs"), options={"vector.index_table": "docs_idx"}))
    found = engine.sql(text.rstrip(";"), {"q": [1.0, 0.0, 0.0], "l": "en", "k": 1})
    assert found.rewrite == "two_phase" and found.collect()[0]["id"] == 1


def test_other_statements_are_not_taken_for_vector_queries(engine):
    from marlstone.plans.rewrite import vector_topk

    q = {"q": [1.0]}
    for text in ("SELECT id FROM docs ORDER BY cosine_similarity(emb, :q) LIMIT 1", "SELECT id FROM docs, orders ORDER BY cosine_similarity(emb, :q) DESC LIMIT 1", "SELECT count(*) FROM docs WHERE cosine_similarity(emb, :q) > 0", "SELECT id FROM docs ORDER BY cosine_similarity(emb, :q) DESC, id LIMIT 1", "SELECT FROM WHERE cosine_similarity"):
        assert vector_topk(engine.spark, text, q) is None


def test_a_failed_append_leaves_nothing(spark, tmp_path, monkeypatch):
    from marlstone.sources.files import Files

    folder, df = str(tmp_path / "t"), spark.range(6).repartition(3)
    write_parquet(df, f"file:{folder}")
    before, move, moved = sorted(os.listdir(folder)), Files.move, []

    def failing(self, source, target):
        moved.append(target)
        if len(moved) == 3:
            raise OSError("no")
        move(self, source, target)

    monkeypatch.setattr(Files, "move", failing)
    with pytest.raises(StorageError):
        write_parquet(df, f"file:{folder}", "append")
    assert sorted(os.listdir(folder)) == before and os.listdir(tmp_path) == ["t"]


def test_catalog_sizes_choose_the_broadcast_side(spark, data):
    e = Engine(spark, EngineConfig(broadcast_threshold_bytes=10**6))
    e.register_table(TableDef("lineitem", uri=str(data / "lineitem"), bytes=10**9))
    e.register_table(TableDef("orders", uri=str(data / "orders"), bytes=1))
    e.table("lineitem").collect()
    plan = e.table("orders").join(e.table("lineitem"), [("o_orderkey", "l_orderkey")]).explain()
    assert "BroadcastHashJoin Inner BuildLeft" in plan
    assert e.table("orders").bytes > 1  # the files are larger than the catalog says
    assert e.table("orders").select("o_custkey").bytes is None


def test_metrics_of_operators(engine):
    engine.table("lineitem").join(engine.table("orders"), [("l_orderkey", "o_orderkey")], "shuffle").groupby("l_orderkey").agg(("count", "l_partkey", "n")).collect()
    text = engine.prometheus_metrics()
    for name in ("operator_rows", "scan_files", "scan_bytes", "shuffle_bytes_written", "shuffle_rows_written", "shuffle_rows_read"):
        assert f"marlstone_{name}_total{{" in text, name
    assert 'marlstone_shuffle_rows_written_total{operator="Exchange"} 9' in text


def test_manifest_of_fixtures(spark, tmp_path):
    from marlstone.sources.fixtures import write_fixtures

    sizes = {"customers": 20, "orders": 50, "lines": 120, "documents": 10}
    one = write_fixtures(spark, str(tmp_path / "a"), **sizes)
    assert one == write_fixtures(spark, f"file:{tmp_path}/b", **sizes) == json.loads((tmp_path / "b" / "manifest.json").read_text())
    assert one != write_fixtures(spark, str(tmp_path / "c"), **sizes, seed=2)
    assert {k: v["rows"] for k, v in one["tables"].items()} == {"customer": 20, "orders": 50, "lineitem": 120, "docs": 10}
    line = spark.read.parquet(str(tmp_path / "a" / "lineitem.parquet"))
    assert line.where("l_orderkey between 1 and 50 and l_quantity between 1 and 50 and l_discount between 0 and 0.1").count() == 120


def test_config_of_a_session(monkeypatch):
    monkeypatch.setenv("MARLSTONE_MEMORY_BYTES", str(2 << 30))
    assert EngineConfig(spill_dir="/tmp/x").memory_bytes == 2 << 30
    with pytest.raises(InvalidConfigError):
        monkeypatch.setenv("MARLSTONE_MEMORY_BYTES", "0")
        EngineConfig()


def test_unchanged_files_are_not_read_again(spark, data, monkeypatch):
    e = Engine(spark)
    e.register_table(TableDef("orders", uri=str(data / "orders")))
    opened = []
    monkeypatch.setattr(Engine, "_open", lambda self, t: opened.append(t.name))
    e.sql("SELECT * FROM orders")
    assert opened == []
