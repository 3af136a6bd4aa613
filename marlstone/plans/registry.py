"""The registered queries over the engine's own operators, and their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.config import EngineConfig
from marlstone.engine import Engine
from marlstone.functions.vector import cosine_similarity, dot_product, l2_distance, register_functions
from marlstone.operators import relational, retrieval
from marlstone.sources.catalog import TableDef
from marlstone.sources.tbl import COLUMNS, convert_tbl
from marlstone.sources.writes import write_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A fixed query vector of the embeddings' dimension: (d mod 7 - 3) / 10.
QUERY = [(d % 7 - 3) / 10 for d in range(64)]
DUCK_QUERY = "[((d % 7 - 3) / 10.0)::FLOAT for d in range(64)]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    """Register a function under its name, with its DuckDB SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def same(name: str, sql: str, *tables: str, args: dict | None = None, duck: str | None = None) -> None:
    """Register SQL that both engines run alike over the tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, args=args, **{t: table(spark, sf_dir, t) for t in tables}) if not args else _with_views(spark, sf_dir, sql, tables, args)

    text = duck or sql
    for t in tables:
        text = text.replace(f"{{{t}}}", t)
    QUERIES[name], SQL[name] = run, text


def _with_views(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...], args: dict) -> DataFrame:
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(f"marlstone_{t}")
        sql = sql.replace(f"{{{t}}}", f"marlstone_{t}")
    return spark.sql(sql, args=args)


same("scan_project", "SELECT o_orderkey, o_custkey, o_orderpriority FROM {orders}", "orders")
same("scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity > 45 AND l_returnflag = 'R'", "lineitem")
same("arith", "SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS plus, l_orderkey - l_partkey AS minus, l_linenumber * 3 AS times, round(l_extendedprice * (1 - l_discount), 4) AS price FROM {lineitem}", "lineitem")
same("arith_div", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS DOUBLE) / l_linenumber AS ratio, 5 / 2 AS half FROM {lineitem}", "lineitem", duck="SELECT l_orderkey, l_linenumber, l_orderkey::DOUBLE / l_linenumber AS ratio, 2.5::DOUBLE AS half FROM lineitem")
same("bool_logic", "SELECT l_orderkey, l_linenumber, NOT (l_quantity < 10) AS big, (l_discount > 0.05 OR l_tax > 0.05) AND l_returnflag <> 'N' AS mixed FROM {lineitem}", "lineitem")
same("compare_string", "SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_mktsegment >= 'BUILDING' AND c_mktsegment < 'HOUSEHOLD'", "customer")
same("compare_ts", "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'", "orders")
same("cast_types", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS whole, CAST(o_custkey AS DOUBLE) AS real, CAST(o_orderkey AS STRING) AS text FROM {orders} WHERE o_totalprice = floor(o_totalprice) OR o_orderkey < 100", "orders", duck="SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS whole, o_custkey::DOUBLE AS real, o_orderkey::VARCHAR AS text FROM orders WHERE o_totalprice = floor(o_totalprice) OR o_orderkey < 100")
same("agg_global", "SELECT count(l_orderkey) AS n, round(sum(l_quantity), 2) AS total, min(l_shipdate) AS first_ship, max(l_returnflag) AS last_flag, round(avg(l_discount), 8) AS mean FROM {lineitem}", "lineitem")
same("agg_group_all5", "SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(sum(l_quantity), 2) AS total, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_tax), 8) AS mean FROM {lineitem} GROUP BY l_returnflag, l_linestatus", "lineitem")
same("agg_empty_input", "SELECT count(l_orderkey) AS n, sum(l_quantity) AS total, min(l_tax) AS low, max(l_tax) AS high, avg(l_tax) AS mean FROM {lineitem} WHERE l_quantity < 0", "lineitem")
same("agg_min_max_types", "SELECT o_orderstatus, min(o_orderpriority) AS low, max(o_orderpriority) AS high, min(o_totalprice > 100000) AS small, max(o_custkey) AS last FROM {orders} GROUP BY o_orderstatus", "orders")
same("limit_n", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_orderkey LIMIT 25", "orders")
same("limit_param", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > :least ORDER BY o_orderkey LIMIT :k", "orders", args={"k": 25, "least": 1000.0}, duck="SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000.0 ORDER BY o_orderkey LIMIT 25")
same("tpch_q1", "SELECT l_returnflag, count(l_quantity) AS count_order, round(sum(l_quantity), 2) AS sum_qty FROM {lineitem} WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag", "lineitem")
same("tpch_q3", "SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice), 2) AS revenue FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE o_orderdate < '1995-03-15' AND l_shipdate > '1995-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10", "orders", "lineitem")


def _orders_lineitem(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return relational.join(items, orders, [("l_orderkey", "o_orderkey")], strategy)


JOINED = "SELECT l_orderkey, l_linenumber, l_quantity, o_orderkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(JOINED)
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_lineitem(spark, sf_dir, "auto")


@query("SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region table has a fixed size."""
    return relational.join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), [("n_regionkey", "r_regionkey")], "broadcast")


@query(JOINED)
def join_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_lineitem(spark, sf_dir, "shuffle")


@query(JOINED)
def join_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_lineitem(spark, sf_dir, "hash")


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_orderkey AS k2, b.l_linenumber AS n2, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_suppkey = b.l_suppkey")
def join_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    left = items.select("l_orderkey", "l_linenumber", "l_suppkey")
    right = items.select(F.col("l_orderkey").alias("k2"), F.col("l_linenumber").alias("n2"), F.col("l_suppkey").alias("s2"), "l_quantity")
    return relational.join(left, right, [("l_orderkey", "k2"), ("l_linenumber", "n2"), ("l_suppkey", "s2")]).drop("l_suppkey", "s2")


@query("SELECT o_custkey, count(l_quantity) AS n, round(sum(l_quantity), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey")
def join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = relational.aggregate(_orders_lineitem(spark, sf_dir, "auto"), ["o_custkey"], [("count", "l_quantity", "n"), ("sum", "l_quantity", "total")])
    return made.withColumn("total", F.round("total", 2))


@query("SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_chain3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    both = relational.join(c, n, [("c_nationkey", "n_nationkey")])
    return relational.join(both, r, [("n_regionkey", "r_regionkey")]).select("c_custkey", "c_mktsegment", "n_name", "r_name")


def _vector_query(name: str, function, duck: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "embeddings").select("vec_id", (F.round(function(F.col("embedding"), QUERY).cast("double"), 4) + 0.0).alias("score"))

    QUERIES[name] = run
    SQL[name] = f"SELECT vec_id, round(({duck}(embedding::DOUBLE[], {DUCK_QUERY}::DOUBLE[]))::FLOAT::DOUBLE, 4) + 0.0 AS score FROM embeddings"


_vector_query("cosine", cosine_similarity, "list_cosine_similarity")
_vector_query("l2", l2_distance, "list_distance")
_vector_query("dot", dot_product, "list_inner_product")

_TOPK = f"SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], {DUCK_QUERY}::DOUBLE[])::FLOAT AS exact FROM embeddings"
_ROUND = "round(exact::DOUBLE, 4) AS score"


@query(f"SELECT vec_id, {_ROUND} FROM ({_TOPK}) ORDER BY exact DESC, vec_id DESC LIMIT 10")
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.topk_similar(table(spark, sf_dir, "embeddings"), "embedding", QUERY, 10, tie="vec_id").select("vec_id", F.round(F.col("score").cast("double"), 4).alias("score"))


@query(f"SELECT vec_id, {_ROUND} FROM ({_TOPK}) WHERE label = 1 ORDER BY exact DESC, vec_id DESC LIMIT 10")
def topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.topk_similar(table(spark, sf_dir, "embeddings").where("label = 1"), "embedding", QUERY, 10, tie="vec_id").select("vec_id", F.round(F.col("score").cast("double"), 4).alias("score"))


@query("SELECT vec_id, (label % 3)::BIGINT AS score FROM embeddings ORDER BY label % 3 DESC, vec_id DESC LIMIT 20")
def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.topk_by_score(table(spark, sf_dir, "embeddings"), (F.col("label") % 3).cast("long"), 20, "vec_id").select("vec_id", "score")


@query(f"SELECT vec_id AS id, {_ROUND}, label::VARCHAR AS payload FROM ({_TOPK}) WHERE label = 2 ORDER BY exact DESC, vec_id DESC LIMIT 7")
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.ExactIndex(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return index.topk(QUERY, 7, retrieval.filter_document([("label", 2)])).select("id", F.round(F.col("score").cast("double"), 4).alias("score"), "payload")


@query(f"WITH c AS ({_TOPK} ORDER BY exact DESC, vec_id DESC LIMIT 80) SELECT vec_id, lang, {_ROUND} FROM c JOIN documents ON vec_id = doc_id WHERE lang = 'en' ORDER BY exact DESC, vec_id DESC LIMIT 20")
def two_phase_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    docs = relational.join(vectors, table(spark, sf_dir, "documents").select("doc_id", "lang"), [("vec_id", "doc_id")])
    found = retrieval.two_phase(docs, "vec_id", "embedding", retrieval.ExactIndex(vectors, "vec_id", "embedding"), QUERY, 20, F.col("lang") == "en")
    return found.select("vec_id", "lang", F.round(F.col("score").cast("double"), 4).alias("score"))


@query(f"SELECT vec_id, {_ROUND} FROM ({_TOPK}) ORDER BY exact DESC, vec_id DESC LIMIT 10")
def topk_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL function, with the vector as a bound parameter."""
    register_functions(spark)
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("marlstone_embeddings")
    return spark.sql("SELECT vec_id, round(cast(s as double), 4) AS score FROM (SELECT vec_id, cosine_similarity(embedding, cast(:q as array<float>)) AS s FROM marlstone_embeddings) ORDER BY s DESC, vec_id DESC LIMIT 10", args={"q": QUERY})


def _target(spark: SparkSession, name: str) -> str:
    """A new path for a written table: in the cluster's shared folder, or in the warehouse where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/marlstone-queries/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def write_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = _target(spark, "overwritten"), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    write_parquet(rows.where("o_orderstatus = 'O'").drop("o_orderstatus"), path)
    write_parquet(rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), path)
    return spark.read.parquet(path)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')")
def write_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = _target(spark, "appended"), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    for status in ("F", "O"):
        write_parquet(rows.where(F.col("o_orderstatus") == status).drop("o_orderstatus"), path, "append")
    return spark.read.parquet(path)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _target(spark, "inserted")
    customer = table(spark, sf_dir, "customer")
    write_parquet(customer.select("c_custkey", "c_acctbal").limit(0), path)
    engine = Engine(spark)
    engine.register_table(TableDef("target", uri=path, schema=[("c_custkey", "bigint"), ("c_acctbal", "double")]))
    engine.register_table(TableDef("customer", uri=f"{sf_dir}/customer.parquet"))
    engine.sql("INSERT INTO target (c_custkey, c_acctbal) SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
    return engine.table("target").df


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000")
def write_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _target(spark, "single") + ".parquet"
    write_parquet(table(spark, sf_dir, "customer").where("c_acctbal > 1000").select("c_custkey", "c_acctbal"), path)
    return spark.read.parquet(path)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')")
def save_as_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends to a table that lies elsewhere: its own rows stay."""
    path, rows = _target(spark, "elsewhere"), table(spark, sf_dir, "orders")
    write_parquet(rows.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), path)
    engine = Engine(spark, EngineConfig(managed_dir=_target(spark, "managed")))
    engine.register_table(TableDef("kept", uri=path))
    engine.register_table(TableDef("orders", uri=f"{sf_dir}/orders.parquet"))
    engine.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'").save_as_table("kept", "append")
    return engine.table("kept").df


@query("SELECT o_orderstatus, count(o_orderkey) AS n FROM orders WHERE o_orderkey % 3 < 2 GROUP BY o_orderstatus")
def multi_file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table over two folders."""
    paths, rows = [_target(spark, "part") for _ in range(2)], table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for i, path in enumerate(paths):
        write_parquet(rows.where(F.col("o_orderkey") % 3 == i), path)
    engine = Engine(spark)
    engine.register_table(TableDef("parts", paths=paths))
    return engine.table("parts").groupby("o_orderstatus").agg(("count", "o_orderkey", "n")).df


@query("SELECT c_custkey, c_nationkey::DOUBLE AS c_nationkey FROM customer")
def widened_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of int and bigint keys, and of int and double values: each read in the wider type."""
    path, rows = _target(spark, "widened"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    write_parquet(rows.where("c_custkey % 2 = 0").selectExpr("cast(c_custkey AS int) AS c_custkey", "c_nationkey"), path)
    write_parquet(rows.where("c_custkey % 2 = 1").selectExpr("c_custkey", "cast(c_nationkey AS double) AS c_nationkey"), path, "append")
    engine = Engine(spark)
    engine.register_table(TableDef("widened", uri=path))
    return engine.table("widened").df


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(n_nationkey, 3)")
def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").selectExpr("c_custkey", "nullif(c_nationkey, 3) AS c_key")
    right = table(spark, sf_dir, "nation").selectExpr("n_name", "nullif(n_nationkey, 3) AS n_key")
    return relational.join(left, right, [("c_key", "n_key")], null_safe=True).select("c_custkey", "n_name")


@query(f"SELECT vec_id, {_ROUND} FROM ({_TOPK}) WHERE label <> 1 ORDER BY exact DESC, vec_id DESC LIMIT 12")
def vector_sql_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alias, qualified columns and a projected score: answered by the index and its exact rerank."""
    vectors, engine = table(spark, sf_dir, "embeddings"), Engine(spark)
    options = {"vector.index_table": "near", "vector.id_column": "vec_id", "vector.prefetch_multiplier": "100"}
    engine.register_table(TableDef("embeddings", uri=f"{sf_dir}/embeddings.parquet", options=options))
    engine.register_index("near", retrieval.ExactIndex(vectors, "vec_id", "embedding"))
    found = engine.sql("SELECT e.vec_id, cosine_similarity(e.embedding, :q) AS s FROM embeddings e WHERE e.label <> :not ORDER BY s DESC LIMIT :k", {"q": QUERY, "k": 12, "not": 1})
    assert found.rewrite == "two_phase"
    return found.df.select("vec_id", F.round(F.col("s").cast("double"), 4).alias("score"))


@query("SELECT * FROM (VALUES (9::BIGINT, 0.75::DOUBLE, 'b'), (4::BIGINT, 0.5::DOUBLE, NULL)) t(id, score, payload)")
def index_given_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = json.dumps([{"id": 4, "score": 0.5}, {"id": 9, "score": 0.75, "payload": "b"}, {"id": 2, "score": 0.25}])
    engine = Engine(spark)
    engine.register_table(TableDef("given", format="index", options={"vector.mock_rows_json": rows}))
    found = engine.sql("SELECT id, score, payload FROM given ORDER BY cosine_similarity(emb, :q) DESC LIMIT 2", {"q": [1.0]})
    return found.df.select("id", F.col("score").cast("double").alias("score"), "payload")


@query("SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, 0::BIGINT AS o_shippriority FROM orders")
def tbl_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe-delimited text, converted to Parquet."""
    folder = _target(spark, "tbl")
    given = {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderdate": "date_format(o_orderdate, 'yyyy-MM-dd')", "o_shippriority": "0"}
    line = F.concat_ws("|", *[F.expr(given.get(c, "'x'")).cast("string") for c in COLUMNS["orders"].split()], F.lit(""))
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(f"{folder}/orders.tbl")
    return spark.read.parquet(*convert_tbl(spark, folder, f"{folder}/out", ("orders",))["orders"])


@query("SELECT l_returnflag, count(l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 200000 GROUP BY l_returnflag")
def join_by_catalog_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's sizes choose the side that is broadcast."""
    engine = Engine(spark)
    engine.register_table(TableDef("lineitem", uri=f"{sf_dir}/lineitem.parquet", bytes=10**9))
    engine.register_table(TableDef("orders", uri=f"{sf_dir}/orders.parquet", bytes=10**5))
    both = engine.table("lineitem").join(engine.table("orders").filter("o_totalprice > 200000"), [("l_orderkey", "o_orderkey")])
    return both.groupby("l_returnflag").agg(("count", "l_orderkey", "n")).df
