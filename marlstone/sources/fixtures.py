"""Deterministic made-up tables of any size, in expressions over a range, and a manifest of them.

Each value is drawn by a hash of the row, the column and a seed, so a table is the same however it is
partitioned, and columns are independent of one another.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.files import Files
from marlstone.sources.writes import write_parquet

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _draw(column: str, n: int, seed: int) -> Column:
    """A whole number from 0 to n - 1."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(column), F.lit(seed)), F.lit(n))


def _one_of(column: str, values: tuple[str, ...], seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_draw(column, len(values), seed) + 1).cast("int"))


def _day(column: str, days: int, seed: int) -> Column:
    return F.date_add(F.lit("1992-01-01").cast("date"), _draw(column, days, seed).cast("int"))


def made_customer(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("c_custkey"), _one_of("segment", SEGMENTS, seed).alias("c_mktsegment"))


def made_orders(spark: SparkSession, n: int, customers: int, seed: int = 1) -> DataFrame:
    """Orders of customers 1 to ``customers``."""
    key = (_draw("customer", customers, seed) + 1).alias("o_custkey")
    day = _day("order", 7 * 365, seed).cast("string").alias("o_orderdate")
    return spark.range(1, n + 1).select(F.col("id").alias("o_orderkey"), key, day, F.lit(0).cast("long").alias("o_shippriority"))


def made_lineitem(spark: SparkSession, n: int, orders: int, seed: int = 1) -> DataFrame:
    """Lines of orders 1 to ``orders``."""
    quantity = _draw("quantity", 50, seed) + 1
    return spark.range(n).select(
        (_draw("order", orders, seed) + 1).alias("l_orderkey"),
        quantity.cast("double").alias("l_quantity"),
        (quantity * (_draw("price", 100_000, seed) + 10_000) / 100).alias("l_extendedprice"),
        (_draw("discount", 11, seed) / 100).alias("l_discount"),
        (_draw("tax", 9, seed) / 100).alias("l_tax"),
        _one_of("flag", ("A", "N", "R"), seed).alias("l_returnflag"),
        _one_of("status", ("F", "O"), seed).alias("l_linestatus"),
        _day("ship", 7 * 365 + 120, seed).cast("string").alias("l_shipdate"),
    )


# The vectors, languages and titles of the documents that the vector queries are told for.
WAVE_SEED, WAVE_ID, WAVE_DIMENSION = 42, 31, 17
GERMAN_EVERY = 5


def made_documents(spark: SparkSession, n: int, dimensions: int = 64) -> DataFrame:
    """id, title, lang and a vector whose entries follow a wave."""
    at = lambda d: F.col("id") * WAVE_ID + d * WAVE_DIMENSION + WAVE_SEED
    x = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: ((F.sin(at(d)) + F.cos(at(d))) / 2).cast("float"))
    lang = F.when(F.col("id") % GERMAN_EVERY == 0, "de").otherwise("en")
    return spark.range(1, n + 1).select("id", F.concat(F.lit("doc-"), F.col("id")).alias("title"), lang.alias("lang"), x.alias("emb"))


def write_fixtures(spark: SparkSession, folder: str, customers: int = 10_000, orders: int = 50_000, lines: int = 200_000, documents: int = 10_000, seed: int = 1) -> dict:
    """All tables below ``folder``, and manifest.json: of each its file, rows, columns and a checksum."""
    made = {
        "customer": made_customer(spark, customers, seed),
        "orders": made_orders(spark, orders, customers, seed),
        "lineitem": made_lineitem(spark, lines, orders, seed),
        "docs": made_documents(spark, documents),
    }
    manifest: dict = {"seed": seed, "tables": {}}
    for name, df in made.items():
        path = write_parquet(df, f"{folder}/{name}.parquet")[0]
        back = spark.read.parquet(path)
        row = back.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64(*back.columns), F.lit(2**31))).alias("sum")).first()
        manifest["tables"][name] = {"file": f"{name}.parquet", "rows": row["n"], "checksum": row["sum"], "columns": [[f.name, f.dataType.simpleString()] for f in back.schema]}
    Files(spark).write_text(f"{folder}/manifest.json", json.dumps(manifest, indent=2))
    return manifest
