"""Pipe-delimited dbgen files to Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.errors import UnsupportedError
from marlstone.sources.writes import write_parquet

#: The columns of dbgen's files, in order.
COLUMNS = {
    "customer": "c_custkey c_name c_address c_nationkey c_phone c_acctbal c_mktsegment c_comment",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority o_clerk o_shippriority o_comment",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate l_commitdate l_receiptdate l_shipinstruct l_shipmode l_comment",
}
#: The columns that the queries use, and the types of those that are no text.
KEPT = {
    "customer": "c_custkey c_mktsegment",
    "orders": "o_orderkey o_custkey o_orderdate o_shippriority",
    "lineitem": "l_orderkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
}
WHOLE = {"c_custkey", "o_orderkey", "o_custkey", "o_shippriority", "l_orderkey"}
REAL = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}


def read_tbl(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The kept columns, typed; a bad number is an error."""
    if name not in COLUMNS:
        raise UnsupportedError(f"no layout for {name}; there are: {', '.join(COLUMNS)}")
    schema = ", ".join(f"{c} {'bigint' if c in WHOLE else 'double' if c in REAL else 'string'}" for c in COLUMNS[name].split())
    return spark.read.schema(schema).csv(path, sep="|", mode="FAILFAST", enforceSchema=True).select(*KEPT[name].split())


def convert_tbl(spark: SparkSession, source: str, target: str, names: tuple[str, ...] = ("customer", "orders", "lineitem")) -> dict[str, list[str]]:
    """``source``/<name>.tbl to the folders ``target``/<name>, a file for each split of the text; the files made."""
    return {n: write_parquet(read_tbl(spark, n, f"{source}/{n}.tbl"), f"{target}/{n}") for n in names}
