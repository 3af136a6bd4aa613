"""Vector kernels as Spark expressions, and as SQL functions that Catalyst inlines."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _vector(q: Sequence[float]) -> Column:
    return F.lit([float(x) for x in q]).cast("array<float>").cast("array<double>")


def _checked(v: Column, n: int, result: Column) -> Column:
    """Null vectors give null; another dimension than the query's is an error."""
    wrong = F.raise_error(F.concat(F.lit(f"vector has another dimension than the query's {n}: "), F.size(v)))
    return F.when(v.isNull(), F.lit(None).cast("float")).when(F.size(v) != n, wrong.cast("float")).otherwise(result.cast("float"))


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def dot_product(v: Column, q: Sequence[float]) -> Column:
    return _checked(v, len(q), _sum(F.zip_with(v, _vector(q), lambda a, b: a * b)))


def l2_distance(v: Column, q: Sequence[float]) -> Column:
    return _checked(v, len(q), F.sqrt(_sum(F.zip_with(v, _vector(q), lambda a, b: (a - b) * (a - b)))))


def cosine_similarity(v: Column, q: Sequence[float]) -> Column:
    """0 where either norm is 0.  Dot product and norm come from one pass over the vector."""
    norm = math.sqrt(sum(float(x) ** 2 for x in q))
    both = F.aggregate(
        F.zip_with(v, _vector(q), lambda a, b: F.struct(a.cast("double").alias("a"), b.alias("b"))),
        F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n")),
        lambda s, x: F.struct((s["d"] + x["a"] * x["b"]).alias("d"), (s["n"] + x["a"] * x["a"]).alias("n")),
        lambda s: F.when(s["n"] == 0, F.lit(0.0)).otherwise(s["d"] / (F.sqrt(s["n"]) * norm)),
    )
    return _checked(v, len(q), both if norm else F.lit(0.0))


_SUM = "aggregate(zip_with({v}, {q}, (x, y) -> {f}), 0D, (s, x) -> s + x)"


def _sql(body: str) -> str:
    return f"CASE WHEN v IS NULL OR q IS NULL THEN NULL WHEN size(v) <> size(q) THEN raise_error('vectors of different dimensions') ELSE CAST({body} AS FLOAT) END"


def register_functions(spark: SparkSession) -> None:
    """cosine_similarity, l2_distance and dot_product for SQL; pass a bound list as the query vector."""
    dot = _SUM.format(v="v", q="q", f="CAST(x AS DOUBLE) * y")
    square = lambda c: _SUM.format(v=c, q=c, f="CAST(x AS DOUBLE) * y")
    bodies = {
        "dot_product": dot,
        "l2_distance": f"sqrt({_SUM.format(v='v', q='q', f='(CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)')})",
        "cosine_similarity": f"CASE WHEN {square('v')} = 0 OR {square('q')} = 0 THEN 0D ELSE {dot} / sqrt({square('v')} * {square('q')}) END",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v ARRAY<FLOAT>, q ARRAY<FLOAT>) RETURNS FLOAT RETURN {_sql(body)}")
