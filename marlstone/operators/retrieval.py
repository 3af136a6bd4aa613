"""Vector retrieval: exact top-k, the index protocol, and two-phase prefetch with rerank."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.errors import PlanningError
from marlstone.functions.vector import cosine_similarity, dot_product, l2_distance

METRICS = {"cosine": cosine_similarity, "dot": dot_product, "l2": l2_distance}
#: What an index returns.
FOUND = "id bigint, score float, payload string"


def topk_by_score(df: DataFrame, score: Column, k: int, tie: str | None = None, name: str = "score") -> DataFrame:
    """The k rows of greatest score in that order, ties by ``tie`` descending; null scores never count.

    Plans as TakeOrderedAndProject: each task keeps k rows, and k rows a task are merged.
    """
    if k < 0:
        raise PlanningError("k is 0 or more")
    scored = df.withColumn(name, score).where(F.col(name).isNotNull())
    order = [F.col(name).desc()] + ([F.col(tie).desc()] if tie else [])
    return scored.orderBy(*order).limit(k)


def topk_similar(df: DataFrame, column: str, query: Sequence[float], k: int, metric: str = "cosine", tie: str | None = None) -> DataFrame:
    """By similarity, or by the negative distance for l2."""
    if metric not in METRICS:
        raise PlanningError(f"metric is one of {tuple(METRICS)}, not {metric!r}")
    score = METRICS[metric](F.col(column), query)
    return topk_by_score(df, -score if metric == "l2" else score, k, tie)


def filter_document(conditions: Sequence[tuple[str, object]]) -> str:
    """An AND of column = literal as the JSON text that indexes take."""
    for field, value in conditions:
        if not isinstance(value, (int, str, bool)):
            raise PlanningError(f"{field}: an index compares whole numbers, strings and booleans only")
    return json.dumps({"must": [{"field": f, "value": v} for f, v in conditions]})


def filter_condition(document: str | None) -> Column:
    """The predicate that a filter document stands for."""
    out = F.lit(True)
    for c in json.loads(document)["must"] if document else []:
        out = out & (F.col(c["field"]) == F.lit(c["value"]))
    return out


class VectorIndex(Protocol):
    """``topk`` returns at most k rows of (id, score, payload), best first."""

    def topk(self, query: Sequence[float], k: int, filter: str | None = None) -> DataFrame: ...


class ExactIndex:
    """Searches a DataFrame exactly; the filter applies before the top k."""

    def __init__(self, df: DataFrame, id: str, column: str, payload: str | None = None):
        self.df, self.id, self.column, self.payload = df, id, column, payload

    def topk(self, query: Sequence[float], k: int, filter: str | None = None) -> DataFrame:
        payload = F.col(self.payload).cast("string") if self.payload else F.lit(None).cast("string")
        found = topk_similar(self.df.where(filter_condition(filter)), self.column, query, k, tie=self.id)
        return found.select(F.col(self.id).cast("long").alias("id"), "score", payload.alias("payload"))


class FixedIndex:
    """Given rows, as JSON text: for tests and for results computed elsewhere.  Query and filter are ignored."""

    def __init__(self, spark: SparkSession, rows_json: str):
        rows = [(int(r["id"]), float(r["score"]), r.get("payload")) for r in json.loads(rows_json)]
        self.df = spark.createDataFrame(rows, FOUND)

    def topk(self, query: Sequence[float], k: int, filter: str | None = None) -> DataFrame:
        return topk_by_score(self.df, F.col("score"), k, "id")


def prefetch_k(k: int, multiplier: int = 4, cap: int | None = None) -> int:
    """How many candidates the first phase asks for: never under k."""
    return max(k, min(max(k * multiplier, k), cap) if cap is not None else k * multiplier)


def two_phase(docs: DataFrame, id: str, column: str, index: VectorIndex, query: Sequence[float], k: int, where: Column | None = None, multiplier: int = 4, cap: int | None = None) -> DataFrame:
    """Prefetch candidates from the index, filter their documents, rerank exactly.

    The filter comes after the prefetch, so fewer than k rows can come back; raise ``multiplier``
    then.  The candidates are prefetch_k rows at most; up to a million ids and scores are broadcast.
    With payloads, whose size is not known, the join is left to sizes at run time.
    """
    n = prefetch_k(k, multiplier, cap)
    found = index.topk(query, n).select(F.col("id").alias("_found"), *[F.col(c) for c in ("score", "payload") if c not in docs.columns])
    slim = n <= 1_000_000 and "payload" not in found.columns
    joined = docs.join(F.broadcast(found) if slim else found, docs[id] == F.col("_found")).drop("_found")
    if where is not None:
        joined = joined.where(where)
    if "score" in joined.columns:
        joined = joined.withColumnRenamed("score", "index_score")
    return topk_similar(joined, column, query, k, tie=id)
