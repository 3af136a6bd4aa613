"""Relational operators over DataFrames: joins with a strategy, grouped aggregates, limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.errors import PlanningError

#: Of each strategy the hint of the left and of the right side.
HINTS = {"auto": (None, None), "broadcast": (None, "broadcast"), "broadcast_left": ("broadcast", None), "broadcast_right": (None, "broadcast"), "shuffle": (None, "merge"), "hash": (None, "shuffle_hash")}
AGGREGATES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}


def strategy_of(left_bytes: int | None, right_bytes: int | None, threshold: int) -> str:
    """What catalog sizes alone say: broadcast_left, broadcast_right or shuffle."""
    if left_bytes is not None and left_bytes <= threshold and (right_bytes is None or left_bytes <= right_bytes):
        return "broadcast_left"
    if right_bytes is not None and right_bytes <= threshold and (left_bytes is None or right_bytes < left_bytes):
        return "broadcast_right"
    return "shuffle"


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], strategy: str = "auto", null_safe: bool = False) -> DataFrame:
    """Inner equi-join that keeps both sides' columns.  ``auto`` leaves the choice to run-time sizes;
    ``broadcast`` is for a right side, ``broadcast_left`` for a left side, of known small size."""
    if not on:
        raise PlanningError("a join needs at least one pair of keys")
    if strategy not in HINTS:
        raise PlanningError(f"strategy is one of {tuple(HINTS)}, not {strategy!r}")
    for a, b in on:
        if a not in left.columns or b not in right.columns:
            raise PlanningError(f"no such join key: {a} on the left, {b} on the right")
    condition = None
    for a, b in on:
        pair = left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b]
        condition = pair if condition is None else condition & pair
    hint_left, hint_right = HINTS[strategy]
    return (left.hint(hint_left) if hint_left else left).join(right.hint(hint_right) if hint_right else right, condition, "inner")


def aggregate(df: DataFrame, keys: Sequence[str], aggs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``aggs``: (function, column, name).  Without keys one row comes out, of empty input too."""
    columns: list[Column] = []
    for function, column, name in aggs:
        if function not in AGGREGATES:
            raise PlanningError(f"aggregate is one of {tuple(AGGREGATES)}, not {function!r}")
        columns.append(AGGREGATES[function](F.col(column)).alias(name))
    if not columns:
        raise PlanningError("no aggregate is given")
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def limit(df: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise PlanningError("a limit is 0 or more")
    return df.limit(n)
