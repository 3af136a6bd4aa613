"""Counters of an engine, in Prometheus' text format.

Beside queries, rows and seconds there are Spark's own counts of each operator of a plan: rows, bytes,
shuffle, spill, memory and times.  Which of them an operator has is Spark's matter.
"""

from __future__ import annotations

from collections import defaultdict
from threading import Lock

from pyspark.sql import DataFrame


#: Spark's metric of an operator, and ours.  Times are in milliseconds, sizes in bytes.
OF_PLAN = {
    "numOutputRows": "operator_rows", "numOutputBatches": "operator_batches", "numFiles": "scan_files", "filesSize": "scan_bytes",
    "scanTime": "scan_ms", "dataSize": "exchange_bytes", "shuffleBytesWritten": "shuffle_bytes_written", "shuffleRecordsWritten": "shuffle_rows_written",
    "recordsRead": "shuffle_rows_read", "localBytesRead": "shuffle_local_bytes_read", "remoteBytesRead": "shuffle_remote_bytes_read", "fetchWaitTime": "shuffle_fetch_wait_ms",
    "spillSize": "spill_bytes", "peakMemory": "operator_peak_bytes", "sortTime": "sort_ms", "aggTime": "aggregate_ms", "buildTime": "join_build_ms", "buildDataSize": "join_build_bytes",
}


def operators_of(df: DataFrame):
    """(operator, counts) of each operator of the plan that a DataFrame ran by."""
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        counts, it = {}, node.metrics().iterator()
        while it.hasNext():
            entry = it.next()
            counts[entry._1()] = entry._2().value()
        yield node.nodeName().split("(")[0].strip(), counts
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]


class Metrics:
    def __init__(self) -> None:
        self.values: dict[tuple[str, str], float] = defaultdict(float)
        self.lock = Lock()

    def ran(self, operator: str, rows: int, seconds: float) -> None:
        with self.lock:
            self.values["marlstone_queries_total", operator] += 1
            self.values["marlstone_rows_out_total", operator] += rows
            self.values["marlstone_seconds_total", operator] += seconds

    def ran_plan(self, df: DataFrame) -> None:
        found = [(operator, OF_PLAN[k], v) for operator, counts in operators_of(df) for k, v in counts.items() if k in OF_PLAN and v > 0]
        with self.lock:
            for operator, name, value in found:
                self.values[f"marlstone_{name}_total", operator] += value

    def failed(self, operator: str) -> None:
        with self.lock:
            self.values["marlstone_failures_total", operator] += 1

    def text(self) -> str:
        lines, last = [], ""
        for (name, operator), value in sorted(self.values.items()):
            if name != last:
                lines.append(f"# TYPE {name} counter")
                last = name
            lines.append(f'{name}{{operator="{operator}"}} {value:g}')
        return "\n".join(lines) + "\n"
