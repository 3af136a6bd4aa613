"""The engine: a catalog of tables over Spark, SQL with parameters, and frames."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Sequence

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.config import EngineConfig
from marlstone.errors import EngineError, ExecutionError, PlanningError, UnsupportedError
from marlstone.functions.vector import cosine_similarity, register_functions
from marlstone.metrics import Metrics
from marlstone.operators import relational, retrieval
from marlstone.plans.parameters import parameters_of, with_parameters
from marlstone.plans.rewrite import VectorTopk, vector_topk
from marlstone.sources.catalog import Catalog, TableDef
from marlstone.sources.files import Files
from marlstone.sources.scan import files_of, read_table, state_of
from marlstone.sources.writes import is_single_file, write_parquet

_INSERT = re.compile(r"\s*INSERT\s+INTO\s+(?:TABLE\s+)?`?(\w+)`?\s*(?:\(([^)]*)\)\s*)?(SELECT|WITH|FROM|VALUES|TABLE)\b", re.I)
_EQUALS = re.compile(r"\s*(\w+)\s*=\s*(?:(-?\d+)|'((?:[^']|'')*)'|(true|false))\s*", re.I)


class Engine:
    def __init__(self, spark: SparkSession | None = None, config: EngineConfig | None = None):
        self.config = config or EngineConfig()
        self.spark = (spark or self.config.session()).newSession()
        for k, v in self.config.spark_conf().items():
            self.spark.conf.set(k, v)
        register_functions(self.spark)
        self.catalog = Catalog(self.config.catalog_path)
        self.metrics = Metrics()
        self.schemas: dict[str, tuple[tuple[str, ...], object]] = {}
        self.indexes: dict[str, retrieval.VectorIndex] = {}
        for name in self.catalog.names():
            self._open(self.catalog.get(name))

    # tables

    def register_table(self, table: TableDef) -> None:
        self.register_table_checked(table)

    def register_table_checked(self, table: TableDef) -> list[tuple[str, str]]:
        """Register, and return the schema; an entry that can't be read is an error now."""
        before = self.catalog.tables.get(table.name)
        self.catalog.register(table)
        try:
            self._open(table)
        except EngineError:
            self.catalog.tables.pop(table.name)
            if before:
                self.catalog.register(before)
            raise
        return self.table_schema(table.name)

    def register_parquet(self, name: str, *paths: str) -> None:
        self.register_table(TableDef(name, paths=list(paths)))

    def register_index(self, name: str, index: retrieval.VectorIndex) -> None:
        """An index of any kind, for tables whose option ``vector.index_table`` names it."""
        self.indexes[name] = index

    def list_tables(self) -> list[str]:
        return self.catalog.names()

    def table_schema(self, name: str) -> list[tuple[str, str]]:
        return self.table_schema_with_origin(name)[0]

    def table_schema_with_origin(self, name: str) -> tuple[list[tuple[str, str]], str]:
        """The schema, and whether it is ``declared`` or ``inferred``."""
        table = self.catalog.get(name)
        if table.format == "index":
            return [("id", "bigint"), ("score", "float"), ("payload", "string")], "declared"
        self._refresh(table)
        return [(f.name, f.dataType.simpleString()) for f in self.spark.table(f"`{name}`").schema], "declared" if table.schema else "inferred"

    def _open(self, table: TableDef) -> None:
        if table.format == "index":
            rows = table.options.get("vector.mock_rows_json")
            if rows:
                self.indexes[table.name] = retrieval.FixedIndex(self.spark, rows)
            return
        state = state_of(self.spark, table) if table.schema is None else ()
        df, schema = read_table(self.spark, table, self.config.schema_inference)
        self.schemas[table.name] = (state, schema)
        df.createOrReplaceTempView(table.name)

    def _refresh(self, table: TableDef) -> None:
        """Files that changed since their schema was inferred are an error or are read anew, by policy."""
        if table.format != "parquet" or table.schema is not None:
            return
        if state_of(self.spark, table) == self.schemas[table.name][0]:
            return
        if self.config.schema_drift == "fail":
            raise PlanningError(f"the files of table {table.name} have changed, and the drift policy is to fail")
        self._open(table)
        if self.config.schema_writeback:
            table.options |= {"schema.inferred_at": str(int(time.time())), "schema.fingerprint": ";".join(self.schemas[table.name][0])}
            self.catalog.save()

    def _refresh_named(self, text: str) -> None:
        words = set(re.findall(r"\w+", text))
        for name in self.catalog.names():
            if name in words:
                self._refresh(self.catalog.get(name))

    # queries

    def sql(self, text: str, params: dict | None = None) -> "Frame":
        """Named parameters are written ``:name``; a list is a vector."""
        if m := _INSERT.match(text):
            return self._insert(m[1], [c.strip().strip("`") for c in m[2].split(",")] if m[2] else None, text[m.start(3) :], params)
        self._refresh_named(text)
        missing = [p for p in parameters_of(text) if p not in (params or {})]
        if missing:
            raise PlanningError(f"no value for parameter {', '.join(missing)}")
        if (found := vector_topk(self.spark, text, params or {})) and (frame := self._vector_query(found, params or {})):
            return frame
        return Frame(self, self._spark_sql(text, params))

    sql_with_params = sql

    def _spark_sql(self, text: str, params: dict | None) -> DataFrame:
        vectors = {k for k, v in (params or {}).items() if isinstance(v, (list, tuple))}
        text = with_parameters(text, lambda p: f"cast(:{p} as array<float>)" if p in vectors else f":{p}")
        try:
            return self.spark.sql(text, args={k: list(v) if isinstance(v, tuple) else v for k, v in (params or {}).items()} or None)
        except (ParseException, AnalysisException) as e:
            raise PlanningError(str(e)) from e

    def _vector_query(self, found: VectorTopk, params: dict) -> "Frame | None":
        """Top-k by cosine over a table with an index: two-phase, or the index alone, else not at all."""
        table = self.catalog.tables.get(found.table)
        if table is None:
            return None
        query, k = list(params[found.query]), found.k
        if table.format == "index":
            conditions = equalities(found.where) if found.where else []
            index = self.indexes.get(table.name)
            if index is None or conditions is None or not set(found.names) <= {"id", "score", "payload"}:
                raise UnsupportedError(f"table {table.name} is an index: it gives id, score and payload, filtered by equality alone")
            top = index.topk(query, k, retrieval.filter_document(conditions) if conditions else None)
            return Frame(self, top.selectExpr(*found.columns), "index_applied")
        self._refresh(table)
        docs, id = self.spark.table(f"`{table.name}`").alias(found.alias), table.options.get("vector.id_column", "id")
        index = self.indexes.get(table.options.get("vector.index_table", ""))
        condition = F.expr(found.where) if found.where else None
        if index is not None and table.options.get("vector.embedding_column", found.vector) == found.vector:
            cap = table.options.get("vector.prefetch_cap")
            top = retrieval.two_phase(docs, id, found.vector, index, query, k, condition, int(table.options.get("vector.prefetch_multiplier", 4)), int(cap) if cap else None)
            return Frame(self, top.selectExpr(*found.columns), "two_phase")
        score = cosine_similarity(F.col(f"`{found.vector}`"), query)
        top = retrieval.topk_by_score(docs.where(condition) if found.where else docs, score, k, id if id in docs.columns else None, "_score")
        top = top.drop("_score") if "_score" not in docs.columns else top
        return Frame(self, top.selectExpr(*found.columns), "index_fallback" if "vector.index_table" in table.options else None)

    def _insert(self, name: str, columns: list[str] | None, select: str, params: dict | None) -> "Frame":
        """Append rows to a catalog table, columns by the list's names or else by position."""
        table = self.catalog.get(name)
        if table.format != "parquet":
            raise UnsupportedError(f"table {name} can't be written")
        df = self.sql(select, params).df
        fields = {f.name: f.dataType for f in self.spark.table(f"`{name}`").schema}
        names = columns or list(fields)
        if unknown := [c for c in names if c not in fields]:
            raise PlanningError(f"table {name} has no column {', '.join(unknown)}")
        if len(names) != len(df.columns):
            raise PlanningError(f"INSERT gives {len(df.columns)} columns for {len(names)}")
        numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
        for c, f in zip(names, df.schema):
            a, b = f.dataType.simpleString(), fields[c].simpleString()
            if a != b and not (a in numbers and b in numbers) and a != "void":
                raise PlanningError(f"column {c} is {b}, and INSERT gives {a}")
        given = df.toDF(*names)
        row = given.select(*[(F.col(f"`{c}`").cast(t) if c in names else F.lit(None).cast(t)).alias(c) for c, t in fields.items()])
        target = table.locations()[0]
        if len(table.locations()) > 1 or is_single_file(target) and not Files(self.spark).is_folder(target):
            raise UnsupportedError(f"table {name} is not a folder, so nothing can be appended to it")
        Frame(self, row).write_parquet(target, "append")
        self._open(table)
        return Frame(self, row.limit(0))

    def table(self, name: str) -> "Frame":
        table = self.catalog.get(name)
        if table.format != "parquet":
            raise UnsupportedError(f"table {name} is an index, not rows")
        self._refresh(table)
        return Frame(self, self.spark.table(f"`{name}`"), bytes=self._known_bytes(table))

    def _known_bytes(self, table: TableDef) -> int | None:
        """The catalog's size of a table, but not less than its files have now."""
        if table.bytes is None:
            return None
        files = Files(self.spark)
        return max(table.bytes, sum(files.size(x) for x in table.locations()))

    def prometheus_metrics(self) -> str:
        return self.metrics.text()

    def shutdown(self) -> None:
        """Forget the tables; the Spark session belongs to the caller."""
        for name in self.catalog.names():
            self.spark.catalog.dropTempView(name)
        self.schemas.clear()


def equalities(where: str) -> list[tuple[str, object]] | None:
    """The conditions of an AND of column = literal, or None for anything else."""
    out: list[tuple[str, object]] = []
    at = 0
    while m := _EQUALS.match(where, at):
        out.append((m[1], int(m[2]) if m[2] else m[4].lower() == "true" if m[4] else m[3].replace("''", "'")))
        at = m.end()
        if at == len(where):
            return out
        if not (more := re.compile(r"AND\b", re.I).match(where, at)):
            return None
        at = more.end()
    return None


class Frame:
    """A lazy query of an engine.  ``df`` is the Spark DataFrame, with all that it offers."""

    def __init__(self, engine: Engine, df: DataFrame, rewrite: str | None = None, bytes: int | None = None):
        self.engine, self.df, self.rewrite, self.bytes = engine, df, rewrite, bytes

    def _with(self, df: DataFrame) -> "Frame":
        return Frame(self.engine, df)

    def filter(self, condition: Column | str) -> "Frame":
        """A part of the rows is no larger than the catalog says the table is."""
        return Frame(self.engine, self.df.filter(condition), bytes=self.bytes)

    def select(self, *columns: Column | str) -> "Frame":
        return self._with(self.df.select(*columns))

    def join(self, right: "Frame", on: Sequence[tuple[str, str]], strategy: str = "auto", null_safe: bool = False) -> "Frame":
        if right.engine is not self.engine:
            raise PlanningError("both sides of a join must be of one engine")
        if strategy == "auto" and (self.bytes is not None or right.bytes is not None):
            told = relational.strategy_of(self.bytes, right.bytes, self.engine.config.broadcast_threshold_bytes)
            strategy = told if told.startswith("broadcast") else "auto"
        return self._with(relational.join(self.df, right.df, on, strategy, null_safe))

    def groupby(self, *keys: str) -> "Grouped":
        return Grouped(self, keys)

    def agg(self, *aggs: tuple[str, str, str]) -> "Frame":
        return Grouped(self, ()).agg(*aggs)

    def limit(self, n: int) -> "Frame":
        return self._with(relational.limit(self.df, n))

    def topk(self, column: str, query: Sequence[float], k: int, metric: str = "cosine", tie: str | None = None) -> "Frame":
        return self._with(retrieval.topk_similar(self.df, column, query, k, metric, tie))

    def explain(self, mode: str = "formatted") -> str:
        """The plan, headed by ``rewrite=...`` where a vector rewrite was applied or fell back."""
        jvm = self.df.sparkSession._jvm
        text = self.df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        return (f"rewrite={self.rewrite}\n" if self.rewrite else "") + text

    def collect(self) -> list:
        return self._observed(self._timed("collect", self.df.collect, len))

    def to_arrow(self):
        return self._observed(self._timed("collect", self.df.toArrow, len))

    def _observed(self, out):
        """What Spark counted in each operator of the plan that just ran."""
        self.engine.metrics.ran_plan(self.df)
        return out

    def write_parquet(self, path: str, mode: str = "overwrite") -> list[str]:
        return self._timed("write", lambda: write_parquet(self.df, path, mode), len)

    write_parquet_with_mode = write_parquet

    def save_as_table(self, name: str, mode: str = "overwrite") -> None:
        """A managed folder beside the catalog file, entered in the catalog."""
        catalog = self.engine.catalog
        root = self.engine.config.managed_dir or (os.path.join(os.path.dirname(os.path.abspath(catalog.path)), "tables") if catalog.path else self.engine.spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tables")
        folder = f"{root.rstrip('/')}/{name}"
        before = catalog.tables.get(name)
        # A table that lies elsewhere keeps its files; a managed one is its whole folder.
        kept = [p for p in before.locations() if p.rstrip("/") != folder and not p.startswith(f"{folder}/")] if before and mode == "append" else []
        self.write_parquet(folder, mode)
        self.engine.register_table(TableDef(name, paths=[*kept, folder], options=dict(before.options) if before else {}))
        catalog.save()

    save_as_table_with_mode = save_as_table

    def _timed(self, operator: str, run, size):
        began = time.perf_counter()
        try:
            out = run()
        except PySparkException as e:
            self.engine.metrics.failed(operator)
            raise ExecutionError(str(e)) from e
        self.engine.metrics.ran(operator, size(out), time.perf_counter() - began)
        return out


class Grouped:
    def __init__(self, frame: Frame, keys: Sequence[str]):
        self.frame, self.keys = frame, keys

    def agg(self, *aggs: tuple[str, str, str]) -> Frame:
        """Each is (function, column, name); functions are count, sum, min, max and avg."""
        return self.frame._with(relational.aggregate(self.frame.df, list(self.keys), aggs))
