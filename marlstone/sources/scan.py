"""Parquet tables: declared or inferred schemas, numeric widening over files, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.errors import PlanningError, StorageError
from marlstone.sources.catalog import TableDef
from marlstone.sources.files import Files

_WHOLE = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def state_of(spark: SparkSession, table: TableDef) -> tuple[str, ...]:
    """What tells that a table's files have changed, without listing them."""
    files = Files(spark)
    for location in table.locations():
        if not files.exists(location):
            raise StorageError(f"table {table.name}: {location} does not exist")
    return tuple(files.state(location) for location in table.locations())


def files_of(spark: SparkSession, table: TableDef) -> list[str]:
    """The data files of a table, listed by Spark, in parallel where there are many folders."""
    return sorted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(table.locations()).inputFiles())


def widened(a: T.DataType, b: T.DataType, name: str) -> T.DataType:
    """The type that holds both: the wider whole number, or double if either is a float."""
    if a == b:
        return a
    whole_a, whole_b = type(a) in _WHOLE, type(b) in _WHOLE
    if whole_a and whole_b:
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    floats = (T.FloatType, T.DoubleType)
    if (whole_a or isinstance(a, floats)) and (whole_b or isinstance(b, floats)):
        return T.DoubleType()
    raise PlanningError(f"column {name}: {a.simpleString()} and {b.simpleString()} have no common type")


def merged_schema(schemas: list[T.StructType], strict: bool = False) -> T.StructType:
    """One schema of several files; names and order must agree, and types too if strict."""
    out = schemas[0]
    for other in schemas[1:]:
        if [f.name for f in other] != [f.name for f in out]:
            raise PlanningError(f"files differ in their columns: {out.names} and {other.names}")
        if strict and [f.dataType for f in other] != [f.dataType for f in out]:
            raise PlanningError("files differ in their types, and the policy is strict")
        out = T.StructType([T.StructField(f.name, widened(f.dataType, g.dataType, f.name), f.nullable or g.nullable) for f, g in zip(out, other)])
    return out


def declared(table: TableDef) -> T.StructType | None:
    return T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in table.schema)) if table.schema else None


def _footers(batches):
    import pyarrow as pa
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    for batch in batches:
        paths = batch.column("path").to_pylist()
        told = []
        for path in paths:
            fs, at = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as f:
                told.append(str(pq.ParquetFile(f).schema))  # names, physical and logical types
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([t.partition("\n")[2] for t in told], pa.string())], ["path", "told"])


def infer(spark: SparkSession, files: list[str]) -> list[tuple[T.StructType, list[str]]]:
    """Files by their schema.  Tasks read the footers, and Spark reads one file of each kind."""
    kinds: dict[str, list[str]] = {"": files}
    if len(files) > 1:
        n = min(len(files), 4 * spark.sparkContext.defaultParallelism)
        rows = spark.createDataFrame([(f,) for f in files], "path string").repartition(n)
        kinds = {}
        for r in rows.mapInArrow(_footers, "path string, told string").collect():
            kinds.setdefault(r["told"], []).append(r["path"])
    return sorted(((spark.read.parquet(min(of)).schema, sorted(of)) for of in kinds.values()), key=lambda x: x[1][0])


def read_table(spark: SparkSession, table: TableDef, inference: str = "on") -> tuple[DataFrame, T.StructType]:
    """The table as a DataFrame.  Filters and columns reach the scan of each group of like files."""
    schema = declared(table)
    if schema is not None:
        return spark.read.schema(schema).parquet(*table.locations()), schema
    if inference == "off":
        raise PlanningError(f"table {table.name} has no schema, and inference is off")
    files = files_of(spark, table)
    if not files:
        raise StorageError(f"table {table.name} has no files to infer a schema from")
    groups = infer(spark, files)
    schema = merged_schema([s for s, _ in groups], inference == "strict")
    parts = []
    for s, paths in groups:
        whole = table.locations() if len(groups) == 1 else paths
        df = spark.read.schema(s).parquet(*whole)
        parts.append(df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if s[f.name].dataType != f.dataType else F.col(f"`{f.name}`") for f in schema]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, schema
