"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches.  Each batch becomes a run: its line hashes in order, with the number of the
batch's documents that hold each.  A run is a bucketed, sorted table, so Spark merges it: a new batch is
anti-joined by a sort-merge join with the hashes of each run that have reached the threshold there,
which need no more counting, and runs are neither exchanged nor sorted again for it.  A level has one
run; with a second one, the two are merged into a run of the next level, between batches, so a hash is
rewritten once a level.  At the end what is left is merged, least first, and lines at the threshold go.

Lines are hashed with 128 bits.  Up to ``held_keys`` frequent hashes go to the tasks as a set, those of
the greatest counts first; what is beyond is joined to the documents' hashes instead, and no hash left
there is in more than 2 / ``held_keys`` of all lines, so none is hot.

Defined cases: a null or empty text is one empty line; a document counts once for a line however
often it repeats there; repeated rows count as documents of their own; keys under ``min_chars`` code
points are never dropped; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shared import arrow_batches, drop_path, fresh_path, hold, staged, table, texts_of


def line_keys(text: str) -> list[bytes]:
    """The lines' keys in UTF-8; bytes.lower and bytes.strip know ASCII only, as the keys want."""
    return [line.strip() for line in text.encode().lower().split(b"\n")]


def _hash(key: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(key)


def _hashes(min_chars: int):
    def run(arrow):
        for batch in arrow:
            out: list[bytes] = []
            for text in texts_of(batch):
                keys = set(line_keys(text))
                out += [_hash(k) for k in keys if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)]
            both = np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)
            n = len(both)
            part = np.full(n, batch.column("batch")[0].as_py() if len(batch) else 0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(part)], ["a", "b", "batch"])

    return run


#: With these, a scan of a run keeps its buckets and their order.
_SORTED_RUNS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.enabled": "true"}


@contextmanager
def sorted_runs(spark: SparkSession):
    before = {k: spark.conf.get(k) for k in _SORTED_RUNS}
    for k, v in _SORTED_RUNS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class RunLevels:
    """Levelled runs (a, b, n): tables in the shared folder, in ``buckets`` buckets sorted by hash."""

    def __init__(self, spark: SparkSession, threshold: int, buckets: int | None = None):
        self.spark, self.threshold = spark, threshold
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[str, str] | None] = []  # of each level its run: (table, path)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(run[0]) for run in self.levels if run]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The batch's hashes (a, b), one row a document, counted, but for what has reached the threshold.

        Counting comes first: it folds a frequent line before any shuffle."""
        counts = batch.groupBy("a", "b").agg(F.count("*").alias("n"))
        for run in self.runs():
            counts = counts.join(run.where(F.col("n") >= self.threshold).select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        return counts

    def add(self, batch: DataFrame) -> None:
        with sorted_runs(self.spark):
            run = self._write(self.fresh(batch), 0)
            level = 0
            while level < len(self.levels) and self.levels[level]:
                run, self.levels[level] = self._merged(self.levels[level], run, level + 1), None
                level += 1
            self.levels[level : level + 1] = [run]

    def _write(self, rows: DataFrame, level: int) -> tuple[str, str]:
        name, path = f"marlstone_run_{uuid.uuid4().hex}", fresh_path(self.spark, f"lines-level-{level}")
        rows.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", path).saveAsTable(name)
        return name, path

    def merging(self, one: DataFrame, other: DataFrame) -> DataFrame:
        both = one.join(other.withColumnRenamed("n", "m").hint("merge"), ["a", "b"], "full_outer")
        return both.select("a", "b", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    def _merged(self, one: tuple[str, str], other: tuple[str, str], level: int) -> tuple[str, str]:
        out = self._write(self.merging(self.spark.table(one[0]), self.spark.table(other[0])), level)
        self._drop(one)
        self._drop(other)
        return out

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE {run[0]}")
        drop_path(self.spark, run[1])

    def frequent(self) -> DataFrame:
        """The hashes at the threshold, with their counts up to where counting stopped; ends the levels."""
        with sorted_runs(self.spark):
            runs = [(level, run) for level, run in enumerate(self.levels) if run]
            last = runs[0][1]
            for level, run in runs[1:]:
                last = self._merged(last, run, level)
            out = staged(self.spark.table(last[0]).where(F.col("n") >= self.threshold), "lines-frequent")
        self._drop(last)
        self.levels = []
        return out


KEPT = "doc_id long, n_lines long, n_dropped long, kept string"


def _drop(held, min_chars: int):
    """Drop the lines with a frequent hash: of the held set, or of the row's own list."""

    def run(arrow):
        frequent = held.value
        for batch in arrow:
            own = batch.column("frequent").to_pylist() if "frequent" in batch.schema.names else None
            n_lines, n_dropped, kept = [], [], []
            for i, text in enumerate(texts_of(batch)):
                known = frequent.union(own[i]) if own and own[i] else frequent
                lines = text.split("\n")
                stays = [x for x, k in zip(lines, line_keys(text)) if not k or _hash(k) not in known]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stays))
                kept.append("\n".join(stays))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def held_from(frequent: DataFrame, held_keys: int) -> int | None:
    """The least power of two of which at most ``held_keys`` hashes have that count or more."""
    size = F.floor(F.log2("n")).cast("int")
    sizes = {r["k"]: r["c"] for r in frequent.groupBy(size.alias("k")).agg(F.count("*").alias("c")).collect()}  # 64 rows at most
    seen, least = 0, None
    for k in sorted(sizes, reverse=True):
        seen += sizes[k]
        if seen > held_keys:
            break
        least = 1 << k
    return least


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batch_docs: int = 50_000_000, least_batches: int = 4, held_keys: int = 250_000) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept, the text without the lines found in ``min_docs`` documents.

    A batch has about ``batch_docs`` documents, or fewer where that gives fewer than ``least_batches``."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    batches = max(least_batches, -(-texts.count() // batch_docs))
    levels = RunLevels(spark, min_docs)
    whole = texts.select("text", F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch"))  # a task is of one batch
    hashes = staged(whole.mapInArrow(_hashes(min_chars), "a long, b long, batch int"), "line-hashes", ("batch",))
    for k in range(batches):
        levels.add(hashes.where(F.col("batch") == k).select("a", "b"))
    frequent = levels.frequent()
    least = held_from(frequent, held_keys)
    few = frequent.where(F.col("n") >= least) if least else frequent.limit(0)
    pairs = few.select("a", "b").toArrow()  # at most held_keys
    both = np.stack([pairs.column(c).to_numpy() for c in ("a", "b")], axis=1).astype("<i8").tobytes()
    held = hold(spark, frozenset(both[i : i + 16] for i in range(0, len(both), 16)))
    many = frequent.where(F.col("n") < least) if least else frequent
    if many.limit(1).count():
        texts = texts_with_own(texts, many.select("a", "b"), held)
    return texts.mapInArrow(_drop(held, min_chars), KEPT)


def texts_with_own(texts: DataFrame, frequent: DataFrame, held) -> DataFrame:
    """Each text with the list of its own hashes among ``frequent``: those that aren't held everywhere.

    Rows are told apart by their place in the input, so repeated doc_ids do no harm."""
    placed = staged(texts.withColumn("place", F.monotonically_increasing_id()), "line-places")

    def run(arrow):
        for batch in arrow:
            at, out = [], []
            for place, text in zip(batch.column("place").to_pylist(), texts_of(batch)):
                keys = {_hash(k) for k in line_keys(text) if k} - held.value
                at += [place] * len(keys)
                out += keys
            both = np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(out, pa.binary())], ["place", "a", "b", "hash"])

    own = placed.select("place", "text").mapInArrow(run, "place long, a long, b long, hash binary").join(frequent, ["a", "b"]).groupBy("place").agg(F.collect_list("hash").alias("frequent"))
    return placed.join(own, "place", "left").select("doc_id", "text", "frequent")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = drop_frequent_lines(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (key IN (SELECT key FROM f))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (key NOT IN (SELECT key FROM f)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
