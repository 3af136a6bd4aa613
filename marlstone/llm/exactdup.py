"""Exact deduplication over an extendible-hash index in the shared folder, in Spark SQL only.

1. Every text is normalised and hashed once.  Entries of equal hash and digest fold before any shuffle
   into one key (hash, digest, number of documents), so copies don't fill buckets.
2. The keys are the index's rows.  A range exchange on the bucket gives every owner task a range of the
   directory; it writes its buckets, sorted, into one file of the level.  A bucket over ``capacity`` is
   split: its keys are read again and written, told apart by one more leading bit of the hash, into the
   next level's files.  Where over ``listed`` buckets of a level are overfull, the directory doubles:
   all buckets of the level split.  A bucket that one hash fills can't be split, and stays.
3. The directory says of a hash which level's files hold it; rows of split buckets in older files are
   dead.  It is a short list at any size: depths, and at most ``listed`` split buckets of each.
4. Only keys of several documents need texts.  These are read again, equal texts fold before the
   shuffle, and owner tasks take the folded texts by ranges of the directory, chain the different texts
   of a hash, and settle each class by its bytes.
5. Every document looks its class up; classes of over a thousandth of all rows are broadcast.

Defined cases: null texts are empty and equal to one another and to texts of white space alone; of
equal rows (same doc_id too) each is returned, and a repeated doc_id is kept at every row of it; a
null doc_id stays only if no other of the group is as long; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.shared import HOT, WHITE, fresh_path, join_by_class, small_side, staged, table


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _prefix(depth: int) -> Column:
    """The leading bits of the hash ``h``, as a number from 0."""
    return F.shiftrightunsigned(F.col("h"), 64 - depth) if depth else F.lit(0).cast("long")


class ExtendibleIndex:
    """Keys (``h`` and other columns) in files by bucket, and the directory that finds them."""

    def __init__(self, spark: SparkSession, capacity: int, listed: int = 4096):
        self.spark, self.capacity, self.listed = spark, capacity, listed
        self.root = fresh_path(spark, "exact-index")
        #: The directory: of each level its depth, and which of its buckets were split; None: all.
        self.levels: list[tuple[int, frozenset[int] | None]] = []

    def _path(self, depth: int) -> str:
        return f"{self.root}/level-{depth:02d}"

    def _live(self, depth: int, split: frozenset[int] | None) -> DataFrame:
        rows = self.spark.read.parquet(self._path(depth))
        return rows.where(~F.col("bucket").isin(list(split))) if split else rows

    def _owned(self, rows: DataFrame) -> DataFrame:
        """Rows with a ``depth`` and a ``bucket``, dealt so that a task owns a range of the directory."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartitionByRange(n, "depth", "bucket")

    def build(self, keys: DataFrame, rows: int) -> "ExtendibleIndex":
        """Write ``keys``, at most ``rows`` of them, and split buckets until all fit."""
        depth = max(0, math.ceil(math.log2(max(1, rows / self.capacity))))
        part = keys
        while True:
            placed = part.withColumn("depth", F.lit(depth)).withColumn("bucket", _prefix(depth))
            self._owned(placed).sortWithinPartitions("bucket", "h").write.parquet(self._path(depth))
            level = self.spark.read.parquet(self._path(depth))
            sizes = level.groupBy("bucket").agg(F.count("*").alias("n"), F.min("h").alias("a"), F.max("h").alias("b"))
            over = sizes.where((F.col("n") > self.capacity) & (F.col("a") != F.col("b")) & F.lit(depth < 63))
            split = [r["bucket"] for r in over.select("bucket").limit(self.listed + 1).collect()]
            self.levels.append((depth, None if len(split) > self.listed else frozenset(split)))
            if not split:
                return self
            part = (level if len(split) > self.listed else level.where(F.col("bucket").isin(split))).drop("depth", "bucket")
            depth += 1

    def read(self) -> DataFrame:
        """The live keys, each once, with their bucket."""
        live = [self._live(depth, split) for depth, split in self.levels if split is not None]
        out = live[0]
        for rows in live[1:]:
            out = out.unionByName(rows)
        return out

    def address(self) -> Column:
        """The directory's entry of the hash ``h``: struct (depth, bucket)."""
        out = None
        for depth, split in reversed(self.levels):
            here = F.struct(F.lit(depth).alias("depth"), _prefix(depth).alias("bucket"))
            out = here if out is None or split == frozenset() else out if split is None else F.when(_prefix(depth).isin(list(split)), out).otherwise(here)
        return out

    def owned(self, rows: DataFrame) -> DataFrame:
        """Any rows with a hash ``h``, dealt to the owners of their buckets."""
        return self._owned(rows.withColumn("at", self.address()).select("*", "at.depth", "at.bucket").drop("at"))


def exact_duplicates(docs: DataFrame, capacity: int = 16_384, held: int = 200_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    Of equal texts the one with the most code points before normalising stays, then the smallest id.
    Up to ``held`` classes of copies are broadcast; beyond that, hot ones alone.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), normalised(F.col("text")).alias("norm"))
    entries = staged(texts.select("doc_id", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha")), "exact-entries")
    total = entries.count()
    index = ExtendibleIndex(docs.sparkSession, capacity).build(entries.groupBy("h", "sha").agg(F.count("*").alias("n")), total)
    several = staged(index.read().where("n > 1").select("h").distinct(), "exact-several")
    shared = texts.withColumn("h", F.xxhash64("norm")).join(small_side(several, several.count(), 2_000_000), "h", "left_semi")
    best = F.max(F.struct("chars", (-F.col("doc_id")).alias("neg")))
    folded = shared.groupBy("h", "norm").agg(F.count("*").alias("n"), best.alias("best"))
    chain = F.row_number().over(Window.partitionBy("depth", "bucket", "h").orderBy("norm"))
    classes = index.owned(folded).select("depth", "bucket", "h", chain.alias("link"), F.sha2("norm", 256).alias("sha"), "n", (-F.col("best.neg")).alias("keep"))
    # The index holds every key of several documents at its address; its class is the link with its digest.
    keys = index.read().where("n > 1").select("depth", "bucket", "h", "sha")
    classes = staged(classes.where("n > 1").join(keys, ["depth", "bucket", "h", "sha"]).select("h", "sha", "n", "keep"), "exact-classes")
    if (few := classes.count()) <= held:
        found = entries.join(small_side(classes, few, held), ["h", "sha"], "left")
    else:
        found = join_by_class(entries, classes, ["h", "sha"], F.col("n") * HOT > total, "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS n FROM t)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
