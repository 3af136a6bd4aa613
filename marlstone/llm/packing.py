"""Best-fit packing of tokenised documents, planned over a histogram of lengths.

The plan packs counts, not documents: best-fit decreasing over at most ``capacity`` distinct
lengths on the driver, where a run of equal sequences is one entry.  Its size depends on the
capacity, not on the number of documents.  Each piece then takes its slot by its rank among the
pieces of its length.

Defined cases: a null or empty text is a document of the end id alone; a document longer than the
capacity is cut into full pieces behind one shorter first piece; repeated rows are packed once
each; a special token's string inside a text is that token, as the tokenizer file says; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.shared import arrow_batches, last_at_most, small_side, staged, table, texts_of, tidy
from marlstone.llm.tokens import encode_in_blocks

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
#: Of each length its slots, by rank: the first rank, sequence and offset of each.
PLAN = pa.schema([("length", pa.int64()), *((name, pa.list_(pa.int64())) for name in ("froms", "firsts", "offsets"))])


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, rank_from, rank_to, first_sequence, offset) by best-fit decreasing.

    A slot seats the pieces of ranks rank_from to rank_to - 1 of one length in consecutive
    sequences from first_sequence on, all at the same offset.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, how many)
    free: list[int] = []  # the keys of room that are in use, ascending
    used = 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if not room[left]:
                insort(free, left)
            room[left].append((first, n))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect_left(free, length)
            if at < len(free):
                left = free[at]
                first, n = room[left].pop()
                if not room[left]:
                    free.pop(at)
                k = min(n, todo)
                slots.append((length, rank, rank + k, first, capacity - left))
                put(left, first + k, n - k)
                put(left - length, first, k)
            else:
                each = capacity // length
                n, each = (todo // each, each) if todo >= each else (1, todo)
                for j in range(each):
                    slots.append((length, rank + j * n, rank + (j + 1) * n, used, j * length))
                put(capacity - each * length, used, n)
                used, k = used + n, n * each
            rank, todo = rank + k, todo - k
    return slots


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for i, found in encode_in_blocks(path, texts_of(batch)):
                data = memoryview(found + end)
                n, at, k = len(data) // 4, 0, 0
                while at < n:
                    length = n % capacity or capacity if not at else capacity
                    out.append((ids[i], k, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), part, seen[length]))
                    seen[length] += 1
                    at, k = at + length, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names)

    return tidy(run, cached=True)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = staged(texts.mapInArrow(_pieces(tokenizer_path, end_id, capacity), PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most `capacity` rows, whatever the number of documents.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan_best_fit(histogram, capacity)
    by_length: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, rank_from, _, first, offset in slots:
        by_length[length].append((rank_from, first, offset))
    rows = [dict(zip(PLAN.names, (length, *map(list, zip(*sorted(of)))))) for length, of in by_length.items()]
    # A row a length; its slots are found by binary search, so a piece meets one row, not each slot.
    # By Arrow: from a list, each executor would start a second Python daemon with workers of its own.
    plan = spark.createDataFrame(pa.Table.from_pylist(rows, PLAN))
    steps = max((len(of) for of in by_length.values()), default=1).bit_length()
    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    placed = ranked.join(small_side(plan, len(slots), 1_000_000), "length").withColumn("slot", last_at_most(F.col("froms"), F.col("rank"), steps))
    sequence = F.get("firsts", "slot") + F.col("rank") - F.get("froms", "slot")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), F.get("offsets", "slot").alias("offset"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
