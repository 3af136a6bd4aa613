"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

A shard is one file: magic, the ids (2 bytes each where the vocabulary allows, else 4), the coded
boundaries, the coded document ids, then a JSON footer and its length.  A boundary costs about
2 + log2(ids per document) bits; a sampled select structure finds any boundary without decoding
the others.  Shards hold ascending ranges of doc_id, and a manifest lists them in order.

Defined cases: a null or empty text is the end id alone; null doc_ids come first and come back as
null; a special token's string inside a text is that token; repeated rows are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shared import arrow_batches, fresh_path, table, texts_of
from marlstone.llm.tokens import encode_in_blocks

MAGIC = b"MARLTOK1"
SAMPLE = 256


@dataclass
class EliasFano:
    """A non-decreasing sequence of integers from 0 on, as low bits and a unary-coded high part."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: np.ndarray  # position of every SAMPLE-th one in `high`

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", np.zeros(0, "<u8"))
        bits = max(0, int(int(v[-1]) // n).bit_length() - 1)
        if bits:
            low = (v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(low.astype(np.uint8), bitorder="little").tobytes()
        else:
            low = b""
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) // 8 + 1) * 8, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u8"))

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        data = np.frombuffer(self.low, np.uint8)
        for j in range(self.low_bits):
            bit = at * self.low_bits + j
            out |= ((data[bit >> 3] >> (bit & 7)) & 1).astype(np.uint64) << np.uint64(j)
        return out

    def select(self, i: int) -> int:
        """Value number i: from the nearest sample on, counting ones."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while word.bit_count() <= left:
            left -= word.bit_count()
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = 8 * byte + (word & -word).bit_length() - 1
        return ((one - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def selected(self, start: int, stop: int) -> np.ndarray:
        """Values number start to stop - 1: by select, a sample's block of the high part at a time."""
        out = np.zeros(max(0, stop - start), np.uint64)
        at = start
        while at < stop:
            block = at // SAMPLE
            to = min(stop, (block + 1) * SAMPLE)
            first = int(self.samples[block])
            last = int(self.samples[block + 1]) if block + 1 < len(self.samples) else 8 * len(self.high)
            bits = np.unpackbits(np.frombuffer(self.high[first >> 3 : (last + 7) >> 3], np.uint8), bitorder="little")
            ones = np.flatnonzero(bits[first & 7 :])[at - block * SAMPLE : to - block * SAMPLE] + first
            i = np.arange(at, to)
            out[at - start : to - start] = ((ones - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)
            at = to
        return out

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")) if self.n else np.zeros(0, np.int64)
        high = (ones - np.arange(self.n)).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(np.arange(self.n))

    def parts(self) -> list[bytes]:
        return [self.low, self.high, self.samples.tobytes()]

    def head(self) -> dict:
        return {"n": self.n, "low_bits": self.low_bits, "sizes": [len(p) for p in self.parts()]}

    @classmethod
    def read(cls, head: dict, data: bytes) -> "EliasFano":
        a, b, c = head["sizes"]
        return cls(head["n"], head["low_bits"], data[:a], data[a : a + b], np.frombuffer(data[a + b : a + b + c], "<u8"))


class ShardWriter:
    def __init__(self, out, width: int):
        self.out, self.width, self.tokens = out, width, 0
        self.ends: list[int] = [0]
        self.docs: list[int] = []
        self.nulls = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Documents come in ascending order of doc_id, nulls first."""
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.tokens += len(ids)
        self.ends.append(self.tokens)
        if doc_id is None:
            self.nulls += 1
        else:
            self.docs.append(doc_id)

    def close(self) -> None:
        first = self.docs[0] if self.docs else 0
        ends = EliasFano.encode(np.array(self.ends, np.uint64))
        docs = EliasFano.encode(np.array([d - first for d in self.docs], np.uint64))
        for part in ends.parts() + docs.parts():
            self.out.write(part)
        foot = json.dumps({"tokens": self.tokens, "width": self.width, "nulls": self.nulls, "first": first, "ends": ends.head(), "docs": docs.head()}).encode()
        self.out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
        self.out.close()


class ShardReader:
    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token-id shard, or cut short")
        n = int.from_bytes(tail[:8], "little")
        file.seek(size - 16 - n)
        self.foot = json.loads(file.read(n))
        at = len(MAGIC) + self.foot["tokens"] * self.foot["width"]
        file.seek(at)
        body = file.read(size - 16 - n - at)
        cut = sum(self.foot["ends"]["sizes"])
        self.ends = EliasFano.read(self.foot["ends"], body[:cut])
        self.docs = EliasFano.read(self.foot["docs"], body[cut:])

    def __len__(self) -> int:
        return self.ends.n - 1

    def ids(self, start: int, stop: int) -> np.ndarray:
        w = self.foot["width"]
        self.file.seek(len(MAGIC) + start * w)
        return np.frombuffer(self.file.read((stop - start) * w), f"<u{w}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """The ids of document i alone, found by two selects."""
        return self.ids(self.ends.select(i), self.ends.select(i + 1))

    def some_doc_ids(self, start: int, stop: int) -> list[int | None]:
        """The doc_ids of documents start to stop - 1, found by select."""
        nulls = self.foot["nulls"]
        known = self.docs.selected(max(0, start - nulls), max(0, stop - nulls))
        return [None] * max(0, min(stop, nulls) - start) + [int(d) + self.foot["first"] for d in known]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.foot["nulls"] + [int(d) + self.foot["first"] for d in self.docs.decode()]


def _writer(where: str, tokenizer_path: str, end_id: int, width: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(where)
        name = f"shard-{part:06d}.tok"
        attempt = f"{root}/_attempt-{uuid.uuid4().hex}"
        out = ShardWriter(fs.open_output_stream(attempt), width)
        end = np.array([end_id], "<u4")
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for i, found in encode_in_blocks(tokenizer_path, texts_of(batch)):
                out.add(docs[i], np.concatenate([np.frombuffer(found, "<u4"), end]))
        out.close()
        fs.move(attempt, f"{root}/{name}")  # a shard appears whole or not at all
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(out.ends) - 1], pa.int64()), pa.array([out.tokens], pa.int64())], ["shard", "name", "docs", "tokens"])

    return run


def write_token_files(docs: DataFrame, where: str, tokenizer_path: str, end_id: int = 2, shards: int | None = None) -> list[dict]:
    """Write all of ``docs`` in ascending doc_id order below ``where``; returns the manifest."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    arrow_batches(spark)
    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, root = pafs.FileSystem.from_uri(where)
    fs.create_dir(root, recursive=True)
    # The row's place in the input breaks ties, so repeated doc_ids can be spread over shards.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_place"))
    rows = rows.repartitionByRange(n, "doc_id", "_place").sortWithinPartitions("doc_id", "_place").select("doc_id", "text")
    made = rows.mapInArrow(_writer(where, tokenizer_path, end_id, 2 if vocabulary <= 65536 else 4), "shard int, name string, docs long, tokens long")
    manifest, docs_before, tokens_before = [], 0, 0
    for r in sorted(made.collect(), key=lambda r: r["shard"]):  # one row for each shard
        manifest.append({"name": r["name"], "docs": r["docs"], "tokens": r["tokens"], "docs_before": docs_before, "tokens_before": tokens_before})
        docs_before, tokens_before = docs_before + r["docs"], tokens_before + r["tokens"]
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def _reader(where: str, manifest: list[dict], step: int = 1 << 20, documents: int = 16 * SAMPLE):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(where)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                shard = manifest[k]
                with fs.open_input_file(f"{root}/{shard['name']}") as file:
                    reader = ShardReader(file)
                    for lo in range(0, len(reader), documents):  # boundaries by select, a block of documents at a time
                        hi = min(len(reader), lo + documents)
                        docs, ends = reader.some_doc_ids(lo, hi), reader.ends.selected(lo, hi + 1).astype(np.int64)
                        crc, at = [], 0
                        while at < len(docs):  # about `step` ids at a time
                            to = max(at + 1, int(np.searchsorted(ends, ends[at] + step)))
                            to = min(to, len(docs))
                            data = memoryview(reader.ids(int(ends[at]), int(ends[to])).tobytes())
                            crc += [zlib.crc32(data[4 * (a - ends[at]) : 4 * (b - ends[at])]) for a, b in zip(ends[at:to], ends[at + 1 : to + 1])]
                            at = to
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends[:-1] + shard["tokens_before"]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files below ``where``."""
    fs, root = pafs.FileSystem.from_uri(where)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    n = len(manifest)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(_reader(where, manifest), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    where = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), where, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, where)
