"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint is cut into blocks of 32 bits.  Fingerprints of k blocks at distance 3k - 1 or less differ
by at most 2 bits in one block.  The anchors of a block are the words of the [31, 26] Hamming code and a
free bit: a perfect covering code of radius 1.  Between two blocks at distance 2 lies a point at distance
1 of both, and an anchor within 1 of that point; so both reach it within 1 (covering radius) + 1 (half
the 2 bits).  Replicating each block to the 17 or fewer anchors within 2 therefore loses no such pair: at
64 bits, no pair within 5.  Pairs beyond that, which wide fingerprints with a wide threshold ask for, are
found where one block is near enough.  Each anchor compares the fingerprints that it holds, all of their
bits, and passes on one link each to a representative, never all pairs.

Equal fingerprints are folded first, so a large group of copies counts once.  An anchor with very many
fingerprints is cut into parts, and every two parts are compared by a task.  Fingerprints and components
that hold over a thousandth of all rows are broadcast, so their rows are not gathered in one task.

Defined cases: null and empty texts, and those of white space, have fingerprint zero, which links
like any other; fewer words than a shingle: the whole sequence is the one shingle; repeated rows get
one component; a null doc_id belongs to a component but never names it unless it has no other id;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.links import components
from marlstone.llm.shared import HOT, arrow_batches, join_by_class, staged, table, texts_of, tidy


def fingerprint(text: str, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash; see ``fingerprints``."""
    return int(fingerprints([text], shingle)[0, 0])


def _widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """(hashes, words): each hash, and further words mixed from it."""
    out = np.empty((len(hashes), words), np.uint64)
    out[:, 0] = hashes
    for k in range(1, words):
        z = hashes + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def shingle_hashes(text: str, shingle: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of each shingle in order, repeats included; none for a text without words."""
    import xxhash

    hash64 = xxhash.xxh64_intdigest
    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = starts[shingle:] + [at] if len(words) >= shingle else [at]
    held = []
    for lo in range(0, n, 65536):  # very long texts, block by block
        held.append(np.array([hash64(joined[a : b - 1], 42) for a, b in zip(starts[lo : min(n, lo + 65536)], ends[lo : lo + 65536])], dtype="<u8"))
    return np.concatenate(held)


def voted(hashes: np.ndarray, bits: int = 64) -> np.ndarray:
    """(bits / 64) unsigned words: a bit is 1 if set in over half of the hashes, mixed on beyond 64 bits."""
    votes = np.zeros(bits, np.int64)
    for lo in range(0, len(hashes), 65536 * 64 // bits):
        wide = _widened(hashes[lo : lo + 65536 * 64 // bits], bits // 64)
        votes += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return np.bitwise_or.reduce(np.where((votes * 2 > len(hashes)).reshape(-1, 64), weights, np.uint64(0)), axis=1)


def fingerprints(texts: list[str], shingle: int = 4, bits: int = 64, repeats: bool = True) -> np.ndarray:
    """(texts, bits / 64) unsigned words.  A bit is 1 if set in over half of the shingles' XXH64 hashes
    (seed 42), repeats included or not; beyond 64 bits the hashes are mixed on."""
    out = np.zeros((len(texts), bits // 64), np.uint64)
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, shingle)
        if len(hashes):
            out[i] = voted(hashes if repeats else np.unique(hashes), bits)
    return out


def distance_of(similarity: float, bits: int, deviations: float = 0.5) -> int:
    """Differing bits of two texts whose sets of shingles, of like size, have that Jaccard similarity:
    as many as expected, and half a deviation more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def _fingerprint_rows(shingle: int, bits: int, repeats: bool):
    @tidy
    def run(arrow):
        for batch in arrow:
            found = fingerprints(texts_of(batch), shingle, bits, repeats).astype(">u8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f.tobytes() for f in found], pa.binary())], ["doc_id", "fp"])

    return run


def _words(batch) -> np.ndarray:
    """Binary fingerprints as (rows, words)."""
    data = b"".join(batch.column("fp").to_pylist())
    return np.frombuffer(data, ">u8").astype(np.uint64).reshape(batch.num_rows, -1)


def anchor_masks() -> list[list[int]]:
    """By syndrome: what to xor to a half of 32 bits to reach its anchors within distance 2.

    Bit j of the lower 31 has the check j + 1; bit 31 is free.
    """
    masks = []
    for s in range(32):
        if s:
            near = [1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s and i ^ s]
            masks.append([*near, (1 << (s - 1)) | 1 << 31])
        else:
            masks.append([0, 1 << 31])
    return masks


def _anchors(at: int):
    """(anchor, key, fp) for both blocks of a fingerprint's word ``at``: the anchor's word, with the block's number above."""
    return lambda arrow: _anchors_of(arrow, at)


def _anchors_of(arrow, at: int):
    masks = anchor_masks()
    checks = [sum(1 << (j - 1) for j in range(1, 32) if j >> b & 1) for b in range(5)]
    table = np.zeros((32, 17), np.uint64)
    size = np.array([len(m) for m in masks])
    for s, m in enumerate(masks):
        table[s, : len(m)] = m
    for batch in arrow:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            fps = _words(part)
            for block in (2 * at, 2 * at + 1):
                word = (fps[:, at] >> np.uint64(32 * (block % 2))) & np.uint64(0xFFFFFFFF)
                syndrome = sum((np.bitwise_count(word & np.uint64(c)).astype(np.int64) & 1) << b for b, c in enumerate(checks))
                reach = (word[:, None] ^ table[syndrome]) | np.uint64(block << 32)
                valid = np.arange(17)[None, :] < size[syndrome][:, None]
                of = pa.array(np.repeat(np.arange(len(fps)), valid.sum(axis=1)))
                yield pa.RecordBatch.from_arrays([pa.array(reach[valid].view(np.int64)), part.column("key").take(of), part.column("fp").take(of)], ["anchor", "key", "fp"])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _link_group(fps: np.ndarray, keys: np.ndarray, threshold: int, block: int, out: list) -> None:
    """Links that join what lies within the threshold: one for each newly joined fingerprint."""
    n = len(fps)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for lo in range(0, n, block):
        a = fps[lo : lo + block]
        for lo2 in range(lo, n, block):
            near = np.argwhere(_distances(a[:, None], fps[None, lo2 : lo2 + block]) <= threshold)
            for i, j in near:
                i, j = lo + int(i), lo2 + int(j)
                if i < j and (x := find(i)) != (y := find(j)):
                    root[max(x, y)] = min(x, y)
                    out.append((int(keys[i]), int(keys[j])))


def _compare(threshold: int, block: int, most: int):
    """Over rows sorted by anchor, of which a task has whole anchors: the links (a, b), and the rows
    (anchor, key, fp) of anchors with over ``most`` fingerprints, which are passed on as they come."""

    @tidy
    def run(arrow):
        pending: list[tuple] = []  # the rows so far of the last anchor
        passing = None  # an anchor that is passed on

        def links(anchors: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            out: list = []
            cuts = np.flatnonzero(np.diff(anchors)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(anchors)]
            pair = starts[ends - starts == 2]
            near = pair[_distances(fps[pair], fps[pair + 1]) <= threshold]
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                _link_group(fps[s:e], keys[s:e], threshold, block, out)
            more = np.array(out, np.int64).reshape(-1, 2)
            a, b = np.r_[keys[near], more[:, 0]], np.r_[keys[near + 1], more[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary())], ["a", "b", "fp"])

        def passed(anchors: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(keys), pa.array([f.tobytes() for f in fps.astype(">u8")], pa.binary())], ["a", "b", "fp"])

        for batch in arrow:
            anchors, keys, fps = batch.column("anchor").to_numpy(), batch.column("key").to_numpy(), _words(batch)
            if passing is not None:
                cut = int(np.searchsorted(anchors != passing, True)) if (anchors != passing).any() else len(anchors)
                if cut:
                    yield passed(anchors[:cut], keys[:cut], fps[:cut])
                anchors, keys, fps = anchors[cut:], keys[cut:], fps[cut:]
                passing = passing if not len(anchors) else None
            if not len(anchors):
                continue
            pending.append((anchors, keys, fps))
            if anchors[-1] == pending[0][0][0] and sum(len(x[0]) for x in pending) <= most:
                continue  # one anchor still
            anchors, keys, fps = (np.concatenate(x) for x in zip(*pending))
            starts = np.r_[0, np.flatnonzero(np.diff(anchors)) + 1]
            sizes = np.diff(np.r_[starts, len(anchors)])
            for s, n in zip(starts[sizes > most], sizes[sizes > most]):
                yield passed(anchors[s : s + n], keys[s : s + n], fps[s : s + n])
            last = slice(starts[-1], None)
            pending = [(anchors[last], keys[last], fps[last])] if sizes[-1] <= most else []
            passing = anchors[-1] if sizes[-1] > most else None
            keep = np.repeat((sizes <= most) & (np.arange(len(sizes)) < len(sizes) - 1), sizes)
            if keep.any():
                yield links(anchors[keep], keys[keep], fps[keep])
        if pending:
            yield links(*(np.concatenate(x) for x in zip(*pending)))

    return run


def near_links(fps: DataFrame, threshold: int = 4, block: int = 1024, most: int = 16_384) -> DataFrame:
    """Links (a, b) between the keys of the distinct fingerprints (``key``, ``fp``) within the threshold.

    Not all pairs: enough to join what is linked.  See above for which pairs are sure to be found.  An
    anchor with over ``most`` fingerprints is cut into parts, and a task compares two parts.  Wide
    fingerprints have many anchors; those of a word at a time are on disk.
    """
    # A task gets about 64 MB of replicas, of 32 bytes and the fingerprint each.
    width = fps.select(F.max(F.octet_length("fp"))).first()[0] or 8
    size = fps.count() * 34 * (32 + width)
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (64 << 20)))
    return reduce(DataFrame.unionByName, [_word_links(fps, k, n, threshold, block, most) for k in range(width // 8)])


def _word_links(fps: DataFrame, word: int, n: int, threshold: int, block: int, most: int) -> DataFrame:
    """The links of the anchors of one word."""
    at = fps.mapInArrow(tidy(_anchors(word)), "anchor long, key long, fp binary").repartition(n, "anchor").sortWithinPartitions("anchor")
    found = staged(at.mapInArrow(_compare(threshold, block, most), "a long, b long, fp binary"), "near-links")
    links, hot = found.where("fp is null").select("a", "b"), found.where("fp is not null").select(F.col("a").alias("anchor"), F.col("b").alias("key"), "fp")
    sizes = hot.groupBy("anchor").agg(F.ceil(2 * F.count("*") / most).alias("parts"))
    if not sizes.limit(1).count():
        return links
    # A row of part c goes to the tasks of the pairs (c, 0), (c, 1) and so on, the lesser part first.
    parted = hot.join(sizes, "anchor").withColumn("c", F.pmod(F.xxhash64("key"), "parts"))
    paired = parted.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = F.xxhash64("anchor", F.least("c", "o"), F.greatest("c", "o"))
    again = paired.select(pair.alias("anchor"), "key", "fp").repartition(n, "anchor").sortWithinPartitions("anchor")
    return links.unionByName(staged(again.mapInArrow(_compare(threshold, block, 1 << 62), "a long, b long, fp binary").select("a", "b"), "near-links-parts"))


def near_duplicates(docs: DataFrame, shingle: int = 4, threshold: int = 4, bits: int = 64, repeats: bool = True) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id that links reach) of every row."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = staged(texts.mapInArrow(_fingerprint_rows(shingle, bits, repeats), "doc_id long, fp binary"), "fingerprints")
    folded = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = staged(folded.withColumn("key", F.monotonically_increasing_id()), "fingerprint-classes")
    roots = staged(components(near_links(classes.select("key", "fp"), threshold)), "fingerprint-roots")
    linked = staged(classes.join(roots.withColumnRenamed("node", "key"), "key").drop("key"), "fingerprint-linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    joined = join_by_class(linked, least, ["root"], F.col("size") * HOT > linked.count())
    alone = classes.join(roots.withColumnRenamed("node", "key"), "key", "left_anti").withColumn("component_id", F.col("least"))
    of = staged(joined.select("fp", "n", "component_id").unionByName(alone.select("fp", "n", "component_id")), "fingerprint-components")
    return join_by_class(rows, of, ["fp"], F.col("n") * HOT > rows.count()).select("doc_id", "fp", "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
