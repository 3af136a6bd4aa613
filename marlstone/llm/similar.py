"""Near copies: texts whose fingerprints are within a threshold, and texts whose sets of shingles have a
Jaccard similarity of s or more, whatever their fingerprints say.

SimHash links come first, as near_links finds them at its anchors.  Fingerprints only estimate the
similarity and anchors do not reach all of a wide threshold, so the rest is found by prefixes: sets of a
similarity of c or more share one of their first n - ceil(c n) + 1 shingles in any order that is the same
for all.  The order puts shingles that are frequent in a sample last; the sample has an effect on the work
only.  Rows that share a shingle of their prefixes are compared unless they are linked already.  Near
fingerprints are a link.  Others may be as similar as s by their sizes, by the places of the shingle, and
by the parities of 512 buckets of each set, which differ in no more bits than the sets do in shingles.
For long texts so few buckets tell little, so pairs are looked at again by sketches, of as many buckets as
a set has shingles or more; what is left is checked on the two whole sets, of 64 bits a shingle.  In large groups each row is first compared with one of them, then
with all that are not linked yet, so that many near copies do not make all their pairs.

So no pair of a similarity of s or more is lost, and none within the threshold that has c or more.  Pairs
within the threshold that are less similar than c are sure to be found only where they meet at an anchor.

Equal sets are folded first.  Shingles and sets are told apart by 64 bits.  Prefix groups with very many
rows are cut into parts, and every two parts are compared by a task.

Defined cases: texts without words are alike; fewer words than a shingle: the whole sequence is the one
shingle; a null doc_id belongs to a component but never names it unless it has no other id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.links import components
from marlstone.llm.shared import HOT, arrow_batches, forget, hold, join_by_class, small_side, staged, texts_of, tidy
from marlstone.llm.simhash import _distances, near_links, shingle_hashes, voted

#: Bits of a set's parities; documents of the sample; frequent shingles held of it; keys a task remembers;
#: rows of a large group; rounds in which prefixes are shuffled, a share of the shingles each.
PARITIES, SAMPLE, HELD, SEEN, LARGE, ROUNDS = 512, 20_000, 500_000, 50_000, 64, 4


def _set_of(text: str, shingle: int) -> tuple[int, np.ndarray]:
    """The key and the sorted hashes of a text's set of shingles."""
    import xxhash

    hashes = np.unique(shingle_hashes(text, shingle))
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), 42)).view(np.int64)), hashes


def _parities(hashes: np.ndarray, buckets: int = PARITIES) -> bytes:
    counts = np.bincount((hashes % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    return np.packbits(counts & 1).tobytes()


def _sketch(hashes: np.ndarray) -> bytes:
    """The size of a set in 8 bytes, and the parities of as many buckets or more, a power of two."""
    return np.int64(len(hashes)).tobytes() + _parities(hashes, max(PARITIES, 1 << (len(hashes) - 1).bit_length()))


def _apart(x: bytes, y: bytes) -> tuple[int, int, int]:
    """The sizes of two sets, and by their sketches in how many shingles they differ at least."""
    n, m = (int(np.frombuffer(s, np.int64, 1)[0]) for s in (x, y))
    a, b = (np.frombuffer(s, np.uint64, offset=8) for s in (x, y))
    while len(a) != len(b):  # of half as many buckets
        a, b = (v[: len(v) // 2] ^ v[len(v) // 2 :] if len(v) > min(len(a), len(b)) else v for v in (a, b))
    return n, m, int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _class_rows(shingle: int, bits: int):
    def run(arrow):
        for batch in arrow:
            found = [_set_of(t, shingle) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([k for k, _ in found], pa.int64()),
                    pa.array([voted(h, bits).astype(">u8").tobytes() if len(h) else bytes(bits // 8) for _, h in found], pa.binary()),
                    pa.array([_parities(h) for _, h in found], pa.binary()),
                    pa.array([_sketch(h) for _, h in found], pa.binary()),
                ],
                ["doc_id", "key", "fp", "parities", "sketch"],
            )

    return run


def _set_rows(shingle: int):
    def run(arrow):
        for batch in arrow:
            found = [_set_of(t, shingle) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([h.tobytes() for _, h in found], pa.binary())], ["key", "hashes"])

    return run


def _all_hashes(shingle: int):
    def run(arrow):
        for batch in arrow:
            for text in texts_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(_set_of(text, shingle)[1].view(np.int64))], ["h"])

    return run


def frequent_shingles(texts: DataFrame, rows: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that are frequent in a sample, and how frequent by powers of two."""
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(max(1, rows // SAMPLE))) == 0)
    counted = sample.mapInArrow(tidy(_all_hashes(shingle)), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    levels = staged(counted.select("h", F.floor(F.log2("n")).cast("int").alias("level")), "shingle-levels")
    least, held = 64, 0
    for level, n in sorted(((r["level"], r["n"]) for r in levels.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):
        held += n
        if held > HELD:
            break
        least = level
    found = levels.where(F.col("level") >= least).toArrow()
    hashes = found.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("level").to_numpy().astype(np.uint8)[order]


class Least:
    """What a similarity of ``of`` / ``per`` or more asks of the sizes of two sets, in whole numbers."""

    def __init__(self, of: int, per: int):
        self.of, self.per = of, per

    def shared(self, n, m):
        """Shingles that sets of these sizes have in common at least."""
        return -(-self.of * (n + m) // (self.of + self.per))

    def prefix(self, n):
        """Within so many first shingles is the first one shared with any set."""
        return n - -(-self.of * n // self.per) + 1

    def short_prefix(self, n):
        """Within so many first shingles is the first one shared with a set of that size or greater."""
        return n - self.shared(n, n) + 1

    def possible(self, n, at, key, m, to, other):
        """Whether sets of sizes n and m may be that similar if the first shingle shared is at these places."""
        lesser = (n < m) | ((n == m) & (key < other))
        small, large = np.minimum(n, m), np.maximum(n, m)
        fits = (key != other) & (self.per * small >= self.of * large) & (np.where(lesser, at, to) < self.short_prefix(small))
        return fits & (np.minimum(n - at, m - to) >= self.shared(n, m))


def _prefixes(shingle: int, least: Least, frequent):
    """(shingle, key, n, place) of the prefix of each set that another one may be similar to."""

    def run(arrow):
        often, level = frequent.value
        seen: set[int] = set()
        for batch in arrow:
            rows = []
            for text in texts_of(batch):
                key, hashes = _set_of(text, shingle)
                n = len(hashes)
                if least.per * n < least.of * (n + 1) or key in seen:
                    continue  # too small for another one, or a copy
                if len(seen) < SEEN:
                    seen.add(key)
                if len(often):
                    at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
                    hashes = hashes[np.argsort(np.where(often[at] == hashes, level[at], 0), kind="stable")]
                rows.append((hashes[: least.prefix(n)], key, n))
            if rows:
                sizes = [len(h) for h, _, _ in rows]
                columns = [np.concatenate([h for h, _, _ in rows]).view(np.int64)]
                columns += [np.repeat(np.array([r[1] for r in rows], np.int64), sizes), np.repeat(np.array([r[2] for r in rows], np.int32), sizes)]
                columns += [np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "key", "n", "place"])

    return run


def _groups(arrow, most: int):
    """(rows, whole): whole groups of the first column, by which rows are sorted; groups of over ``most``
    rows come piece by piece."""
    held, of, passing = [], None, None
    for batch in arrow:
        ids = batch.column(0).to_numpy()
        if passing is not None:
            cut = int(np.searchsorted(ids, passing, "right"))
            if cut:
                yield pa.Table.from_batches([batch.slice(0, cut)]), False
            batch, ids = batch.slice(cut), ids[cut:]
        if not len(ids):
            continue
        passing = None
        cut = int(np.searchsorted(ids, ids[-1], "left"))
        done = held + ([batch.slice(0, cut)] if cut else [])
        if done and (cut or of != ids[-1]):
            yield pa.Table.from_batches(done), True
            held = []
        of = ids[-1]
        held.append(batch.slice(cut))
        if sum(b.num_rows for b in held) > most:
            yield pa.Table.from_batches(held), False
            held, passing = [], of
    if held:
        yield pa.Table.from_batches(held), True


def _bounds(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.r_[0, np.flatnonzero(np.diff(ids)) + 1]
    return starts, np.r_[starts[1:], len(ids)]


def _shared_rows(least: Least, most: int):
    """The rows that have a possible partner in their group; all rows of large groups, marked so."""

    def run(arrow):
        for rows, whole in _groups(arrow, most):
            large = np.full(rows.num_rows, not whole)
            if whole:
                h, key, n, place = (rows.column(c).to_numpy() for c in ("h", "key", "n", "place"))
                keep = np.zeros(len(h), bool)
                starts, ends = _bounds(h)
                i = starts[ends - starts == 2]
                i = i[least.possible(n[i], place[i], key[i], n[i + 1], place[i + 1], key[i + 1])]
                keep[i] = keep[i + 1] = True
                for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                    g = slice(s, e)
                    large[g] = e - s > LARGE
                    keep[g] = e - s > LARGE or least.possible(n[g, None], place[g, None], key[g, None], n[None, g], place[None, g], key[None, g]).any(axis=1)
                rows, large = rows.filter(pa.array(keep)), large[keep]
            yield from rows.append_column("large", pa.array(large)).to_batches()

    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _pairs(compared: Least, least: Least, threshold: int, most: int, star: bool, block: int = 512):
    """(a, b, sure) of different roots in a group: links by near fingerprints, enough to join what they
    link, and pairs whose sets may be as similar as ``least``.  Each row is compared with the first one of
    its group only (``star``), or with all."""

    def run(arrow):
        first = None  # row of a group that comes in pieces
        for rows, whole in _groups(arrow, most if star else 1 << 62):
            if not whole:  # the first row of the group goes before each piece
                again = first is not None and first.column("h")[0] == rows.column("h")[0]
                rows, first = (pa.concat_tables([first, rows]), first) if again else (rows, rows.slice(0, 1))
            ids, key, root, n, place = (rows.column(c).to_numpy() for c in ("h", "key", "root", "n", "place"))
            fps, parities = _matrix(rows.column("fp")), _matrix(rows.column("parities"))
            root, out = root.copy(), []

            def found(i: np.ndarray, j: np.ndarray, sure: bool) -> None:
                out.append(np.stack([np.minimum(key[i], key[j]), np.maximum(key[i], key[j]), np.full(len(i), sure, np.int64)], axis=1))

            def compare(i: np.ndarray, j: np.ndarray, group: slice) -> None:
                ok = (root[i] != root[j]) & compared.possible(n[i], place[i], key[i], n[j], place[j], key[j])
                i, j = i[ok], j[ok]
                for lo in range(0, len(i), 65536):
                    a, b = i[lo : lo + 65536], j[lo : lo + 65536]
                    near = _distances(fps[a], fps[b]) <= threshold
                    x, y = a[near], b[near]
                    if star:
                        found(x, y, True)
                    else:
                        while len(x):  # one link joins two roots
                            found(x[:1], y[:1], True)
                            here = root[group]
                            here[here == root[y[0]]] = root[x[0]]
                            apart = root[x] != root[y]
                            x, y = x[apart], y[apart]
                    may = ~near & (root[a] != root[b])
                    a, b = a[may], b[may]
                    may = least.possible(n[a], place[a], key[a], n[b], place[b], key[b])
                    may &= _distances(parities[a], parities[b]) <= n[a] + n[b] - 2 * least.shared(n[a], n[b])
                    found(a[may], b[may], False)

            starts, ends = _bounds(ids)
            if star:
                compare(np.repeat(starts, ends - starts), np.arange(len(ids)), slice(None))
            else:
                for s, e in zip(starts, ends):
                    for lo in range(s, e, block):
                        for lo2 in range(lo, e, block):
                            if (root[s:e] == root[s]).all():
                                break
                            i, j = np.meshgrid(np.arange(lo, min(e, lo + block)), np.arange(lo2, min(e, lo2 + block)), indexing="ij")
                            upper = i < j
                            compare(i[upper], j[upper], slice(s, e))
            pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2] == 1)], ["a", "b", "sure"])

    return run


def _likely(least: Least):
    def run(arrow):
        for batch in arrow:
            apart = [_apart(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            keep = [d <= n + m - 2 * least.shared(n, m) for n, m, d in apart]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(least: Least):
    def run(arrow):
        for batch in arrow:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= least.shared(len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _used(pairs: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """A row for each key of ``pairs``: how often it is on the left and on the right, and ``column`` of its class."""
    ends = pairs.select(F.col("a").alias("key"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(pairs.select(F.col("b").alias("key"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    return staged(ends.groupBy("key").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).join(classes.select("key", column), "key"), "similar-used")


def _kept(pairs: DataFrame, used: DataFrame, column: str, kept, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that ``kept`` lets pass, by ``column`` of either side."""
    n = pairs.count()
    left = join_by_class(pairs, used.select(F.col("key").alias("a"), F.col(column).alias("x"), "l"), ["a"], F.col("l") * HOT > n)
    both = join_by_class(left, used.select(F.col("key").alias("b"), F.col(column).alias("y"), "r"), ["b"], F.col("r") * HOT > n)
    return staged(both.select("a", "b", "x", "y").mapInArrow(tidy(kept), "a long, b long"), name)


def _checked(pairs: DataFrame, texts: DataFrame, classes: DataFrame, shingle: int, least: Least) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose whole sets are that similar."""
    used = _used(pairs, classes, "sketch")
    pairs = _kept(pairs, used, "sketch", _likely(least), "similar-likely")
    forget(used)
    used = _used(pairs, classes, "least")
    named = used.select(F.col("least").alias("id")).distinct()
    theirs = texts.join(small_side(named, used.count(), 1_000_000), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = theirs.mapInArrow(tidy(_set_rows(shingle)), "key long, hashes binary").dropDuplicates(["key"])
    sets = staged(used.join(sets, "key").select("key", "hashes", "l", "r"), "similar-sets")
    checked = _kept(pairs, sets, "hashes", _alike(least), "similar-checked")
    forget(used, sets)
    return checked


def _roots(links: DataFrame) -> DataFrame:
    """(key, root) of every key that ``links`` (a, b) names."""
    return staged(components(links).withColumnRenamed("node", "key"), "similar-roots")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of their key, which is the key itself where nothing links it."""
    return rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def _parted(rows: DataFrame, most: int) -> DataFrame:
    """Rows of groups that may have several roots; one of over ``most`` rows becomes groups of two parts."""
    rows, small = rows.where("large"), rows.where("not large")
    sizes = staged(rows.groupBy("h").agg(F.ceil(2 * F.count("*") / most).alias("parts"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h", "parts"), "similar-groups")
    few, hot = sizes.where("parts <= 2"), sizes.where("parts > 2")
    small = small.unionByName(rows.join(few, "h", "left_semi").select(*rows.columns))
    # A row of part c goes to the tasks of the pairs (c, 0), (c, 1) and so on, the lesser part first.
    cut = rows.join(F.broadcast(hot), "h").withColumn("c", F.pmod(F.xxhash64("key"), "parts")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return small.unionByName(cut.withColumn("h", F.xxhash64("h", F.least("c", "o"), F.greatest("c", "o"))).select(*rows.columns))


def similar_texts(
    docs: DataFrame,
    shingle: int = 5,
    similarity: tuple[int, int] = (4, 5),
    bits: int = 256,
    threshold: int = 42,
    compared: tuple[int, int] = (3, 5),
    most: int = 16_384,
) -> DataFrame:
    """doc_id, component_id (the least doc_id that links reach) of every row.

    ``similarity`` and ``compared``, s and c above, are fractions."""
    spark, least, loose = docs.sparkSession, Least(*similarity), Least(*compared)
    arrow_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = staged(texts.mapInArrow(tidy(_class_rows(shingle, bits)), "doc_id long, key long, fp binary, parities binary, sketch binary"), "similar-rows")
    classes = staged(rows.groupBy("key", "fp", "parities", "sketch").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "similar-classes")
    roots = _roots(near_links(classes.select("key", "fp"), threshold).select("a", "b"))

    # The rest by prefixes, among what is not linked yet.  A task gets about 64 MB of prefixes.  Groups are
    # of one shingle, so each round takes a share of the shingles, and only its rows are in a shuffle.
    count = rows.count()
    frequent = hold(spark, frequent_shingles(texts, count, shingle))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count * 160 * 40 // (64 << 20) // ROUNDS))
    prefixes = staged(texts.mapInArrow(tidy(_prefixes(shingle, loose, frequent)), "h long, key long, n int, place int"), "similar-prefixes")
    shares = []
    for k in range(ROUNDS):
        rows_of = prefixes.where(F.pmod("h", F.lit(ROUNDS)) == k).repartition(parts, "h").sortWithinPartitions("h")
        some = staged(rows_of.mapInArrow(tidy(_shared_rows(loose, most)), "h long, key long, n int, place int, large boolean"), "similar-shared")
        shares.append(staged(some.join(classes.select("key", "fp", "parities"), "key").select("h", "key", "n", "place", "fp", "parities", "large"), "similar-compared"))
        forget(some)
    forget(prefixes)
    tested = None
    for star in (True, False):
        pieces = []
        for shared in shares:
            rooted = _rooted(shared.where("large") if star else shared, roots)
            grouped = (rooted if star else _parted(rooted, most)).repartition(parts, "h").sortWithinPartitions("h", "key")
            pieces.append(staged(grouped.mapInArrow(tidy(_pairs(loose, least, threshold, most, star)), "a long, b long, sure boolean").distinct(), "similar-found-by-share"))
        found = staged(reduce(DataFrame.unionByName, pieces).distinct(), "similar-found")
        pairs = found.where("not sure").select("a", "b")
        pairs = staged(pairs.join(tested, ["a", "b"], "left_anti"), "similar-pairs") if tested else pairs
        links = found.where("sure").select("a", "b").unionByName(_checked(pairs, texts, classes, shingle, least))
        # The roots join all that earlier links do, by one link a key; so those need not be followed again.
        roots = _roots(roots.select(F.col("key").alias("a"), F.col("root").alias("b")).unionByName(links))
        tested = pairs
    forget(*shares)
    frequent.unpersist()

    linked = staged(_rooted(classes.select("key", "least", "n"), roots), "similar-linked")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    joined = join_by_class(linked, named, ["root"], F.col("size") * HOT > linked.count())
    of_key = staged(joined.select("key", "n", "component_id"), "similar-components")
    return join_by_class(rows, of_key, ["key"], F.col("n") * HOT > count).select("doc_id", "component_id")
