import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import exactdup, shared, simhash
from marlstone.llm.exactdup import ExtendibleIndex, exact_duplicates
from marlstone.llm.linedup import RunLevels, drop_frequent_lines, sorted_runs
from marlstone.llm.links import components
from marlstone.llm.similar import Least, similar_texts
from marlstone.llm.simhash import anchor_masks, distance_of, fingerprint, fingerprints, near_duplicates, near_links


def brute_components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(odd):
    for r in odd.collect():
        assert fingerprint(r["text"] or "") == brute_fingerprint(r["text"])


def test_anchors_cover():
    """Any two halves within 2 bits share an anchor."""
    masks, rng = anchor_masks(), np.random.default_rng(0)

    def anchors(x):
        s = 0
        for j in range(1, 32):
            if x >> (j - 1) & 1:
                s ^= j
        return {x ^ m for m in masks[s]}

    for _ in range(300):
        x = int(rng.integers(0, 2**32))
        i, j = (int(k) for k in rng.choice(32, 2, replace=False))
        for y in (x, x ^ 1 << i, x ^ 1 << i ^ 1 << j):
            assert anchors(x) & anchors(y)


def plain_anchors(fp, blocks):
    """(block, anchor) of every anchor that a fingerprint is replicated to, bit by bit."""
    masks, out = anchor_masks(), set()
    for b in range(blocks):
        x, s = fp >> (32 * b) & 0xFFFFFFFF, 0
        for j in range(1, 32):
            if x >> (j - 1) & 1:
                s ^= j
        out |= {(b, x ^ m) for m in masks[s]}
    return out


def brute_near(texts, shingle, bits, threshold):
    """Components by all pairs: within the threshold, and at one anchor."""
    fps = [sum(int(w) << (64 * k) for k, w in enumerate(f)) for f in fingerprints(texts, shingle, bits, repeats=False)]
    at = [plain_anchors(f, bits // 32) for f in fps]
    return brute_components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= threshold and at[i] & at[j]])


def test_near_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    fps = []
    for b in rng.integers(0, 2**63, 25, dtype=np.uint64):
        fps.append(int(b))
        for _ in range(12):
            x = int(b)
            for k in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(k)
            fps.append(x)
    fps = sorted(set(fps))
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = brute_components(len(fps), pairs)
    df = spark.createDataFrame([(i, x.to_bytes(8)) for i, x in enumerate(fps)], "key long, fp binary")
    for most in (16_384, 5, 2):  # with few an anchor, those with more are compared part by part
        got = {r["node"]: r["root"] for r in components(near_links(df, block=16, most=most)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_workers_give_memory_back_after_fingerprints_and_comparing(monkeypatch):
    trimmed = []
    monkeypatch.setattr(shared, "trim", lambda: trimmed.append(1))
    texts = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two"]})
    assert [b.num_rows for b in simhash._fingerprint_rows(4, 64, True)([texts])] == [1] and len(trimmed) == 1
    rows = pa.RecordBatch.from_pydict({"anchor": [5, 5], "key": [1, 2], "fp": [b"12345678", b"12345679"]})
    assert [b.num_rows for b in simhash._compare(4, 1024, 99)([rows])] == [1] and len(trimmed) == 2


def test_a_hot_anchor_is_cut_into_parts(spark):
    """Thousands of distinct fingerprints of one anchor: linked as by brute force, through pairs of parts."""
    rng = np.random.default_rng(23)
    near = sorted({0x0123456789ABCDEF ^ sum(1 << int(k) for k in rng.choice(64, 3, replace=False)) for _ in range(1500)})
    far = sorted({int(x) for x in rng.integers(0, 2**63, 200)})
    df = spark.createDataFrame([(i, x.to_bytes(8)) for i, x in enumerate(near + far)], "key long, fp binary")
    links = near_links(df, most=100)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    pairs = [(i, j) for i in range(len(near)) for j in range(i) if (near[i] ^ near[j]).bit_count() <= 4]
    assert [got.get(i, i) for i in range(len(near))] == brute_components(len(near), pairs)
    assert not any(k >= len(near) for k in got)


def test_wide_fingerprints_find_what_blocks_allow(spark):
    """At 256 bits no pair within 23 is lost, and wider ones are linked only within the threshold."""
    rng = np.random.default_rng(5)
    base = [int.from_bytes(rng.bytes(32)) for _ in range(60)]
    rows = list(base)
    for x in base:
        for flips in (23, 30, 60):
            y = x
            for k in rng.choice(256, flips, replace=False):
                y ^= 1 << int(k)
            rows.append(y)
    df = spark.createDataFrame([(i, x.to_bytes(32)) for i, x in enumerate(rows)], "key long, fp binary")
    got = {frozenset(map(int, r)) for r in near_links(df, 40).collect()}
    assert all((rows[a] ^ rows[b]).bit_count() <= 40 for a, b in map(sorted, got))
    roots = {r["node"]: r["root"] for r in components(near_links(df, 40)).collect()}
    assert all(roots.get(60 + 3 * i, -1) == roots.get(i, -2) for i in range(60))


def test_similar_texts_are_linked_and_others_not(spark):
    """Recall by true five-word Jaccard similarity; texts under half alike are left alone."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    shingles = lambda t: {" ".join(t[i : i + 5]) for i in range(len(t) - 4)}
    docs, pairs = [], []
    for i in range(300):
        text = list(rng.choice(words, int(rng.integers(100, 500))))
        other = [w if rng.random() > (0.002, 0.008, 0.015, 0.1)[i % 4] else "edit" for w in text]
        a, b = shingles(text), shingles(other)
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
        pairs.append((2 * i, 2 * i + 1, len(a & b) / len(a | b)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, 5, distance_of(0.8, 256), 256, repeats=False).collect()}
    found = lambda lo, hi: np.mean([got[a] == got[b] for a, b, j in pairs if lo <= j < hi])
    assert found(0.95, 1.01) > 0.98 and found(0.9, 0.95) > 0.9 and found(0.8, 0.9) > 0.6 and found(0, 0.6) == 0
    assert len({got[a] for a, _, _ in pairs}) == len(pairs)


def word_sets(texts, shingle=5):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set() for w in words]


def brute_similar(texts, anchors=True, least=3):
    """Components by all pairs: a Jaccard similarity of 0.8 or more, or fingerprints within 42 bits; these
    of a similarity of ``least`` / 5 or more, or at one anchor."""
    sets = word_sets(texts)
    fps = [sum(int(w) << (64 * k) for k, w in enumerate(f)) for f in fingerprints([t or "" for t in texts], 5, 256, repeats=False)]
    at = [plain_anchors(f, 8) if anchors else set() for f in fps]

    def linked(i, j):
        common, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        return 5 * common >= 4 * union or ((fps[i] ^ fps[j]).bit_count() <= 42 and (5 * common >= least * union or bool(at[i] & at[j])))

    return brute_components(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if linked(i, j)])


def within(parts, wholes):
    """Whether each component of ``parts`` lies in one of ``wholes``."""
    return len(set(zip(parts, wholes))) == len(set(parts))


def edited_texts(seed=31):
    """Copies about the threshold, of long and short texts, in pairs, chains and a large group, some with
    a common passage; cuts of texts; and texts at 4/5 exactly."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(2000)]
    passage = list(rng.choice(words, 60))
    edit = lambda t, share: [w if rng.random() > share else f"e{rng.integers(10**9)}" for w in t]
    texts = [None, "", " \n", "one", "One", "one two", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h i j"]
    for i in range(120):
        text = list(rng.choice(words, int(rng.integers(8, 400)))) + (passage if i % 3 == 0 else [])
        for share in (0.012, 0.02, 0.03):
            texts.append(" ".join(edit(text, share)))
        texts += [" ".join(text), " ".join(text[: int(len(text) * 0.82)])]
    base = list(rng.choice(words, 150))
    for i in range(150):
        base = edit(base, 0.012) if i % 5 == 0 else base
        texts.append(" ".join(edit(base, 0.012)))
    return [texts[i] for i in rng.permutation(len(texts))]


@pytest.mark.parametrize("most", [16_384, 20])
def test_near_copies_equal_brute_force(spark, most):
    """No pair at a threshold is lost and no other is linked, also where groups are cut into parts."""
    texts = edited_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in similar_texts(df, most=most).collect()}
    got = [got[i] for i in range(len(texts))]
    assert within(brute_similar(texts), got) and within(got, brute_similar(texts, least=0))


def test_near_copies_stage_keeps_what_brute_force_keeps(spark):
    from marlstone.llm.stages import drop_near_copies

    texts = edited_texts(37)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in drop_near_copies(spark, df, "").collect()}
    least, most = ({i for i, r in enumerate(brute_similar(texts, least=k)) if r == i} for k in (0, 3))
    assert least <= kept <= most


def test_near_copies_without_anchors(spark, monkeypatch):
    """Without the anchors' links the prefixes give all of 0.6 or more within the threshold, and of 0.8."""
    from marlstone.llm import similar

    monkeypatch.setattr(similar, "near_links", lambda found, threshold: found.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0))
    texts = edited_texts(41)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar_texts(df).collect()}
    got = [got[i] for i in range(len(texts))]
    assert within(brute_similar(texts, anchors=False), got) and within(got, brute_similar(texts, least=0))


def test_links_of_near_copies_are_followed_once(spark, monkeypatch):
    """Anchors link a text to many others; later rounds of links start from one link a text instead."""
    from marlstone.llm import similar

    rng = np.random.default_rng(43)
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(200):
        at = set(rng.choice(150, 2, replace=False))
        texts.append(" ".join(f"e{i}x{k}" if k in at else w for k, w in enumerate(base)))
    given = []

    def counted(links):
        given.append(links.distinct().count())
        return components(links)

    monkeypatch.setattr(similar, "components", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar_texts(df).collect()}
    assert got == dict.fromkeys(range(len(texts)), 0)
    assert given[0] > 5 * len(texts) and len(given) == 3 and max(given[1:]) <= 2 * len(texts)


def test_sketches_tell_long_texts_apart_and_lose_no_similar_ones():
    from marlstone.llm.similar import Least, _apart, _likely, _parities, _sketch

    rng, least = np.random.default_rng(47), Least(4, 5)
    for n, m in ((1, 1), (300, 300), (500, 540), (1500, 1800), (2040, 2060), (9000, 9500)):
        x, y = (np.unique(rng.integers(0, 2**64, k, dtype=np.uint64)) for k in (n, m))
        whole = 2 * least.shared(n, m)
        assert _apart(_sketch(x), _sketch(x)) == (n, n, 0)
        if n > 1000:  # 512 buckets differ in too few bits for that, sketches do not
            few = np.bitwise_count(np.frombuffer(_parities(x), np.uint64) ^ np.frombuffer(_parities(y), np.uint64)).sum()
            assert few <= n + m - whole < _apart(_sketch(x), _sketch(y))[2]
        z = np.unique(np.r_[x[: least.shared(n, m)], y[: m - least.shared(n, m)]])  # as similar as asked, just so
        n, m, apart = _apart(_sketch(x), _sketch(z))
        assert apart <= len(np.setxor1d(x, z)) <= n + m - 2 * least.shared(n, m)
        batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "x": [_sketch(x)], "y": [_sketch(z)]})
        assert [b.num_rows for b in _likely(least)([batch])] == [1]


def test_files_of_shuffles_and_tables_go_when_they_are_not_needed(spark, monkeypatch):
    """What the near-duplicate stage writes by the way is not on disk until the driver collects its garbage."""
    from marlstone.llm import similar

    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before, gone, kept = tracker.shuffleStatuses().size(), [], similar.forget
    monkeypatch.setattr(similar, "forget", lambda *tables: (gone.extend(t.staged_at for t in tables), kept(*tables)))
    df = spark.createDataFrame(list(enumerate(edited_texts(53))), "doc_id long, text string")
    shared.staged(df.repartition(7).groupBy("text").count(), "of-two-shuffles")
    assert tracker.shuffleStatuses().size() <= before
    found = similar_texts(df)
    assert found.count() == df.count()
    assert any("similar-prefixes" in g for g in gone) and any("similar-sets" in g for g in gone)
    assert not any(os.path.exists(g.removeprefix("file://")) for g in gone)


def test_anchors_come_word_by_word():
    """The replicas of wide fingerprints are on disk for a word at a time; together they are the same."""
    batch = pa.RecordBatch.from_pydict({"key": [1], "fp": [bytes(range(32))]})
    at = [[a for b in simhash._anchors(k)([batch]) for a in b.column("anchor").to_pylist()] for k in range(4)]
    assert all(32 <= len(a) <= 34 for a in at)
    assert {a >> 32 for k in at for a in k} == set(range(8)) and sorted({a >> 32 for a in at[3]}) == [6, 7]


def test_sizes_that_a_similarity_asks_for():
    """The bounds hold for all small sizes: as many as needed and no more."""
    least = Least(4, 5)
    for n in range(1, 60):
        assert least.prefix(n) == n - min(o for o in range(n + 1) if 5 * o >= 4 * n) + 1
        assert least.short_prefix(n) == n - min(o for o in range(n + 1) if 5 * o >= 4 * (2 * n - o)) + 1
        for m in range(1, 60):
            assert least.shared(n, m) == min(o for o in range(n + m) if 5 * o >= 4 * (n + m - o))


def test_similar_texts_odd(spark, odd, empty):
    rows = odd.collect()
    roots, least = brute_similar([r["text"] for r in rows]), defaultdict(list)
    for r, root in zip(rows, roots):
        if r["doc_id"] is not None:
            least[root].append(r["doc_id"])
    want = Counter((r["doc_id"], min(least[root], default=None)) for r, root in zip(rows, roots))
    assert Counter(map(tuple, similar_texts(odd).collect())) == want
    assert similar_texts(empty).count() == 0


def test_wide_fingerprint_counts_votes():
    text = "one two three four five six seven " + "again " * 40
    once, all_ = (fingerprints([text], 5, 256, r)[0] for r in (False, True))
    assert int(all_[0]) == int(fingerprints([text], 5)[0, 0]) and (once != all_).any() and len(once) == 4


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_odd(odd, empty):
    rows, got = odd.collect(), near_duplicates(odd).collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    roots = brute_components(len(rows), pairs)
    least = defaultdict(list)
    for r, root in zip(rows, roots):
        if r["doc_id"] is not None:
            least[root].append(r["doc_id"])
    want = Counter((r["doc_id"], f, min(least[root], default=None)) for r, f, root in zip(rows, fps, roots))
    assert Counter((r["doc_id"], int.from_bytes(r["fp"]), r["component_id"]) for r in got) == want
    assert near_duplicates(empty).count() == 0


def test_exact_duplicates_odd(odd, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for r in odd.collect():
        groups[norm(r["text"])].append((-len(r["text"] or ""), float("inf") if r["doc_id"] is None else r["doc_id"], r["doc_id"]))
    want = Counter()
    for text, members in groups.items():
        keep = min(members)[2]
        for _, _, d in members:
            want[d, keep, len(members), d == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_duplicates(odd, capacity=2).collect())) == want
    assert exact_duplicates(empty).count() == 0


def keys_of(spark, n):
    return spark.range(n).select(F.xxhash64("id").alias("h"), F.col("id").alias("sha"))


@pytest.mark.parametrize("listed", [4096, 3])
def test_index_splits_and_finds(spark, listed):
    """Buckets hold at most the capacity, each key is read once, and the directory knows where it is."""
    index = ExtendibleIndex(spark, 16, listed).build(keys_of(spark, 700), 60)  # too shallow at first
    assert len(index.levels) > 3 and (listed == 4096 or any(split is None for _, split in index.levels))
    rows = index.read().select("*", index.address().alias("at")).collect()
    assert sorted(r["sha"] for r in rows) == list(range(700))
    sizes = Counter((r["depth"], r["bucket"]) for r in rows)
    assert max(sizes.values()) <= 16
    for r in rows:
        assert (r["at"]["depth"], r["at"]["bucket"]) == (r["depth"], r["bucket"])
        assert r["bucket"] == ((r["h"] % 2**64) >> (64 - r["depth"]) if r["depth"] else 0)
    covered = sum(2.0**-d for d, _ in sizes)
    assert covered <= 1


def test_a_bucket_of_one_hash_stays(spark):
    hot = keys_of(spark, 40).unionByName(spark.range(100).select(F.lit(5).cast("long").alias("h"), (F.col("id") + 1000).alias("sha")))
    index = ExtendibleIndex(spark, 16).build(hot, 140)
    assert sorted(r["sha"] for r in index.read().collect()) == [*range(40), *range(1000, 1100)]


def test_index_files_are_ranges_of_buckets(spark):
    """Every owner task wrote a range of the directory: no bucket is in two files."""
    index = ExtendibleIndex(spark, 16).build(keys_of(spark, 500), 500)
    at = index.read().select("depth", "bucket", F.input_file_name().alias("file")).distinct().collect()
    assert len({(r["depth"], r["bucket"]) for r in at}) == len(at) and len({r["file"] for r in at}) > 1


def test_without_the_directory_results_are_wrong(odd, monkeypatch):
    """Split buckets stay in old files; only the directory says that they are dead."""
    right = Counter(map(tuple, exact_duplicates(odd, capacity=2).collect()))
    address = ExtendibleIndex.address
    monkeypatch.setattr(ExtendibleIndex, "address", lambda self: F.struct(F.lit(99).alias("depth"), F.lit(-1).cast("long").alias("bucket")))
    assert Counter(map(tuple, exact_duplicates(odd, capacity=2).collect())) != right
    monkeypatch.setattr(ExtendibleIndex, "address", address)
    assert Counter(map(tuple, exact_duplicates(odd, capacity=2).collect())) == right


def test_different_texts_of_one_hash_are_chained(spark, monkeypatch):
    """With a hash of one value for all texts, bytes alone tell them apart."""
    real = F.xxhash64
    monkeypatch.setattr(exactdup.F, "xxhash64", lambda *c: real(*c) * 0)
    df = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (4, "c "), (5, "d")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_duplicates(df, capacity=1).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (4, 2), 4: (4, 2), 5: (5, 1)}


def test_classes_beyond_the_broadcast_limit(spark, monkeypatch):
    """Hot classes are broadcast, the others are shuffled; nothing is lost."""
    monkeypatch.setattr(exactdup, "HOT", 10)
    rows = [(i, "hot" if i % 3 == 0 else f"text {i // 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(map(tuple, exact_duplicates(df).collect()))
    assert Counter(map(tuple, exact_duplicates(df, held=0).collect())) == want


def brute_lines(rows, least, min_chars=1):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or held[key(x)] < least]
        out[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_lines(spark, odd, empty):
    lines = ["Same line ", "same LINE", "  other", "", "é line", "\tSame line", "rare", "x\r"]
    rows = [(i, "\n".join(lines[(i * k + k) % len(lines)] for k in range(i % 5 + 1))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_lines(rows, 5)
    assert Counter(map(tuple, drop_frequent_lines(df, 5).collect())) == want
    assert Counter(map(tuple, drop_frequent_lines(df, 5, held_keys=0).collect())) == want
    assert Counter(map(tuple, drop_frequent_lines(df, 5, min_chars=6).collect())) == brute_lines(rows, 5, 6)
    odd_rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter(map(tuple, drop_frequent_lines(odd, 2).collect())) == brute_lines(odd_rows, 2)
    assert drop_frequent_lines(empty).count() == 0


def counts_of(rows):
    return sorted(tuple(r) for r in rows.collect())


def test_levels_compact(spark):
    """Compaction comes between batches, and a hash that has reached the threshold is not counted on."""
    levels = RunLevels(spark, 3)
    sizes = []
    for k in range(5):
        levels.add(spark.createDataFrame([(1, 1), (k, 0)], "a long, b long"))
        sizes.append([bool(level) for level in levels.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    assert counts_of(levels.runs()[0]) == [(4, 0, 1)]  # the fifth batch leaves (1, 1) out
    assert counts_of(levels.frequent()) == [(1, 1, 4)] and levels.runs() == []


def test_runs_are_merged_as_they_lie(spark):
    """Runs are merged: not exchanged, not sorted and not broadcast, for a batch or for compaction."""

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    levels = RunLevels(spark, 1)
    for k in range(3):
        levels.add(spark.range(1000).select(F.xxhash64("id").alias("a"), (F.col("id") * 0 + k).alias("b")))
    with sorted_runs(spark):
        batch = plan(levels.fresh(spark.range(50).select("id", F.col("id").alias("k")).toDF("a", "b")))
        compaction = plan(levels.merging(*levels.runs()))
    assert batch.count("SortMergeJoin") == 2 and "Broadcast" not in batch
    assert batch.count("Exchange") == 1 and batch.count("Sort [") == 1, batch  # the batch's own counting
    assert compaction.count("SortMergeJoin") == 1 and "Exchange" not in compaction and "Sort [" not in compaction
    assert levels.frequent().count() == 3000


def test_hashes_beyond_the_held_ones(spark):
    """The most frequent are held, the others joined; whatever is held, the result is the same."""
    rows = [(i, "\n".join(f"line {j}" for j in range(12) if i % (j + 1) == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_lines(rows, 11)
    for held in (0, 2, 5, 100):
        assert Counter(map(tuple, drop_frequent_lines(df, 11, held_keys=held, batch_docs=25).collect())) == want
