"""Benchmark decontamination by latent semantic retrieval and alignment.

1. Texts become term ids, once, in the shared folder: benchmark words, told by a hash of 32 bits, have ids
   of their own, all other words share ``HASHED`` ids.
2. Occurrences of the terms over all passages (``window`` words each) give TF-IDF.
3. A distributed randomised SVD of the TF-IDF matrix A of all passages.  Every task takes Y = A G of its
   passages for one random G and adds up A'Y; Y'Y is G'(A'Y).  With Y'Y = R'R, Q = Y / R is an orthonormal
   range of A, and B = Q'A follows from the sum; B's right singular vectors, of ``rank`` greatest singular
   values, span the latent space.  Benchmark items take no part in it.
4. Overlapping passages are projected into the latent space, and those with a cosine of at least
   ``cosine`` to an item are candidates.  Only pairs that share at least ``weak`` of the item's weight are
   compared, found by an inverted index of the terms: no other could pass the alignment.  Beside these,
   passages that hold ``maybe`` of an item's weight are candidates whatever their cosine: a verbatim
   leak may be a small part of a passage.
5. Every region of a candidate, of up to 1.5 item lengths, is aligned to the item by an IDF-weighted
   longest common subsequence.  A share of ``sure`` is a leak.  A share of ``maybe``, or of ``weak`` in a
   passage near the item in the latent space, is a paraphrase, and a leak if the item's answer, its last
   quarter, is in the same region.  Each region is decided for itself.

Tasks hold a block of ``block_items`` items: their words, the latent vectors of all terms and items.

Defined cases: null and empty texts and items match nothing; items under ``min_words`` words match
only a text that holds all their words in a row; repeated rows are each returned; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shared import arrow_batches, hold, staged, table, texts_of, tidy

_PARTS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
FOUND = "doc_id long, item_id long, cosine double, overlap double, answer double"
#: Ids that the words outside of the benchmark share.
HASHED = 1 << 14
#: Terms in a row of the distributed sums.
TERMS_A_ROW = 16


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PARTS).split()


def weighted_lcs(item: np.ndarray, region: np.ndarray, weights: np.ndarray) -> float:
    """Greatest weight of a common subsequence of two arrays of term ids, by rows of the table."""
    best = np.zeros(len(region) + 1)
    for term in item:
        took = np.where(region == term, best[:-1] + weights[term], 0.0)
        best[1:] = np.maximum(best[1:], took)
        np.maximum.accumulate(best, out=best)
    return float(best[-1])


class TermIds:
    """Ids of words by their CRC-32: places of benchmark words among ``hashes``, and for all other words
    ``len(hashes)`` and up."""

    SLOTS = 1 << 20

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.own = hashes, len(hashes)  # sorted, each once
        slots, first, n = np.unique(hashes % self.SLOTS, return_index=True, return_counts=True)
        self.table = np.full(self.SLOTS, -1, np.int32)
        self.table[slots] = np.where(n == 1, first, -2)  # -2: several, so they are searched
        self.kind = np.uint16 if self.own + HASHED < 1 << 16 else np.int32  # room for one more, the pad

    def of(self, words: list[bytes]) -> np.ndarray:
        h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        at = self.table[h % self.SLOTS]
        if len(several := np.flatnonzero(at == -2)):
            at[several] = np.minimum(np.searchsorted(self.hashes, h[several]), self.own - 1)
        known = (at >= 0) & (self.hashes[at] == h)
        return np.where(known, at, self.own + h // self.SLOTS % HASHED).astype(self.kind)


class Items:
    """A block of benchmark items: vocabulary, term ids, and after ``weigh`` what is looked for."""

    def __init__(self, rows: list[tuple[int, str]]):
        words = [(i, words_of(t)) for i, t in rows]
        words = [(i, w) for i, w in words if w]
        self.hashes = np.unique(np.array([zlib.crc32(x) for _, w in words for x in w], np.uint32))
        self.own = len(self.hashes)
        self.size = self.own + HASHED
        self.ids = [i for i, _ in words]
        self.terms = [TermIds(self.hashes).of(w).astype(np.int32) for _, w in words] if words else []

    def weigh(self, occurrences: np.ndarray, passages: int, stop_share: float, weak: float) -> None:
        """Weights, and which terms are looked for.  Frequent ones are not, but for those without
        which an item would lose over ``weak`` / 2 of its weight; ``lost`` is what it loses.
        """
        self.idf = np.log((passages + 1) / (np.minimum(occurrences, passages) + 0.5)).clip(0.01).astype(np.float32)
        self.content = occurrences[: self.own] <= max(20, stop_share * passages)
        parts = []
        for t in self.terms:
            term, n = np.unique(t, return_counts=True)
            share = n * self.idf[term].astype(np.float64)
            answer = np.bincount(np.searchsorted(term, answer_of(t)), minlength=len(term)) * self.idf[term].astype(np.float64)
            parts.append((term, share / share.sum(), answer / answer.sum()))
        frequent = ~self.content
        for term, share, _ in parts:
            order = np.argsort(self.idf[term], kind="stable")
            order = order[frequent[term[order]]]
            self.content[term[order[np.cumsum(share[order]) > weak / 2]]] = True
        self.lost, self.answer_lost = np.array([[x[~self.content[term]].sum() + 1e-6 for x in shares] for term, *shares in parts]).T
        # Of each term the items that hold it, and its share of their weight and of their answer's.
        terms = np.concatenate([term for term, _, _ in parts])
        order = np.argsort(terms, kind="stable")
        self.held_by = np.repeat(np.arange(len(parts)), [len(term) for term, _, _ in parts])[order]
        self.share = np.concatenate([share for _, share, _ in parts])[order]
        self.answer_share = np.concatenate([answer for _, _, answer in parts])[order]
        self.first = np.searchsorted(terms[order], np.arange(self.own + 1))

    def spans(self) -> np.ndarray:
        """Words of the region that an item is aligned to, at most."""
        return np.array([span_of(t) for t in self.terms], np.int64)


def span_of(item: np.ndarray) -> int:
    return int(1.5 * len(item)) + 8


def answer_of(item: np.ndarray) -> np.ndarray:
    return item[-max(3, len(item) // 4) :]


def _positions(hashes):
    """Of each text its term ids."""

    @tidy
    def run(batches):
        look = TermIds(hashes.value)
        for batch in batches:
            out, texts = [], texts_of(batch)
            for lo in range(0, len(texts), 100):
                words = [words_of(t) for t in texts[lo : lo + 100]]
                ends = np.cumsum([0, *map(len, words)])
                ids = look.of([w for of in words for w in of])
                out += [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "terms"])

    return run


def _arrays(batch, own: int) -> list[np.ndarray]:
    kind = np.uint16 if own + HASHED < 1 << 16 else np.int32
    return [np.frombuffer(v.as_buffer(), kind) for v in batch.column("terms")]


def _occurrences(own: int, window: int):
    """Term -1 counts the passages."""
    size = own + HASHED

    @tidy
    def run(batches):
        total, passages = np.zeros(size, np.int64), 0
        for batch in batches:
            arrays = _arrays(batch, own)
            if arrays:
                total += np.bincount(np.concatenate(arrays), minlength=size)
            passages += sum(-(-len(a) // window) for a in arrays)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[passages, total[at]])], ["term", "n"])

    return run


def _padded(arrays: list[np.ndarray], width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in rows of ``width`` terms, each text's last row filled with ``pad``; and rows of each."""
    rows = np.array([-(-len(a) // width) for a in arrays], np.int64)
    flat = np.full(int(rows.sum()) * width, pad, arrays[0].dtype if arrays else np.int32)
    at = 0
    for a, n in zip(arrays, rows.tolist()):
        flat[at : at + len(a)] = a
        at += n * width
    return flat.reshape(-1, width), rows


def _sums(rows: np.ndarray, matrix: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """For each row of terms the sum of their rows of ``matrix``."""
    out = np.empty((len(rows), matrix.shape[1]), np.float32)
    step = max(1, block // rows.shape[1])
    for lo in range(0, len(rows), step):
        out[lo : lo + step] = matrix.take(rows[lo : lo + step], axis=0).sum(axis=1)
    return out


def noise_of(size: int, columns: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size, columns)).astype(np.float32)


def _range_sums(idf, window: int, columns: int, seed: int):
    """Parts of A'Y, ``TERMS_A_ROW`` terms each."""

    @tidy
    def run(batches):
        weights = np.r_[idf.value, np.float32(0)]  # the pad has none
        size = len(weights)
        noise = np.r_[noise_of(size - 1, columns, seed), np.zeros((1, columns), np.float32)] * weights[:, None]
        back = np.zeros((columns, size))
        for batch in batches:
            rows, _ = _padded(_arrays(batch, size - 1 - HASHED), window, size - 1)
            for lo in range(0, len(rows), 4096):
                part = rows[lo : lo + 4096]
                y = np.ascontiguousarray(_sums(part, noise).T.astype(np.float64))
                terms = part.ravel().astype(np.int64)
                for column, of in zip(back, y):
                    column += np.bincount(terms, np.repeat(of, window), size)
        back = back.T
        back = (back * weights[:, None])[:-1].astype(np.float32)
        back = np.r_[back, np.zeros((-len(back) % TERMS_A_ROW, columns), np.float32)].reshape(-1, TERMS_A_ROW * columns)
        at = np.flatnonzero(np.abs(back).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([r.tobytes() for r in back[at]], pa.binary())], ["part", "data"])

    return run


def _sum_parts(batches):
    """Sum what is of the same part; a task has whole parts."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist()):
            a = np.frombuffer(data, np.float32)
            sums[k] = sums[k] + a if k in sums else a.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([a.tobytes() for a in sums.values()], pa.binary())], ["part", "data"])


def latent_space(gram: np.ndarray, back: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (terms, at most ``rank``) and singular values of A, from Y'Y and A'Y.

    Directions of Y without strength are left out, so fewer passages than columns do no harm."""
    strength, turn = np.linalg.eigh(gram)
    keep = strength > 1e-9 * max(strength.max(initial=0), 1e-30)
    to_range = turn[:, keep] / np.sqrt(strength[keep])  # Y times this is an orthonormal range Q
    vectors, values, _ = np.linalg.svd(back @ to_range, full_matrices=False)  # of B' = A'Q
    keep = values > 1e-6 * max(values.max(initial=0), 1e-30)
    return vectors[:, keep][:, :rank], values[keep][:rank]


def latent_basis(terms: DataFrame, idf: np.ndarray, window: int, rank: int, oversample: int = 8, seed: int = 11) -> np.ndarray:
    """The latent vector of each term (terms, rank), over all passages.  The driver gets (terms, rank + oversample) numbers."""
    spark, columns = terms.sparkSession, rank + oversample
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = terms.mapInArrow(_range_sums(hold(spark, idf), window, columns, seed), "part long, data binary")
    summed = made.repartition(n, "part").mapInArrow(tidy(_sum_parts), "part long, data binary").toArrow()
    back = np.zeros((len(idf) + (-len(idf) % TERMS_A_ROW), columns))
    for k, data in zip(summed.column("part").to_pylist(), summed.column("data").to_pylist()):
        back[k * TERMS_A_ROW : (k + 1) * TERMS_A_ROW] = np.frombuffer(data).reshape(TERMS_A_ROW, columns)
    back = back[: len(idf)]
    gram = noise_of(len(idf), columns, seed).T @ back
    vectors, _ = latent_space((gram + gram.T) / 2, back, rank)
    return (vectors * idf[:, None]).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _passage_terms(arrays: list[np.ndarray], items: Items, window: int, step: int):
    """Owner and number of each passage, and (passage, term) of the terms that are looked for, once each."""
    sizes = np.array([len(a) for a in arrays], np.int64)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    n_parts = np.maximum(1, -(-sizes // step)) if len(sizes) else sizes
    first = np.cumsum(n_parts) - n_parts
    at = np.flatnonzero(np.r_[items.content, np.zeros(HASHED, bool)][flat])
    doc = np.repeat(np.arange(len(arrays)), sizes)[at]
    pos = at - (np.cumsum(sizes) - sizes)[doc]
    term = flat[at].astype(np.int64)
    passage = first[doc] + pos // step
    again = (pos >= step) & (pos % step < window - step)  # a passage reaches into the next one's words
    passage, term = np.r_[passage, passage[again] - 1], np.r_[term, term[again]]
    key = np.unique(passage << 32 | term)
    return np.repeat(np.arange(len(arrays)), n_parts), np.arange(int(n_parts.sum())) - np.repeat(first, n_parts), key >> 32, key & 0xFFFFFFFF


def _shared(items: Items, passage: np.ndarray, term: np.ndarray, owners: np.ndarray, window: int, step: int, least: float):
    """(item, passage, further passages, share, answer's share): where a region may hold ``least`` of an item's weight.

    A region starts in a passage and reaches into a fixed number of further ones, so the weight that
    it shares is at most the sum of what these hold: no region that alignment would take is left out.
    """
    n = items.first[term + 1] - items.first[term]
    at = np.repeat(items.first[term] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
    key, of = np.unique(items.held_by[at] * len(owners) + np.repeat(passage, n), return_inverse=True)
    sums = np.stack([np.bincount(of, x[at], len(key)).astype(np.float64) for x in (items.share, items.answer_share)])
    item, passage = np.divmod(key, max(1, len(owners)))
    more = np.maximum(0, -(-(items.spans() - 1 - (window - step)) // step))[item]
    total, every = sums.copy(), np.arange(len(key))
    for i in range(1, int(more.max(initial=0)) + 1):
        own = every[(more >= i) & (passage + i < len(owners))]
        own = own[owners[passage[own] + i] == owners[passage[own]]]
        there = np.searchsorted(key, key[own] + i)
        hit = (there < len(key)) & (key[np.minimum(there, len(key) - 1)] == key[own] + i)
        total[:, own[hit]] += sums[:, there[hit]]
    share, answer = total[0] + items.lost[item], total[1] + items.answer_lost[item]
    found = share >= least
    return item[found], passage[found], more[found], share[found], answer[found]


def _passage_vectors(arrays: list[np.ndarray], basis: np.ndarray, window: int) -> np.ndarray:
    """Unit latent vectors of the passages: four units of a quarter window each, three units apart."""
    unit, pad = window // 4, len(basis) - 1
    rows, n = _padded(arrays, unit, pad)
    y = _sums(rows, basis)
    ends = np.cumsum(n)
    starts = ends - n
    parts = np.maximum(1, -(-np.array([len(a) for a in arrays], np.int64) // (3 * unit)))
    total = int(parts.sum())
    owner = np.repeat(np.arange(len(arrays)), parts)
    at = starts[owner] + 3 * (np.arange(total) - np.repeat(np.cumsum(parts) - parts, parts))
    out = np.zeros((total, basis.shape[1]), np.float32)
    for i in range(4):
        there = at + i < ends[owner]
        out[there] += y[(at + i)[there]]
    return _unit(out)


def _near(vectors: np.ndarray, latent: np.ndarray, owners: np.ndarray, item: np.ndarray, passage: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The greatest cosine of an item with a passage or the further ones, for each given pair."""
    best = np.full(len(item), -1.0, np.float32)
    for i in range(int(more.max(initial=0)) + 1):
        there = np.flatnonzero((more >= i) & (passage + i < len(owners)))
        there = there[owners[passage[there] + i] == owners[passage[there]]]
        for lo in range(0, len(there), 65536):
            at = there[lo : lo + 65536]
            best[at] = np.maximum(best[at], np.einsum("ij,ij->i", vectors[passage[at] + i], latent[item[at]]))
    return best


def aligned(item: np.ndarray, region: np.ndarray, idf: np.ndarray, near: bool, sure: float, maybe: float, weak: float, answer: float):
    """(overlap, answer) of the first region of the span that is a leak, of those that share most; or None."""
    at = np.flatnonzero(np.isin(region, item))
    if not len(at):
        return None
    total, span = float(idf[item].sum()), span_of(item)
    tail = answer_of(item)
    tail_weight, least = float(idf[tail].sum()), (weak if near else maybe)
    sums = np.r_[0.0, np.cumsum(idf[region[at]], dtype=np.float64)]
    shares = sums[np.searchsorted(at, at + span)] - sums[:-1]
    if shares.max() < least * total * (1 - 1e-6):
        return None
    if weighted_lcs(item, region, idf) < least * total * (1 - 1e-6):
        return None  # no part of the region can share more than all of it
    for i in np.argsort(-shares, kind="stable"):
        if shares[i] < least * total * (1 - 1e-6):
            return None
        part = region[at[i] : at[i] + span]
        share = weighted_lcs(item, part, idf) / total
        if share < least - 1e-6:
            continue
        has = weighted_lcs(tail, part, idf) / tail_weight
        if share >= sure or has >= answer:
            return share, has
    return None


def _search(held, window: int, cosine: float, sure: float, maybe: float, weak: float, answer: float, min_words: int):
    @tidy
    def run(batches):
        items, basis, latent = held.value
        step = window // 4 * 3
        for batch in batches:
            arrays = _arrays(batch, items.own)
            owners, number, passage, term = _passage_terms(arrays, items, window, step)
            item, passage, more, share, answers = _shared(items, passage, term, owners, window, step, weak)
            able = (share >= sure) | (answers >= answer)  # else no region can be a leak
            item, passage, more, share = item[able], passage[able], more[able], share[able]
            cosines = _near(_passage_vectors(arrays, basis, window), latent, owners, item, passage, more)
            take = (share >= maybe) | (cosines >= cosine)
            places: dict[tuple[int, int], list] = {}
            for k, p, m, c in zip(item[take].tolist(), passage[take].tolist(), more[take].tolist(), cosines[take].tolist()):
                places.setdefault((int(owners[p]), k), []).append((c, int(number[p]), m))
            out = []
            for (doc, k), of in places.items():
                text, terms = arrays[doc], items.terms[k]
                if len(terms) < min_words:
                    if len(text) >= len(terms) and (np.lib.stride_tricks.sliding_window_view(text, len(terms)) == terms).all(axis=1).any():
                        out.append((doc, items.ids[k], max(of)[0], 1.0, 1.0))
                    continue
                best = None
                for c, number_, m in of:
                    region = text[number_ * step : (number_ + m + 1) * step + span_of(terms)]
                    found = aligned(terms, region, items.idf, c >= cosine, sure, maybe, weak, answer)
                    if found and (best is None or (*found, c) > best):
                        best = (*found, c)
                if best:
                    out.append((doc, items.ids[k], best[2], best[0], best[1]))
            ids = batch.column("doc_id").to_pylist()
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], [c.split()[0] for c in FOUND.split(", ")])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 64, rank: int = 24, cosine: float = 0.7, sure: float = 0.6, maybe: float = 0.4, weak: float = 0.25, answer: float = 0.75, stop_share: float = 0.02, min_words: int = 6, block_items: int = 20_000) -> DataFrame:
    """doc_id, item_id, cosine, overlap, answer of every document that holds an item or a paraphrase.

    ``window`` is a multiple of 4.  ``stop_share`` saves work alone: see ``Items.weigh``."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-places.count() // block_items))
    found = None
    for b in range(blocks):
        rows = places.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        items = Items([(r["item_id"], r["text"]) for r in rows])
        if not items.ids:
            continue
        terms = staged(texts.mapInArrow(_positions(hold(spark, items.hashes)), "doc_id long, terms binary").where("length(terms) > 0"), "benchmark-terms")
        counts = {r["term"]: r["n"] for r in terms.mapInArrow(_occurrences(items.own, window), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        passages = counts.pop(-1, 0)
        occurrences = np.zeros(items.size, np.int64)
        occurrences[list(counts)] = list(counts.values())
        items.weigh(occurrences, passages, stop_share, weak)
        basis = latent_basis(terms, items.idf, window, rank)
        latent = _unit(np.array([basis[t].sum(axis=0) for t in items.terms], np.float32))
        basis = np.r_[basis, np.zeros((1, basis.shape[1]), np.float32)]  # the pad
        search = _search(hold(spark, (items, basis, latent)), window, cosine, sure, maybe, weak, answer, min_words)
        part = terms.mapInArrow(search, FOUND)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], FOUND)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
