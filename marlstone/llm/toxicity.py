"""Toxicity by a small convolutional classifier, trained and run in numpy.

A word and its first four and six bytes are hashed to embeddings, which are added, so forms of a stem
share what is learnt of it; filters of widths 1 to 3 slide over the whole text; the maximum of each
filter over the text feeds a logistic output.  Gradients reach the winning windows only.  The
score depends on the text alone.  Thresholds per language, for callers that want them, are calibrated
on training rows kept apart from the fit, and shrunk to the common threshold where a language is rare.

The network is fitted on at most about ``max_train`` labelled documents and ``max_bytes`` of their texts,
chosen by a hash of doc_id; texts over ``max_text`` characters are scored but not fitted.

Defined cases: null and empty texts have the score of a text without words; repeated rows are scored
alike; a repeated label is the greater one, and a repeated doc_id is fitted once; an empty table gives no rows; without labels of both values every score is the share of label
1, or 0; other columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shared import arrow_batches, hold, table, texts_of

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
STEMS = (4, 6)  # bytes
PAD = BUCKETS  # its embedding is zero; windows may lie over it
_PARTS = bytes.maketrans(string.punctuation.encode() + b"\x00", b" " * (len(string.punctuation) + 1))
_SEPARATOR = b" " + b"\x00 " * max(WIDTHS)


def word_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of all texts in a row the buckets of it and its stems, with pads behind each text;
    and where each text starts."""
    parts = [t.lower().encode().translate(_PARTS) for t in texts]
    words = (_SEPARATOR.join(parts) + _SEPARATOR).split()
    pad = np.fromiter((w == b"\x00" for w in words), bool, len(words))
    hashes = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
    hashes += [np.fromiter((zlib.crc32(w[:n], n) for w in words), np.uint32, len(words)) for n in STEMS]
    ids = np.where(pad, PAD, np.stack(hashes) & np.uint32(BUCKETS - 1)).astype(np.int64)
    ends = np.flatnonzero(pad)[max(WIDTHS) - 1 :: max(WIDTHS)] + 1
    return ids, np.r_[0, ends[:-1]].astype(np.int64)


@dataclass
class Network:
    embeddings: np.ndarray  # (BUCKETS + 1, DIM)
    filters: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    out: np.ndarray
    bias: float

    def windows(self, ids: np.ndarray) -> list[np.ndarray]:
        x = self.embeddings[ids[0]]
        for stem in ids[1:]:
            x += self.embeddings[stem]
        found = []
        for w in self.filters:
            z = x @ w[0]
            for j in range(1, len(w)):
                z[:-j] += x[j:] @ w[j]
            z[ids[0] == PAD] = 0  # a window that starts on a pad would reach the next text
            found.append(z)
        return found

    def logits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        pooled = [np.maximum(np.maximum.reduceat(z, starts, axis=0), 0) for z in self.windows(ids)]
        return np.concatenate(pooled, axis=1) @ self.out + self.bias

    def scores(self, texts: list[str], chars: int = 500_000) -> np.ndarray:
        """Scores of whole texts, about ``chars`` characters at a time."""
        found, block, size = [np.zeros(0)], [], 0
        for i, t in enumerate(texts):
            block.append(t)
            size += len(t)
            if size >= chars or i + 1 == len(texts):
                found.append(1 / (1 + np.exp(-np.clip(self.logits(*word_ids(block)), -30, 30))))
                block, size = [], 0
        return np.concatenate(found)


def gradients(net: Network, ids: np.ndarray, starts: np.ndarray, y: np.ndarray):
    """Of the mean log loss: by output weights, bias, filters, and rows of embeddings with one gradient each."""
    ends = np.r_[starts[1:], ids.shape[1]]
    zs = net.windows(ids)
    best = [np.array([z[a:b].argmax(axis=0) + a for a, b in zip(starts, ends)]) for z in zs]
    top = [np.take_along_axis(z, k, axis=0) for z, k in zip(zs, best)]
    pooled = np.concatenate([np.maximum(t, 0) for t in top], axis=1)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias, -30, 30)))
    error = ((p - y) / len(y)).astype(np.float32)
    d_filters, rows, d_emb = [], [], []
    for n, (w, k, t) in enumerate(zip(net.filters, best, top)):
        part = error[:, None] * net.out[n * FILTERS : (n + 1) * FILTERS] * (t > 0)  # (docs, filters)
        d_w = np.zeros_like(w)
        for j in range(len(w)):
            at = ids[:, np.minimum(k + j, ids.shape[1] - 1)]  # (word and stems, docs, filters)
            d_w[j] = np.einsum("dfe,df->ef", net.embeddings[at].sum(axis=0), part)
            for of in at:
                rows.append(of.ravel())
                d_emb.append((part[:, :, None] * w[j].T[None]).reshape(-1, DIM))
        d_filters.append(d_w)
    return error @ pooled, float(error.sum()), d_filters, np.concatenate(rows), np.concatenate(d_emb)


def train(texts: list[str], y: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.05, prior: float = 8.0, seed: int = 7) -> Network:
    """Adagrad over minibatches.  The first embedding dimension starts at the log-odds of the word or
    stem against the base rate, shrunk as by ``prior`` documents of it."""
    rng = np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.0
    emb = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -14, 14))
    net = Network(emb, filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), bias)
    emb[PAD] = 0
    if not 0 < share < 1:
        return net
    all_ids = [word_ids([t])[0] for t in texts]
    seen = np.zeros((2, BUCKETS + 1))
    for ids, label in zip(all_ids, y):
        seen[int(label), np.unique(ids)] += 1
    rates = (seen[1] + prior * share) / (seen.sum(axis=0) + prior)
    emb[:, 0] = (np.log(rates / (1 - rates)) - np.log(share / (1 - share))) / 8
    emb[PAD] = 0
    for w in filters:
        w[0, 0, : FILTERS // 2] += 1
    net.out[:] = 0.5
    g_emb, g_filters, g_out, g_bias = np.full(emb.shape, 1e-3, np.float32), [np.full(w.shape, 1e-3, np.float32) for w in filters], np.full(net.out.shape, 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            ids = np.concatenate([all_ids[i] for i in chosen], axis=1)
            starts = np.r_[0, np.cumsum([all_ids[i].shape[1] for i in chosen])[:-1]]
            d_out, d_bias, d_filters, rows, d = gradients(net, ids, starts, y[chosen])
            for n, (w, d_w) in enumerate(zip(filters, d_filters)):
                g_filters[n] += d_w**2
                w -= rate * d_w / np.sqrt(g_filters[n])
            touched, back = np.unique(rows, return_inverse=True)
            summed = np.zeros((len(touched), DIM), np.float32)
            np.add.at(summed, back, d)
            g_emb[touched] += summed**2
            emb[touched] -= rate * summed / np.sqrt(g_emb[touched])
            emb[PAD] = 0
            d_out += 1e-4 * net.out
            g_out += d_out**2
            net.out -= (rate * d_out / np.sqrt(g_out)).astype(np.float32)
            g_bias += d_bias**2
            net.bias -= rate * d_bias / g_bias**0.5
    return net


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the greatest F1; 0.5 without both labels."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-scores)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    return float(scores[order][int(f1.argmax())])


@dataclass
class Toxicity:
    network: Network
    common: float
    by_language: dict[str, float]


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 6000, max_bytes: int = 64 << 20, max_text: int = 200_000, shrink: float = 200.0) -> Toxicity:
    """Fit on about ``max_train`` rows and ``max_bytes`` at most; a fifth of them calibrates thresholds."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).where(F.coalesce(F.length("text"), F.lit(0)) <= max_text)

    def some(share: float) -> DataFrame:
        chosen = known.where(hashed < int(share * (1 << 20)))
        return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("text").alias("text"), F.first("lang").alias("lang"), F.first("toxic").alias("toxic"))

    share = min(1.0, max_train / max(known.count(), 1))
    size = some(share).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = some(share * min(1.0, max_bytes / max(size, 1))).toArrow()  # bounded by max_train and max_bytes
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    found = [t or "" for t in rows.column("text").to_pylist()]
    langs, y, ids = rows.column("lang").to_pylist(), rows.column("toxic").to_numpy().astype(np.float64), rows.column("doc_id").to_pylist()
    fits = [i for i in order if zlib.crc32(b"fold%d" % ids[i]) % 5]
    rest = [i for i in order if not zlib.crc32(b"fold%d" % ids[i]) % 5]
    net = train([found[i] for i in fits], y[fits])
    scores, labels_ = net.scores([found[i] for i in rest]), y[rest]
    common = best_threshold(scores, labels_)
    by = {}
    for lang in sorted({langs[i] for i in rest if langs[i] is not None}):
        of = np.array([langs[i] == lang for i in rest])
        by[lang] = (of.sum() * best_threshold(scores[of], labels_[of]) + shrink * common) / (of.sum() + shrink)
    return Toxicity(net, common, by)


def _score_rows(model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(model.value.network.scores(texts_of(batch)))], ["doc_id", "lang", "score"])

    return run


def toxicity_scores(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, score, and toxic by the calibrated threshold of the document's language."""
    spark = docs.sparkSession
    arrow_batches(spark)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"))
    scored = rows.mapInArrow(_score_rows(hold(spark, model)), "doc_id long, lang string, score double")
    threshold = F.lit(model.common)
    for lang, t in model.by_language.items():
        threshold = F.when(F.col("lang") == lang, t).otherwise(threshold)
    return scored.select("doc_id", "score", (F.col("score") >= threshold).alias("toxic"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))  # a null doc_id has no label
    scored = toxicity_scores(docs, fit(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
