"""Quality by hierarchical empirical Bayes: document evidence, shrunk site rates.

A logistic classifier over byte shares and word repetition gives each document its log-odds.  Sites
have two levels, host and path.  A document's evidence is its label, or its probability where it has
none; the mean evidence of a site is its rate, shrunk to the level above by a Beta prior whose strength
comes from how far sites differ beyond chance (method of moments).  A document's final log-odds are its
own, moved by the rate of its path without itself, against the global rate.

The classifier is fitted on at most about ``max_train`` labelled documents, chosen by a hash of
doc_id; labels, rates and strengths cover all documents.

Defined cases: null and empty texts are scored like others, from the prior of their features; null
hosts and paths form a site of their own; repeated rows each count and are each returned; a repeated
label is the greater one, and a repeated doc_id is fitted once; an empty table gives no rows; without
labels of both values every score is the classifier's neutral 0.5 and all is kept; other columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shared import arrow_batches, hold, small_side, staged, table, texts_of, tidy

N_FEATURES = 256 + 4


def features(texts: list[str]) -> np.ndarray:
    """Byte shares (square roots), log length, share of distinct words, of repeated neighbours, mean word length."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for i, text in enumerate(texts):
        raw = text.encode()
        words = raw.split()
        if not words:
            continue
        out[i, :256] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw))
        same = sum(map(bytes.__eq__, words, words[1:]))
        out[i, 256:] = math.log1p(len(words)), len(set(words)) / len(words), same / len(words), len(raw) / len(words) / 10
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 3.0, rounds: int = 12) -> "Logistic":
        """Newton's method with a ridge; deterministic."""
        mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        w = np.zeros(x.shape[1] + 1)
        if len(set(y.tolist())) > 1:
            z = np.c_[(x - mean) / scale, np.ones(len(x))].astype(np.float64)
            penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
                w = w + step
                if np.abs(step).max() < 1e-6:
                    break
        return cls(mean.astype(np.float32), scale.astype(np.float32), w.astype(np.float32))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -12, 12)


def _feature_rows(batches):
    for batch in batches:
        x = features(texts_of(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))], ["doc_id", "y", "x"])


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, y), one row a document with a label."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("double")).alias("y"))


def fit_classifier(docs: DataFrame, labels: DataFrame, max_train: int = 8000) -> Logistic:
    """On about ``max_train`` labelled rows at most; their features come to the driver."""
    n = labels.count()
    share = min(1.0, max_train / max(n, 1))
    chosen = labelled(labels).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # bounded by max_train
    made = rows.select("doc_id", "y", "text").mapInArrow(tidy(_feature_rows), "doc_id long, y double, x array<float>")
    data = made.groupBy("doc_id").agg(F.first("y").alias("y"), F.first("x").alias("x")).toArrow()
    y = data.column("y").to_numpy()
    x = np.array(data.column("x").combine_chunks().flatten(), np.float32).reshape(len(y), N_FEATURES)
    return Logistic.fit(x, y)


def _logit_rows(model):
    @tidy
    def run(batches):
        for batch in batches:
            logit = model.value.logit(features(texts_of(batch))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "host", "path")] + [pa.array(logit)], ["doc_id", "host", "path", "logit"])

    return run


def _strength(sums: tuple[float, float, float, float], default: float = 1e6) -> float:
    """Beta prior's strength from sums over sites of (n, n * rate, n * (rate - prior)^2, noise)."""
    n, mean, spread, noise = sums
    if not n:
        return default
    between = max(0.0, (spread - noise) / n)
    return min(default, max(10.0, mean * (1 - mean) / between - 1)) if between > 0 else default


def _logit(c: Column) -> Column:
    p = F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def site_rates(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """Of documents (host, path, e, v: evidence and its variance): (host, path, n, s, host_rate) of each
    path, the global rate, and the strength of a path's prior."""
    paths = staged(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("s"), F.sum("v").alias("v")), "site-paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("v").alias("hv")), "site-hosts")
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = total["s"] / total["n"] if total["n"] else 0.5

    def strength(df: DataFrame, n: str, s: str, v: str, prior: Column) -> float:
        rate = F.col(s) / F.col(n)
        # Chance moves a site's mean by the variance within it, beyond its documents' own, over n.
        within = (rate * (1 - rate) - F.col(v) / F.col(n)) / F.col(n)
        r = df.agg(F.sum(n), F.sum(s), F.sum(F.col(n) * (rate - prior) ** 2), F.sum(F.col(n) * within)).first()
        return _strength((r[0] or 0, (r[1] or 0) / r[0] if r[0] else 0, r[2] or 0, r[3] or 0))

    at_host = strength(hosts, "hn", "hs", "hv", F.lit(mean))
    hosts = hosts.select("host", ((F.col("hs") + at_host * mean) / (F.col("hn") + at_host)).alias("host_rate"))
    both = paths.alias("p").join(hosts.alias("q"), F.col("p.host").eqNullSafe(F.col("q.host"))).select("p.*", "host_rate")
    return staged(both.select("host", "path", "n", "s", "host_rate"), "site-rates"), mean, strength(both, "n", "s", "v", F.col("host_rate"))


def _sites(docs: DataFrame, host: str, path: str) -> tuple[Column, Column]:
    return tuple(F.col(c).cast("string") if c in docs.columns else F.lit("") for c in (host, path))


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_train: int = 8000, keep_from: float = 0.5) -> DataFrame:
    """doc_id, score (probability of quality 1), document_score, kept."""
    spark = docs.sparkSession
    arrow_batches(spark)
    model = hold(spark, fit_classifier(docs, labels, max_train))
    h, p = _sites(docs, host, path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("host"), p.alias("path"))
    logits = staged(rows.mapInArrow(_logit_rows(model), "doc_id long, host string, path string, logit double"), "quality-logits")
    p = 1 / (1 + F.exp(-F.col("logit")))
    evidence = logits.join(labelled(labels), "doc_id", "left").withColumn("p", p)
    known = F.col("y").isNotNull()
    scored = staged(evidence.withColumns({"e": F.when(known, F.col("y")).otherwise(F.col("p")), "v": F.when(known, 0.0).otherwise(F.col("p") * (1 - F.col("p")))}).drop("y"), "quality-evidence")
    rates, mean, strength = site_rates(scored)
    near = small_side(rates, rates.count(), 500_000)
    joined = scored.alias("d").join(near.alias("r"), F.col("d.host").eqNullSafe(F.col("r.host")) & F.col("d.path").eqNullSafe(F.col("r.path")))
    others = (F.col("s") - F.col("e") + strength * F.col("host_rate")) / (F.col("n") - 1 + strength)
    score = 1 / (1 + F.exp(-(F.col("logit") + _logit(others) - _logit(F.lit(mean)))))
    return joined.select("doc_id", score.alias("score"), F.col("p").alias("document_score"), (score >= keep_from).alias("kept"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
