"""Filtering stages: operators whose decisions remove rows of `documents`, all columns kept.

Near copies are those of a similarity of 0.8 or more on shingles of five words, by SimHash of 256 bits; pairs
of that Jaccard similarity which SimHash or its anchors miss are found by their sets of shingles (see similar).

Defined cases: rows without a doc_id can't be named by a decision and stay; rows of a repeated doc_id go
together; null and empty texts are decided like others; an empty table stays empty; further columns of
any name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.decontam import leaks
from marlstone.llm.exactdup import exact_duplicates
from marlstone.llm.packing import pack
from marlstone.llm.quality import quality_scores
from marlstone.llm.shared import small_side, staged, table
from marlstone.llm.similar import similar_texts
from marlstone.llm.simhash import distance_of


#: Of near copies: words of a shingle, bits of a fingerprint, least similarity as a fraction.
SHINGLE, BITS, SIMILARITY = 5, 256, (4, 5)


def without(docs: DataFrame, ids: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """``docs`` but for the doc_ids of ``ids``; these are broadcast only while few."""
    name = "_gone"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    gone = staged(ids.select(F.col("doc_id").alias(name)).where(F.col(name).isNotNull()).distinct(), "gone")
    return docs.join(small_side(gone, gone.count(), limit), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, quality_scores(docs, table(spark, sf_dir, "labels")).where("not kept"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, exact_duplicates(docs).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = similar_texts(docs, SHINGLE, SIMILARITY, BITS, distance_of(SIMILARITY[0] / SIMILARITY[1], BITS))
    return without(docs, found.where("doc_id <> component_id"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, leaks(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
