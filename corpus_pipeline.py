"""The corpus pipeline: from raw documents to packed training sequences, in five stages.

Every stage takes the rows its predecessor wrote; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from aestudy.llm import pattern_packing, quality_gbt, secret_scan, simhash, tree_dedup
from aestudy.llm.common import keep_rows
from aestudy.sources.checkpoints import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the documents it is given."""
    model = quality_gbt.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gbt.keep_good(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier stays."""
    return keep_rows(docs, tree_dedup.exact_groups(docs, keep="largest"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    Near copies have a Jaccard similarity of at least 0.8 over their distinct five-word shingles, computed
    from the texts. Which texts are compared is told by fingerprints of 256 bits in sixteen segments: those
    that differ in at most 56 bits (sets of similarity 0.8 differ in 39 on average, with a deviation of 6), and in at most one bit of some segment.
    """
    return keep_rows(docs, simhash.near_groups(docs, words=5, radius=56, segments=4, lanes=4, reach=1, similarity=0.8))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; the documents stay."""
    return secret_scan.redact_secrets(docs, secret_scan.fit_network(docs), length_col="n_chars" if "n_chars" in docs.columns else None)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    pieces = pattern_packing.cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, most=1024, with_ids=False)
    return pattern_packing.pack(pieces, most=1024)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("secret scan", secret_redaction),
    ("pattern packing", best_fit_packing),
]

#: Trained models, fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
