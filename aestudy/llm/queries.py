"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aestudy.llm import ball_codes, bpe_stream, context_tree, mixture_packing, pattern_packing, quality_gbt, robust_outliers, secret_scan, simhash, spelling_trie, token_files, tree_dedup, url_filter
from aestudy.llm.common import in_fold
from aestudy.llm.oracles import oracle_sql as oracle_sql
from aestudy.sources.checkpoints import scratch_path

#: (verdict, host, path) of the rules that come before the list.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Parts of host names whose pages make up the list of blocked URLs.
LISTED_HOSTS = r"(?i)^[^:]*://[^/?#]*(casino|pills|bets|adult|spam)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, pages.where(F.col("url").rlike(LISTED_HOSTS)), URL_RULES)


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.judge_quality(table(spark, sf_dir, "documents"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_texts(table(spark, sf_dir, "documents"), folds=10)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op5_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_stream.encode_texts(table(spark, sf_dir, "documents"), path, digests=True)


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = pattern_packing.cut_pieces(table(spark, sf_dir, "documents"), path, end_id=2, most=1024, with_ids=False)
    return pattern_packing.pack(pieces, most=1024)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan_secrets(docs, secret_scan.fit_network(docs))


def op8_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_gbt.fit_quality(docs, table(spark, sf_dir, "labels"), folds=5)
    scored = quality_gbt.score_quality(docs, model)
    held_out = in_fold(F.col("doc_id"), 5).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= quality_gbt.THRESHOLD).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=3, radius=3)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(spark, folder)


def op11_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_trie.group_variants(spelling_trie.count_words(table(spark, sf_dir, "documents")))


def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.compress_vectors(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return mixture_packing.pack_mixture(table(spark, sf_dir, "documents"), path, end_id=1, most=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_filter, op2_robust_outliers, op3_context_tree, op4_exact_dedup, op5_bpe_stream, op6_pattern_packing, op7_secret_scan, op8_quality_gbt, op9_simhash, op10_token_files, op11_spelling_trie, op12_ball_codes, op13_mixture_packing)
    return {f.__name__: f for f in found}
