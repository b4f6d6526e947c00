"""The corpus operators as queries over the tables of a folder, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, fingerprints, licenses, linededup, lm, mixing, quality, simhash_dedup, urlfilter
from .common import small_batches, table


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path of a public vocabulary and the split pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, good)``: good quality and not toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path, pattern = tokenizer()
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.resample(table(spark, sf_dir, "documents"), good_labels(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = linededup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = lm.in_fold("doc_id")
    scored = lm.score(docs, lm.train(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_embedding_neardup, op3_license_scan, op4_simhash_neardup, op5_source_mix,
                            op6_fingerprints, op7_quality, op8_line_dedup, op9_url_filter, op10_lm_score)
}
SQL: dict[str, str] = {"op3_license_scan": licenses.SQL, "op5_source_mix": mixing.SQL, "op8_line_dedup": linededup.SQL, "op9_url_filter": urlfilter.SQL}
