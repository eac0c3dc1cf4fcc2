"""Queries of this subpackage over the tables in a folder, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, fingerprints, html, jaccard, language, licenses, mixing, quality, secrets, sharding, warc
from ..sources.shared import shared_dir, until_exit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.score(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def rank_file() -> tuple[str, str]:
    """Path of the rank file and the pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *rank_file(), keep=["doc_id"])


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"), 3, 90)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate: place, kind, digest of the candidate, probability and verdict."""
    docs = table(spark, sf_dir, "documents")
    words = secrets.corpus_words(docs)
    d = secrets.scan(docs, secrets.fit(secrets.labelled(spark, words=words), words=words), words=words)
    d = d.select("doc_id", F.explode_outer("findings").alias("f")).where(F.col("f").isNotNull())  # no filter below the scan, which would repeat it
    return d.select("doc_id", "f.start", "f.length", "f.kind", F.sha2("f.candidate", 256).alias("candidate_sha256"), "f.probability", "f.secret")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    until_exit(spark, path)
    return warc.rebuilt(warc.read_archive(spark, path)).withColumnRenamed("id", "page_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "virtual_finish", "taken")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_fingerprints, op2_quality, op3_html, op4_sharding, op5_bpe, op6_jaccard, op7_secrets, op8_warc, op9_language, op10_mixing, op11_divergence, op12_licenses)}
ORACLES: dict[str, str] = {"op2_quality": quality.ORACLE, "op4_sharding": sharding.ORACLE, "op8_warc": warc.ORACLE, "op10_mixing": mixing.ORACLE, "op11_divergence": divergence.ORACLE, "op12_licenses": licenses.ORACLE}
