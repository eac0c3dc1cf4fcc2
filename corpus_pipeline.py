"""A training-data pipeline: each stage is one operator of lorekeep.llm over all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; each result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Null and empty texts fail the quality rules, so no later stage meets one from documents; each stage alone takes them too (see the operators): they have no
shingles and link with nothing, hold no secret, have size 0 in the mix and aren't taken, and have no ids. Null sources are a
source; rows without an id aren't compared, and all stay. Repeated rows are copies: near_duplicates keeps one of them. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import bpe, jaccard, mixing, quality, secrets
from lorekeep.llm.common import Scratch
from lorekeep.llm.queries import rank_file

#: Scratch tables of the stage that ran last; its result is written by the time the next one begins.
_HELD: list[Scratch] = []


def _scratch(spark: SparkSession) -> Scratch:
    while _HELD:
        _HELD.pop().close()
    _HELD.append(Scratch(spark))
    return _HELD[0]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; lines that fail are gone from their texts."""
    return quality.passing(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles."""
    return jaccard.keep_one(docs, 5, 80, scratch=_scratch(spark))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    _scratch(spark)
    words = secrets.corpus_words(docs)
    d = secrets.redact(docs, secrets.fit(secrets.labelled(spark, words=words), words=words), words=words)
    return d.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of service, repeated as the mix repeats them."""
    return mixing.mixed(docs, scratch=_scratch(spark)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes."""
    _scratch(spark)
    return bpe.digests(docs, *rank_file(), keep=["doc_id", "source"])


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", mix_sources), ("bpe", encode)]
#: Two stages (joins on shingle sets, byte-pair merges) can't be put in SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes once its successor is written."""
    own, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        last, docs = docs, own.store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        own.drop(last)
    return docs
