"""How well search finds the documents that hold given passages, on an index that is kept up with the documents.

    python -m jobs.retrieval_report --documents DOCUMENTS --questions PASSAGES --target FOLDER [--config FILE]

Each run

* brings the positional index at TARGET/index up to the documents: only those that are new or changed (by a digest) are indexed, those that are gone are
  marked; where nothing changed nothing is written;
* asks the index for every passage, by its first `terms` words and by its first `short_terms` words, in one plan;
* calls a document relevant if it holds the whole passage;
* writes TARGET/hits (the ranked documents, partitioned by the form of the question and the documents' shelf), TARGET/report (share of questions with a relevant
  document at each cut-off, in both forms, with the gap and a verdict) and TARGET/misses (questions without one).

Outputs are written over the last ones, so a run that is repeated gives the same result.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import evaluation, fts, postings

log = logging.getLogger("jobs.retrieval_report")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "retrieval_report.json")


def load_config(path: str | None = None) -> dict:
    with open(path or CONFIG, encoding="utf-8") as f:
        return json.load(f)


def ranked_hits(spark: SparkSession, index: str, questions: DataFrame, config: dict) -> DataFrame:
    """(form, query_id, key, score, rank) of both forms of every question."""
    words = evaluation.english_terms(F.coalesce("text", F.lit("")), config["terms"])
    forms = F.array(F.struct(F.lit("long").alias("form"), words.alias("w")), F.struct(F.lit("short").alias("form"), F.slice(words, 1, config["short_terms"]).alias("w")))
    asked = questions.select("query_id", F.explode(forms).alias("f")).select(F.struct("f.form", "query_id").alias("query_id"), F.explode("f.w").alias("term"))
    return postings.search_batch(spark, index, asked, config["limit"]).select("query_id.form", "query_id.query_id", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def run(spark: SparkSession, documents: str, questions: str, target: str, config: dict | None = None) -> dict:
    config = config or load_config()
    key, text, shelf = (config["documents"][c] for c in ("key", "text", "shelf"))
    docs = spark.read.parquet(documents).select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(shelf).cast("string"), F.lit("")).alias("shelf"))
    ask = spark.read.parquet(questions).select(F.col(config["questions"]["key"]).alias("query_id"), F.col(config["questions"]["text"]).alias("text"))
    index = f"{target}/index"
    change = postings.refresh(docs, "key", ["text"], index)
    log.info("%s: %d documents, of those %d added, %d changed, %d removed in %s", documents, change["n"], change["added"], change["changed"], change["removed"], index)

    relevant = fts.containing(docs, "key", "text", ask.select("query_id", F.col("text").alias("p"))).withColumn("relevant", F.lit(True))
    hits = ranked_hits(spark, index, ask, config).join(relevant, ["query_id", "key"], "left").join(docs.select("key", "shelf"), "key")
    hits = hits.withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    # an empty name can't name a directory
    hits.withColumn("shelf_dir", F.when(F.col("shelf") == "", "none").otherwise(F.col("shelf"))).write.mode("overwrite").partitionBy("form", "shelf_dir").parquet(f"{target}/hits")
    hits = spark.read.schema("query_id " + dict(ask.dtypes)["query_id"] + ", key " + dict(docs.dtypes)["key"] + ", score double, rank long, relevant boolean, shelf string, form string, shelf_dir string").parquet(f"{target}/hits").drop("shelf_dir")

    of = lambda form: hits.where(F.col("form") == form)
    good = hits.where("relevant").select("query_id", "key").distinct()
    rate = lambda form: evaluation.hit_at_k(of(form), good, "key", ask, tuple(config["cutoffs"]))
    report = evaluation.compare(rate("long"), rate("short")).select("k", F.col("a").alias("long_rate"), F.col("b").alias("short_rate"), "gap", "verdict")
    report.coalesce(1).write.mode("overwrite").parquet(f"{target}/report")
    missed = ask.select("query_id").join(hits.where("relevant").select("query_id", "form").distinct().groupBy("query_id").agg(F.array_sort(F.collect_set("form")).alias("f")), "query_id", "left")
    missed = missed.where("f is null or size(f) < 2").select("query_id", F.when(F.array_contains("f", "long"), "short").when(F.array_contains("f", "short"), "long").otherwise("both").alias("missed_by"))
    missed.write.mode("overwrite").partitionBy("missed_by").parquet(f"{target}/misses")
    counts = {"hits": spark.read.parquet(f"{target}/hits").count(), "questions": ask.count(), "misses": spark.read.schema("query_id " + dict(ask.dtypes)["query_id"] + ", missed_by string").parquet(f"{target}/misses").count()}
    log.info("%s: %d questions; %d hits, %d misses in %s", questions, counts["questions"], counts["hits"], counts["misses"], target)
    return change | counts


def output(spark: SparkSession, target: str) -> DataFrame:
    """All that the job's tables hold: (part, query_id, key, score, rank, relevant, shelf, form, k, long_rate, short_rate, gap, verdict)."""
    hits = spark.read.schema("query_id long, key long, score double, rank long, relevant boolean, shelf string, form string, shelf_dir string").parquet(f"{target}/hits").drop("shelf_dir")
    report = spark.read.parquet(f"{target}/report")
    misses = spark.read.schema("query_id long, missed_by string").parquet(f"{target}/misses").withColumnRenamed("missed_by", "form")
    parts = [d.withColumn("part", F.lit(n)) for n, d in (("hit", hits), ("report", report), ("miss", misses))]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return out.select("part", "query_id", "key", "score", "rank", "relevant", "shelf", "form", "k", "long_rate", "short_rate", "gap", "verdict")


def main() -> None:
    a = argparse.ArgumentParser(description="Reports how well search finds documents that hold given passages.")
    for name in ("documents", "questions", "target"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--config")
    args = a.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("retrieval_report").getOrCreate()
    try:
        run(spark, args.documents, args.questions, args.target, load_config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
