"""Archive of chat messages, kept up by a file stream.

    python -m jobs.archive_messages --source MESSAGES --target FOLDER --checkpoint FOLDER [--config FILE]

Each run takes the Parquet files that came below the source since the last one (the stream's checkpoint is the high-water mark), and

* adds messages that aren't archived yet to TARGET/messages, partitioned by stream, micro-batch and bucket of the chat. A message is known by chat, number,
  user and a digest of its text, so one that was edited is kept in both versions, and the order of arrival doesn't show in the result;
* renews TARGET/chats (counts, tokens and users of a chat), partitioned by bucket, for the buckets that got messages, from the archive.

Messages without text are left out. A run without new files changes nothing; a run that was cut off is repeated by the next one from the checkpoint,
its partitions replaced. A new checkpoint over an old target reads the source again and adds what the archive lacks. All reading and writing is Spark's, so paths may be remote.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import has_cjk, tokens
from lorekeep.streaming.ingest import append_once, stream_id

log = logging.getLogger("jobs.archive_messages")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "archive_messages.json")


def load_config(path: str | None = None) -> dict:
    with open(path or CONFIG, encoding="utf-8") as f:
        return json.load(f)


def messages_of(rows: DataFrame, config: dict) -> DataFrame:
    """Rows of the source as messages with their key; those without text are dropped."""
    names = config["columns"]
    d = rows.select(*[F.col(names[c]).cast("string").alias(c) for c in ("chat_id", "message_id", "user", "text")]).where("text is not null and text <> ''")
    parts = [F.coalesce(c, F.lit("")) for c in ("chat_id", "message_id", "user")]
    d = d.withColumn("key", F.sha2(F.encode(F.concat_ws("|", *[F.char_length(p) for p in parts], *parts, "text"), "utf-8"), 256))
    return d.withColumn("tokens", tokens(F.col("text"))).withColumn("snippet", F.substring("text", 1, config["snippet"])).withColumn("cjk", has_cjk(F.col("text")))


def chats_of(messages: DataFrame) -> DataFrame:
    """(bucket, chat_id, messages, tokens, users); users are few, as roles and names within a chat are."""
    g = messages.groupBy("bucket", "chat_id").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_set("user")).alias("u"))
    return g.select("bucket", "chat_id", "messages", "tokens", F.array_join("u", ",").alias("users"))


def archived(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """The archive as it stands: messages and chats."""
    return spark.read.parquet(f"{target}/messages"), spark.read.parquet(f"{target}/chats")


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: dict | None = None) -> dict:
    """Takes what is new below source; waits for the stream to end. Gives the numbers of batches and of messages added."""
    config = config or load_config()
    schema = spark.read.parquet(source).schema
    done = {"batches": 0, "read": 0, "added": 0}

    def add(batch: DataFrame, number: int) -> None:
        found = messages_of(batch, config)
        me = stream_id(batch.sparkSession, checkpoint)
        here = append_once(found, me, number, f"{target}/messages", "key", config["buckets"], by="chat_id")
        every = batch.sparkSession.read.parquet(f"{target}/messages") if here else None
        if every is not None:
            chats = chats_of(every.where(F.col("bucket").isin(here)))
            chats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{target}/chats")
        rows, added = batch.count(), every.where((F.col("stream") == me) & (F.col("batch") == number)).count() if here else 0
        done["batches"], done["read"], done["added"] = done["batches"] + 1, done["read"] + rows, done["added"] + added
        log.info("batch %d of %s: %d rows read, %d messages added in %d buckets of %s", number, source, rows, added, len(here), target)

    name = source.rstrip("/")
    path = f"{name[:-1]}[{name[-1]}]"  # a pattern that only source fits: a stream takes a folder by its path, but a single file by a pattern alone
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(path)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d batches, %d rows read, %d messages added to %s", source, done["batches"], done["read"], done["added"], target)
    return done


def main() -> None:
    a = argparse.ArgumentParser(description="Archives chat messages that came since the last run.")
    for name in ("source", "target", "checkpoint"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--config")
    args = a.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("archive_messages").getOrCreate()
    try:
        run(spark, args.source, args.target, args.checkpoint, load_config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
