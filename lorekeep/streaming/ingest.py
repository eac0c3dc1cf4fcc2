"""Structured Streaming: incremental, idempotent ingest of messages, and windows over access events."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dialect import encode_notes
from ..operators.ingest import latest_wins, message_key
from ..sources.files import inbox, note


def inbox_stream(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON files as they arrive below path."""
    d = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").text(path, wholetext=True)
    return inbox(d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")))


def deduplicated(messages: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each message key once. Without a watermark the state holds all keys; with (column, delay) only those within the delay."""
    d = message_key(messages.where("text is not null and text <> ''"))
    return d.withWatermark(*watermark).dropDuplicatesWithinWatermark(["key"]) if watermark else d.dropDuplicates(["key"])


def _stored(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The columns of schema of what target holds; nothing if nothing was written yet."""
    try:
        names = [f.split()[0] for f in schema.split(", ")]
        return spark.read.parquet(target).select(*names)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def ingest(messages: DataFrame, target: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends unseen messages to target, which is its own ledger (see append_once): a batch reads the keys of its buckets, not those of the whole table. Of
    a key's messages in one batch the smallest by ts, then text, stays. parse makes messages of a batch where a stream can't (relay logs: a
    file's lines in order)."""

    def add(batch: DataFrame, number: int) -> None:
        d = message_key((parse(batch) if parse else batch).where("text is not null and text <> ''"))
        first = Window.partitionBy("key").orderBy("ts", "text")
        d = d.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
        append_once(d, stream_id(batch.sparkSession, checkpoint), number, target, "key")

    return messages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Directories of a ledger, by hash of the key.
LEDGER = 64


def touched(rows: DataFrame, column: str = "bucket") -> list[int]:
    """The buckets that rows fall in: as many numbers as there are buckets at most."""
    return sorted(r[0] for r in rows.select(column).distinct().collect())


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity that a stream's checkpoint gives it, within foreachBatch: another checkpoint is another stream, and its batches count from 0."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def append_once(batch: DataFrame, stream: str, batch_id: int, target: str, key: str, buckets: int = LEDGER, by: str | None = None) -> list[int]:
    """Adds the rows of a micro-batch whose key target lacks, one per key (any of equal ones; make equal keys mean equal rows), and gives the buckets added to.

    target is the ledger: partitioned by stream, batch and bucket (hash of `by`, the key unless given), so that the anti-join reads the keys of the batch's
    buckets only. A batch that is run again ignores and replaces its own partitions, which dynamic overwrite does; so a restart from the
    checkpoint repeats it without harm, and a new checkpoint over an old target reads everything again but adds nothing twice."""
    spark = batch.sparkSession
    d = batch.where(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(by or key), F.lit(buckets)).cast("int"))
    here = touched(d)
    if not here:
        return here
    seen = _stored(spark, target, f"{key} {batch.schema[key].dataType.simpleString()}, stream string, batch long, bucket int")
    seen = seen.where(F.col("bucket").isin(here) & ((F.col("stream") != stream) | (F.col("batch") < batch_id)))
    new = d.join(seen.select(key), key, "left_anti").dropDuplicates([key]).withColumn("stream", F.lit(stream)).withColumn("batch", F.lit(batch_id).cast("long"))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch", "bucket").parquet(target)
    return here


def log_stream(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """(path, body) of log files as they arrive, each read whole; with `ingest(..., parse=lambda f: relay_log(f, bot))` their messages."""
    d = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def reencode(files: DataFrame, target: str, now: str) -> DataFrame:
    """Encodes the notes among files (path, body) that are new or differ from the last version in target by their hash, appends them, and gives
    the rows added. A file stream doesn't report a file that is saved again, so this runs as a batch over the vault, on a timer or by
    `foreachBatch` of another stream. The last version of a slug by encoded_at is the one that counts."""
    spark = files.sparkSession
    old = latest_wins(_stored(spark, target, "slug string, source_hash string, encoded_at string"), "slug", "encoded_at").select("slug", "source_hash")
    n = files.withColumn("source_hash", F.sha2(F.encode("body", "utf-8"), 256))
    notes = encode_notes(note(n)).join(n.select("path", "source_hash"), "path")
    new = notes.join(old, ["slug", "source_hash"], "left_anti").select("slug", F.col("skeleton").alias("clsc"), F.col("skeleton_tokens").alias("tokens"), "path", "source_hash", F.lit(now).alias("encoded_at"))
    new.write.mode("append").parquet(target)
    return spark.read.parquet(target).where(F.col("encoded_at") == now)


def access_counts(events: DataFrame, ts: str = "ts", key: str = "slug", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Accesses per key and window; late events within the delay count, later ones don't."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"))
