"""Logs that grow: relay logs delivered piece by piece, with the open message of each log kept as state.

A shipper cuts a growing log into files `NAME.log.SEQ` (SEQ 0, 1, 2, ...), wherever it stands: within a line or a message as well. Each log has a state of
its line number, its unfinished line and its open message; pieces that come before their predecessors wait in it. A message is given out once more,
with `closed` false, after every batch that leaves it open, so that the last message of a log is there too; `tailed` takes the last
version of each message, which are those that `sources.files.relay_log` gives for the whole log.

Logs are independent, so work is dealt by log; what one task holds of a log are a batch's pieces. Needs the RocksDB state store (`with_state_store`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.files import RELAY
from .ingest import stream_id

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "log string, ts string, source string, chat_id string, user string, message_id string, text string, closed boolean"
STATE = "next long, line_no long, rest string, open boolean, no long, ts string, chat_id string, user string, text string"
COLUMNS = ["log", "ts", "source", "chat_id", "user", "message_id", "text", "closed"]


def with_state_store(spark: SparkSession) -> SparkSession:
    """Sets the state store that the stream needs, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(log, seq, piece) of piece files as they arrive below path."""
    d = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.log.*").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(.*)\.(\d+)$", 1)
    seq = F.regexp_extract(F.col("_metadata.file_path"), r"(.*)\.(\d+)$", 2).cast("long")
    return d.select(name.alias("log"), seq.alias("seq"), F.col("value").alias("piece")).where("seq is not null")


class Reader:
    """What is known of one log after the pieces read so far: state that `feed` moves on."""

    def __init__(self, next_: int = 0, line_no: int = 0, rest: str = "", message: dict | None = None):
        self.next, self.line_no, self.rest, self.message = next_, line_no, rest, message

    def line(self, text: str, message: dict | None) -> tuple[dict | None, dict | None]:
        """(closed message, open message) after one more line."""
        m = re.match(RELAY, text)
        if m:
            return message, {"no": self.line_no, "ts": m[1], "user": m[2], "chat_id": m[5], "text": m[6]}
        return None, message and {**message, "text": message["text"] + "\n" + text}

    def feed(self, piece: str) -> Iterator[dict]:
        """Messages that a piece closes."""
        *lines, self.rest = (self.rest + piece).split("\n")
        for text in lines:
            self.line_no += 1
            closed, self.message = self.line(text.removesuffix("\r"), self.message)
            if closed:
                yield closed
        self.next += 1

    def pending(self) -> Iterator[tuple[dict, bool]]:
        """(message, closed) as if the log ended here."""
        self.line_no += 1
        closed, last = self.line(self.rest.removesuffix("\r"), self.message)
        self.line_no -= 1
        if closed:
            yield closed, False  # its end isn't certain before the line is whole
        if last:
            yield last, False


class Tail(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("reader", STATE)
        self.waiting = handle.getMapState("waiting", "seq long", "piece string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        got = self.state.get() if self.state.exists() else None
        r = Reader(got[0], got[1], got[2], {"no": got[4], "ts": got[5], "chat_id": got[6], "user": got[7], "text": got[8]} if got[3] else None) if got else Reader()
        for b in rows:
            for seq, piece in zip(b["seq"], b["piece"], strict=True):
                if seq >= r.next:  # a piece that comes twice is read once
                    self.waiting.updateValue((int(seq),), (piece or "",))
        out = []
        while self.waiting.containsKey((r.next,)):
            at = (r.next,)
            piece = self.waiting.getValue(at)[0]
            self.waiting.removeKey(at)
            out += [(m, True) for m in r.feed(piece)]
        out += list(r.pending())
        m = r.message or {"no": 0, "ts": "", "chat_id": "", "user": "", "text": ""}
        self.state.update((r.next, r.line_no, r.rest, r.message is not None, m["no"], m["ts"], m["chat_id"], m["user"], m["text"]))
        rows_ = [(key[0], m["ts"], "relay", m["chat_id"], m["user"], str(m["no"]), m["text"].rstrip("\n"), closed) for m, closed in out]
        yield pd.DataFrame(rows_, columns=COLUMNS)

    def close(self) -> None:
        pass


def tail_messages(chunks: DataFrame) -> DataFrame:
    """Versions of messages from pieces (log, seq, piece), a stream."""
    return chunks.groupBy("log").transformWithStateInPandas(statefulProcessor=Tail(), outputStructType=OUT, outputMode="Append", timeMode="None")


def tail_logs(spark: SparkSession, path: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the versions of messages that new pieces below path bring to target, by stream and batch; a batch that is run again replaces its own."""

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("stream", F.lit(stream_id(batch.sparkSession, checkpoint))).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch").parquet(target)

    stream = tail_messages(pieces(with_state_store(spark), path))
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tailed(spark: SparkSession, target: str, bot: str) -> DataFrame:
    """Messages as they stand: the closed version of each, else the longest, since an open message only grows (but for a line that turns out to begin
    the next one, which closes it)."""
    d = spark.read.parquet(target)
    last = F.max_by(F.struct("ts", "source", "chat_id", "user", "text"), F.struct("closed", F.char_length("text"), "batch"))
    return d.groupBy("log", "message_id").agg(last.alias("m")).select(F.lit(bot).alias("bot_name"), "log", "m.ts", "m.source", "m.chat_id", "m.user", "message_id", "m.text")
