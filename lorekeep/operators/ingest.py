"""Ingest: idempotent inserts, latest-wins and change-aware upserts, access and usage records, reports and tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Report and document limits, states and priorities of tasks.
MAX_TITLE, MAX_REPORT, MIN_DOCUMENT, MAX_DOCUMENT, MAX_FILE, MAX_NAMES = 60, 500 * 1024, 100, 50_000, 50 * 1024 * 1024, 100
TASK_STATES, PRIORITIES = ("pending", "in_progress", "review", "done"), ("low", "medium", "high", "urgent")
#: Folder of reports below the vault.
REPORTS = "Ocean/Chart/Reports"


def message_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("bot_name", "source", "chat_id", "message_id")]))


def insert_unseen(new: DataFrame, seen: DataFrame, by_content: bool = False) -> DataFrame:
    """Messages with text whose key is not in seen (key), one per key (the smallest by ts, then text)."""
    d = message_key(new.where("text is not null and text <> ''"))
    d = d.withColumn("key", F.concat_ws("|", "key", F.sha2(F.encode("text", "utf-8"), 256))) if by_content else d
    first = Window.partitionBy("key").orderBy("ts", "text")
    return d.join(seen.select("key"), "key", "left_anti").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def latest_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def changed(new: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of new whose content hash differs from the stored one (source_hash) or that aren't stored; with status."""
    n = new.withColumn("source_hash", F.sha2(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 256))
    j = n.join(stored.select(F.col(key).alias("_k"), F.col("source_hash").alias("_h")), F.col(key) == F.col("_k"), "left")
    return j.where(~F.col("source_hash").eqNullSafe(F.col("_h"))).withColumn("status", F.when(F.col("_k").isNull(), "new").otherwise("changed")).drop("_k", "_h")


def validate_documents(df: DataFrame, text: str, size: str | None = None) -> DataFrame:
    """df with code (OK, EMPTY_CONTENT, FILE_TOO_LARGE) and body, cut at the limit for accepted documents."""
    n = F.char_length(F.trim(F.coalesce(text, F.lit(""))))
    code = F.when(F.col(size) > MAX_FILE, "FILE_TOO_LARGE").when(n < MIN_DOCUMENT, "EMPTY_CONTENT").otherwise("OK") if size else F.when(n < MIN_DOCUMENT, "EMPTY_CONTENT").otherwise("OK")
    return df.withColumn("code", code).withColumn("body", F.when(F.col("code") == "OK", F.substring(text, 1, MAX_DOCUMENT)))


def documents_of(files: DataFrame) -> DataFrame:
    """Files (path, size, format, text, code) as documents: slug, group, body cut at the limit, tokens, truncated, drawer_path; code OK, or
    why there is none (too short a text is EMPTY_CONTENT)."""
    from ..functions.text import file_group, file_slug

    n = F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    d = files.withColumn("code", F.coalesce("code", F.when(n < MIN_DOCUMENT, "EMPTY_CONTENT").otherwise("OK")))
    ok = F.col("code") == "OK"
    body = F.when(ok, F.substring("text", 1, MAX_DOCUMENT))
    return d.select("code", "format", file_slug(F.col("path")).alias("slug"), file_group(F.col("path")).alias("group"), body.alias("body"), tokens(body).alias("tokens"), (ok & (F.char_length("text") > MAX_DOCUMENT)).alias("truncated"), F.col("path").alias("drawer_path"))


def upsert_by_path(radar: DataFrame, documents: DataFrame, now: str) -> DataFrame:
    """radar after documents (slug, body, drawer_path), the last by slug of a path: a row with the same drawer_path gets slug, text, tokens, hash and
    time, its other columns stay; a new path adds a row."""
    one = Window.partitionBy("drawer_path").orderBy(F.col("slug").desc())
    d = documents.withColumn("_r", F.row_number().over(one)).where("_r = 1")
    n = d.select(F.col("drawer_path").alias("_p"), F.col("slug").alias("_slug"), F.col("body").alias("_body"))
    j = radar.join(n, radar["drawer_path"] == n["_p"], "full")
    hit = F.col("_p").isNotNull()
    new = {"slug": F.col("_slug"), "clsc": F.col("_body"), "tokens": tokens(F.col("_body")), "drawer_path": F.col("_p"), "source_hash": F.sha2(F.encode("_body", "utf-8"), 256), "encoded_at": F.lit(now)}
    return j.select(*[F.when(hit, new[c].cast(radar.schema[c].dataType)).otherwise(radar[c]).alias(c) if c in new else radar[c] for c in radar.columns])


def upsert_sonar(radar: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """radar after new index lines (slug, clsc, drawer_path), the longest of a slug's: text, tokens, hash, path and time are theirs, other columns stay.
    The text index is derived: write it anew (fts.write_index) or search the table."""
    one = Window.partitionBy("slug").orderBy(F.char_length("clsc").desc(), "clsc")
    n = new.withColumn("_r", F.row_number().over(one)).where("_r = 1").select(F.col("slug").alias("_slug"), F.col("clsc").alias("_clsc"), F.col("drawer_path").alias("_path"))
    j, hit = radar.join(n, radar["slug"] == n["_slug"], "full"), F.col("_slug").isNotNull()
    put = {"slug": F.col("_slug"), "clsc": F.col("_clsc"), "tokens": tokens(F.col("_clsc")), "drawer_path": F.col("_path"), "source_hash": F.sha2(F.encode("_clsc", "utf-8"), 256), "encoded_at": F.lit(now)}
    return j.select(*[F.when(hit, put[c].cast(radar.schema[c].dataType)).otherwise(radar[c]).alias(c) if c in put else radar[c] for c in radar.columns])


def category_report(encoded: DataFrame, category: str = "group") -> DataFrame:
    """(category, n, tokens, short_tokens, ratio) of encoded notes (raw_tokens, skeleton_tokens); the row with a null category is the whole."""
    g = encoded.rollup(category).agg(F.grouping(category).alias("_all"), F.count("*").alias("n"), F.sum("raw_tokens").alias("tokens"), F.sum("skeleton_tokens").alias("short_tokens"))
    name = F.when(F.col("_all") == 0, F.coalesce(F.col(category).cast("string"), F.lit("unknown")))
    return g.select(name.alias("category"), "n", "tokens", "short_tokens", F.when(F.col("tokens") > 0, F.round(F.col("short_tokens") / F.col("tokens"), 4)).otherwise(1.0).alias("ratio"))


def backfill(sources: dict[str, DataFrame], seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new messages, report) of several sources at once: new ones by key, with the source they came from first (in the order given); the report has
    a row (source, scanned, inserted) for each. Neither is written: a dry run reads the report only."""
    parts = None
    for i, (name, d) in enumerate(sources.items()):
        d = message_key(d).withColumn("from_source", F.lit(name)).withColumn("_o", F.lit(i))
        parts = d if parts is None else parts.unionByName(d)
    first = Window.partitionBy("key").orderBy("_o", "ts", "text")
    new = parts.where("text is not null and text <> ''").join(seen.select("key"), "key", "left_anti").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_o")
    names = parts.sparkSession.createDataFrame([(n,) for n in sources], "source string")
    scanned, inserted = (x.groupBy(F.col("from_source").alias("source")).agg(F.count("*").alias(c)) for x, c in ((parts, "scanned"), (new, "inserted")))
    report = names.join(scanned, "source", "left").join(inserted, "source", "left").select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("scanned", "inserted")])
    return new, report


def embed_new(df: DataFrame, key: str, text: str, stored: DataFrame | None, embed: Callable[[list[str]], list[list[float]]], force: bool = False, batch: int = 32) -> DataFrame:
    """(key, embedding, fp) of rows not in stored (all of them with force): embed gets `batch` texts at a time, fingerprints follow. Append or, with
    force, replace."""
    from . import vector

    rows = df if stored is None or force else df.join(stored.select(key), key, "left_anti")
    kind = df.schema[key].dataType.simpleString()

    @F.arrow_udf("array<float>")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.float32())
        for s in it:  # texts and vectors are Python's objects only while their batch is embedded
            yield pa.concat_arrays([pa.array([None if v is None else [float(x) for x in v] for v in embed(s.slice(a, batch).to_pylist())], kind) for a in range(0, len(s), batch)] or [pa.array([], kind)])

    d = rows.select(F.col(key).cast(kind).alias(key), run(F.coalesce(F.col(text), F.lit(""))).alias("embedding"))
    return vector.fingerprints(d, "embedding")


def record_access(radar: DataFrame, accesses: DataFrame) -> DataFrame:
    """radar with access_count, last_accessed and status after access events (slug, ts); archived rows become active."""
    a = accesses.groupBy("slug").agg(F.count("*").alias("_n"), F.max("ts").alias("_t"))
    j = radar.join(a, "slug", "left")
    return j.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).withColumn("last_accessed", F.greatest("last_accessed", "_t")).withColumn("status", F.when(F.col("_n").isNotNull() & (F.col("status") == "archived"), "active").otherwise(F.col("status"))).drop("_n", "_t")


def stale_after(stale: DataFrame, accesses: DataFrame) -> DataFrame:
    """Stale candidates left after accesses: cold and archived ones that were read are dropped."""
    hit = accesses.select("slug").distinct().withColumn("_hit", F.lit(True))
    return stale.join(hit, "slug", "left").where(~(F.coalesce("_hit", F.lit(False)) & F.col("reason").isin("cold", "archived"))).drop("_hit")


def usage(hits: DataFrame, short: str, full: str, by: list[str]) -> DataFrame:
    """Per group: hits, tokens of short and full texts, percent saved to one place (null if there are no full tokens)."""
    g = hits.groupBy(*by).agg(F.count("*").alias("hits"), F.sum(tokens(F.col(short))).alias("short_tokens"), F.sum(tokens(F.col(full))).alias("full_tokens"))
    return g.withColumn("saved_pct", F.when(F.col("full_tokens") > 0, F.bround((1 - F.col("short_tokens") / F.col("full_tokens")) * 100, 1)))


def check_reports(df: DataFrame, now: str, base: str = REPORTS) -> DataFrame:
    """Reports (title, content, group, bot, ttl_days) as files: code, name, relative_path, size_bytes, tokens_estimate, expires_at and text (front matter
    and content). now is UTC (yyyy-MM-ddTHH:mm:ss). The title is cut at its limit, a bot that isn't plain is unknown, names that clash within
    a group get -dupN; without ttl_days a report never expires. Rejected ones have no text."""
    when = F.to_timestamp(F.lit(now))
    title = F.substring("title", 1, MAX_TITLE)
    code = F.when(F.col("title").isNull(), "MISSING_TITLE").when(F.octet_length("content") > MAX_REPORT, "CONTENT_TOO_LARGE").when(~F.coalesce(F.col("group"), F.lit("")).rlike("^[a-z0-9-]+$"), "INVALID_GROUP").otherwise("OK")
    clean = F.substring(F.regexp_replace(F.regexp_replace(title, r"(?U)[^\w\x{4E00}-\x{9FFF}-]+", "-"), "^-+|-+$", ""), 1, 50)
    d = df.withColumn("code", code).withColumn("title", title).withColumn("content", F.coalesce("content", F.lit("")))
    d = d.withColumn("slug", F.concat(F.date_format(when, "yyyy-MM-dd-HHmm"), F.lit("-"), clean))
    n = F.row_number().over(Window.partitionBy("group", "slug", "code").orderBy("content"))
    d = d.withColumn("_n", n).withColumn("code", F.when((F.col("code") == "OK") & (F.col("_n") > MAX_NAMES + 1), "SLUG_COLLISION").otherwise(F.col("code")))
    d = d.withColumn("name", F.when(F.col("_n") > 1, F.concat("slug", F.lit("-dup"), (F.col("_n") - 1).cast("string"))).otherwise(F.col("slug")))
    bot = F.when(F.coalesce("bot", F.lit("")).rlike("^[a-z0-9_-]+$"), F.col("bot")).otherwise("unknown") if "bot" in df.columns else F.lit("unknown")
    later = F.date_format(when + F.make_interval(days=F.col("ttl_days").cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    d = d.withColumn("bot", bot).withColumn("size_bytes", F.octet_length("content").cast("long")).withColumn("tokens_estimate", tokens(F.col("content"))).withColumn("expires_at", later)
    created = F.date_format(when + F.expr("interval 8 hours"), "yyyy-MM-dd'T'HH:mm:ss'+08:00'")
    quoted = F.replace(F.replace(F.replace(F.replace("title", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    front = F.concat(
        F.lit("---\ntype: subagent-report\ncreated: "), created, F.lit("\nbot: "), "bot", F.lit("\ngroup: "), "group", F.lit('\ntitle: "'), quoted, F.lit('"\nsize_bytes: '), F.col("size_bytes").cast("string"), F.lit("\ntokens_estimate: "), F.col("tokens_estimate").cast("string"),
        F.lit("\nexpires_at: "), F.coalesce(F.concat(F.lit('"'), "expires_at", F.lit('"')), F.lit("null")), F.lit("\nsource: report_store\n---\n\n"),
    )
    d = d.withColumn("relative_path", F.concat_ws("/", F.lit(base), "group", F.concat("name", F.lit(".md"))))
    return d.withColumn("text", F.when(F.col("code") == "OK", F.concat(front, "content"))).drop("_n")


def write_reports(reports: DataFrame, path: str) -> None:
    """Accepted reports as text, a directory by group and name; read them back as whole files."""
    reports.where("code = 'OK'").select("group", "name", F.col("text").alias("value")).repartition("group", "name").write.mode("append").partitionBy("group", "name").text(path)


def unexpired(reports: DataFrame, now: str) -> DataFrame:
    """Reports that don't expire or expire at now (UTC, as expires_at is written) or later."""
    return reports.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def make_tasks(df: DataFrame, assignees: list[str], now: str) -> DataFrame:
    """Tasks (title, description, assigned_to, assigned_by, priority, acceptance_criteria) with code, task_id, filename, status, history and task, the
    JSON document. now is UTC (yyyy-MM-ddTHH:mm:ss); the four digits that set ids apart come from title, assignee and description."""
    c = lambda n, default: F.coalesce(F.col(n), default) if n in df.columns else default
    priority, by = c("priority", F.lit("medium")), c("assigned_by", F.lit("mcp"))
    code = F.when(~F.lower("assigned_to").isin([a.lower() for a in assignees]), "INVALID_ASSIGNEE").when(~priority.isin(*PRIORITIES), "INVALID_PRIORITY").otherwise("OK")
    dashed = F.translate(F.lower("title"), " /_", "---")
    slug = F.regexp_replace(F.substring(F.regexp_replace(dashed, r"[^\p{L}\p{N}-]", ""), 1, 40), "^-+|-+$", "")
    mark = F.substring(F.md5(F.encode(F.concat_ws("|", "title", "assigned_to", c("description", F.lit(""))), "utf-8")), 1, 4)
    d = df.withColumn("code", F.coalesce(code, F.lit("INVALID_ASSIGNEE"))).withColumn("task_id", F.concat(F.date_format(F.to_timestamp(F.lit(now)), "yyyyMMdd-HHmmss"), F.lit("-"), mark))
    d = d.withColumn("filename", F.concat("task_id", F.lit("-"), slug, F.lit(".json"))).withColumn("status", F.lit(TASK_STATES[0]))
    d = d.withColumn("history", F.array(F.struct(F.lit(TASK_STATES[0]).alias("status"), F.lit(now).alias("at"), by.alias("by"))))
    spec = F.struct(c("description", F.lit("")).alias("description"), c("acceptance_criteria", F.array().cast("array<string>")).alias("acceptance_criteria"))
    doc = F.struct("task_id", "title", "assigned_to", by.alias("assigned_by"), "status", priority.alias("priority"), F.lit(now).alias("created_at"), spec.alias("spec"), "history", F.lit(" → ".join(TASK_STATES)).alias("flow"))
    return d.withColumn("task", F.to_json(doc))


def write_tasks(tasks: DataFrame, path: str) -> None:
    """Accepted tasks as JSON, a directory by status; the writer's commit is atomic."""
    tasks.where("code = 'OK'").select("status", F.col("task").alias("value")).write.mode("append").partitionBy("status").text(path)


def advance(tasks: DataFrame, to: str, now: str, by: str = "mcp") -> DataFrame:
    """Tasks moved to the status that follows theirs; others stay."""
    before = TASK_STATES[TASK_STATES.index(to) - 1]
    go = F.col("status") == before
    return tasks.withColumn("history", F.when(go, F.concat("history", F.array(F.struct(F.lit(to).alias("status"), F.lit(now).alias("at"), F.lit(by).alias("by"))))).otherwise(F.col("history"))).withColumn("status", F.when(go, F.lit(to)).otherwise(F.col("status")))


#: Words of procedural content, and tags of index lines that say so; such entries are worth a summary.
PROCEDURAL = r"(?iuU)\b(SOP|spec|指引|CLAUDE|README|task|procedure|步驟|流程|規範)\b"
PROCEDURAL_TAG = r"(?iuU)TAG:[^|\n]*\b(sop|spec|guide|procedure)\b"


def wants_summary(text: Column, short: Column | None = None) -> Column:
    """Whether the text has a word of procedure or the index line such a tag."""
    hit = F.coalesce(text, F.lit("")).rlike(PROCEDURAL)
    return hit if short is None else hit | F.coalesce(short, F.lit("")).rlike(PROCEDURAL_TAG)


def write_summaries(radar: DataFrame, text: str, summarise: Callable[[Column], Column], short: str | None = None) -> DataFrame:
    """radar with summary filled by a caller's Column function (of the first 3000 characters) where the trigger fires."""
    old = F.col("summary") if "summary" in radar.columns else F.lit(None).cast("string")
    hit = wants_summary(F.col(text), F.col(short) if short else None)
    return radar.withColumn("summary", F.when(hit, summarise(F.substring(text, 1, 3000))).otherwise(old))
