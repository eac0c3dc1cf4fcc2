"""Sources and sinks: inbox JSON, relay logs, memory notes, vault notes, seabed day files, QA and IR corpora, HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Directories and names that are no notes; layout of relay and seabed lines.
SKIP_DIRS = r"/(\.stversions|\.obsidian|\.trash|_drafts|_archive)/|sync-conflict|/\.[^/]*$"
RELAY = r"^\[([^\]]+)\] (.+?) → (.+?) \((.+?):(.*?)\): (.*)$"
SEABED = r"^- (\d{2}:\d{2}) \[([^\]]*)\] (.*) <!-- mid:(\S+) -->$"
INBOX = "params struct<content: string, meta: struct<source: string, chat_id: string, user: string, message_id: string, ts: string>>"
MESSAGE = ["bot_name", "ts", "source", "chat_id", "user", "message_id", "text"]


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified, body) of each file below path."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("body"))


def inbox(files: DataFrame) -> DataFrame:
    """Messages of inbox files (path, body); what is no JSON gives no message."""
    j = files.withColumn("j", F.from_json("body", INBOX)).where("j.params is not null")
    m = F.col("j.params.meta")
    bot = F.regexp_extract("path", r"state/([^/]+)/", 1)
    return j.select(bot.alias("bot_name"), m["ts"].alias("ts"), F.coalesce(m["source"], F.lit("telegram")).alias("source"), m["chat_id"].alias("chat_id"), m["user"].alias("user"), m["message_id"].alias("message_id"), F.col("j.params.content").alias("text"))


def relay_log(files: DataFrame, bot: str) -> DataFrame:
    """Messages of relay logs (path, body). Lines without a header continue the last message; lines before the first header are
    dropped; message_id is the header's line number. Each file is one record, so sessions form within it."""
    lines = files.select("path", F.posexplode(F.split("body", r"\r?\n")).alias("no", "line")).withColumn("head", F.col("line").rlike(RELAY))
    w = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    s = lines.withColumn("n", F.sum(F.col("head").cast("int")).over(w)).where("n > 0")
    g = s.groupBy("path", "n").agg(F.min("no").alias("no"), F.array_sort(F.collect_list(F.struct("no", "line"))).alias("ls"))
    first, rest = F.col("ls")[0]["line"], F.transform(F.slice("ls", F.lit(2), F.greatest(F.size("ls") - 1, F.lit(0))), lambda x: x["line"])
    part = lambda i: F.regexp_extract(first, RELAY, i)
    text = F.rtrim(F.array_join(F.concat(F.array(part(6)), rest), "\n"), F.lit("\n"))
    return g.select(F.lit(bot).alias("bot_name"), part(1).alias("ts"), F.lit("relay").alias("source"), part(5).alias("chat_id"), part(2).alias("user"), (F.col("no") + 1).cast("string").alias("message_id"), text.alias("text"))


def project_bot(name):
    """Bot of a project directory: what follows the last 'bots-', 'shared' for the bots directory itself, else the last part."""
    return F.when(name.endswith("claude-bots"), "shared").when(name.contains("bots-"), F.substring_index(name, "bots-", -1)).otherwise(F.substring_index(name, "-", -1))


def memory_notes(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    project = F.regexp_extract("path", r"projects/([^/]+)/", 1)
    return files.select(project_bot(project).alias("bot_name"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit("memory").alias("source"), F.lit("").alias("chat_id"), F.lit("").alias("user"), F.col("path").alias("message_id"), F.concat(name, F.lit("\n"), "body").alias("text"))


def vault(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Notes (*.md) without noise files; with a limit the first ones by path."""
    d = files.where(~F.col("path").rlike(SKIP_DIRS) & F.col("path").endswith(".md"))
    return d.orderBy("path").limit(limit) if limit else d


def drawers(slugs: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, path, body) of slugs: the file {slug}.md, the first by path if several directories have one; null where none has."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.md$", "")
    first = Window.partitionBy("slug").orderBy("path")
    f = files.where(F.col("path").endswith(".md")).withColumn("slug", name).withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return slugs.select("slug").distinct().join(f.select("slug", "path", "body"), "slug", "left")


def note(files: DataFrame) -> DataFrame:
    """(path, slug, front, title, plain, raw_tokens, tags) of notes (path, body). Title: the body's first heading, else the file name;
    so is a title over 60 characters that holds a colon."""
    front = F.regexp_extract("body", r"(?s)\A---\n(.*?)\n---", 1)
    body = F.regexp_replace("body", r"(?s)\A---\n.*?\n---\n?", "")
    pairs = F.transform(F.filter(F.split(front, "\n"), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    last = F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    h1 = F.trim(F.regexp_extract(body, r"(?m)^#\s+(.+)", 1))
    title = F.when((h1 == "") | (h1.contains(":") & (F.char_length(h1) > 60)), stem).otherwise(h1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(body, r"[#*`\[\]()>]", ""), r"\n+", " "))
    d = files.select("path", stem.alias("slug"), last.alias("front"), title.alias("title"), plain.alias("plain"), F.floor(F.char_length("body") / 4).cast("long").alias("raw_tokens"))
    return d.withColumn("tags", F.slice(F.filter(F.split(F.replace(F.coalesce(F.try_element_at("front", F.lit("tags")), F.lit("")), F.lit(" "), F.lit("")), ","), lambda t: t != ""), 1, 3))


def seabed_lines(messages: DataFrame) -> DataFrame:
    """(month, day, chat_id, message_id, ts, line): lines of day files, one per message id; without chat or text none."""
    ok = F.coalesce(F.col("chat_id"), F.lit("")).isin("", "system", "self") | (F.trim(F.coalesce("text", F.lit(""))) == "")
    one = Window.partitionBy("chat_id", "message_id").orderBy("ts", "text")
    d = messages.where(~ok).withColumn("_r", F.row_number().over(one)).where("_r = 1")
    line = F.concat(F.lit("- "), F.substring("ts", 12, 5), F.lit(" ["), "user", F.lit("] "), F.regexp_replace("text", r"\s*\n\s*", " "), F.lit(" <!-- mid:"), "message_id", F.lit(" -->"))
    return d.select(F.substring("ts", 1, 7).alias("month"), F.substring("ts", 1, 10).alias("day"), "chat_id", "message_id", "ts", line.alias("line"))


def write_seabed(messages: DataFrame, path: str) -> None:
    """Day files below month directories; lines of a day and chat in order of time."""
    d = seabed_lines(messages)
    d.repartition("month", "day", "chat_id").sortWithinPartitions("month", "day", "chat_id", "ts", "message_id").select("month", "day", F.col("chat_id").alias("chat"), F.col("line").alias("value")).write.partitionBy("month", "day", "chat").text(path)


def parse_seabed(lines: DataFrame) -> DataFrame:
    """Messages of seabed lines (day, chat_id, line); other lines are ignored."""
    p = lambda i: F.regexp_extract("line", SEABED, i)
    return lines.where(F.col("line").rlike(SEABED)).select(F.concat("day", F.lit("T"), p(1)).alias("ts"), "chat_id", p(2).alias("user"), p(4).alias("message_id"), p(3).alias("text"))


def coverage(stored: DataFrame, known: DataFrame) -> DataFrame:
    """One row: known messages, those missing from stored, percent covered."""
    k = known.select("chat_id", "message_id").distinct()
    hit = k.join(stored.select("chat_id", "message_id").distinct().withColumn("_hit", F.lit(1)), ["chat_id", "message_id"], "left")
    return hit.agg(F.count("*").alias("known"), F.count_if(F.col("_hit").isNull()).alias("missing"), F.round(100.0 * F.count("_hit") / F.greatest(F.count("*"), F.lit(1)), 2).alias("covered_pct"))


def qa_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(contexts, questions) of nested question-answering JSON."""
    schema = "data array<struct<title: string, paragraphs: array<struct<id: string, context: string, qas: array<struct<id: string, question: string, answers: array<struct<text: string, answer_start: long>>>>>>>>"
    p = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("data").alias("d")).select("d.title", F.explode("d.paragraphs").alias("p"))
    q = p.select(F.col("p.id").alias("para_id"), F.explode("p.qas").alias("q")).select("para_id", F.col("q.id").alias("query_id"), "q.question", F.get("q.answers", F.lit(0))["answer_start"].alias("answer_start"))
    return p.select(F.col("p.id").alias("para_id"), "title", F.col("p.context").alias("text")), q


def answer_chunks(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, chunk): the chunk an answer starts in, a range within the paragraph's equi-join."""
    return questions.join(chunks, "para_id").where("start <= answer_start and answer_start < end").select("query_id", "para_id", "chunk")


def ir_corpus(spark: SparkSession, corpus: str, queries: str, qrels: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = spark.read.schema("_id string, title string, text string").json(corpus)
    asked = spark.read.schema("_id string, text string").json(queries)
    rel = spark.read.csv(qrels, sep="\t", header=True, schema="query_id string, doc_id string, score int").where("score >= 1")
    return docs, asked, rel


def bundle(path: str, spark: SparkSession) -> DataFrame:
    """(group, line) of index bundles: files wiki-{group}.clsc.md, or directories group={group} as `write_bundle` makes them."""
    d = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("f"))
    name, folder = F.regexp_extract("f", r"/wiki-([^/]*)\.clsc\.md$", 1), F.regexp_extract("f", r"/group=([^/]*)/", 1)
    return d.where(F.col("value").startswith("[") & F.col("value").contains("|")).select(F.when(name != "", name).otherwise(folder).alias("group"), F.col("value").alias("line")).where("group <> ''")


def groups(lines: DataFrame) -> DataFrame:
    """Groups of a bundle's lines, each once."""
    return lines.select("group").distinct().orderBy("group")


def write_bundle(df: DataFrame, path: str) -> None:
    """Appends lines (group, line), a directory for each group."""
    df.select("group", F.col("line").alias("value")).repartition("group").write.mode("append").partitionBy("group").text(path)


def skills(files: DataFrame) -> DataFrame:
    """(name, section, body) of skill files, sorted: {name}/SKILL.md and other sections, plain {name}.md as section SKILL; names of those below
    a pearls directory begin with pearl: and are the files'."""
    pearl, bundle_ = F.col("path").rlike("/pearls?/"), F.regexp_extract("path", r"([^/]+)/(SKILL|USAGE|EXAMPLE)\.md$", 1)
    plain = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.md$", "")
    name = F.when(pearl, F.concat(F.lit("pearl:"), F.when(bundle_ != "", bundle_).otherwise(plain))).when(bundle_ != "", bundle_).otherwise(plain)
    section = F.when(bundle_ != "", F.regexp_extract("path", r"/(SKILL|USAGE|EXAMPLE)\.md$", 1)).otherwise("SKILL")
    return files.where(F.col("path").endswith(".md") & ~F.col("path").rlike(r"/\.[^/]*(/|$)")).select(name.alias("name"), section.alias("section"), "body").dropDuplicates(["name", "section"]).orderBy("name", "section")


def skill(files: DataFrame, name: str, section: str = "SKILL") -> DataFrame:
    """(name, section, body): the section asked for, else SKILL, else all sections in one, SKILL, USAGE, EXAMPLE. Raises on a name that could
    lead elsewhere; no row where there is no such skill."""
    import re

    stem = name.removeprefix("pearl:").removesuffix(".md")
    if not re.fullmatch(r"[A-Za-z0-9_\-.]{1,200}" if name.startswith("pearl:") else r"[A-Za-z0-9_\-]{1,100}", stem) or stem in (".", ".."):
        raise ValueError(f"not a skill's name: {name}")
    d = skills(files).where(F.col("name") == (f"pearl:{stem}" if name.startswith("pearl:") else stem))
    order = F.create_map(*[F.lit(x) for kv in (("SKILL", 0), ("USAGE", 1), ("EXAMPLE", 2)) for x in kv])
    one = F.struct(order[F.col("section")].alias("o"), F.concat(F.lit("# "), "section", F.lit(".md\n\n"), "body").alias("b"))
    g = d.groupBy("name").agg(F.max(F.when(F.col("section") == section.upper(), F.col("body"))).alias("asked"), F.max(F.when(F.col("section") == "SKILL", F.col("body"))).alias("main"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["b"]), "\n\n---\n\n").alias("whole"))
    return g.select("name", F.lit(section.upper()).alias("section"), F.coalesce("asked", "main", "whole").alias("body"))


def csv_table(body):
    """Text of comma-separated lines as a table with bars."""
    rows = F.filter(F.split(body, r"\r?\n"), lambda x: x != "")
    bars = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.split(r, ","), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.split(F.get(rows, F.lit(0)), ","))))
    return F.array_join(F.concat(F.slice(bars, 1, 1), F.array(rule), F.slice(bars, 2, 1 << 30)), "\n")


#: Suffixes that are converted here; others need a caller's converter.
TEXTS, PAGES = ("md", "txt", "json"), ("html", "htm")


def documents(spark: SparkSession, path: str, wanted: list[str] | None = None, converter=None) -> DataFrame:
    """(path, size, format, text, code) of files below path, and of wanted paths that aren't there (FILE_NOT_FOUND). Texts, JSON, CSV and HTML are
    converted here, other formats by converter, a Column function of (content, format); what has none, or none that works
    (null), gets MARKITDOWN_FAIL. Files over the limit aren't read (FILE_TOO_LARGE)."""
    from ..operators.ingest import MAX_FILE

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    fits = F.col("length") <= MAX_FILE
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    raw = F.when(fits, F.make_valid_utf8(F.col("content").cast("string")))
    other = converter(F.col("content"), kind) if converter else F.lit(None).cast("string")
    text = F.when(kind.isin(*TEXTS), raw).when(kind.isin(*PAGES), html_text(raw)).when(kind == "csv", csv_table(raw)).otherwise(F.when(fits, other))
    d = f.select("path", F.col("length").alias("size"), F.when(kind == "", "unknown").otherwise(kind).alias("format"), text.alias("text"))
    d = d.withColumn("code", F.when(F.col("size") > MAX_FILE, "FILE_TOO_LARGE").when(F.col("text").isNull(), "MARKITDOWN_FAIL"))
    if wanted:
        w = spark.createDataFrame([(x,) for x in wanted], "want string")
        gone = w.join(d, F.regexp_replace("path", "^file:/*", "/") == F.regexp_replace("want", "^file:/*", "/"), "left_anti")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("format", "string"), ("text", "string"))]
        d = d.unionByName(gone.select(F.col("want").alias("path"), *none, F.lit("FILE_NOT_FOUND").alias("code")))
    return d


def html_text(html):
    """Text of a page: scripts, styles and tags out, five named references decoded, white space folded."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " "))
