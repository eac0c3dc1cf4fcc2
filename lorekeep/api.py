"""The ten search and write operations as functions of DataFrames. Searches are pure: they record no access."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import has_cjk, snippet, valid_slug
from .operators import dialect, fts, ingest, kg, postings, rank, vector
from .plans.boolean import SearchSyntaxError, parse, phrases
from .sources import files


@dataclass(frozen=True)
class Options:
    """Gates and compatibility switches; defaults as documented."""

    knn: bool = False
    embed: Callable[[str], list[float]] | None = None  # vector of a query; with knn it stands in for vector_of
    expand: Callable[[str], list[str]] | None = None
    rerank: Callable[[list[str]], str] | None = None
    delegate: Callable[[str, int], str] | None = None  # output of a vault search delegate; an error falls back
    routing: str = "intended"  # or compat: every ASCII letter or digit counts as CJK
    boost: str = "compat"  # or multiply
    bot_filter: str = "first"  # or compat: neighbours are cut before the bot is looked at
    recall: int = 20
    variants: int = 3
    index: str | None = None  # a positional index (operators.postings): of slug and clsc for radar_search, of text for messages_search without a bot


#: The intended ideograph class, and what a misread range made of it.
_CJK = re.compile("[\u4e00-\u9fff\u3400-\u4dbf\U00020000-\U0002a6df]")
_CJK_COMPAT = re.compile("[\u4e00-\u9fff\u3400-\u4dbf\u20000-\u2a6df]")
#: Rows each list of a message search brings to the fusion.
MESSAGE_RECALL = 50


def _vector(query: str, options: Options, given: list[float] | None) -> list[float] | None:
    return (given or (options.embed(query) if options.embed else None)) if options.knn else None


def _recall(index: str | None) -> Callable:
    """Keyword recall by a scan of the texts, or from an index's postings; substrings where that finds nothing."""

    def scan(df: DataFrame, terms: list[str], key: str, text: str, k: int) -> DataFrame:
        return fts.recall_keywords(df, terms, ["slug", "clsc"], key, text, k)

    def look_up(df: DataFrame, terms: list[str], key: str, text: str, k: int) -> DataFrame:
        first = fts.held(postings.search(df.sparkSession, index, terms, k))
        return fts.recall_substrings(df, terms, key, text, k) if first.isEmpty() else first.withColumnRenamed("key", key)

    return look_up if index else scan


def radar_search(
    radar: DataFrame, query: str, limit: int = 5, options: Options = Options(), vectors: DataFrame | None = None, vector_of: list[float] | None = None, messages: DataFrame | None = None, message_vectors: DataFrame | None = None
) -> DataFrame:
    """Hybrid search over radar (slug, clsc, access_count, status): keyword recall, neighbours among index lines and among messages, fusion,
    rerank, boost. (slug, clsc, sources, ..., final_rank); a message's slug is chat:message."""
    n, lists, q = max(options.recall, limit), [], _vector(query, options, vector_of)
    asked = [query, *[v for v in options.expand(query) if v != query][: options.variants]] if options.expand else [query]
    for v in asked:
        cjk = (_CJK_COMPAT if options.routing == "compat" else _CJK).search(v)
        find = fts.recall_substrings if cjk else _recall(options.index)
        lists.append(rank.ranked(find(radar, v.split(), "slug", "clsc", n), "slug", "fts", len(lists)))
    if len(lists) > 1:
        lists = [rank.ranked(rank.fused(lists, n), "slug", "fts", 0)]
    texts = radar.select("slug", "clsc")
    if q is not None and vectors is not None:
        lists.append(rank.ranked(vector.knn(vectors, "slug", "embedding", q, n), "slug", "sem", 1))
    if q is not None and messages is not None and message_vectors is not None:
        near = fts.held(vector.message_neighbours(message_vectors, messages, q, n))
        lists.append(rank.ranked(near, "slug", "msg", 2))
        texts = texts.unionByName(near.select("slug", "clsc"))
    hits = rank.fused(lists, n if options.rerank else limit)
    if options.rerank:
        rows = hits.join(texts, "slug").orderBy("rank").limit(n).collect()  # at most n short lines
        hits = rank.apply_permutation(hits, rank.parse_permutation(options.rerank([r["clsc"] for r in rows]), len(rows))).where(F.col("rank") <= limit)
    out = rank.boosted(hits, radar, mode=options.boost)
    return out.join(texts, "slug").orderBy("final_rank")


def radar_search_batch(radar: DataFrame, queries: DataFrame, index: str, limit: int = 5, options: Options = Options(), variants: DataFrame | None = None, vectors: DataFrame | None = None, vector_of: DataFrame | None = None) -> DataFrame:
    """radar_search for a table of queries (query_id, query): (query_id, slug, clsc, sources, rank, boost, final_rank), in one lazy plan.

    variants (query_id, query, list_id from 1) stand in for options.expand, vector_of (query_id, q) for options.embed; there is no rerank. Keywords are looked up
    in the index of slug and clsc; queries that find nothing there, and those with ideographs, count substrings. A query's words are split at white space."""
    by = ("query_id",)
    n = max(options.recall, limit)
    q = queries.select("query_id", F.lit(0).alias("list_id"), "query")
    if variants is not None:
        own = queries.select("query_id", F.col("query").alias("_own"))
        q = q.unionByName(variants.join(own, "query_id").where((F.col("query") != F.col("_own")) & (F.col("list_id") <= options.variants)).select("query_id", "list_id", "query"))
    words = F.filter(F.split("query", r"\s+"), lambda w: w != "")
    q = q.select(F.struct("query_id", "list_id").alias("one"), words.alias("words"), has_cjk(F.coalesce("query", F.lit("")), options.routing == "compat").alias("cjk"))
    asked = q.select("one", "cjk", F.explode("words").alias("word"))
    keyed = postings.search_batch(radar.sparkSession, index, asked.where("not cjk").select(F.col("one").alias("query_id"), F.col("word").alias("term")), n)
    keyed = keyed.select(F.col("query_id").alias("one"), F.col("key").alias("slug"), "rank")
    rest = asked.join(keyed.select("one").distinct(), "one", "left_anti").groupBy("one", "word").agg(F.count("*").alias("times"))
    near = Window.partitionBy("one").orderBy(F.col("match_count").desc(), "slug")
    counted = _substrings(radar, rest, index).groupBy("one", "slug").agg(F.sum("times").alias("match_count"))
    counted = counted.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= n).select("one", "slug", "rank")
    lists = keyed.unionByName(counted).select("one.query_id", "one.list_id", F.lit("fts").alias("source"), F.col("rank").cast("long").alias("rank"), "slug")
    parts = [rank.ranked(rank.fused([lists], n, by=by), "slug", "fts", 0, by)]
    if options.knn and vectors is not None and vector_of is not None:
        parts.append(rank.ranked(vector.knn_batch(vectors, "slug", "embedding", vector_of, n, skip_self=False), "slug", "sem", 1, by))
    out = rank.boosted(rank.fused(parts, limit, by=by), radar, mode=options.boost, by=by)
    return radar.select("slug", "clsc").join(F.broadcast(out), "slug").select(*out.columns, "clsc")  # limit rows of each query; texts stay where they are


def _substrings(radar: DataFrame, words: DataFrame, index: str) -> DataFrame:
    """words (one, word, times) with the slug of each row whose text holds the word, as it is written. Words of three characters and more come
    from the index, whose hits are verified in the text; shorter ones are joined with the texts' own short strings. No text meets every word."""
    texts = radar.select("slug", F.coalesce("clsc", F.lit("")).alias("clsc"))
    long_ = words.where(F.char_length("word") >= 3).withColumn("term", F.lower("word"))
    hits = postings.found(radar.sparkSession, index, long_.select("term").distinct()).select("term", F.col("key").alias("slug"))
    some = long_.select(F.lit(True).alias("_some")).limit(1)  # where no such word is left, no text is shuffled
    sure = long_.join(hits, "term").join(texts.crossJoin(F.broadcast(some)), "slug").where(F.contains("clsc", F.col("word"))).select("one", "word", "times", "slug")
    pairs = F.regexp_extract_all("clsc", F.lit("(?s)(?=(..))"), F.lit(1))
    short = texts.select("slug", F.explode(F.array_distinct(F.concat(F.filter(F.split("clsc", ""), lambda x: x != ""), pairs))).alias("word"))
    return sure.unionByName(words.where(F.char_length("word") < 3).join(short, "word").select("one", "word", "times", "slug"))


def _messages_by_index(m: DataFrame, query: str, limit: int, words: list[str], index: str) -> DataFrame:
    """fts.search_messages with its first stage from an index of text by slug."""
    try:
        first = fts.held(postings.search_boolean(m.sparkSession, index, query, ["text"], limit).withColumnRenamed("key", "slug"))
        if not first.isEmpty():
            rows = m.join(F.broadcast(first), "slug")  # limit rows
            return rows.withColumn("snippet", F.coalesce(*[snippet(F.col("text"), p) for p in phrases(parse(query))], F.substring("text", 1, 120)))
    except SearchSyntaxError:
        pass
    return fts.search_substrings(m, "text", words, [F.col("ts").desc(), F.col("slug")], limit)


def messages_search(messages: DataFrame, query: str, limit: int = 10, bot: str | None = None, options: Options = Options(), vectors: DataFrame | None = None, vector_of: list[float] | None = None) -> DataFrame:
    """Messages by keywords (any of them, unless the query has operators of its own) and, with knn, by neighbours among vectors (slug, embedding):
    the first of both lists fused. (slug, bot_name, ts, source, chat_id, user, message_id, snippet, rank)."""
    m = messages.withColumn("slug", F.concat_ws(":", "chat_id", "message_id"))
    words = query.split()
    plain = len(words) > 1 and not re.search(r'["():*]|\b(AND|OR|NOT|NEAR)\b', query)
    asked = " OR ".join('"' + w + '"' for w in words) if plain else query
    keep = ["slug", "bot_name", "ts", "source", "chat_id", "user", "message_id", "snippet", "rank"]
    q = _vector(query, options, vector_of)
    most = MESSAGE_RECALL if q is not None else limit
    hits = _messages_by_index(m, asked, most, words, options.index) if options.index and not bot else fts.search_messages(m, asked, most, bot, words=words)
    if q is None or vectors is None:
        return hits.select(*keep)
    first = options.bot_filter == "first"
    of = vectors.join(m.where(F.col("bot_name") == bot).select("slug"), "slug", "left_semi") if bot and first else vectors
    near = vector.knn(of, "slug", "embedding", q, MESSAGE_RECALL, "l2")
    meta = m.where(F.col("bot_name") == bot) if bot else m
    near = vector.with_meta(near.select("slug", "rank"), meta.withColumn("snippet", F.substring("text", 1, 200)), "slug")
    merged = rank.fused([rank.ranked(hits, "slug", "bm25", 0), rank.ranked(near, "slug", "knn", 1)], limit)
    both = hits.select(*keep[:-1]).withColumn("_o", F.lit(0)).unionByName(near.select(*keep[:-1]).withColumn("_o", F.lit(1)))
    rows = both.groupBy("slug").agg(F.min_by(F.struct(*keep[1:-1]), "_o").alias("r")).select("slug", "r.*")
    return merged.select("slug", "rank").join(rows, "slug").select(*keep).orderBy("rank")


def ocean_search(vault: DataFrame, query: str, limit: int = 10, options: Options = Options()) -> DataFrame:
    """Notes of the vault (path, body): by the delegate if there is one and it works, else by any word of the query."""
    if options.delegate and query.strip():
        try:
            out = vault.sparkSession.createDataFrame([(options.delegate(query, limit),)], "output string")
            return fts.delegate_results(out, "output").where(F.col("rank") <= limit)
        except (OSError, RuntimeError, ValueError):  # what a delegate process may fail with
            pass
    return fts.search_notes(vault, query, limit)


def search(radar: DataFrame, messages: DataFrame, query: str, source: str = "all", limit: int = 10, vault: DataFrame | None = None) -> DataFrame:
    """One list over sources; 'all' is radar and messages. A source without a table, or that doesn't exist, gives no rows."""
    parts = [radar.sparkSession.createDataFrame([], "title string, excerpt string, source string, ref string, score_rank int")]
    row = lambda d, title, excerpt, name, ref, at: d.select(F.col(title).alias("title"), F.col(excerpt).alias("excerpt"), F.lit(name).alias("source"), F.col(ref).alias("ref"), F.col(at).cast("int").alias("score_rank"))
    if query.strip() and source in ("all", "radar"):
        parts.append(row(radar_search(radar, query, limit), "slug", "clsc", "radar", "slug", "final_rank"))
    if query.strip() and source in ("all", "messages"):
        parts.append(row(messages_search(messages, query, limit), "slug", "snippet", "messages", "slug", "rank"))
    if query.strip() and source == "ocean" and vault is not None:
        parts.append(row(ocean_search(vault, query, limit), "title", "excerpt", "ocean", "path", "rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rank.unified(out, limit)


def seabed_get(radar: DataFrame, slug: str, mode: str = "sonar", drawers: DataFrame | None = None) -> DataFrame:
    """One row (slug, text): the short text (sonar), or the full one (verbatim): column content, else the drawer (slug, body), else the short text.
    Slugs outside the white list give no row."""
    d = radar.where((F.col("slug") == slug) & valid_slug(F.lit(slug)))
    if mode != "verbatim":
        return d.select("slug", F.col("clsc").alias("text"))
    d = d.join(drawers.select("slug", "body"), "slug", "left") if drawers is not None else d.withColumn("body", F.lit(None).cast("string"))
    return d.select("slug", F.coalesce(*[F.col(c) for c in ("content", "body", "clsc") if c in d.columns]).alias("text"))


def wiki_summary(bundle: DataFrame, drawers: DataFrame, slugs: DataFrame, mode: str = "verbatim", narrate: Callable[[Column], Column] | None = None) -> DataFrame:
    """(slug, text) of slugs: the drawer's text (verbatim), the index line (skeleton) or that line as prose (narrative; narrate replaces the
    template). Lines go by their header's 20 characters; where there is none, the drawer's text; where that is missing too, a note says so."""
    p = bundle.select(F.col("line"), dialect.parse_skeleton(F.col("line")).alias("p"))
    lines = p.groupBy(F.col("p.slug").alias("_s")).agg(F.min("line").alias("line"))
    d = slugs.select("slug").distinct().join(drawers.select("slug", "body"), "slug", "left").join(lines, F.substring("slug", 1, 20) == F.col("_s"), "left")
    parsed = dialect.parse_skeleton(F.col("line"))
    text = {"skeleton": F.col("line"), "narrative": narrate(F.col("line")) if narrate else F.when(F.col("line").isNotNull(), dialect.narrate(parsed))}.get(mode, F.lit(None).cast("string"))
    return d.select("slug", F.coalesce(text, "body", F.concat(F.lit("[drawer not found for "), "slug", F.lit("]"))).alias("text"))


def register_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """aliases (slug, path) after new ones: of a slug's paths the new one stays."""
    return kg.upsert_latest(aliases, new.groupBy("slug").agg(F.max("path").alias("path")), "slug")


kg_query = kg.query_entity
skill_list = files.skills
skill_get = files.skill
report_store = ingest.check_reports
task_create = ingest.make_tasks


def ingest_file(spark: SparkSession, path: str, wanted: list[str] | None = None, converter: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Files below path as validated documents; see sources.files.documents and ingest.documents_of."""
    return ingest.documents_of(files.documents(spark, path, wanted, converter))
