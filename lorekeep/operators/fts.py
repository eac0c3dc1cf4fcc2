"""Full-text search: BM25 over trigram phrases, boolean queries, substring fallbacks, a stored index, batches of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import contains_all, fold, match_count, occurrences, snippet, trigram_length, trigrams
from ..plans.boolean import SearchSyntaxError, parse, phrases, predicate

#: Fixed values of the ranking formula; IDF_FLOOR replaces an idf of 0 or less.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Terms and characters of phrases that one pass over the texts looks for; a batch of more takes several passes.
PASS_TERMS, PASS_CHARS = 100_000, 1_000_000
#: Directories of a stored index.
BUCKETS = 64


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def bm25(df: DataFrame, columns: list[str], terms: list[str], condition: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """Rows that hold a term (or meet condition), with score, negative and smaller for better.

    One pass for the statistics (a single row, joined by broadcast), one for the scores; terms under three characters
    match nothing. known: one row (_n, _avg) of rows and mean length, where df is only part of the table they describe."""
    terms = [t.lower() for t in dict.fromkeys(terms) if len(t) >= 3]
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    length = _total([trigram_length(c) for c in cols])
    tf = [_total([occurrences(F.lower(c), t) for c in cols]) for t in terms]
    hit = [reduce(lambda a, b: a | b, [F.lower(c).contains(t) for c in cols]) for t in terms]
    found = [F.count_if(h).alias(f"_n{i}") for i, h in enumerate(hit)]
    stats = df.agg(F.count("*").alias("_n"), F.avg(length).alias("_avg"), *found) if known is None else known.crossJoin(df.agg(F.count("*").alias("_rows"), *found))  # one row each
    some = df.where(condition if condition is not None else reduce(lambda a, b: a | b, hit, F.lit(False)))
    some = some.select("*", length.alias("_len"), *[t.alias(f"_tf{i}") for i, t in enumerate(tf)]).crossJoin(F.broadcast(stats))  # one row
    parts = [F.lit(0.0)]
    for i in range(len(terms)):
        idf = F.log((F.col("_n") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5))
        norm = F.col(f"_tf{i}") + K1 * (1 - B + B * F.col("_len") / F.col("_avg"))
        parts.append(F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)) * F.col(f"_tf{i}") * (K1 + 1) / norm)
    return some.withColumn("score", -_total(parts)).select(*df.columns, "score")


def top(df: DataFrame, order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """The first `limit` rows with their rank; the window orders those rows only."""
    cut = df.orderBy(*order).limit(limit)
    return cut.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def held(top_rows: DataFrame) -> DataFrame:
    """A result of a known small limit as a local table, so that asking whether it is empty doesn't run the search twice."""
    return top_rows.sparkSession.createDataFrame(top_rows.collect(), top_rows.schema)


def search_boolean(df: DataFrame, query: str, columns: list[str], key: str, limit: int = 10) -> DataFrame:
    node = parse(query)
    return top(bm25(df, columns, phrases(node), predicate(node, columns)), [F.col("score"), F.col(key)], limit)


def search_substrings(df: DataFrame, text: str, terms: list[str], order: list[Column], limit: int = 10) -> DataFrame:
    """Fallback: every term a case-sensitive substring; snippet is '[LIKE] ' and the first 120 characters, score 0. No terms, no rows."""
    hits = df.where(contains_all(F.col(text), terms) if terms else F.lit(False)).withColumn("score", F.lit(0.0)).withColumn("snippet", F.concat(F.lit("[LIKE] "), F.substring(text, 1, 120)))
    return top(hits, order, limit)


def search_messages(df: DataFrame, query: str, limit: int = 10, bot: str | None = None, key: str = "slug", words: list[str] | None = None) -> DataFrame:
    """Two stages: boolean search; substrings, latest first, where that finds nothing or the query doesn't parse. The snippet of the
    first stage is a window about the first phrase that the text holds. words: what the second stage looks for, if not the query's words."""
    df = df.where(F.col("bot_name") == bot) if bot else df
    try:
        first = held(search_boolean(df, query, ["text"], key, limit))
        if not first.isEmpty():
            return first.withColumn("snippet", F.coalesce(*[snippet(F.col("text"), p) for p in phrases(parse(query))], F.substring("text", 1, 120)))
    except SearchSyntaxError:
        pass
    return search_substrings(df, "text", query.split() if words is None else words, [F.col("ts").desc(), F.col(key)], limit)


def recall_keywords(df: DataFrame, terms: list[str], columns: list[str], key: str, text: str, limit: int = 20) -> DataFrame:
    """Keyword recall: BM25 of any term, else substring matches by number of terms matched."""
    if not terms:
        return recall_substrings(df, terms, key, text, limit)
    first = held(top(bm25(df, columns, terms), [F.col("score"), F.col(key)], limit))
    return first if not first.isEmpty() else recall_substrings(df, terms, key, text, limit)


def recall_substrings(df: DataFrame, terms: list[str], key: str, text: str, limit: int = 20) -> DataFrame:
    n = match_count(F.col(text), terms) if terms else F.lit(0)
    return top(df.withColumn("match_count", n).where("match_count >= 1").withColumn("score", F.lit(0.0)), [F.col("match_count").desc(), F.col(key)], limit)


def like(df: DataFrame, text: str, query: str, key: str, limit: int = 20) -> DataFrame:
    return top(df.where(fold(text).contains(query.lower())), [F.col(key)], limit)


def sound_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern, or its literal text where it doesn't compile."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException

    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return pattern
    except (Py4JJavaError, IllegalArgumentException):
        return spark._jvm.java.util.regex.Pattern.quote(pattern)


def search_regex(df: DataFrame, path: str, text: str, terms: list[str], limit: int = 10) -> DataFrame:
    """Regex OR search, ignoring case; the first hit's surroundings (100 characters either way) as excerpt of 200 at most. What doesn't
    compile is searched as it stands."""
    rx = f"(?iu)({sound_pattern(df.sparkSession, '|'.join(terms))})"
    hits = df.where(F.col(text).rlike(rx) if any(terms) else F.lit(False)).withColumn("_at", F.regexp_instr(text, F.lit(rx))).withColumn("_m", F.char_length(F.regexp_extract(text, rx, 1)))
    lo = F.greatest(F.col("_at") - 100, F.lit(1))
    excerpt = F.substring(F.trim(F.substring(F.col(text), lo, F.col("_at") - lo + F.col("_m") + 100)), 1, 200)
    return top(hits.withColumn("excerpt", excerpt).withColumn("score", F.lit(0.0)).withColumn("source", F.lit("bm25")), [F.col(path)], limit).drop("_at", "_m")


def search_notes(notes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Notes (path below the vault, body) that hold a word of the query: slug, content, score, path, source, title, wikilink, excerpt."""
    import re

    hits = search_regex(notes, "path", "body", [re.escape(t) for t in query.split()], limit)
    title = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.md$", "")
    return hits.select(F.regexp_replace(F.lower("path"), r"\.md$", "").alias("slug"), F.col("excerpt").alias("content"), "score", "path", "source", title.alias("title"), F.concat(F.lit("[["), title, F.lit("]]")).alias("wikilink"), "excerpt", "rank")


def search_bridge(messages: DataFrame, bundle: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Messages by boolean search (by LIKE where the query doesn't parse), up to limit, then every bundle line (group, line) that holds the
    query or shares an ideograph with it: (source, slug, text, entities, available)."""
    from ..functions.text import shares_ideograph
    from .dialect import parse_skeleton

    try:
        found = messages.where(predicate(parse(query), ["text"]))
    except SearchSyntaxError:
        found = messages.where(fold("text").contains(query.lower()))
    m = found.orderBy("ts", "chat_id", "message_id").limit(limit)  # the limit is the feature; the order makes it repeatable
    m = m.select(F.lit("fts5").alias("source"), F.lit("").alias("slug"), F.substring("text", 1, 200).alias("text"), F.array().cast("array<string>").alias("entities"), F.lit(False).alias("available"))
    lines = bundle.where(fold("line").contains(query.lower()) | shares_ideograph(F.col("line"), query)).withColumn("p", parse_skeleton(F.col("line")))
    return m.unionByName(lines.select(F.concat(F.lit("closet:"), "group").alias("source"), F.col("p.slug").alias("slug"), F.col("line").alias("text"), F.col("p.entities").alias("entities"), F.lit(True).alias("available")))


def parse_delegate(output: Column) -> Column:
    """Array of (score, slug, content) of a search delegate's output: blocks `[score] slug -- content`, content up to the next block and
    2000 characters long at most."""
    head = r"\[(\d+(?:\.\d+)?)\]\s+(\S+)\s+--\s*"
    scores, slugs = (F.regexp_extract_all(output, F.lit(head), F.lit(i)) for i in (1, 2))
    rest = F.split(output, head)
    return F.transform(scores, lambda s, i: F.struct(s.cast("double").alias("score"), F.get(slugs, i).alias("slug"), F.substring(F.regexp_replace(F.get(rest, i + 1), r"^\s+|\s+$", ""), 1, 2000).alias("content")))


def delegate_results(outputs: DataFrame, output: str) -> DataFrame:
    """Rows of search_notes' form from a delegate's output; the title is the content's first line without #, else the slug's last part."""
    from ..functions.text import display_name

    r = outputs.select(F.posexplode(parse_delegate(F.col(output))).alias("i", "r")).select("r.*", (F.col("i") + 1).alias("rank"))
    first = F.trim(F.regexp_replace(F.regexp_extract("content", r"^([^\r\n]*)", 1), r"^#+\s*", ""))
    title = F.when(first != "", first).otherwise(F.regexp_extract("slug", r"([^/]*)$", 1))
    return r.select("slug", "content", "score", F.col("slug").alias("path"), F.lit("gbrain").alias("source"), title.alias("title"), F.concat(F.lit("[["), display_name(F.col("slug")), F.lit("]]")).alias("wikilink"), F.substring("content", 1, 200).alias("excerpt"), "rank")


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): the trigram index as a table."""
    return df.select(key, F.explode(trigrams(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def gram_counts(df: DataFrame, text: str) -> DataFrame:
    """(term, tf): how often each trigram occurs in the whole table. A task counts its texts by about a million characters, so what is shuffled is a row
    for each trigram of such a part, not one for each of a text."""
    from .postings import PIECE, _cut, _runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            _, gram, _, ends = _runs([0] * len(texts), texts, [0] * len(texts))
            return pa.RecordBatch.from_arrays([pa.array(gram, pa.string()), pa.array(ends - [0, *ends[:-1]] if len(ends) else [], pa.int64())], names=["term", "n"])

        texts, held_ = [], 0
        for b in batches:
            for t in b.column("t"):
                for piece, _ in _cut(t.as_py(), 0):
                    texts.append(piece)
                    held_ += len(piece)
                    if held_ >= PIECE:
                        yield counted()
                        texts, held_ = [], 0
        if texts:
            yield counted()

    return df.select(F.coalesce(fold(text), F.lit("")).alias("t")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("tf"))


def gram_keys(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(gram, keys): rows that hold a trigram, those of about a million characters of a task's texts in one row; a long text's key may stand in several."""
    import numpy as np

    from .postings import PIECE, _cut

    names = [f"t{i}" for i in range(len(columns))]
    kind = df_kind(df, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put() -> pa.RecordBatch:
            size = np.array([len(t) for t in texts], np.int64)
            c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
            which = np.repeat(np.arange(len(texts)), size)
            at = np.arange(max(len(c) - 2, 0))
            at = at[at + 3 <= np.cumsum(size)[which[at]]]
            kinds, kind_ = np.unique(c[at] << 42 | c[at + 1] << 21 | c[at + 2], return_inverse=True)
            pair = np.unique(kind_ * len(keys) + np.array(rows)[which[at]])  # by gram, each row once
            ends = np.searchsorted(pair, np.arange(len(kinds) + 1) * len(keys))
            chars = np.stack([kinds >> 42, kinds >> 21 & 0x1FFFFF, kinds & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
            own = pa.array(keys, types["key"]).take(pa.array(pair % len(keys), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([chars[k : k + 3] for k in range(0, len(chars), 3)], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own)], names=["gram", "keys"])

        types: dict = {}
        texts, rows, keys, held_ = [], [], [], 0
        for b in batches:
            types = {"key": b.schema.field("key").type}
            for i in range(b.num_rows):
                keys.append(b.column("key")[i].as_py())
                for n in names:
                    for piece, _ in _cut(b.column(n)[i].as_py(), 0):
                        texts.append(piece), rows.append(len(keys) - 1)
                        held_ += len(piece)
                        if held_ >= PIECE:
                            yield put()
                            texts, rows, keys, held_ = [], [], keys[-1:], 0
        if texts:
            yield put()

    d = df.select(F.col(key).alias("key"), *[F.coalesce(fold(F.col(c).cast("string")), F.lit("")).alias(n) for c, n in zip(columns, names, strict=True)])
    return d.mapInArrow(run, f"gram string, keys array<{kind}>")


def write_index(df: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Stores the trigram index of df: postings (bucket, gram, keys), sorted by gram within a file of a directory by bucket, the texts, and one row of
    statistics. Writing it again replaces it (the rebuild). A task writes the grams of its own texts, so nothing is shuffled."""
    rows = gram_keys(df, key, columns).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")).sortWithinPartitions("bucket", "gram")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    df.write.mode("overwrite").parquet(f"{path}/texts")
    length = _total([trigram_length(F.col(c).cast("string")) for c in columns])
    df.agg(F.count("*").alias("_n"), F.avg(length).alias("_avg")).write.mode("overwrite").parquet(f"{path}/stats")


def search_index(spark: SparkSession, path: str, key: str, columns: list[str], terms: list[str], limit: int = 10) -> DataFrame:
    """BM25 on a stored index, the same rows and scores as `bm25` on the table. Only the buckets and row groups of the terms' trigrams are
    read; rows that have all trigrams of a term are candidates, whose texts are then searched."""
    terms = [t.lower() for t in dict.fromkeys(terms) if len(t) >= 3]
    asked = [(i, t[j : j + 3]) for i, t in enumerate(terms) for j in range(len(t) - 2)]
    grams = sorted({g for _, g in asked})
    texts, known = spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/stats")
    if not grams:
        return top(bm25(texts.where(F.lit(False)), columns, [], None, known), [F.col("score"), F.col(key)], limit)
    q = spark.createDataFrame(sorted(set(asked)), "term int, gram string")
    buckets = [r[0] for r in q.select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # BUCKETS at most
    hits = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    hits = hits.select("gram", F.explode("keys").alias("key")).distinct().join(F.broadcast(q), "gram")  # a long text's key stands in several rows
    need = q.groupBy("term").agg(F.count("*").alias("need"))
    keys = hits.groupBy("term", "key").agg(F.count("*").alias("n")).join(F.broadcast(need), "term").where("n = need").select("key").distinct()
    return top(bm25(texts.join(keys, texts[key] == keys["key"], "left_semi"), columns, terms, None, known), [F.col("score"), F.col(key)], limit)


def _finder(words: list[str]):
    """An automaton that finds all of words, overlapping ones too, in one pass; kept by the worker."""
    import sys
    import types

    import ahocorasick

    store = sys.modules.setdefault("_lorekeep_finders", types.ModuleType("_lorekeep_finders")).__dict__
    name = (len(words), hash(tuple(words)))
    if name not in store:
        store.clear()
        a = ahocorasick.Automaton()
        for i, w in enumerate(words):
            a.add_word(w, i)
        a.make_automaton()
        store[name] = a
    return store[name]


def _blocks(rows: Iterator, size, most: int) -> Iterator[list]:
    """rows in lists of up to `most` in sum of size."""
    block, held_ = [], 0
    for r in rows:
        if block and held_ + size(r) > most:
            yield block
            block, held_ = [], 0
        block.append(r)
        held_ += size(r)
    if block:
        yield block


def bm25_batch(df: DataFrame, key: str, text: str, terms: DataFrame, limit: int = 10, places: int = 12) -> DataFrame:
    """Many queries at once. terms (query_id, term); gives (query_id, key, score, rank). Scores are ranked when rounded to `places`, 6 at least: twelve as in
    postings.search_batch, since terms of an idf of 0 or less add millionths.

    Two passes over the texts for each block of queries (PASS_TERMS terms): one automaton finds all terms of the block in a text. The
    first pass counts texts by term, the second scores; a task keeps its best rows of each query, so neither texts nor
    postings are shuffled. A block's queries and counts pass through the driver."""
    asked = terms.select("query_id", F.lower("term").alias("term")).where(F.char_length("term") >= 3).groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("ts"))
    d = df.select(F.col(key).alias("key"), fold(text).alias("t"), trigram_length(F.col(text)).cast("long").alias("len"))
    whole = d.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    kinds, found = (terms.schema["query_id"].dataType.simpleString(), df.schema[key].dataType.simpleString()), None
    for block in _blocks(asked.orderBy("query_id").toLocalIterator(), lambda r: len(r["ts"]), PASS_TERMS):
        got = _scored(d, whole["n"], whole["avg"], [(r["query_id"], r["ts"]) for r in block], kinds, limit)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return df.sparkSession.createDataFrame([], f"query_id {kinds[0]}, `{key}` {kinds[1]}, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.round("score", places), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", F.col("key").alias(key), "score", "rank")


def _scored(d: DataFrame, n: int, avg: float, queries: list[tuple], kinds: tuple[str, str], limit: int) -> DataFrame:
    """(query_id, key, score): each task's best rows for the queries of a block."""
    import math

    words = sorted({t for _, ts in queries for t in ts})
    place = {w: i for i, w in enumerate(words)}
    of: list[list[int]] = [[] for _ in words]
    for q, (_, ts) in enumerate(queries):
        for t in ts:
            of[place[t]].append(q)
    shared = d.sparkSession.sparkContext.broadcast((words, of, [q for q, _ in queries]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, total = _finder(shared.value[0]), Counter()
        for b in batches:
            for t in b.column("t"):
                if (t := t.as_py()) is not None:
                    total.update({i for _, i in a.iter(t)})
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    rows = {r["i"]: r["n"] for r in d.select("t").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}  # a row per term of the block
    weight = {i: (w if (w := math.log((n - m + 0.5) / (m + 0.5))) > 0 else IDF_FLOOR) for i, m in rows.items()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of, ids = shared.value
        a, best, room = _finder(words), [[] for _ in ids], [16 * limit] * len(ids)

        def cut(q: int) -> None:
            # all that may be among the first `limit` once scores are rounded; of equal scores the first by key
            rows = sorted(best[q], key=lambda x: (x[0], x[1] is not None, x[1]))
            edge, kept, run, last = rows[limit - 1][0] + 2e-6, [], 0, None
            for s, k in rows:
                run, last = (run + 1 if s == last else 1), s
                if s > edge:
                    break
                if run <= limit:
                    kept.append((s, k))
            best[q], room[q] = kept, max(16 * limit, 2 * len(kept))

        for b in batches:
            for k, t, size in zip(*(b.column(c) for c in ("key", "t", "len")), strict=True):
                if (t := t.as_py()) is None:
                    continue
                sums: dict[int, float] = {}
                for i, tf in sorted(Counter(i for _, i in a.iter(t)).items()):
                    part = weight[i] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size.as_py() / avg))
                    for q in of[i]:
                        sums[q] = sums.get(q, 0.0) - part
                for q, s in sums.items():
                    best[q].append((s, k.as_py()))
                    if len(best[q]) >= room[q]:
                        cut(q)
        for q in range(len(ids)):
            if len(best[q]) > limit:
                cut(q)
        out = [(ids[q], k, s) for q in range(len(ids)) for s, k in best[q]]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], schema[0].type), pa.array([x[1] for x in out], schema[1].type), pa.array([x[2] for x in out], pa.float64())], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = f"query_id {kinds[0]}, key {kinds[1]}, score double"
    schema = to_arrow_schema(d.sparkSession.createDataFrame([], ddl).schema)
    return d.mapInArrow(score, ddl)


def containing(docs: DataFrame, key: str, text: str, passages: DataFrame) -> DataFrame:
    """(query_id, key) of documents that contain the whole passage p of (query_id, p), upper and lower case apart: one automaton for each
    block of passages (PASS_CHARS characters) finds all of them in one pass. An empty passage is in every text."""
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    asked = passages.where("p is not null").groupBy("p").agg(F.collect_set("query_id").alias("ids"))
    found = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key")).crossJoin(F.broadcast(passages.where("p = ''").select("query_id"))).select("query_id", "key")  # queries with an empty passage
    kind = df_kind(docs, key)
    for block in _blocks(asked.where("p <> ''").orderBy("p").toLocalIterator(), lambda r: len(r["p"]), PASS_CHARS):
        words = [r["p"] for r in block]
        shared = docs.sparkSession.sparkContext.broadcast(words)

        def hits(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a = _finder(shared.value)
            for b in batches:
                at, which = [], []
                for n, t in enumerate(b.column("t")):
                    got = sorted({i for _, i in a.iter(t)}) if (t := t.as_py()) is not None else []
                    at += [n] * len(got)
                    which += got
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), pa.array(which, pa.int64())], names=["key", "i"])

        names = docs.sparkSession.createDataFrame([(i, q) for i, r in enumerate(block) for q in r["ids"]], f"i long, query_id {df_kind(passages, 'query_id')}")
        found = found.unionByName(d.mapInArrow(hits, f"key {kind}, i long").join(F.broadcast(names), "i").select("query_id", "key"))  # names: a block's passages
    return found.select("query_id", F.col("key").alias(key)).distinct()


def df_kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
