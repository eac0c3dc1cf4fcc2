"""Retrieval evaluation: chunking, query terms, Hit@K, comparisons, compression statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dialect import STOP

#: Chunk length, query terms, cut-offs, width of the neutral band.
CHUNK, TERMS, KS, NEUTRAL = 400, 15, (1, 3, 5, 10), 0.005


def chunks(text: Column, size: int = CHUNK, after: str = "。！？\\n") -> Column:
    """Array of (start, end, text): sentences packed greedily up to `size` characters, longer ones cut hard; true offsets.

    Pieces are at most `size` long before packing, so one fold over them is enough."""
    parts = F.filter(F.split(text, f"(?<=[{after}])"), lambda p: p != "")
    # a long part gives full pieces and a rest; only a rest (or a short part) is packed with what follows
    cut = F.flatten(F.transform(parts, lambda p: F.when(F.char_length(p) <= size, F.array(F.struct(p.alias("t"), F.lit(False).alias("hard")))).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.char_length(p) - 1) / size).cast("int")), lambda i: F.struct(F.substring(p, i * size + 1, F.lit(size)).alias("t"), ((i + 1) * size < F.char_length(p)).alias("hard"))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, x: Column) -> Column:
        flushed = F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        fits = F.char_length(acc["cur"]) + F.char_length(x["t"]) <= size
        return F.when(x["hard"], F.struct(F.concat(flushed, F.array(x["t"])).alias("done"), F.lit("").alias("cur"))).when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["cur"], x["t"]).alias("cur"))).otherwise(F.struct(flushed.alias("done"), x["t"].alias("cur")))

    packed = F.aggregate(cut, start, step, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))
    return packed


def with_offsets(df: DataFrame, key: str, text: str, size: int = CHUNK, after: str = "。！？\\n") -> DataFrame:
    """(key, chunk, start, end, text): one row per chunk."""
    c = df.select(key, chunks(F.coalesce(F.col(text), F.lit("")), size, after).alias("c"))
    ends = F.aggregate("c", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.char_length(x))))
    return c.withColumn("e", ends).select(key, "e", F.posexplode("c").alias("chunk", "text")).select(key, "chunk", F.get("e", F.col("chunk")).alias("start"), F.get("e", F.col("chunk") + 1).alias("end"), "text")


def english_terms(text: Column, n: int = TERMS, stop: list[str] = STOP) -> Column:
    """First n distinct folded words of three letters or more that are no stop words."""
    return F.slice(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: (F.char_length(w) >= 3) & ~w.isin(stop))), 1, n)


def cjk_terms(text: Column, n: int = 12, anchors: Column | None = None, drop: str = "什麼|哪|誰|何時|為何|如何|多少|幾") -> Column:
    """First n distinct terms: anchors from a segmenter if given, then three-character ideograph windows without question words."""
    from ..functions.text import CJK

    windows = F.filter(F.regexp_extract_all(text, F.lit(f"(?=({CJK}{{3}}))"), F.lit(1)), lambda w: ~w.rlike(drop))
    return F.slice(F.array_distinct(F.concat(anchors, windows) if anchors is not None else windows), 1, n)


def hit_at_k(ranked: DataFrame, relevant: DataFrame, key: str, queries: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(k, hit_rate, queries): share of queries with a relevant key at rank k or better. Queries without results count as misses."""
    best = ranked.join(relevant, ["query_id", key]).groupBy("query_id").agg(F.min("rank").alias("best"))
    d = queries.select("query_id").distinct().join(best, "query_id", "left")
    return d.crossJoin(F.broadcast(d.sparkSession.createDataFrame([(k,) for k in ks], "k int"))).groupBy("k").agg(F.round(F.avg(F.when(F.col("best") <= F.col("k"), 1.0).otherwise(0.0)), 4).alias("hit_rate"), F.count("*").alias("queries"))


def misses(ranked: DataFrame, relevant: DataFrame, key: str, queries: DataFrame, k: int = 10, n: int = 5) -> DataFrame:
    """Up to n queries (a sample by id) that have no relevant key at rank k or better."""
    hit = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", key]).select("query_id").distinct()
    return queries.select("query_id").distinct().join(hit, "query_id", "left_anti").orderBy("query_id").limit(n)


def chunk_relevance(relevant: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(query_id, key, chunk): every chunk of a relevant document counts as relevant."""
    return relevant.select("query_id", key).distinct().join(chunks.select(key, "chunk"), key).select("query_id", key, "chunk")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same on every run: those with the smallest hash of key and seed."""
    return df.orderBy(F.md5(F.encode(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), "utf-8")), key).limit(n)


def token_savings(radar: DataFrame, queries: DataFrame, short: str, full: str, n: int = 5) -> DataFrame:
    """(query, full_tokens, short_tokens, savings) of queries (query): tokens of the first n rows (by slug) whose short text holds the query,
    ASCII case ignored; savings 0 where the full texts have none. One row, the average, is `average_savings`."""
    hit = radar.join(F.broadcast(queries.select("query").distinct()), F.lower(short).contains(F.lower("query")))  # queries of one report
    first = Window.partitionBy("query").orderBy("slug")
    hit = hit.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    quarter = lambda c: F.sum(F.floor(F.char_length(c) / 4)).cast("long")
    g = hit.groupBy("query").agg(quarter(full).alias("full_tokens"), quarter(short).alias("short_tokens"))
    g = queries.select("query").distinct().join(g, "query", "left").select("query", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("full_tokens", "short_tokens")])
    return g.withColumn("savings", F.when(F.col("full_tokens") > 0, F.round(1 - F.col("short_tokens") / F.col("full_tokens"), 6)).otherwise(0.0))


def average_savings(savings: DataFrame) -> DataFrame:
    return savings.agg(F.round(F.avg("savings"), 6).alias("average_savings"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(k, a, b, gap, verdict) of two hit_at_k results."""
    j = a.select("k", F.col("hit_rate").alias("a")).join(b.select("k", F.col("hit_rate").alias("b")), "k").withColumn("gap", F.round(F.col("b") - F.col("a"), 4))
    return j.withColumn("verdict", F.when(F.abs("gap") < NEUTRAL, "neutral").when(F.col("gap") > 0, "better").otherwise("worse"))


def ratio_summary(df: DataFrame, original: str, short: str) -> DataFrame:
    """One row: documents, missing, mean, upper median (exact; counts of equal values, no list) and four buckets of len(short) / len(original)."""
    # six places bound the number of different ratios that the median's window orders
    d = df.select(F.round(F.char_length(short) / F.greatest(F.char_length(original), F.lit(1)), 6).alias("r"))
    v = d.groupBy("r").count()  # the texts are gone through once, for this
    sum_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).cast("long")
    known = F.col("r").isNotNull()
    n = v.agg(sum_if(known).alias("n"), sum_if(F.lit(True)).alias("all"), F.round(F.sum(F.col("r") * F.col("count")) / F.sum(F.when(known, F.col("count"))), 6).alias("mean"), *[sum_if(c).alias(k) for k, c in (("under_10", F.col("r") < 0.1), ("under_20", (F.col("r") >= 0.1) & (F.col("r") < 0.2)), ("under_30", (F.col("r") >= 0.2) & (F.col("r") < 0.3)), ("over_30", F.col("r") >= 0.3))])
    v = v.where(known)
    upto = v.crossJoin(F.broadcast(n.select("n")))  # one row
    total = F.sum("count").over(Window.orderBy("r"))
    mid = upto.select("r", total.alias("c"), "n").where(F.col("c") > F.floor(F.col("n") / 2)).agg(F.round(F.min("r"), 6).alias("median"))
    return n.crossJoin(F.broadcast(mid)).select("n", (F.col("all") - F.col("n")).alias("missing"), "mean", "median", "under_10", "under_20", "under_30", "over_30")
