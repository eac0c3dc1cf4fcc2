"""Vector search: exact neighbours, cosine re-scoring, multi-probe SimHash, overlap evaluation.

A vector that is null, holds a null or NaN, or has another length than the one it is compared with can't be compared: it has no fingerprint, is no one's
neighbour and, as a query, has none; `rescore` and `rerank` put it last, as a candidate without a vector."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tables and bits of the fingerprint, first seed, guard of norms, candidates of the coarse search.
TABLES, BITS, SEED, EPS, COARSE = 8, 512, 42, 1e-10, 50
#: Vectors that are projected at a time.
ROWS = 500


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPS) * (norm(b) + EPS))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def usable(a: Column, dim: Column | int | None = None) -> Column:
    """Whether a is a vector without gaps (of length dim)."""
    ok = a.isNotNull() & (F.size(a) > 0) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce(ok if dim is None else ok & (F.size(a) == dim), F.lit(False))


def literal(vec: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vec])


def knn(df: DataFrame, key: str, vec: str, query: list[float], k: int = 10, metric: str = "cosine") -> DataFrame:
    """k nearest rows with score (cosine, larger is nearer) or distance (l2); ties by key."""
    q, df = literal(query), df.where(usable(F.col(vec), len(query)))
    s = F.round(cosine(F.col(vec), q), 6).alias("score") if metric == "cosine" else F.round(F.sqrt(squared_l2(F.col(vec), q)), 6).alias("distance")
    d = df.select(key, s)
    order = [F.col("score").desc() if metric == "cosine" else F.col("distance").asc(), F.col(key)]
    return d.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def knn_batch(df: DataFrame, key: str, vec: str, queries: DataFrame, k: int = 10, skip_self: bool = True) -> DataFrame:
    """(query_id, key, score, rank) for any number of queries (query_id, q), in blocks that every task holds as one matrix.

    Each batch of rows is one matrix product; a task keeps its k best per query, so only tasks x queries x k rows move."""
    kind, found = f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {df.schema[key].dataType.simpleString()}", None
    for block in _query_blocks(queries.where(usable(F.col("q")))):
        got = _best_of(df.where(usable(F.col(vec), len(block[0]["q"]))), key, vec, kind, block, k, skip_self)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return df.sparkSession.createDataFrame([], f"{kind}, score double, rank int").withColumnRenamed("key", key)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "score", "rank")


def _parts(batches: Iterator[pd.DataFrame], queries: int) -> Iterator[pd.DataFrame]:
    """batches in parts whose matrix with the queries has MATRIX numbers at most, or one row."""
    rows = max(1, MATRIX // queries)
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i : i + rows]


def _query_blocks(queries: DataFrame) -> Iterator[list]:
    """Queries (query_id, q, ...) in blocks of MAX_QUERIES at most, of one length each."""
    rows = queries.orderBy(F.size("q"), "query_id").toLocalIterator()
    for _, same in groupby(rows, key=lambda r: len(r["q"])):
        while block := list(islice(same, MAX_QUERIES)):
            yield block


def _best_of(df: DataFrame, key: str, vec: str, kind: str, rows: list, k: int, skip_self: bool) -> DataFrame:
    """(query_id, key, score): each task's k best rows for each query of one block."""
    ids, q = np.array([r["query_id"] for r in rows]), np.array([r["q"] for r in rows], dtype=np.float64)
    q = q / (np.linalg.norm(q, axis=1, keepdims=True) + EPS)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: pd.DataFrame | None = None
        for b in _parts(batches, len(ids)):
            x = np.array(b["v"].tolist(), dtype=np.float64)
            s = np.round((x @ q.T) / (np.linalg.norm(x, axis=1, keepdims=True) + EPS), 6)
            m = min(k + 1, len(x))
            got = pd.concat([pd.DataFrame({"query_id": ids[j], "key": b["k"].to_numpy(), "score": s[:, j]}).nlargest(m, "score", keep="all") for j in range(len(ids))])
            got = got[got["query_id"] != got["key"]] if skip_self else got
            top = got if top is None else pd.concat([top, got])
            top = top.sort_values(["query_id", "score", "key"], ascending=[True, False, True]).groupby("query_id").head(k)
        if top is not None:
            yield top

    return df.select(F.col(key).alias("k"), F.col(vec).alias("v")).mapInPandas(best, f"{kind}, score double")


#: Queries in a block, numbers in a matrix of rows and queries (8 bytes each).
MAX_QUERIES, MATRIX = 10_000, 1 << 21


def planes(dim: int, tables: int = TABLES, bits: int = BITS, kind: str = "numpy", seed: int = SEED) -> np.ndarray:
    """[tables, dim, bits]: unit Gaussian columns by numpy's RandomState, or +-1 by integer arithmetic ('hash'), which SQL can repeat."""
    if kind == "numpy":
        out = np.stack([np.random.RandomState(seed + t).randn(dim, bits) for t in range(tables)])
        return out / np.linalg.norm(out, axis=1, keepdims=True)
    t, d, b = np.ogrid[:tables, :dim, :bits]
    h = (t * 7919 + d * 104729 + b * 1299709 + (d + 1) * (b + 3) * (t + 5) * 31) % 1000003
    return np.where(h % 2 == 0, 1.0, -1.0)


def fingerprints(df: DataFrame, vec: str, tables: int = TABLES, bits: int = BITS, kind: str = "numpy") -> DataFrame:
    """df with fp: array (tables) of arrays (bits / 64) of longs; a bit is set where the projection is positive. Null where there is no usable vector."""

    @F.arrow_udf("array<array<bigint>>")
    def project(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[int, np.ndarray] = {}

        def of(s: list) -> pa.Array:
            out: list = [None] * len(s)
            places: dict[int, list[int]] = {}
            for i, v in enumerate(s):
                if v is not None:
                    places.setdefault(len(v), []).append(i)
            for dim, at in places.items():  # vectors of one length are projected together
                x = np.array([s[i] for i in at], dtype=np.float64)
                if dim not in known:
                    known[dim] = planes(dim, tables, bits, kind)
                words = [np.packbits((x @ known[dim][t]) > 0, axis=1).reshape(len(x), bits // 64, 8).view(">u8")[:, :, 0].astype(np.uint64).view(np.int64) for t in range(tables)]
                for j, i in enumerate(at):
                    out[i] = [w[j].tolist() for w in words]
            return pa.array(out, pa.list_(pa.list_(pa.int64())))

        for s in it:  # only ROWS vectors at a time are Python's numbers
            yield pa.concat_arrays([of(s.slice(a, ROWS).to_pylist()) for a in range(0, len(s), ROWS)] or [of([])])

    return df.withColumn("fp", project(F.when(usable(F.col(vec)), F.col(vec))))


def hamming(a: Column, b: Column) -> Column:
    """Smallest distance over the tables."""
    one = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    return F.array_min(F.zip_with(a, b, one))


def coarse(df: DataFrame, key: str, query: DataFrame, n: int = COARSE) -> DataFrame:
    """The n rows nearest to the one query fingerprint (a one-row frame with column fp); fewer rows give all."""
    q = query.select(F.col("fp").alias("_q")).limit(1)
    d = df.crossJoin(F.broadcast(q)).withColumn("distance", hamming(F.col("fp"), F.col("_q"))).drop("_q").where("distance is not null")  # one row
    return d.orderBy("distance", key).limit(n)


def simhash_knn(df: DataFrame, key: str, vec: str, query: list[float], k: int = 10, bits: int = 384, kind: str = "numpy") -> DataFrame:
    """k nearest rows by plain Hamming distance of one table's fingerprints."""
    spark = df.sparkSession
    q = fingerprints(spark.createDataFrame([(list(map(float, query)),)], "q array<double>"), "q", 1, bits, kind)
    d = coarse(fingerprints(df.select(key, vec).where(usable(F.col(vec), len(query))), vec, 1, bits, kind), key, q, k).select(key, "distance")
    return d.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))


def with_meta(hits: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """hits (key, rank) with the columns of meta, in order of rank; hits that meta doesn't know are dropped, ranks stay."""
    return hits.join(meta, key).orderBy("rank", key)


def message_neighbours(vectors: DataFrame, messages: DataFrame, query: list[float], k: int = 20) -> DataFrame:
    """Messages nearest to a query vector (vectors: slug, embedding): (slug, clsc, tokens, drawer_path, rank), texts cut at 200 characters."""
    near = knn(vectors, "slug", "embedding", query, k, "l2").select("slug", "rank")
    m = messages.where("text is not null and text <> ''").select(F.concat_ws(":", "chat_id", "message_id").alias("slug"), F.substring("text", 1, 200).alias("clsc"), F.floor(F.char_length("text") / 4).cast("long").alias("tokens"), F.concat_ws(":", F.lit("tg"), "chat_id", "message_id").alias("drawer_path"))
    return with_meta(near, m, "slug")


def two_layer_batch(df: DataFrame, key: str, vec: str, queries: DataFrame, k: int = 10, n: int = COARSE, tables: int = TABLES, bits: int = BITS, skip_self: bool = True) -> DataFrame:
    """(query_id, key, distance, score, rank) for queries (query_id, q): the n nearest by fingerprint, of those the k best by cosine."""
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {df.schema[key].dataType.simpleString()}"
    v, found = df.select(F.col(key).alias("k"), F.col(vec).alias("v")), None
    for block in _query_blocks(fingerprints(queries.where(usable(F.col("q"))), "q", tables, bits)):
        got = _coarse_of(fingerprints(v.where(usable(F.col("v"), len(block[0]["q"]))), "v", tables, bits), kind, block, n, skip_self)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return df.sparkSession.createDataFrame([], f"{kind}, distance int, score double, rank int").withColumnRenamed("key", key)
    near = Window.partitionBy("query_id").orderBy("distance", "key")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "distance", "key")
    c = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= n).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return c.select("query_id", F.col("key").alias(key), "distance", "score", "rank")


def _coarse_of(d: DataFrame, kind: str, rows: list, n: int, skip_self: bool) -> DataFrame:
    """(query_id, key, distance, score): each task's n rows (k, v, fp) nearest by fingerprint to each query of one block."""
    ids, q, qf = np.array([r["query_id"] for r in rows]), np.array([r["q"] for r in rows], dtype=np.float64), np.array([r["fp"] for r in rows], dtype=np.int64)
    q = q / (np.linalg.norm(q, axis=1, keepdims=True) + EPS)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: pd.DataFrame | None = None
        for b in _parts(batches, len(ids)):
            x, keys = np.array(b["v"].tolist(), dtype=np.float64), b["k"].to_numpy()
            x = x / (np.linalg.norm(x, axis=1, keepdims=True) + EPS)
            f = np.array([[w.tolist() for w in r] for r in b["fp"]], dtype=np.int64).view(np.uint64)
            parts = []
            for j in range(len(ids)):
                h = np.bitwise_count(f ^ qf[j].view(np.uint64)).sum(axis=2, dtype=np.int64).min(axis=1)
                at = np.lexsort((keys, h))
                at = (at[keys[at] != ids[j]] if skip_self else at)[:n]
                parts.append(pd.DataFrame({"query_id": ids[j], "key": keys[at], "distance": h[at], "score": np.round(x[at] @ q[j], 6)}))
            got = pd.concat(parts if top is None else [top, *parts])
            top = got.sort_values(["query_id", "distance", "key"]).groupby("query_id").head(n)
        if top is not None:
            yield top

    return d.mapInPandas(nearest, f"{kind}, distance int, score double")


def rescore(cands: DataFrame, vectors: DataFrame, key: str, vec: str, query: list[float], k: int) -> DataFrame:
    """Candidates (key, rank) by cosine; without a vector -1, with a zero query in input order."""
    v = vectors.select(key, F.col(vec).alias("_v"))
    qn = float(np.linalg.norm(query))
    q = literal(query)
    s = F.when(F.col("_v").isNull(), F.lit(-1.0)).otherwise(dot(F.col("_v"), q) / (norm(F.col("_v")) * qn + EPS)) if qn else F.lit(0.0)
    order = [F.col("score").desc(), F.col("rank")]
    return cands.join(v, key, "left").withColumn("score", F.round(s, 6)).drop("_v").orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rerank(cands: DataFrame, vectors: DataFrame, key: str, vec: str, query: list[float]) -> DataFrame:
    """Candidates by exact distance to the query; those without a vector come last (largest distance plus 1)."""
    d = cands.join(vectors.select(key, F.sqrt(squared_l2(F.col(vec), literal(query))).alias("_d")), key, "left")
    far = F.max("_d").over(Window.partitionBy())
    return d.withColumn("distance", F.coalesce("_d", F.coalesce(far, F.lit(0.0)) + 1)).drop("_d")


def overlap_at_k(exact: DataFrame, approx: DataFrame, key: str, k: int = 10) -> DataFrame:
    """One row: mean, median, min, max of |A ∩ B| / k over queries and the share of queries at 0.8 or more."""
    a = exact.groupBy("query_id").agg(F.collect_set(key).alias("a"))
    b = approx.groupBy("query_id").agg(F.collect_set(key).alias("b"))
    o = a.join(b, "query_id").select((F.size(F.array_intersect("a", "b")) / k).alias("o"))
    return o.agg(F.round(F.avg("o"), 6).alias("mean"), F.round(F.median("o"), 6).alias("median"), F.min("o").alias("min"), F.max("o").alias("max"), F.round(F.avg((F.col("o") >= 0.8).cast("double")), 6).alias("share_08"), F.count("*").alias("queries"))
