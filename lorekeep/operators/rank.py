"""Hybrid ranking: reciprocal rank fusion with provenance, popularity boost, multi-source merge."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fusion constant, boost per log of accesses, cap of accesses, factor of archived rows, source priorities.
RRF_K, BOOST, MAX_ACCESS, ARCHIVED = 60, 0.1, 100, 0.7
PRIORITY = {"ocean": 3, "radar": 2, "messages": 1}


def ranked(df: DataFrame, key: str, source: str, list_id: int, by: tuple[str, ...] = ()) -> DataFrame:
    """A ranked list in the form that fusion takes: (list_id, source, rank, slug), with the columns `by` that tell queries apart."""
    return df.select(*by, F.lit(list_id).alias("list_id"), F.lit(source).alias("source"), F.col("rank").cast("long").alias("rank"), F.col(key).cast("string").alias("slug"))


def rrf(lists: list[DataFrame], k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """(slug, score, sources, first_list, first_rank): sum of 1/(k + rank); sources in list order; empty slugs dropped. by: for each query."""
    u = reduce(lambda a, b: a.unionByName(b), lists).where("slug is not null and slug <> ''")
    g = u.groupBy(*by, "slug").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list_id", "rank")).alias("_f"), F.array_sort(F.collect_set(F.struct("list_id", "source"))).alias("_s"))
    return g.select(*by, "slug", F.round("score", 9).alias("score"), F.array_distinct(F.transform("_s", lambda x: x["source"])).alias("sources"), F.col("_f.list_id").alias("first_list"), F.col("_f.rank").alias("first_rank"))


RRF_ORDER = ["first_list", "first_rank", "slug"]


def fused(lists: list[DataFrame], limit: int, k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """rrf in order (score, then first appearance), cut at limit, with rank; with `by`, for each query."""
    order = [F.col("score").desc(), *[F.col(c) for c in RRF_ORDER]]
    if by:
        return rrf(lists, k, by).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)
    return rrf(lists, k).orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def boost_factor(access: Column, status: Column) -> Column:
    n = F.least(F.coalesce(access, F.lit(0)), F.lit(MAX_ACCESS))
    return (1 + BOOST * F.log(n + 1)) * F.when(status == "archived", ARCHIVED).otherwise(1.0)


def boosted(hits: DataFrame, meta: DataFrame, key: str = "slug", mode: str = "compat", by: tuple[str, ...] = ()) -> DataFrame:
    """hits (rank) with boost: re-sorted by boost alone within the list (compat), or by score times boost (multiply); `by` tells lists apart."""
    d = hits.join(meta.select(key, "access_count", "status"), key, "left")
    d = d.withColumn("boost", F.round(F.when(F.col("access_count").isNull() & F.col("status").isNull(), F.lit(1.0)).otherwise(boost_factor(F.col("access_count"), F.col("status"))), 6))
    order = [F.col("boost").desc(), F.col("rank")] if mode == "compat" else [(F.col("score") * F.col("boost")).desc(), F.col("rank")]
    return d.withColumn("final_rank", F.row_number().over((Window.partitionBy(*by) if by else Window).orderBy(*order))).drop("access_count", "status")


def unified(parts: DataFrame, limit: int) -> DataFrame:
    """parts (title, excerpt, source, ref, score_rank): by source priority, then rank in the source; one row per (source, ref)."""
    prio = reduce(lambda a, s: F.when(F.col("source") == s, PRIORITY[s]).otherwise(a), PRIORITY, F.lit(0))
    one = Window.partitionBy("source", "ref").orderBy("score_rank", "title")
    d = parts.where("ref is not null and ref <> ''").withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r").withColumn("priority", prio)
    order = [F.col("priority").desc(), F.col("score_rank"), F.col("source"), F.col("ref")]
    return d.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def parse_permutation(reply: str, n: int) -> list[int]:
    """Order of n candidates (from 0) in a reply that names them from 1; unnamed ones follow in input order."""
    named = [int(x) - 1 for x in re.findall(r"\d+", reply)]
    out = list(dict.fromkeys(i for i in named if 0 <= i < n))
    return out + [i for i in range(n) if i not in out]


def apply_permutation(hits: DataFrame, order: list[int]) -> DataFrame:
    """hits in the order of a (short) permutation of ranks from 0."""
    where = F.create_map(*[x for i, o in enumerate(order) for x in (F.lit(o + 1), F.lit(i + 1))])
    return hits.withColumn("rank", F.coalesce(where[F.col("rank")], F.col("rank")))
