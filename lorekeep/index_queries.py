"""Registered queries of the positional index, batch hybrid search, search in SQL, as-of joins beyond the facts, vectors with gaps.

Same form as in queries.py, whose tables they share; importing this module adds them there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .memory_queries import ORACLES, QUERIES
from .operators import kg, postings, vector
from .queries import _ASKED, _BATCH, FACTS, RADAR, TERMS, _bm25_sql, facts, query, radar, table
from .sources.shared import shared_dir, until_exit

__all__ = ["ORACLES", "QUERIES"]


def indexed(spark: SparkSession, *versions: DataFrame) -> str:
    """An index of slug and clsc in the shared folder, brought up to each version in turn; it goes with the session."""
    path = f"{shared_dir(spark)}/positions-{uuid.uuid4().hex}"
    for v in versions:
        postings.refresh(v, "slug", ["slug", "clsc"], path)
    until_exit(spark, path)
    return path


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return radar(spark, d).select("slug", "clsc")


@query(f"WITH {RADAR}, {_bm25_sql('radar', ['slug', 'clsc'], TERMS)} SELECT slug, round(score, 6) AS score FROM bm")
def fts_positions(spark, d):
    """All rows that hold a term, scored from postings; no scan of texts in the plan."""
    path = indexed(spark, _lines(spark, d))
    asked = spark.createDataFrame([(0, t) for t in TERMS], "query_id int, term string")
    return postings.bm25(spark, path, asked, TERMS).select(F.col("key").alias("slug"), F.round("score", 6).alias("score"))


@query(f"""WITH {RADAR}, {_bm25_sql('radar', ['slug', 'clsc'], ['and', 'thing', 'with'], "(regexp_matches(lower(clsc), '(?s)and.{0,18}thing|thing.{0,18}and') OR contains(lower(slug) , 'with') OR contains(lower(clsc), 'with')) AND NOT contains(lower(clsc), 'token')")}
SELECT slug, round(score, 6) AS score FROM bm ORDER BY bm.score, slug LIMIT 50""")
def fts_positions_boolean(spark, d):
    """NEAR, OR, NOT and a column filter on places."""
    path = indexed(spark, _lines(spark, d))
    hits = postings.search_boolean(spark, path, "(clsc: NEAR(and thing, 20) OR with) NOT clsc: token", ["slug", "clsc"], 50)
    return hits.select(F.col("key").alias("slug"), F.round("score", 6).alias("score"))


@query(f"WITH {RADAR}, {_bm25_sql('radar', ['slug', 'clsc'], TERMS)} SELECT slug, round(score, 6) AS score FROM bm ORDER BY bm.score, slug LIMIT 100")
def fts_index_refresh(spark, d):
    """An index of older texts, brought up to today's: every third text was another, some rows weren't there, some have gone since."""
    now, n = _lines(spark, d), F.xxhash64("slug")
    old = now.where(F.pmod(n, F.lit(11)) > 0).withColumn("clsc", F.when(F.pmod(n, F.lit(3)) == 0, F.concat(F.lit("a hand in former action "), "clsc")).otherwise(F.col("clsc")))
    gone = now.where(F.pmod(n, F.lit(5)) == 0).select(F.concat("slug", F.lit("-gone")).alias("slug"), "clsc")
    return postings.search(spark, indexed(spark, old.unionByName(gone), now), TERMS, 100).select(F.col("key").alias("slug"), F.round("score", 6).alias("score"))


@query(f"""WITH {RADAR}, {_bm25_sql('radar', ['slug', 'clsc'], TERMS)}, k AS (SELECT slug, round(bm.score, 6) AS score, row_number() OVER (ORDER BY round(bm.score, 12), slug)::INT AS rank FROM bm)
SELECT k.slug, k.score, k.rank, access_count FROM k JOIN radar USING (slug) WHERE rank <= 30""")
def fts_sql(spark, d):
    """Search in a SQL statement, beside a join."""
    name = f"search_{uuid.uuid4().hex}"
    postings.register(spark, indexed(spark, _lines(spark, d)), name)
    radar(spark, d).createOrReplaceTempView(f"{name}_radar")
    return spark.sql(f"SELECT s.key AS slug, round(s.score, 6) AS score, s.rank, r.access_count FROM {name}('{' '.join(TERMS)}', 30) s JOIN {name}_radar r ON s.key = r.slug")


# queries: the first words of each passage; those of every fourth are cut to two characters, which only the substring stage finds
_WORDS = _ASKED.replace("FROM benchmark)", "FROM (SELECT item_id, CASE WHEN item_id % 4 = 3 THEN '' ELSE text END AS text FROM benchmark) bq)", 1)
_TWO = "SELECT item_id AS query_id, list_distinct(list_transform(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN_]+'), lambda w: length(w) >= 3), lambda w: w[1:2])) AS ws FROM benchmark WHERE item_id % 4 = 3"


def _hybrid_queries(spark: SparkSession, d: str) -> DataFrame:
    from .operators.evaluation import english_terms

    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))
    short = F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 2)))
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(F.when(F.col("item_id") % 4 == 3, short).otherwise(english_terms(F.col("text"))), " ").alias("query"))


_HYBRID = _BATCH.replace(_ASKED, _WORDS).replace("dd AS (SELECT doc_id, lower(text) AS t, greatest(length(text) - 2, 0) AS len FROM documents)", "dd AS (SELECT slug AS doc_id, lower(slug) || chr(1) || chr(1) || lower(clsc) AS t, greatest(length(slug) - 2, 0) + greatest(length(clsc) - 2, 0) AS len FROM radar)").replace("round(score, 6), doc_id", "round(score, 12), doc_id")


@query(f"""WITH {RADAR}, {_HYBRID}, two AS ({_TWO}),
sb AS (SELECT query_id, slug, len(list_filter(ws, lambda w: contains(clsc, w))) AS m FROM two, radar), s AS (SELECT query_id, slug, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, slug) AS rank FROM sb WHERE m > 0),
l AS (SELECT query_id, doc_id AS slug, rank FROM rk WHERE rank <= 5 UNION ALL SELECT query_id, slug, rank FROM s WHERE rank <= 5),
b AS (SELECT l.*, round((1 + 0.1 * ln(least(access_count, 100) + 1)) * CASE WHEN status = 'archived' THEN 0.7 ELSE 1.0 END, 6) AS boost FROM l JOIN radar USING (slug))
SELECT query_id, slug, row_number() OVER (PARTITION BY query_id ORDER BY boost DESC, rank) AS final_rank FROM b""")
def radar_search_batch(spark, d):
    """Every passage of benchmark as a query through recall, substring fallback, fusion and boost, in one plan."""
    r = radar(spark, d)
    hits = api.radar_search_batch(r, _hybrid_queries(spark, d), indexed(spark, r), 5)
    return hits.select("query_id", "slug", F.col("final_rank").cast("long").alias("final_rank"))


@query(f"""WITH {FACTS}, f2 AS (SELECT * REPLACE (CASE WHEN valid_from > '2024-01-20' THEN NULL ELSE valid_from END AS valid_from) FROM facts),
days AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events UNION ALL SELECT unnest(['1899-12-31', '1965-01-01', '2025-03-01', '2190-07-15']))
SELECT day, predicate, count(*) AS live, count(*) FILTER (valid_to IS NULL) AS open FROM f2 JOIN days ON (valid_from IS NULL OR valid_from <= day) AND (valid_to IS NULL OR valid_to >= day) GROUP BY day, predicate""")
def kg_as_of_far_days(spark, d):
    """Days within, long before and long after the facts; facts from the last days have no beginning."""
    f = facts(spark, d).withColumn("valid_from", F.when(~F.coalesce(F.col("valid_from") > "2024-01-20", F.lit(False)), F.col("valid_from")))
    far = spark.createDataFrame([(x,) for x in ("1899-12-31", "1965-01-01", "2025-03-01", "2190-07-15", None)], "day string")
    days = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct().unionByName(far)
    return kg.as_of_join(f, days).groupBy("day", "predicate").agg(F.count("*").alias("live"), F.count_if(F.col("valid_to").isNull()).alias("open"))


def _gapped(spark: SparkSession, d: str) -> DataFrame:
    """embeddings in which some vectors are null, some hold a null, some are half as long."""
    v, i = F.col("embedding"), F.col("vec_id")
    hole = F.transform(v, lambda x, n: F.when(n != 3, x))
    return table(spark, d, "embeddings").withColumn("embedding", F.when(i % 7 == 3, F.lit(None)).when(i % 11 == 5, hole).when(i % 5 == 2, F.slice(v, 1, 32)).otherwise(v))


_GAPPED = """v AS (SELECT vec_id, CASE WHEN vec_id % 5 = 2 THEN e[1:32] ELSE e END AS e FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) z WHERE vec_id % 7 <> 3 AND vec_id % 11 <> 5)"""


@query(f"""WITH {_GAPPED}, n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) + 1e-10 AS m FROM v), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.e, b.e) / (a.m * b.m), 6) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 IN (0, 3, 17)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10""")
def vec_knn_gaps(spark, d):
    """Neighbours among vectors of two lengths with gaps; queries of either length, some of them null."""
    e = _gapped(spark, d)
    q = e.where("vec_id % 100 in (0, 3, 17)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vector.knn_batch(e, "vec_id", "embedding", q, 10).withColumn("rank", F.col("rank").cast("long"))


_LISTS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(["hand", "tion", "shed"]))


@query(f"""WITH {RADAR}, v AS (SELECT * FROM (VALUES {_LISTS}) z(list_id, term)),
w AS (SELECT list_id, slug, greatest(length(slug) - 2, 0) + greatest(length(clsc) - 2, 0) AS len, ((length(clsc) - length(replace(lower(clsc), term, ''))) / length(term))::BIGINT AS tf FROM radar, v),
st AS (SELECT list_id, count(*) AS n, avg(len) AS av, count(*) FILTER (tf > 0) AS m FROM w GROUP BY list_id),
k AS (SELECT list_id, slug, row_number() OVER (PARTITION BY list_id ORDER BY -(CASE WHEN ln((n - m + 0.5) / (m + 0.5)) > 0 THEN ln((n - m + 0.5) / (m + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))), slug) AS rank FROM w JOIN st USING (list_id) WHERE tf > 0 QUALIFY rank <= 20),
f AS (SELECT slug, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list_id) AS fl, arg_min(rank, list_id) AS fr FROM k GROUP BY slug),
o AS (SELECT slug, row_number() OVER (ORDER BY score DESC, fl, fr, slug) AS rank FROM f QUALIFY rank <= 12),
b AS (SELECT slug, rank, round((1 + 0.1 * ln(least(access_count, 100) + 1)) * CASE WHEN status = 'archived' THEN 0.7 ELSE 1.0 END, 6) AS boost FROM o JOIN radar USING (slug))
SELECT slug, row_number() OVER (ORDER BY boost DESC, rank) AS final_rank FROM b""")
def radar_search_expanded(spark, d):
    """A query and the variants that its expander gives, each a list of its own, fused."""
    o = api.Options(expand=lambda q: [q, "tion", "shed", "more than variants allows"], variants=2)
    return api.radar_search(radar(spark, d), "hand", 12, o).select("slug", F.col("final_rank").cast("long").alias("final_rank"))
