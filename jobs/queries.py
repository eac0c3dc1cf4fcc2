"""The jobs as registered queries: each runs twice into one new folder of the shared one and gives the whole output after the second run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.queries import _BATCH
from lorekeep.sources.shared import shared_dir

from . import archive_messages, retrieval_report


def job1_archive_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and chats of the archive."""
    at = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        archive_messages.run(spark, f"{sf_dir}/conversations.parquet", f"{at}/archive", f"{at}/checkpoint")
    m, c = archive_messages.archived(spark, f"{at}/archive")
    m = m.select(F.lit("message").alias("part"), "chat_id", "message_id", "user", "text", F.lit(1).cast("long").alias("messages"), "tokens")
    none = F.lit(None).cast("string")
    return m.unionByName(c.select(F.lit("chat").alias("part"), "chat_id", none.alias("message_id"), F.col("users").alias("user"), none.alias("text"), F.col("messages").cast("long").alias("messages"), "tokens"))


JOB1 = """
WITH m AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS chat_id, CAST(turn AS VARCHAR) AS message_id, role AS "user", text FROM conversations WHERE text <> ''),
t AS (SELECT *, CAST(length(text) // 4 AS BIGINT) AS tokens FROM m)
SELECT 'message' AS part, chat_id, message_id, "user", text, CAST(1 AS BIGINT) AS messages, tokens FROM t
UNION ALL SELECT 'chat', chat_id, NULL, coalesce(string_agg(DISTINCT "user", ',' ORDER BY "user"), ''), NULL, count(*), CAST(sum(tokens) AS BIGINT) FROM t GROUP BY chat_id
"""


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, report and misses."""
    at = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        retrieval_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", at)
    return retrieval_report.output(spark, at)


_RANKED = _BATCH.replace("round(score, 6), doc_id", "round(score, 12), doc_id").replace("\ntf AS (", "\ntf AS MATERIALIZED (").replace("\npart AS (", "\npart AS MATERIALIZED (")
JOB2 = f"""
WITH {_RANKED}, asked_short AS (SELECT query_id, unnest(ts[1:4]) AS term FROM qf),
sc_short AS (SELECT query_id, doc_id, -sum(p) AS score FROM asked_short JOIN part USING (term) GROUP BY query_id, doc_id),
rk_short AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12), doc_id) AS rank FROM sc_short), rel AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents dc ON contains(dc.text, b.text)),
hits AS (SELECT 'long' AS form, query_id, doc_id, score, rank FROM rk WHERE rank <= 10 UNION ALL SELECT 'short', query_id, doc_id, score, rank FROM rk_short WHERE rank <= 10),
h AS (SELECT hits.*, rel.doc_id IS NOT NULL AS relevant, coalesce(d.source, '') AS shelf FROM hits JOIN documents d USING (doc_id) LEFT JOIN rel ON rel.query_id = hits.query_id AND rel.doc_id = hits.doc_id),
best AS (SELECT item_id AS query_id, min(rank) FILTER (form = 'long') AS l, min(rank) FILTER (form = 'short') AS s FROM benchmark b LEFT JOIN (SELECT * FROM h WHERE relevant) g ON g.query_id = b.item_id GROUP BY item_id),
r AS (SELECT k::INT AS k, round(avg(CASE WHEN l <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS a, round(avg(CASE WHEN s <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS b FROM best, (SELECT unnest([1, 3, 5, 10]) AS k) ks GROUP BY k)
SELECT 'hit' AS part, query_id, doc_id AS key, round(score, 6) AS score, rank, relevant, shelf, form, NULL::INT AS k, NULL::DOUBLE AS long_rate, NULL::DOUBLE AS short_rate, NULL::DOUBLE AS gap, NULL::VARCHAR AS verdict FROM h
UNION ALL SELECT 'report', NULL, NULL, NULL, NULL, NULL, NULL, NULL, k, a, b, round(b - a, 4), CASE WHEN abs(round(b - a, 4)) < 0.005 THEN 'neutral' WHEN b > a THEN 'better' ELSE 'worse' END FROM r
UNION ALL SELECT 'miss', query_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN l IS NULL AND s IS NULL THEN 'both' WHEN l IS NULL THEN 'long' ELSE 'short' END, NULL, NULL, NULL, NULL, NULL FROM best WHERE l IS NULL OR s IS NULL
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_archive_messages": job1_archive_messages, "job2_retrieval_report": job2_retrieval_report}
ORACLES = {"job1_archive_messages": JOB1, "job2_retrieval_report": JOB2}
