"""More registered queries: message hybrids, stored index, vault and bundle searches, zettels, reports, tasks, back-fills, evaluation.

Same form as in queries.py, whose tables they share; importing this module adds them there."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import api
from .functions import text as tx
from .operators import dialect, evaluation, fts, ingest, kg, rank, vector, zettel
from .queries import _ASKED, _BATCH, _COS, _PARSED, _SKEL, _V, FACTS, MESSAGES, ORACLES, QUERIES, RADAR, TERMS, _asked, _bm25_sql, _probe, _skeletons, facts, messages, notes, query, radar, table
from .sources import files
from .sources.shared import shared_dir
from .streaming import ingest as stream

__all__ = ["ORACLES", "QUERIES"]
NOW = "2024-03-01T10:20:30"


def _slugged(m: DataFrame) -> DataFrame:
    return m.withColumn("slug", F.concat_ws(":", "chat_id", "message_id"))


# ---- full text ---------------------------------------------------------------------------------------------------------

# places of a phrase that can't overlap itself, from the lengths of what stands between
_AT = "list_transform(range(1, len(string_split(t, '{p}'))), lambda k: list_sum(list_transform(string_split(t, '{p}')[1:k], lambda x: length(x)))::BIGINT + (k - 1) * {n} + 1)"
_N3 = [("and", 3), ("the", 3), ("ing", 3)]
_NEAR3 = ", ".join(f"{_AT.format(n=n, p=p)} AS p{i}" for i, (p, n) in enumerate(_N3))
_MEET3 = " OR ".join("len(list_filter(p{0}, lambda s: {1})) > 0".format(i, " AND ".join(f"len(list_filter(p{j}, lambda x: x <= s AND s - x <= {_N3[j][1] - 2 + 12})) > 0" for j in range(3) if j != i)) for i in range(3))


@query(f"WITH {RADAR}, w AS (SELECT slug, lower(clsc) AS t FROM radar), q AS (SELECT slug, {_NEAR3} FROM w) SELECT slug FROM q WHERE {_MEET3}")
def fts_near_three(spark, d):
    """Three phrases in any order, 12 trigrams apart at most."""
    from .plans.boolean import parse, predicate

    return radar(spark, d).where(predicate(parse("NEAR(and the ing, 12)"), ["clsc"])).select("slug")


@query(f"WITH {RADAR}, {_bm25_sql('radar', ['slug', 'clsc'], TERMS)} SELECT slug, round(score, 6) AS score FROM bm ORDER BY bm.score, slug LIMIT 20")
def fts_index_search(spark, d):
    """The stored index, written and then searched."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    fts.write_index(radar(spark, d).select("slug", "clsc"), "slug", ["slug", "clsc"], path)
    return fts.search_index(spark, path, "slug", ["slug", "clsc"], TERMS, 20).select("slug", F.round("score", 6).alias("score"))


@query("SELECT path[1:0] || 'src' || regexp_extract(path, 'src([0-9]+)', 1) || '/' || regexp_extract(path, '([0-9]+)\\.md$', 1) AS slug, path, '[[' || regexp_extract(path, '([0-9]+)\\.md$', 1) || ']]' AS wikilink, excerpt, rank FROM (SELECT *, row_number() OVER (ORDER BY path) AS rank FROM (SELECT path, substr(trim(substr(t, greatest(p - 100, 1), p - greatest(p - 100, 1) + length(m) + 100), ' '), 1, 200) AS excerpt FROM (SELECT *, instr(t, m) AS p FROM (SELECT source || '/' || doc_id || '.md' AS path, coalesce(text, '') AS t, regexp_extract(coalesce(text, ''), '(?i)(tion\\.|schen)', 1) AS m FROM documents) a WHERE m <> '') b) c) e WHERE rank <= 30")
def vault_search(spark, d):
    t = table(spark, d, "documents")
    v = t.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("body"))
    return api.ocean_search(v, "tion. schen", 30).select("slug", "path", "wikilink", "excerpt", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {MESSAGES}, {_SKEL}, m AS (SELECT 'fts5' AS source, '' AS slug, substr(text, 1, 200) AS text, false AS available FROM messages WHERE contains(lower(text), 'tion') ORDER BY ts, chat_id, message_id LIMIT 5)
SELECT * FROM m UNION ALL SELECT 'closet:general', regexp_extract(line, '^\\[([^|\\]]*)\\|', 1), line, true FROM skel WHERE contains(lower(line), 'tion')""")
def fts_bridge(spark, d):
    b = _skeletons(spark, d).select(F.lit("general").alias("group"), "line")
    return fts.search_bridge(messages(spark, d), b, "tion").select("source", "slug", "text", "available")


@query("""SELECT doc_id, source || '/' || doc_id AS slug, 0.5 + doc_id % 7 AS score, substr(regexp_replace(t, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), 1, 2000) AS content FROM (SELECT doc_id, source, replace(coalesce(text, ''), '[', '(') AS t FROM documents) z""")
def delegate_parse(spark, d):
    """Output of a search delegate, three blocks a call, parsed back."""
    t = table(spark, d, "documents").select("doc_id", "source", F.replace(F.coalesce("text", F.lit("")), F.lit("["), F.lit("(")).alias("t"))
    block = F.concat(F.lit("["), (F.col("doc_id") % 7 + 0.5).cast("string"), F.lit("] "), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(" -- "), "t", F.lit("\n\n"))
    out = t.groupBy(F.floor(F.col("doc_id") / 3).alias("call")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", block.alias("b")))), lambda x: x["b"]), "").alias("output"))
    r = fts.delegate_results(out, "output")
    return r.select(F.regexp_extract("slug", "([0-9]+)$", 1).cast("long").alias("doc_id"), "slug", "score", "content")


def _message_vectors(spark, d) -> DataFrame:
    """A vector for each message: those of embeddings in turn, by a number that both engines compute."""
    m = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("slug"), ((F.col("conv_id") * 31 + F.col("turn") * 7) % 400).alias("vec_id"))
    return m.join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id").select("slug", "embedding")


_MV = f"{MESSAGES}, {_V}, mv AS (SELECT 'c' || conv_id || ':' || turn AS slug, v.e FROM conversations JOIN v ON v.vec_id = (conv_id * 31 + turn * 7) % 400), ms AS (SELECT *, chat_id || ':' || message_id AS slug FROM messages)"
_L2 = "round(sqrt(list_sum(list_transform(list_zip(e, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6)"


@query(f"WITH {_MV}, s AS (SELECT slug, row_number() OVER (ORDER BY {_L2}, slug) AS rank FROM mv, q) SELECT slug, substr(text, 1, 200) AS clsc, length(text) // 4 AS tokens, 'tg:' || slug AS drawer_path, rank FROM s JOIN ms USING (slug) WHERE rank <= 20 AND text <> ''")
def messages_semantic(spark, d):
    return vector.message_neighbours(_message_vectors(spark, d), messages(spark, d), _probe(spark, d)).select("slug", "clsc", "tokens", "drawer_path", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_MV}, m AS (SELECT ms.* REPLACE (coalesce(text, '') AS text) FROM ms WHERE bot_name = 'bot1'), {_bm25_sql('m', ['text'], ['the', 'tion'])},
l0 AS (SELECT slug, row_number() OVER (ORDER BY score, slug) AS rank FROM bm QUALIFY rank <= 50), l1 AS (SELECT slug, row_number() OVER (ORDER BY {_L2}, slug) AS rank FROM mv JOIN m USING (slug), q QUALIFY rank <= 50),
u AS (SELECT 0 AS l, * FROM l0 UNION ALL SELECT 1, * FROM l1), f AS (SELECT slug, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(l * 1000 + rank) AS fst FROM u GROUP BY slug)
SELECT slug, ts, row_number() OVER (ORDER BY score DESC, fst, slug) AS rank FROM f JOIN m USING (slug) QUALIFY rank <= 10""")
def messages_hybrid(spark, d):
    """Keywords and neighbours of one bot's messages, fused."""
    m = messages(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    hits = api.messages_search(m, "the tion", 10, "bot1", api.Options(knn=True), _message_vectors(spark, d), _probe(spark, d))
    return hits.select("slug", "ts", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {RADAR}, {_MV}, {_bm25_sql('radar', ['slug', 'clsc'], TERMS)}, l0 AS (SELECT slug, row_number() OVER (ORDER BY score, slug) AS rank FROM bm QUALIFY rank <= 20),
l1 AS (SELECT vec_id::VARCHAR AS slug, row_number() OVER (ORDER BY round({_COS}, 6) DESC, vec_id::VARCHAR) AS rank FROM v, q QUALIFY rank <= 20),
l2 AS (SELECT slug, rank FROM (SELECT slug, row_number() OVER (ORDER BY {_L2}, slug) AS rank FROM mv, q) z JOIN ms USING (slug) WHERE rank <= 20 AND text <> ''),
u AS (SELECT 0 AS l, 'fts' AS s, * FROM l0 UNION ALL SELECT 1, 'sem', * FROM l1 UNION ALL SELECT 2, 'msg', * FROM l2),
f AS (SELECT slug, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(l * 1000 + rank) AS fst, string_agg(s, ',' ORDER BY l) AS sources FROM u GROUP BY slug),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, fst, slug) AS rank FROM f QUALIFY rank <= 15),
b AS (SELECT o.*, CASE WHEN r.slug IS NULL THEN 1.0 ELSE round((1 + 0.1 * ln(least(access_count, 100) + 1)) * CASE WHEN status = 'archived' THEN 0.7 ELSE 1.0 END, 6) END AS boost FROM o LEFT JOIN radar r USING (slug)),
k AS (SELECT slug, sources, row_number() OVER (ORDER BY boost DESC, rank) AS final_rank FROM b) SELECT k.* FROM k WHERE slug IN (SELECT slug FROM radar UNION ALL SELECT slug FROM ms)""")
def radar_search_three_lists(spark, d):
    """Keywords, neighbours among index lines and among messages."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("slug"), "embedding")
    r = api.radar_search(radar(spark, d), " ".join(TERMS), 15, api.Options(knn=True), e, _probe(spark, d), messages(spark, d), _message_vectors(spark, d))
    return r.select("slug", F.array_join("sources", ",").alias("sources"), F.col("final_rank").cast("long").alias("final_rank"))


@query(f"WITH {_V}, s AS (SELECT vec_id, round({_COS}, 6) AS score, row_number() OVER (ORDER BY round({_COS}, 6) DESC, vec_id) AS rank FROM v, q) SELECT vec_id, rank, label FROM s JOIN embeddings USING (vec_id) WHERE rank <= 25 AND label <> 3")
def vec_with_meta(spark, d):
    """Neighbours with metadata in their order; those without (label 3 here) are dropped."""
    e = table(spark, d, "embeddings")
    hits = vector.knn(e, "vec_id", "embedding", _probe(spark, d), 25).select("vec_id", "rank")
    return vector.with_meta(hits, e.where("label <> 3").select("vec_id", "label"), "vec_id").select("vec_id", F.col("rank").cast("long").alias("rank"), "label")


@query(f"WITH {_V}, c AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM v WHERE vec_id % 9 = 0 QUALIFY rank <= 30), k AS (SELECT c.vec_id, c.rank, CASE WHEN c.vec_id % 2 = 0 THEN sqrt(list_sum(list_transform(list_zip(e, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) END AS dd FROM c JOIN v USING (vec_id), q) SELECT vec_id, round(coalesce(dd, max(dd) OVER () + 1), 6) AS distance FROM k")
def vec_rerank(spark, d):
    """Candidates by exact distance; those without a vector last."""
    e = table(spark, d, "embeddings")
    c = e.where("vec_id % 9 = 0").orderBy("vec_id").limit(30).select("vec_id").withColumn("rank", F.row_number().over(Window.orderBy("vec_id")))
    return vector.rerank(c, e.where("vec_id % 2 = 0"), "vec_id", "embedding", _probe(spark, d)).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_V}, pl AS (SELECT b, list_transform(range(0, 64), lambda i: CASE WHEN ((i * 104729 + b * 1299709 + (i + 1) * (b + 3) * 5 * 31) % 1000003) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS r FROM range(0, 128) y(b)), s AS (SELECT vec_id, count(*) FILTER ((list_dot_product(e, r) > 0) <> (list_dot_product(q, r) > 0)) AS distance FROM v, pl, q GROUP BY vec_id) SELECT vec_id, distance::INT AS distance, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM s QUALIFY rank <= 20")
def vec_simhash_single(spark, d):
    """Plain Hamming neighbours of one table of 128 portable bits."""
    r = vector.simhash_knn(table(spark, d, "embeddings"), "vec_id", "embedding", _probe(spark, d), 20, 128, "hash")
    return r.select("vec_id", "distance", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_V} SELECT vec_id, len(e) AS dim, vec_id % 3 <> 0 AS fresh FROM v WHERE vec_id % 3 <> 0")
def vec_embed_new(spark, d):
    """Texts without a vector get one from an embedder (here: their stored vector's own numbers), with fingerprints."""
    e = table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ").alias("text"))
    got = ingest.embed_new(e, "vec_id", "text", e.where("vec_id % 3 = 0"), lambda ts: [[float(x) for x in t.split()] for t in ts])
    return got.select("vec_id", F.size("embedding").cast("long").alias("dim"), (F.size("fp") == 8).alias("fresh"))


# ---- graph and sets ----------------------------------------------------------------------------------------------------


@query("""SELECT lower('U' || user_id) AS id, 'U' || user_id AS name, 'user' AS type, '{"n":"' || count(*) || '"}' AS properties FROM events GROUP BY user_id
UNION ALL SELECT DISTINCT 'k' || regexp_extract(props, '([0-9]+)', 1), 'k' || regexp_extract(props, '([0-9]+)', 1), 'unknown', '{}' FROM events""")
def kg_add_entities(spark, d):
    """Users replace the entities that their facts made; objects stay."""
    f = facts(spark, d)
    old = kg.entities_of(f).withColumn("type", F.lit("unknown")).withColumn("properties", F.lit("{}")).withColumn("created_at", F.lit("2024-01-01"))
    new = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("name"), F.lit("user").alias("type"), F.create_map(F.lit("n"), F.col("n").cast("string")).alias("properties"))
    return kg.add_entities(old, new, NOW).select("id", "name", "type", "properties")


@query(f"WITH {FACTS} SELECT DISTINCT subject AS id FROM facts UNION SELECT DISTINCT object FROM facts")
def set_union_distinct(spark, d):
    f = facts(spark, d)
    return f.select(F.col("subject").alias("id")).union(f.select("object")).distinct()


@query(f"WITH {RADAR} SELECT slug, status FROM radar WHERE slug IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'purchase')")
def slugs_in(spark, d):
    """Rows of slugs that another table names: a semi join."""
    named = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("slug"))
    return radar(spark, d).join(named, "slug", "left_semi").select("slug", "status")


# ---- vault, bundles, slugs ---------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE length(coalesce(text, '')) END AS n FROM documents WHERE doc_id % 2 = 0")
def drawer_lookup(spark, d):
    """Files of slugs, null where there is none."""
    t = table(spark, d, "documents").withColumn("slug", F.col("doc_id").cast("string"))
    f = t.where("doc_id % 5 <> 0").select(F.concat(F.lit("/v/"), "source", F.lit("/"), "slug", F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("body"))
    return files.drawers(t.where("doc_id % 2 = 0"), f).select(F.col("slug").cast("long").alias("doc_id"), F.length("body").cast("long").alias("n"))


@query(f"""WITH {_SKEL}, {_PARSED}, pk AS (SELECT *, list_filter(keys, lambda x: trim(x, ' ') <> '') AS ks, array_to_string(list_filter(string_split(entities, ','), lambda x: x <> ''), '、') AS es FROM ps),
na AS (SELECT doc_id, '關於「' || title || '」' || CASE WHEN es <> '' THEN '：主要涉及 ' || es ELSE '' END || CASE WHEN len(ks) > 0 THEN '。' || array_to_string(ks, '。') ELSE '' END || '。' AS narrative FROM pk)
SELECT m AS mode, d.doc_id, md5(CASE WHEN m = 'verbatim' OR d.doc_id % 4 = 0 THEN CASE WHEN d.doc_id % 6 = 0 THEN '[drawer not found for ' || d.doc_id || ']' ELSE coalesce(text, '') END WHEN m = 'skeleton' THEN line ELSE narrative END) AS text_md5
FROM documents d JOIN skel USING (doc_id) JOIN na USING (doc_id), (SELECT unnest(['verbatim', 'skeleton', 'narrative']) AS m) x""")
def wiki_summary(spark, d):
    """Three modes; a quarter of the notes has no index line, a sixth no file."""
    t = table(spark, d, "documents").withColumn("slug", F.col("doc_id").cast("string"))
    f = t.where("doc_id % 6 <> 0").select(F.concat(F.lit("/v/"), "slug", F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("body"))
    b, out = _skeletons(spark, d).where("doc_id % 4 <> 0").select("line"), None
    for mode in ("verbatim", "skeleton", "narrative"):
        r = api.wiki_summary(b, files.drawers(t, f), t, mode).select(F.lit(mode).alias("mode"), F.col("slug").cast("long").alias("doc_id"), F.md5(F.encode("text", "utf-8")).alias("text_md5"))
        out = r if out is None else out.unionByName(r)
    return out


@query(f"WITH {RADAR} SELECT slug, 'sonar' AS mode, md5(clsc) AS text_md5 FROM radar WHERE slug = '7' UNION ALL SELECT slug, 'verbatim', md5('full ' || slug) FROM radar WHERE slug = '8'")
def point_lookup(spark, d):
    """One row's short and full text; a slug that leads elsewhere gives none."""
    r = radar(spark, d).withColumn("content", F.concat(F.lit("full "), "slug"))
    one = lambda slug, mode: api.seabed_get(r, slug, mode).select("slug", F.lit(mode).alias("mode"), F.md5(F.encode("text", "utf-8")).alias("text_md5"))
    return one("7", "sonar").unionByName(one("8", "verbatim")).unionByName(one("../7", "sonar"))


@query("""SELECT page_id, 'pages/' || page_id || '-x/a-b' AS slug, 'A B' AS name, page_id % 2 = 0 AS inside, CASE WHEN page_id % 3 = 0 THEN 'docs-release-note' WHEN page_id % 3 = 1 THEN 'docs-pdf' ELSE 'raw' END AS grp,
'file:' || CASE page_id % 3 WHEN 0 THEN 'changelog' WHEN 1 THEN 'my-file-' || page_id ELSE 'data' END || '-' || right(md5(CASE page_id % 3 WHEN 0 THEN '/x/CHANGELOG.md' WHEN 1 THEN '/x/My File (' || page_id || ').pdf' ELSE '/x/data.csv' END), 6) AS file_slug FROM pages""")
def path_slugs(spark, d):
    """Slugs and names of vault paths, the gate that keeps paths inside, groups and slugs of files."""
    p = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("i"))
    path = F.concat(F.lit("/vault/Pages/"), "i", F.lit("  X/A b.md"))
    gate = F.concat(F.lit("/vault/x/./"), "i", F.when(F.col("page_id") % 2 == 0, "/../y").otherwise("/../../../etc"))
    file = F.when(F.col("page_id") % 3 == 0, "/x/CHANGELOG.md").when(F.col("page_id") % 3 == 1, F.concat(F.lit("/x/My File ("), "i", F.lit(").pdf"))).otherwise("/x/data.csv")
    slug = tx.path_slug(path, "/vault")
    return p.select("page_id", slug.alias("slug"), tx.display_name(slug).alias("name"), tx.under_root(gate, "/vault").alias("inside"), tx.file_group(file).alias("grp"), tx.file_slug(file).alias("file_slug"))


@query("SELECT 'pearl:' || doc_id AS name, 'SKILL' AS section FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT 's' || doc_id, 'USAGE' FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT 's' || doc_id, 'SKILL' FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id::VARCHAR, 'SKILL' FROM documents WHERE doc_id % 4 = 2")
def skill_list(spark, d):
    """Bundles, plain files and pearls, each name and section once."""
    t, i = table(spark, d, "documents"), F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/k/pearl/"), i, F.lit(".md"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("/k/"), i, F.lit(".md"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("/k/s"), i, F.lit("/SKILL.md"))).otherwise(F.concat(F.lit("/k/.hidden/"), i, F.lit(".md")))
    f = t.select(path.alias("path"), F.lit("x").alias("body"))
    f = f.unionByName(f.where(F.col("path").endswith("SKILL.md")).withColumn("path", F.replace("path", F.lit("SKILL.md"), F.lit("USAGE.md")))).unionByName(f)
    return files.skills(f).select("name", "section")


@query(f"WITH {MESSAGES} SELECT bot_name, ts, source, chat_id, \"user\", message_id, text FROM messages")
def inbox_parse(spark, d):
    """Messages as the inbox's JSON files, parsed back; a broken file gives none."""
    m = messages(spark, d)
    body = F.to_json(F.struct(F.struct(F.col("text").alias("content"), F.struct("source", "chat_id", "user", "message_id", "ts").alias("meta")).alias("params")))
    f = m.select(F.concat(F.lit("/d/state/"), "bot_name", F.lit("/inbox/messages/1.json")).alias("path"), body.alias("body"))
    return files.inbox(f.unionByName(f.limit(1).withColumn("body", F.lit("{broken"))))


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'shared' WHEN 1 THEN 'amy' ELSE 'zed' END AS bot_name, doc_id || '.md' || chr(10) || coalesce(text, '') AS text FROM documents")
def memory_parse(spark, d):
    """Memory notes of three project directories."""
    t = table(spark, d, "documents")
    project = F.when(F.col("doc_id") % 3 == 0, "-home-claude-bots").when(F.col("doc_id") % 3 == 1, "-x-claude-bots-bots-amy").otherwise("-y-zed")
    f = t.select(F.concat(F.lit("/d/projects/"), project, F.lit("/memory/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.to_timestamp(F.lit(NOW)).alias("modified"), F.coalesce("text", F.lit("")).alias("body"))
    return files.memory_notes(f).select("bot_name", "text")


# ---- zettels -----------------------------------------------------------------------------------------------------------

CODES, SKIP = {"Bob": "BOB"}, ["system"]


def zettels(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as zettel files, a zettel for each turn."""
    c = table(spark, d, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    i = F.concat_ws("-", F.lit("z"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    tone = F.when(F.col("turn") % 3 == 0, F.array(F.lit("joy"), F.lit("fear"))).when(F.col("turn") % 3 == 1, F.array(F.lit("raw_grief"), F.lit("gratitude"), F.lit("serenity"))).otherwise(F.array().cast("array<string>"))
    z = F.struct(
        i.alias("id"), F.concat(F.lit("T - "), F.substring("t", 1, 60)).alias("title"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("He said: "), "t", F.lit(' "'), F.substring("t", 3, 30), F.lit('"'))).otherwise("").alias("content"),
        F.when(F.col("turn") % 5 == 0, "a Core pivot").otherwise("").alias("notes"), F.when(F.col("conv_id") % 7 == 0, "Genesis").otherwise("").alias("origin_label"), ((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0)).alias("origin_moment"),
        F.when(F.col("conv_id") % 11 == 0, "maximum").when(F.col("conv_id") % 11 == 1, "low").otherwise("").alias("sensitivity"), F.array(F.col("role"), F.lit("Bob Stone")).alias("people"), F.array(F.lit("x"), F.col("role")).alias("topics"),
        (F.col("turn") % 10 / 10.0).cast("double").alias("emotional_weight"), tone.alias("emotional_tone"), F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit(", noon")).alias("date_context"),
    )
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", z.alias("z")))), lambda x: x["z"]).alias("zettels"))
    tunnel = F.array(F.struct(F.concat(F.lit("z-"), F.col("conv_id").cast("string"), F.lit("-0")).alias("from"), F.lit("z-1-1").alias("to"), F.when(F.col("conv_id") % 2 == 0, "echo: of it").otherwise("a label that is longer than thirty characters").alias("label")))
    return g.select(F.concat(F.lit("file_"), F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.lit(".json")).alias("file"), F.concat(F.col("conv_id").cast("string"), F.lit("-talk.txt")).alias("source_file"), F.when(F.col("conv_id") % 2 == 0, "calm").otherwise("").alias("emotional_arc"), "zettels", tunnel.alias("tunnels"))


_PTS = " + ".join(f"CASE WHEN contains(lower(q), '{w}') THEN 2 ELSE 0 END" for w in zettel.MOVING)
_RX = [r.replace("'", "''") for r in zettel.QUOTES]
_ZET = f"""z0 AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
z1 AS (SELECT *, 'T - ' || substr(t, 1, 60) AS title, CASE WHEN turn % 2 = 0 THEN 'He said: ' || t || ' "' || substr(t, 3, 30) || '"' ELSE '' END AS content, CASE WHEN turn % 5 = 0 THEN 'a Core pivot' ELSE '' END AS notes, CASE WHEN conv_id % 7 = 0 THEN 'Genesis' ELSE '' END AS ol FROM z0),
z2 AS (SELECT *, content || ' ' || ol || ' ' || notes AS every FROM z1),
q0 AS (SELECT conv_id, turn, unnest(qs) AS q, generate_subscripts(qs, 1) AS i FROM (SELECT conv_id, turn, list_filter(list_transform(list_concat(list_concat(regexp_extract_all(every, '{_RX[0]}', 1), regexp_extract_all(every, '{_RX[1]}', 1)), regexp_extract_all(every, '{_RX[2]}', 1)), lambda x: trim(x, ' ')), lambda x: length(x) >= 8) AS qs FROM z2) a),
q1 AS (SELECT *, CASE WHEN regexp_matches(q, '^\\p{{Lu}}') THEN 2 ELSE 0 END + {_PTS} + CASE WHEN length(q) > 20 THEN 1 ELSE 0 END - CASE WHEN regexp_matches(q, '^(The|This|She) ') THEN 2 ELSE 0 END AS p FROM q0),
q2 AS (SELECT * FROM q1 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY p DESC, i) = 1),
z3 AS (SELECT z2.*, coalesce(q, substr(title, 5, 45)) AS quote, concat_ws('+', CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN 'ORIGIN' END, CASE WHEN conv_id % 11 = 0 THEN 'SENSITIVE' END, CASE WHEN notes <> '' THEN 'CORE' END, CASE WHEN ol <> '' THEN 'GENESIS' END, CASE WHEN notes <> '' THEN 'PIVOT' END) AS fl,
  CASE role WHEN 'user' THEN 'BOB+USE' WHEN 'assistant' THEN 'ASS+BOB' ELSE 'BOB' END AS codes, (turn % 10 / 10.0)::DOUBLE AS w FROM z2 LEFT JOIN q2 USING (conv_id, turn)),
zl AS (SELECT *, concat_ws('|', turn || ':' || codes, 'x_' || role, CASE WHEN quote <> '' THEN '"' || quote || '"' END, w::VARCHAR, CASE turn % 3 WHEN 0 THEN 'joy+fear' WHEN 1 THEN 'grief+grat+sere' END, nullif(fl, '')) AS line FROM z3)"""


@query(f"WITH {_ZET} SELECT conv_id, turn, line FROM zl")
def zettel_encode(spark, d):
    z = zettels(spark, d).select(F.explode("zettels").alias("z"))
    part = lambda i: F.split("z.id", "-")[i].cast("long")
    return z.select(part(1).alias("conv_id"), part(2).alias("turn"), zettel.encode(F.col("z"), CODES, SKIP).alias("line"))


@query(f"""WITH {_ZET}, ppl AS (SELECT conv_id, string_agg(c, '+' ORDER BY c) AS ppl FROM (SELECT DISTINCT conv_id, unnest(string_split(codes, '+')) AS c FROM zl) a GROUP BY conv_id)
SELECT 'file_' || lpad(conv_id::VARCHAR, 6, '0') || '.json' AS file, conv_id || '|' || any_value(ppl) || '|2024-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') || ', noon|talk' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'ARC:calm' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY turn) || chr(10)
  || 'T:0<->1|' || CASE WHEN conv_id % 2 = 0 THEN 'echo' ELSE substr('a label that is longer than thirty characters', 1, 30) END || chr(10) || '---' AS text FROM zl JOIN ppl USING (conv_id) GROUP BY conv_id""")
def zettel_files(spark, d):
    return zettel.compress_all(zettels(spark, d), CODES, SKIP)


_L1 = f"""{_ZET}, es AS (SELECT '2024-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') AS day, row_number() OVER (PARTITION BY conv_id % 28 ORDER BY w DESC, lpad(conv_id::VARCHAR, 6, '0'), turn)::INT AS position,
  concat_ws('|', codes, nullif(substr(title, 5, 30), ''), CASE WHEN quote <> '' AND quote <> substr(title, 5, 30) AND quote <> title THEN '"' || quote || '"' END, CASE WHEN conv_id % 11 = 1 THEN 'SENSITIVE' END, w::VARCHAR, nullif(fl, '')) AS line
  FROM zl WHERE w >= 0.85 OR (turn = 0 AND conv_id % 3 = 0) OR regexp_matches(fl, 'ORIGIN|CORE|GENESIS'))"""


@query(f"""WITH {_L1}, td AS (SELECT row_number() OVER (ORDER BY lpad(conv_id::VARCHAR, 6, '0'))::INT AS position, CASE WHEN conv_id % 2 = 0 THEN 'echo' ELSE substr('a label that is longer than thirty characters', 1, 40) END AS line FROM (SELECT DISTINCT conv_id FROM conversations) a QUALIFY position <= 8)
SELECT 0 AS part, '' AS day, i::INT AS position, line FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i, unnest(['## LAYER 1 -- ESSENTIAL STORY', '## Auto-generated from zettel files. Updated 2024-03-01.', '', '=SELF=', 'me', '']) AS line) h
UNION ALL SELECT 1, day, position, line FROM es UNION ALL SELECT DISTINCT 1, day, 0, '=MOMENTS[' || day || ']=' FROM es UNION ALL SELECT DISTINCT 1, day, 2147483647, '' FROM es
UNION ALL SELECT 2, '', position, line FROM td UNION ALL SELECT 2, '', 0, '=TUNNELS=' UNION ALL SELECT 2, '', 9, ''""")
def zettel_layer_one(spark, d):
    return zettel.layer_one(zettels(spark, d), NOW[:10], {"SELF": ["me"]}, codes=CODES, skip=SKIP)


@query("""WITH c AS (SELECT DISTINCT role, upper(substr(role, 1, 3)) AS t FROM conversations UNION SELECT 'usher', 'USH' UNION SELECT 'useful', 'USE' UNION SELECT 'used', 'USE')
SELECT role AS name, upper(substr(role, 1, 2 + row_number() OVER (PARTITION BY t ORDER BY role)::INT)) AS code FROM c""")
def entity_registry(spark, d):
    """Codes of names, longer where shorter ones are taken."""
    n = table(spark, d, "conversations").select(F.col("role").alias("name")).union(spark.createDataFrame([("usher",), ("useful",), ("used",)], "name string")).distinct()
    return zettel.assigned_codes(n).select("name", "code")


@query(f"WITH {_ZET} SELECT conv_id, turn, line FROM zl")
def zettel_decode(spark, d):
    """Files encoded, then decoded to their zettel lines."""
    text = F.regexp_replace("text", "\n---$", "")
    r = zettel.compress_all(zettels(spark, d), CODES, SKIP).select(F.regexp_extract("file", "_0*([0-9]+)", 1).cast("long").alias("conv_id"), dialect.decode(F.regexp_replace(text, "\n(?![0-9]+:[A-Z?+]+\\||T:|ARC:)", "\\\\n")).alias("r"))
    line = F.explode("r.zettels").alias("line")
    return r.select("conv_id", line).select("conv_id", F.regexp_extract("line", "^([0-9]+):", 1).cast("long").alias("turn"), F.regexp_replace("line", "\\\\n", "\n").alias("line"))


# ---- reports, tasks, back-fills ----------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT doc_id, substr('Report on ' || source || ': "' || lang || '"', 1, 60) AS title, coalesce(text, '') AS content, CASE WHEN doc_id % 9 = 0 THEN 'Bad Group' ELSE 'g-' || doc_id % 5 END AS grp, CASE WHEN doc_id % 4 = 0 THEN 'Not Plain' ELSE 'bot_1' END AS bot, CASE WHEN doc_id % 2 = 0 THEN 7 END AS ttl FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id <> a.doc_id AND b.text = a.text)),
s AS (SELECT *, '2024-03-01-1020-' || regexp_replace(regexp_replace(title, '[^\\pL\\pN_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY grp, slug ORDER BY content, doc_id) AS n FROM s)
SELECT grp AS "group", CASE WHEN doc_id % 9 = 0 THEN 'INVALID_GROUP' WHEN n > 101 THEN 'SLUG_COLLISION' ELSE 'OK' END AS code, slug || CASE WHEN n > 1 THEN '-dup' || (n - 1) ELSE '' END AS name, octet_length(encode(content)) AS size_bytes, CASE WHEN ttl IS NOT NULL THEN '2024-03-08T10:20:30Z' END AS expires_at,
CASE WHEN doc_id % 9 <> 0 AND n <= 101 THEN md5('---' || chr(10) || 'type: subagent-report' || chr(10) || 'created: 2024-03-01T18:20:30+08:00' || chr(10) || 'bot: ' || CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE bot END || chr(10) || 'group: ' || grp || chr(10) || 'title: "' || replace(title, '"', '\\"') || '"' || chr(10)
  || 'size_bytes: ' || octet_length(encode(content)) || chr(10) || 'tokens_estimate: ' || length(content) // 4 || chr(10) || 'expires_at: ' || CASE WHEN ttl IS NOT NULL THEN '"2024-03-08T10:20:30Z"' ELSE 'null' END || chr(10) || 'source: report_store' || chr(10) || '---' || chr(10) || chr(10) || content) END AS text_md5 FROM n""")
def report_store(spark, d):
    """Documents as reports (those whose text is no other's, so that names are settled by content)."""
    t = table(spark, d, "documents")
    alone = t.groupBy("text").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id")).where("c = 1 or text is null").select("doc_id")
    t = t.join(alone, "doc_id", "left_semi")
    r = t.select(
        F.concat(F.lit("Report on "), "source", F.lit(': "'), "lang", F.lit('"')).alias("title"), F.coalesce("text", F.lit("")).alias("content"), F.when(F.col("doc_id") % 9 == 0, "Bad Group").otherwise(F.concat(F.lit("g-"), (F.col("doc_id") % 5).cast("string"))).alias("group"),
        F.when(F.col("doc_id") % 4 == 0, "Not Plain").otherwise("bot_1").alias("bot"), F.when(F.col("doc_id") % 2 == 0, 7).alias("ttl_days"),
    )
    return api.report_store(r, NOW).select("group", "code", "name", "size_bytes", "expires_at", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


@query("""WITH x AS (SELECT conv_id, turn, 'Do_it: ' || role || ' /' || conv_id AS title, CASE WHEN turn % 4 = 0 THEN 'nobody' ELSE 'Amy' END AS who, CASE WHEN turn % 5 = 0 THEN 'normal' ELSE 'high' END AS pr, coalesce(text, '') AS descr FROM conversations),
y AS (SELECT *, '20240301-102030-' || substr(md5(title || '|' || who || '|' || descr), 1, 4) AS task_id FROM x)
SELECT conv_id, turn, task_id, CASE WHEN turn % 4 = 0 THEN 'INVALID_ASSIGNEE' WHEN turn % 5 = 0 THEN 'INVALID_PRIORITY' ELSE 'OK' END AS code, task_id || '-' || regexp_replace(substr(regexp_replace(translate(lower(title), ' /_', '---'), '[^\\pL\\pN-]', '', 'g'), 1, 40), '^-+|-+$', '', 'g') || '.json' AS filename,
CASE WHEN turn % 2 = 0 THEN 'in_progress' ELSE 'pending' END AS status, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END::INT AS steps, length(descr) AS n FROM y""")
def task_create(spark, d):
    """Tasks from turns; half of them move on by one state."""
    c = table(spark, d, "conversations")
    t = c.select("conv_id", "turn", F.concat(F.lit("Do_it: "), "role", F.lit(" /"), F.col("conv_id").cast("string")).alias("title"), F.when(F.col("turn") % 4 == 0, "nobody").otherwise("Amy").alias("assigned_to"), F.when(F.col("turn") % 5 == 0, "normal").otherwise("high").alias("priority"), F.coalesce("text", F.lit("")).alias("description"))
    t = api.task_create(t, ["amy"], NOW)
    moved = ingest.advance(t.where("turn % 2 = 0"), "in_progress", NOW).unionByName(t.where("turn % 2 <> 0"))
    spec = F.get_json_object("task", "$.spec.description")
    return moved.select("conv_id", "turn", "task_id", "code", "filename", "status", F.size("history").alias("steps"), F.length(spec).cast("long").alias("n"))


@query(f"""WITH {MESSAGES}, a AS (SELECT * FROM messages WHERE message_id::INT % 2 = 0), b AS (SELECT * FROM messages WHERE message_id::INT % 3 = 0), s AS (SELECT * FROM messages WHERE bot_name = 'bot2')
SELECT 'inbox' AS source, (SELECT count(*) FROM a) AS scanned, (SELECT count(*) FROM a WHERE text <> '' AND bot_name <> 'bot2') AS inserted UNION ALL SELECT 'relay', (SELECT count(*) FROM b), (SELECT count(*) FROM b WHERE text <> '' AND bot_name <> 'bot2' AND message_id::INT % 2 <> 0) UNION ALL SELECT 'memory', 0, 0""")
def ingest_backfill(spark, d):
    """Counts by source of a dry run over three sources that overlap, one of them empty."""
    m, i = messages(spark, d), F.col("message_id").cast("int")
    seen = ingest.message_key(m.where("bot_name = 'bot2'")).select("key")
    return ingest.backfill({"inbox": m.where(i % 2 == 0), "relay": m.where(i % 3 == 0), "memory": m.limit(0)}, seen)[1]


_RAD = "SELECT CAST(doc_id AS VARCHAR) AS slug, coalesce(text, '') AS clsc, '/f/' || doc_id AS drawer_path, doc_id % 37 AS access_count FROM documents"


def _stored(spark, d) -> DataFrame:
    r = radar(spark, d).withColumn("drawer_path", F.concat(F.lit("/f/"), "slug")).withColumn("tokens", tx.tokens(F.col("clsc")))
    return r.withColumn("source_hash", F.lit(None).cast("string")).withColumn("encoded_at", F.lit("2024-01-01"))


@query(f"""WITH r AS ({_RAD}), o AS (SELECT slug, clsc, drawer_path, access_count, '2024-01-01' AS encoded_at FROM r WHERE CAST(slug AS BIGINT) % 3 <> 0 UNION ALL SELECT 'n' || slug, 'new ' || clsc, drawer_path, access_count, '{NOW}' FROM r WHERE CAST(slug AS BIGINT) % 3 = 0 UNION ALL SELECT 'x' || slug, 'added', '/g/' || slug, NULL, '{NOW}' FROM r WHERE CAST(slug AS BIGINT) % 5 = 0)
SELECT slug, drawer_path, access_count, length(clsc) // 4 AS tokens, encoded_at, CASE WHEN encoded_at > '2024-02' THEN sha256(clsc) END AS source_hash FROM o""")
def ingest_upsert_path(spark, d):
    """Documents by path: known paths get new slugs and texts, new paths rows."""
    r = _stored(spark, d)
    third, fifth = r.where("cast(slug as bigint) % 3 = 0"), r.where("cast(slug as bigint) % 5 = 0")
    docs = third.select(F.concat(F.lit("n"), "slug").alias("slug"), F.concat(F.lit("new "), "clsc").alias("body"), "drawer_path").unionByName(fifth.select(F.concat(F.lit("x"), "slug").alias("slug"), F.lit("added").alias("body"), F.concat(F.lit("/g/"), "slug").alias("drawer_path")))
    return ingest.upsert_by_path(r, docs, NOW).select("slug", "drawer_path", "access_count", "tokens", "encoded_at", "source_hash")


@query(f"""WITH r AS ({_RAD}) SELECT slug, length(c) // 4 AS tokens, CASE WHEN n THEN sha256(c) END AS source_hash, access_count FROM (SELECT *, CAST(slug AS BIGINT) % 4 = 0 AS n, CASE WHEN CAST(slug AS BIGINT) % 4 = 0 THEN '[' || slug || '|x]' ELSE clsc END AS c FROM r) z""")
def ingest_sonar(spark, d):
    """Index lines by slug: tokens and hash refreshed, other columns kept."""
    r = _stored(spark, d)
    new = r.where("cast(slug as bigint) % 4 = 0").select("slug", F.concat(F.lit("["), "slug", F.lit("|x]")).alias("clsc"), F.lit("/b/wiki.clsc.md").alias("drawer_path"))
    return ingest.upsert_sonar(r, new, NOW).select("slug", "tokens", "source_hash", "access_count")


@query(f"""WITH {_SKEL}, j AS (SELECT regexp_extract(source, '([0-9])$', 1) AS category, raw_tokens, length(line) // 4 AS st FROM skel JOIN documents USING (doc_id))
SELECT category, count(*) AS n, sum(raw_tokens)::BIGINT AS tokens, sum(st)::BIGINT AS short_tokens, round(sum(st) / sum(raw_tokens)::DOUBLE, 4) AS ratio FROM j GROUP BY ROLLUP (category)""")
def ingest_category_report(spark, d):
    n = dialect.encode_notes(files.note(notes(spark, d)), r"[。！？.!?\n]+")
    return ingest.category_report(n.withColumn("group", F.regexp_extract("path", r"([0-9])/[^/]*$", 1)))


@query(f"WITH {RADAR} SELECT slug, CASE WHEN regexp_matches(clsc, '(?i)\\b(task|spec|readme)\\b') OR CAST(slug AS BIGINT) % 6 = 0 THEN substr(clsc, 1, 40) END AS summary FROM (SELECT slug, 'A ' || CASE CAST(slug AS BIGINT) % 4 WHEN 0 THEN 'task' WHEN 1 THEN 'multitask' ELSE '' END || ' ' || clsc AS clsc FROM radar) r")
def ingest_summaries(spark, d):
    """Summaries where the text has a word of procedure or the line such a tag."""
    i = F.col("slug").cast("long")
    r = radar(spark, d).withColumn("content", F.concat(F.lit("A "), F.when(i % 4 == 0, "task").when(i % 4 == 1, "multitask").otherwise(""), F.lit(" "), "clsc")).withColumn("line", F.when(i % 6 == 0, "[x|y] TAG:a,Guide").otherwise("[x|y] TAG:guided"))
    return ingest.write_summaries(r, "content", lambda c: F.substring(c, 1, 40), "line").select("slug", "summary")


@query("SELECT page_id, CASE WHEN length(trim(t, ' ')) < 100 THEN 'EMPTY_CONTENT' ELSE 'OK' END AS code, md5(CASE WHEN length(trim(t, ' ')) >= 100 THEN substr(t, 1, 50000) END) AS body_md5 FROM (SELECT page_id, '| ' || replace(url, ',', ' | ') || ' |' || chr(10) || '|' || repeat(' --- |', 1 + length(url) - length(replace(url, ',', ''))) || chr(10) || '| ' || repeat('x', CAST(page_id % 150 AS INT)) || ' |' AS t FROM pages) z")
def ingest_csv(spark, d):
    """Comma-separated texts as documents."""
    p = table(spark, d, "pages")
    body = files.csv_table(F.concat("url", F.lit("\n"), F.repeat(F.lit("x"), (F.col("page_id") % 150).cast("int"))))
    f = p.select("page_id", F.concat(F.lit("/f/"), F.col("page_id").cast("string"), F.lit(".csv")).alias("path"), F.lit("csv").alias("format"), body.alias("text"), F.lit(None).cast("string").alias("code"))
    r = ingest.documents_of(f)
    return r.select(F.regexp_extract("drawer_path", "([0-9]+)", 1).cast("long").alias("page_id"), "code", F.md5(F.encode("body", "utf-8")).alias("body_md5"))


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def access_windows(spark, d):
    """The window aggregation that the stream runs, over all events."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("slug"))
    r = stream.access_counts(e)
    return r.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), F.col("slug").alias("event_type"), "n")


# ---- evaluation --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50")
def eval_sample(spark, d):
    """A seeded sample, the same in every engine."""
    return evaluation.sample(table(spark, d, "documents"), "doc_id", 50).select("doc_id")


@query(f"""WITH {_BATCH}, rel AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents dc ON contains(dc.text, b.text)), ok AS (SELECT DISTINCT rk.query_id FROM rk JOIN rel ON rk.query_id = rel.query_id AND rk.doc_id = rel.doc_id WHERE rank <= 1)
SELECT query_id FROM qf WHERE query_id NOT IN (SELECT query_id FROM ok) ORDER BY query_id LIMIT 5""")
def eval_misses(spark, d):
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    rel = fts.containing(docs, "doc_id", "text", b.select(F.col("item_id").alias("query_id"), F.col("text").alias("p")))
    return evaluation.misses(fts.bm25_batch(docs, "doc_id", "text", _asked(spark, d), places=6), rel, "doc_id", b.select(F.col("item_id").alias("query_id")), 1)


@query("SELECT doc_id AS query_id, doc_id + 1 AS doc_id, i::INT AS chunk FROM documents, (SELECT unnest([0, 1, 2]) AS i) z WHERE (doc_id + 1) % 3 >= i AND doc_id + 1 <= (SELECT max(doc_id) FROM documents)")
def eval_chunk_relevance(spark, d):
    """All chunks of a relevant document count."""
    t = table(spark, d, "documents").select("doc_id")
    rel = t.select(F.col("doc_id").alias("query_id"), (F.col("doc_id") + 1).alias("doc_id"))
    return evaluation.chunk_relevance(rel, t.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("chunk")), "doc_id")


@query("SELECT conv_id AS query_id, conv_id AS para_id, (turn * 10) // 25 AS chunk FROM conversations WHERE turn * 10 < 100")
def eval_answer_chunks(spark, d):
    """The chunk an answer starts in."""
    c = table(spark, d, "conversations")
    chunks = c.select(F.col("conv_id").alias("para_id")).distinct().select("para_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("chunk")).select("para_id", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * 25).alias("start"), (F.col("chunk") * 25 + 25).alias("end"))
    return files.answer_chunks(chunks, c.select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("para_id"), (F.col("turn") * 10).alias("answer_start")))


@query(f"""WITH {_SKEL}, q AS (SELECT unnest(['tion', 'THE', 'no such thing']) AS query), h AS (SELECT query, text, line, row_number() OVER (PARTITION BY query ORDER BY doc_id::VARCHAR) AS r FROM skel JOIN documents USING (doc_id), q WHERE contains(lower(line), lower(query))),
g AS (SELECT query, sum(length(text) // 4)::BIGINT AS f, sum(length(line) // 4)::BIGINT AS s FROM h WHERE r <= 5 GROUP BY query)
SELECT q.query, coalesce(f, 0) AS full_tokens, coalesce(s, 0) AS short_tokens, CASE WHEN f > 0 THEN round(1 - s / f::DOUBLE, 6) ELSE 0.0 END AS savings FROM q LEFT JOIN g USING (query)""")
def eval_token_savings(spark, d):
    t = table(spark, d, "documents").join(_skeletons(spark, d).select("doc_id", "line"), "doc_id").select(F.col("doc_id").cast("string").alias("slug"), "text", "line")
    return evaluation.token_savings(t, spark.createDataFrame([("tion",), ("THE",), ("no such thing",)], "query string"), "line", "text")


@query("SELECT k::INT AS k, a, b, round(b - a, 4) AS gap, CASE WHEN abs(round(b - a, 4)) < 0.005 THEN 'neutral' WHEN b > a THEN 'better' ELSE 'worse' END AS verdict FROM (SELECT unnest([1, 3, 5]) AS k, unnest([0.5::DOUBLE, 0.7, 0.9]) AS a, unnest([0.6::DOUBLE, 0.701, 0.8]) AS b) z")
def eval_compare(spark, d):
    """Gaps and verdicts of two runs."""
    rows = lambda xs: spark.createDataFrame(pd.DataFrame({"k": [1, 3, 5], "hit_rate": xs}), "k int, hit_rate double")
    return evaluation.compare(rows([0.5, 0.7, 0.9]), rows([0.6, 0.701, 0.8]))


_HAN = "一二三四五六七八九十"


def _han(c: Column) -> Column:
    """Digits of a number as ideographs: CJK text for tables that hold none."""
    return F.translate(c.cast("string"), "0123456789", _HAN)


@query(f"""WITH t AS (SELECT doc_id, translate((doc_id * 7919 + 100000)::VARCHAR, '0123456789', '{_HAN}') || '什麼' AS x FROM documents), w AS (SELECT doc_id, list_filter(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)), lambda g: NOT regexp_matches(g, '什麼|哪|誰|何時|為何|如何|多少|幾')) AS l FROM t)
SELECT doc_id, array_to_string(list_filter(l, lambda g, i: list_position(l, g) = i)[1:12], ',') AS terms FROM w""")
def eval_cjk_terms(spark, d):
    """Three-ideograph windows without question words."""
    t = table(spark, d, "documents").select("doc_id", F.concat(_han(F.col("doc_id") * 7919 + 100000), F.lit("什麼")).alias("x"))
    return t.select("doc_id", F.array_join(evaluation.cjk_terms(F.col("x")), ",").alias("terms"))


@query(f"WITH {RADAR}, u AS (SELECT slug, translate(slug, '0123456789', '{_HAN}') || ' ' || clsc AS clsc, access_count, status FROM radar) SELECT slug, (contains(clsc, '二三')::INT + contains(clsc, '四')::INT) AS match_count FROM u WHERE contains(clsc, '二三') OR contains(clsc, '四') ORDER BY match_count DESC, slug LIMIT 20")
def radar_recall_cjk(spark, d):
    """Short ideograph terms go to substring search."""
    r = radar(spark, d).withColumn("clsc", F.concat(_han(F.col("slug")), F.lit(" "), "clsc"))
    return fts.recall_keywords(r, ["二三", "四"], ["clsc"], "slug", "clsc").select("slug", "match_count")


@query(f"WITH {_ASKED} SELECT query_id, count(*) AS n, min(term) AS first_term FROM asked GROUP BY query_id")
def eval_term_counts(spark, d):
    return _asked(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.min("term").alias("first_term"))


@query(f"WITH {RADAR}, {_bm25_sql('radar', ['slug', 'clsc'], ['hand'])}, a AS (SELECT slug, row_number() OVER (ORDER BY score, slug) AS rank FROM bm QUALIFY rank <= 20), o AS (SELECT slug, rank, CASE WHEN rank = 3 THEN 1 WHEN rank = 1 THEN 2 WHEN rank = 2 THEN 3 ELSE rank END AS r2 FROM a), b AS (SELECT slug, r2, round((1 + 0.1 * ln(least(access_count, 100) + 1)) * CASE WHEN status = 'archived' THEN 0.7 ELSE 1.0 END, 6) AS boost FROM o JOIN radar USING (slug) WHERE r2 <= 5) SELECT slug, row_number() OVER (ORDER BY boost DESC, r2) AS final_rank FROM b")
def radar_search_reranked(spark, d):
    """Query variants and a reranker from the caller: the third candidate first."""
    o = api.Options(rerank=lambda texts: "3", expand=lambda q: [q])
    return api.radar_search(radar(spark, d), "hand", 5, o).select("slug", F.col("final_rank").cast("long").alias("final_rank"))


@query(f"WITH {_V}, n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) + 1e-10 AS m FROM v), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.e, b.e) / (a.m * b.m), 6) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), o AS (SELECT query_id, count(*) FILTER (rank <= 10 AND vec_id % 5 <> 0) / 10.0::DOUBLE AS o FROM r GROUP BY query_id) SELECT round(avg(o), 6) AS mean, min(o) AS min, max(o) AS max, count(*) AS queries FROM o")
def vec_overlap(spark, d):
    """overlap@10 of the exact neighbours with those among four fifths of the vectors."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = vector.knn_batch(e, "vec_id", "embedding", q, 10)
    o = vector.overlap_at_k(exact, vector.knn_batch(e.where("vec_id % 5 <> 0"), "vec_id", "embedding", q, 10), "vec_id", 10)
    return o.select("mean", "min", "max", "queries")


@query(f"WITH {RADAR}, l AS (SELECT slug, row_number() OVER (ORDER BY length(clsc) DESC, slug) AS rank FROM radar QUALIFY rank <= 30), r AS (SELECT l.slug, round(1.0::DOUBLE / (60 + l.rank), 9) AS score FROM l) SELECT slug, row_number() OVER (ORDER BY round(score * boost, 12) DESC, slug) AS final_rank FROM (SELECT r.slug, score, round((1 + 0.1 * ln(least(access_count, 100) + 1)) * CASE WHEN status = 'archived' THEN 0.7 ELSE 1.0 END, 6) AS boost FROM r JOIN radar USING (slug)) z")
def rank_boost_multiply(spark, d):
    """Boost as a factor of the score."""
    r = radar(spark, d)
    top = fts.top(r.withColumn("n", F.char_length("clsc")), [F.col("n").desc(), F.col("slug")], 30)
    b = rank.boosted(rank.fused([rank.ranked(top, "slug", "fts", 0)], 30), r, mode="multiply")
    return b.withColumn("final_rank", F.row_number().over(Window.orderBy(F.round(F.col("score") * F.col("boost"), 12).desc(), "slug")).cast("long")).select("slug", "final_rank")
