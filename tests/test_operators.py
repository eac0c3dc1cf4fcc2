import json
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep import api
from lorekeep.functions import text as tx
from lorekeep.operators import dialect, evaluation, fts, ingest, kg, rank, vector, zettel
from lorekeep.sources import files
from lorekeep.streaming import ingest as stream


def test_kg_closed_intervals_and_directions(spark):
    f = spark.createDataFrame([("1", "amy", "works_at", "old", "2024-01-01", "2025-06-01", 1.0, ""), ("2", "amy", "works_at", "new", "2025-06-01", None, 1.0, ""), ("3", "amy", "likes", "amy", None, None, 1.0, "")], "id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, source_ref string")
    e = kg.entities_of(f)
    on = lambda d: sorted(r["object"] for r in kg.query_entity(f, e, "Amy", d).where("predicate = 'works_at'").collect())
    assert (on("2024-05-05"), on("2025-06-01"), on("2025-06-02")) == (["old"], ["new", "old"], ["new"])
    assert kg.query_entity(f, e, "amy", None, "both").count() == 4
    assert kg.query_entity(f, e, "amy", None, "sideways").count() == 0
    g = kg.add_triples(f, spark.createDataFrame([("Amy", "Works At", "new", None), ("amy", "works at", "old", None)], "subject string, predicate string, object string, valid_from string"), "2026-01-01")
    assert g.count() == 4
    assert kg.invalidate(f, "amy", "likes", "amy", "2026-01-01").where("valid_to = '2026-01-01'").count() == 1
    days = spark.createDataFrame([("2024-05-05",), ("2025-06-01",), ("2023-01-01",)], "day string")
    assert {r["day"]: r["count"] for r in kg.as_of_join(f, days).groupBy("day").count().collect()} == {"2024-05-05": 2, "2025-06-01": 3, "2023-01-01": 1}


def test_rrf_ties_keep_first_appearance(spark):
    mk = lambda xs, i: rank.ranked(spark.createDataFrame([(x, n + 1) for n, x in enumerate(xs)], "slug string, rank int"), "slug", f"s{i}", i)
    got = rank.fused([mk("abc", 0), mk("bad", 1)], 10).orderBy("rank").collect()
    assert [r["slug"] for r in got] == ["a", "b", "c", "d"]
    assert got[0]["sources"] == ["s0", "s1"] and abs(got[0]["score"] - (1 / 61 + 1 / 62)) < 1e-9


def test_permutation_is_one():
    assert rank.parse_permutation("1", 2) == [0, 1]
    assert rank.parse_permutation("3, 1 and 9", 3) == [2, 0, 1]
    assert rank.parse_permutation("", 2) == [0, 1]


@pytest.mark.parametrize("n", [10, 60])
def test_simhash(spark, n):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((n, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    fp = vector.fingerprints(df, "embedding", 2, 128).cache()
    got = vector.coarse(fp, "vec_id", fp.where("vec_id = 0"))
    assert got.count() == min(n, 50) and got.first()["vec_id"] == 0
    r = vector.planes(16, 2, 128)
    bits = np.packbits((x[3].astype(np.float64) @ r[1]) > 0).view(">u8").astype(np.uint64).view(np.int64)
    assert fp.where("vec_id = 3").first()["fp"][1] == bits.tolist()
    exact = [int(i) for i in np.argsort(-(x @ x[0]) / np.linalg.norm(x, axis=1), kind="stable")[:5]]
    assert [r["vec_id"] for r in vector.knn(df, "vec_id", "embedding", x[0].tolist(), 5).collect()] == exact
    same = vector.knn_batch(df, "vec_id", "embedding", df.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5)
    assert vector.overlap_at_k(same, same, "vec_id", 5).first()["mean"] == 1.0


def test_knn_batch_of_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.standard_normal((40, 8)))], "vec_id long, embedding array<float>")
    q = df.where("vec_id < 23").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    want = sorted(map(tuple, vector.knn_batch(df, "vec_id", "embedding", q, 5).collect()))
    monkeypatch.setattr(vector, "MAX_QUERIES", 10)
    assert len(want) == 23 * 5 and sorted(map(tuple, vector.knn_batch(df, "vec_id", "embedding", q, 5).collect())) == want


def test_production_simhash(spark, tmp_path):
    """Queries on 8 x 512 bits against brute force."""
    from lorekeep import queries

    x = np.random.default_rng(2).standard_normal((300, 16)).astype(np.float32)
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    v = x.astype(np.float64)
    bits = np.stack([v @ r > 0 for r in vector.planes(16)], axis=1)
    assert {(r["vec_id"], r["tbl"]): r["bits"] for r in run("vec_simhash512")} == {(i, t): np.packbits(bits[i, t]).tobytes().hex().upper() for i in range(300) for t in range(8)}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    far = lambda j: (bits != bits[j]).sum(axis=2).min(axis=1)
    coarse = lambda j, skip: [int(i) for i in np.lexsort((np.arange(300), far(j))) if not (skip and i == j)][:50]
    best = lambda j, ids: sorted(ids, key=lambda i: (-round(float(unit[i] @ unit[j]), 6), i))[:10]
    assert [(r["vec_id"], r["distance"]) for r in run("vec_simhash512_coarse")] == [(i, far(0)[i]) for i in coarse(0, False)]
    assert [r["vec_id"] for r in run("vec_two_layer512")] == best(0, coarse(0, False))
    share = [len(set(best(j, coarse(j, True))) & set(best(j, [i for i in range(300) if i != j]))) / 10 for j in (0, 100, 200)]
    got = run("vec_simhash512_overlap")[0]
    assert got["queries"] == 3 and abs(got["mean"] - np.mean(share)) < 1e-6 and got["min"] == min(share)


def test_hit_at_k_on_short_and_whole_passages(spark, tmp_path):
    from lorekeep import queries

    start = "the first sixty characters of this passage are shared by others "
    docs = [(1, "some zebra here"), (2, start + "and end with walrus"), (3, start + "but end elsewhere"), (4, None), (5, "nothing of it")]
    asked = [("a", "zebra"), ("b", start + "and end with walrus"), ("c", start + "which no document has"), ("d", None)]
    one = spark.createDataFrame(docs, "doc_id long, text string")
    two = spark.createDataFrame(asked, "item_id string, text string")
    rel = lambda p: {tuple(r) for r in fts.containing(one, "doc_id", "text", two.select(F.col("item_id").alias("query_id"), p.alias("p"))).collect()}
    for cut in (60, 1000):
        assert rel(F.substring("text", 1, cut)) == {(q, i) for q, p in asked for i, t in docs if p is not None and t is not None and p[:cut] in t}
    one.write.parquet(str(tmp_path / "documents.parquet"))
    two.write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda name: {r["k"]: (r["hit_rate"], r["queries"]) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("eval_hit_at_k")[10] == (0.5, 4)


def test_dialect(spark):
    t = "We decided to go because Alice trusted the GraphQL api. " + "x" * 160 + ". Later Bob was worried."
    d = spark.createDataFrame([(1, t), (2, ""), (3, None)], "doc_id int, text string")
    got = {r["doc_id"]: r["line"] for r in dialect.compress(d, "doc_id", "text").collect()}
    assert got[1].startswith("0:ALI+LAT+BOB|") and "determ+anx+trust" in got[1] and "DECISION+TECHNICAL" in got[1]
    assert got[2] == "0:???|misc"
    assert dialect.compress(d, "doc_id", "text", {"Alice": "ALC"}).where("doc_id = 1").first()["line"].startswith("0:ALC|")
    s = dialect.parse_skeleton(F.lit("[note-seven|標題] ENT:a,b KEY:s1|s2 TAG:x,y"))
    r = spark.range(1).select(s.alias("s"), dialect.narrate(s).alias("n")).first()
    assert (r["s"]["slug"], r["s"]["entities"], r["s"]["sentences"], r["s"]["tags"]) == ("note-seven", ["a", "b"], ["s1", "s2"], ["x", "y"])
    assert r["n"] == "關於「標題」：主要涉及 a、b。s1。s2。"
    # rows with null or repeated keys keep a line each, from their own text
    d = spark.createDataFrame([(None, "Alpha alpha beta"), (1, "gamma Gamma gamma"), (1, "delta delta")], "doc_id int, text string")
    assert sorted(r["line"].split("|")[1] for r in dialect.compress(d, "doc_id", "text").collect()) == ["alpha_beta", "delta", "gamma"]
    assert dialect.compress(d.limit(0), "doc_id", "text").count() == 0


def _zettel(**more):
    z = {"id": "z-1", "title": "T - hint", "content": "", "notes": "", "origin_label": "", "origin_moment": False, "sensitivity": "", "people": ["Zoe", "Ann"], "topics": [], "emotional_weight": 0.9, "emotional_tone": [], "date_context": "2024-01-01, dawn"}
    return z | more


def test_zettels(spark):
    rows = [_zettel(), _zettel(id="z-2", notes="core and PIVOT", origin_label="core pivot Genesis", sensitivity="Maximum care", origin_moment=True), _zettel(id="z-3", origin_label="core pivot"), _zettel(id="z-4", content='x "a small quote" then "I love and trust you" said: the real reason was hope. end', people=["hidden one"], topics=["a", "b", "c"], emotional_weight=None, emotional_tone=None)]
    d = spark.createDataFrame([(z,) for z in rows], f"z {zettel.ZETTEL}")
    r = d.select(zettel.encode(F.col("z"), {"Zoe": "ZOX"}, ["hidden"]).alias("l"), zettel.flags(F.col("z")).alias("f")).collect()
    assert [x["f"] for x in r] == ["", "ORIGIN+SENSITIVE+CORE+GENESIS+PIVOT", "", ""]
    assert r[0]["l"] == '1:ANN+ZOX|misc|"hint"|0.9' and r[3]["l"] == '4:???|a_b|"I love and trust you"|0.5'
    f = spark.createDataFrame([("f1.json", "007-the tale.txt", "up", rows[:2], [{"from": "z-1", "to": "z-2", "label": "because: of"}])], f"file string, {zettel.FILE}")
    text = zettel.compress_all(f).first()["text"].split("\n")
    assert text[0] == "007|ANN+ZOE|2024-01-01, dawn|the tale" and text[1] == "ARC:up" and text[4:] == ["T:1<->2|because", "---"]
    one = zettel.as_text(zettel.layer_one(f, "2024-05-05")).first()["text"].split("\n")
    assert one[3] == "=MOMENTS[2024-01-01]=" and one[4] == "ANN+ZOE|hint|0.9" and one[-3:] == ["=TUNNELS=", "because", ""]
    assert [x["code"] for x in zettel.assigned_codes(spark.createDataFrame([("alan",), ("alana",), ("alanis",), ("bo",)], "name string")).orderBy("name").collect()] == ["ALA", "ALAN", "ALANI", "BO"]


def test_notes_and_summaries(spark):
    n = files.note(spark.createDataFrame([("/v/a.md", "---\ntags: x, y,z,w\n---\n# Head\n王小明銀行 met Anna Smith. Anna Smith and Bolt in 台北市。" + "word here again and more。" * 3)], "path string, body string"))
    assert {(x["text"], x["category"]) for x in n.select(dialect.entities(F.col("plain")).alias("e")).first()["e"]} >= {("王小明銀行", "org"), ("Anna Smith", "person"), ("台北市", "place"), ("Bolt", "proper")}
    r = dialect.encode_notes(n).first()
    assert r["skeleton"].startswith("[a|Head] ENT:王小明銀行,Anna Smith,") and r["skeleton"].endswith("TAG:x,y,z") and 0 < r["ratio"] <= 1.5
    b = spark.createDataFrame([("[a|Head] ENT:x KEY:k1|k2",)], "line string")
    drawers = files.drawers(spark.createDataFrame([("a",), ("b",), ("c",)], "slug string"), spark.createDataFrame([("/1/a.md", "A"), ("/2/a.md", "no"), ("/1/b.md", "B")], "path string, body string"))
    ask = lambda mode: {r["slug"]: r["text"] for r in api.wiki_summary(b, drawers, drawers, mode).collect()}
    assert ask("verbatim") == {"a": "A", "b": "B", "c": "[drawer not found for c]"} and ask("skeleton")["a"].startswith("[a|") and ask("narrative") == {"a": "關於「Head」：主要涉及 x。k1。k2。", "b": "B", "c": "[drawer not found for c]"}
    t = spark.createDataFrame([("a multitask", ""), ("see the SOP", ""), ("流程", ""), ("x", "TAG:a,Guide"), ("x", "KEY:guide")], "t string, s string")
    assert [r[0] for r in t.select(ingest.wants_summary(F.col("t"), F.col("s"))).collect()] == [False, True, True, True, False]


def _pack(text, size, after):
    out, cur = [], ""
    for part in [p for p in re.split(f"(?<=[{after}])", text) if p]:
        if len(cur) + len(part) <= size:
            cur += part
            continue
        if cur:
            out.append(cur)
        while len(part) > size:
            out.append(part[:size])
            part = part[size:]
        cur = part
    return out + ([cur] if cur else [])


def test_chunks_equal_plain_packing(spark):
    texts = ["一。二！三？" * 30, "abc", "", "x" * 95 + "。y", "a。" * 7 + "b" * 20 + "。", "z" * 40]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in evaluation.with_offsets(d, "k", "t", 20).orderBy("k", "chunk").collect():
        assert texts[r["k"]][r["start"] : r["end"]] == r["text"]
        got.setdefault(r["k"], []).append(r["text"])
    assert got == {i: c for i, t in enumerate(texts) if (c := _pack(t, 20, "。！？\n"))}


def test_ingest(spark, tmp_path):
    m = spark.createDataFrame([("b", "t1", "s", "c", "u", "1", "x"), ("b", "t0", "s", "c", "u", "1", "w"), ("b", "t2", "s", "c", "u", "2", ""), ("b", "t3", "s", "c", "u", "3", "y")], ", ".join(f"{c} string" for c in files.MESSAGE))
    seen = spark.createDataFrame([("b|s|c|3",)], "key string")
    assert [r["text"] for r in ingest.insert_unseen(m, seen).collect()] == ["w"]
    rows = [("T x", "a", "g-1", "bot1", 7), ("T x", "b", "g-1", "Bad Bot", None), (None, "c", "g", "b", None), ("V", "d", "G!", "b", None), ("W", "x" * (500 * 1024 + 1), "g", "b", None), ("y" * 80 + '"', "e", "g", "b", 0)]
    reports = spark.createDataFrame(rows, "title string, content string, `group` string, bot string, ttl_days int")
    got = {r["content"][:1]: r for r in ingest.check_reports(reports, "2026-01-01T20:00:00").collect()}
    assert {k: r["code"] for k, r in got.items()} == {"a": "OK", "b": "OK", "c": "MISSING_TITLE", "d": "INVALID_GROUP", "x": "CONTENT_TOO_LARGE", "e": "OK"}
    assert (got["a"]["name"], got["b"]["name"], got["b"]["bot"]) == ("2026-01-01-2000-T-x", "2026-01-01-2000-T-x-dup1", "unknown")
    assert got["a"]["expires_at"] == "2026-01-08T20:00:00Z" and got["b"]["expires_at"] is None and "created: 2026-01-02T04:00:00+08:00" in got["a"]["text"]
    assert len(got["e"]["title"]) == 60 and len(got["e"]["name"]) == 16 + 50 and got["x"]["text"] is None
    ingest.write_reports(ingest.check_reports(reports, "2026-01-01T20:00:00"), str(tmp_path / "r"))
    back = {r["path"].split("name=")[1].split("/")[0]: r["body"] for r in files.whole_files(spark, str(tmp_path / "r"), "*.txt").collect()}
    assert len(back) == 3 and back["2026-01-01-2000-T-x"].rstrip("\n") == got["a"]["text"]
    assert ingest.unexpired(ingest.check_reports(reports, "2026-01-01T20:00:00"), "2026-01-05T00:00:00Z").where("code = 'OK'").count() == 2
    many = spark.createDataFrame([("S", f"{i:03}", "g") for i in range(103)], "title string, content string, `group` string").withColumn("ttl_days", F.lit(None).cast("int"))
    assert [r["code"] for r in ingest.check_reports(many, "2026-01-01").orderBy("content").collect()][100:] == ["OK", "SLUG_COLLISION", "SLUG_COLLISION"]
    t = ingest.make_tasks(spark.createDataFrame([("Do it / now_", "Amy", "high"), ("No", "eve", "high"), ("Odd", "amy", "normal")], "title string, assigned_to string, priority string"), ["amy"], "2026-01-01T00:00:00")
    assert [r["code"] for r in t.orderBy("title").collect()] == ["OK", "INVALID_ASSIGNEE", "INVALID_PRIORITY"]
    assert t.first()["filename"].endswith("-do-it---now.json") and json.loads(t.first()["task"])["flow"] == "pending → in_progress → review → done"
    assert ingest.advance(ingest.advance(t, "in_progress", "n"), "done", "n").first()["status"] == "in_progress"
    ingest.write_tasks(t, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).select("title", "status").collect() == [("Do it / now_", "pending")]


def test_gates_and_slugs(spark, tmp_path):
    paths = ["/vault/a/../b.md", "/vault/../etc/passwd", "/vault", "/vaulted/x", "vault/x", "/vault/./x/../../vault/y"]
    d = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in d.select(tx.under_root(F.col("p"), "/vault")).collect()] == [True, False, True, False, False, True]
    (tmp_path / "v").mkdir()
    (tmp_path / "out").write_text("x")
    (tmp_path / "v" / "link").symlink_to(tmp_path / "out")
    with pytest.raises(tx.OutsideRoot):
        tx.resolved_under_root(str(tmp_path / "v" / "link"), str(tmp_path / "v"))
    assert tx.resolved_under_root(str(tmp_path / "v"), str(tmp_path / "v")).endswith("/v")
    s = spark.createDataFrame([("/vault/研究 筆記/My  Note?.md",), ("/else/X y.md",)], "p string").select(tx.path_slug(F.col("p"), "/vault").alias("s"))
    assert [r[0] for r in s.select("s", tx.display_name(F.col("s")).alias("n")).collect()] == ["研究-筆記/my-note-", "/else/x-y-md"]
    a = api.register_aliases(spark.createDataFrame([("a", "/1"), ("b", "/2")], "slug string, path string"), spark.createDataFrame([("b", "/3"), ("c", "/4")], "slug string, path string"))
    assert {tuple(r) for r in a.collect()} == {("a", "/1"), ("b", "/3"), ("c", "/4")}


def test_skills_and_documents(spark, tmp_path):
    k = tmp_path / "k"
    for name, body in {"deploy/SKILL.md": "S", "deploy/USAGE.md": "U", "odd/EXAMPLE.md": "E", "odd/USAGE.md": "V", "plain.md": "P", "pearl/2024-1-x.md": "Q"}.items():
        (k / name).parent.mkdir(parents=True, exist_ok=True)
        (k / name).write_text(body)
    f = files.whole_files(spark, str(k))
    get = lambda *a: (r := files.skill(f, *a).first()) and r["body"]
    assert (get("deploy"), get("deploy", "usage"), get("deploy", "EXAMPLE"), get("plain.md"), get("pearl:2024-1-x"), get("none")) == ("S", "U", "S", "P", "Q", None)
    assert get("odd", "SKILL") == "# USAGE.md\n\nV\n\n---\n\n# EXAMPLE.md\n\nE"
    with pytest.raises(ValueError, match="name"):
        files.skill(f, "../secret")
    box = tmp_path / "in"
    box.mkdir()
    for name, body in {"a.html": "<p>" + "text " * 40 + "</p>", "b.csv": "x,y\n" + "1,2\n" * 30, "c.md": "short", "d.bin": "?" * 200, "e.json": json.dumps({"k": "v" * 150}), "long.txt": "z" * 60_000}.items():
        (box / name).write_text(body)
    r = {x["drawer_path"].rsplit("/", 1)[1]: x for x in api.ingest_file(spark, str(box), [str(box / "a.html"), str(box / "gone.pdf")]).collect()}
    assert {n: x["code"] for n, x in r.items()} == {"a.html": "OK", "b.csv": "OK", "c.md": "EMPTY_CONTENT", "d.bin": "MARKITDOWN_FAIL", "e.json": "OK", "long.txt": "OK", "gone.pdf": "FILE_NOT_FOUND"}
    assert r["b.csv"]["body"].startswith("| x | y |\n| --- | --- |\n| 1 | 2 |") and r["long.txt"]["truncated"] and len(r["long.txt"]["body"]) == 50_000 and r["long.txt"]["group"] == "docs-spec"
    own = api.ingest_file(spark, str(box), converter=lambda content, kind: F.when(kind == "bin", F.decode(content, "utf-8")))
    assert own.where("format = 'bin'").first()["code"] == "OK"


def test_upserts_and_embedding(spark):
    r = spark.createDataFrame([("a", "old", 1, "/a", "h", "t", 5), ("b", "keep", 1, "/b", "h", "t", 6)], "slug string, clsc string, tokens long, drawer_path string, source_hash string, encoded_at string, access_count long")
    d = spark.createDataFrame([("a2", "x" * 8, "/a"), ("c", "y" * 4, "/c")], "slug string, body string, drawer_path string")
    rows = {x["slug"]: x for x in ingest.upsert_by_path(r, d, "n").collect()}
    assert set(rows) == {"a2", "b", "c"} and rows["a2"]["access_count"] == 5 and rows["c"]["access_count"] is None and rows["b"]["clsc"] == "keep"
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "vec_id long, text string").coalesce(1)
    embed = lambda ts: [[float(len(ts)), float(t[1:])] for t in ts]
    first = ingest.embed_new(texts, "vec_id", "text", None, embed, batch=2).collect()
    assert [x["embedding"] for x in first] == [[2, 0], [2, 1], [2, 2], [2, 3], [1, 4]] and len(first[0]["fp"]) == 8
    stored = texts.where("vec_id < 3").select("vec_id")
    assert sorted(x["vec_id"] for x in ingest.embed_new(texts, "vec_id", "text", stored, embed).collect()) == [3, 4] and ingest.embed_new(texts, "vec_id", "text", stored, embed, force=True).count() == 5
    e = kg.add_entities(spark.createDataFrame([("amy", "amy", "unknown", "{}", "t")], "id string, name string, type string, properties string, created_at string"), spark.createDataFrame([("Amy", "person", {"a": "1"}), ("Bo Lee", None, None)], "name string, type string, properties map<string,string>"), "n")
    assert {(x["id"], x["type"], x["properties"]) for x in e.collect()} == {("amy", "person", '{"a":"1"}'), ("bo_lee", "unknown", "{}")}


def test_api_corners(spark):
    m = spark.createDataFrame([("bot1", "t1", "s", "c", "u", "1", "alpha beta"), ("bot2", "t2", "s", "c", "u", "2", "beta gamma"), ("bot1", "t3", "s", "c", "u", "3", None)], ", ".join(f"{c} string" for c in files.MESSAGE))
    r = spark.createDataFrame([("x", "alpha line", 3, "active"), ("y", "beta line", 0, "archived")], "slug string, clsc string, access_count long, status string")
    assert api.search(r, m, "", "all").count() == 0 and api.search(r, m, "alpha", "ocean").count() == 0 and api.search(r, m, "alpha", "nonsense").count() == 0
    assert {(x["source"], x["ref"]) for x in api.search(r, m, "beta").collect()} == {("radar", "y"), ("messages", "c:1"), ("messages", "c:2")}
    v = spark.createDataFrame([("c:1", [1.0, 0.0]), ("c:2", [0.0, 1.0])], "slug string, embedding array<float>")
    near = api.messages_search(m, "zzz", 5, "bot2", api.Options(knn=True, embed=lambda q: [1.0, 0.0]), v)
    assert [x["slug"] for x in near.collect()] == ["c:2"]
    assert api.messages_search(m, "gamma zzz", 5).first()["snippet"] == "beta «gamma»"
    o = spark.createDataFrame([("a/Note One.md", "Some C++ text"), ("b.md", "other")], "path string, body string")
    hit = api.ocean_search(o, "c++").first()
    assert (hit["slug"], hit["title"], hit["wikilink"], hit["source"]) == ("a/note one", "Note One", "[[Note One]]", "bm25")
    told = api.ocean_search(o, "q", 2, api.Options(delegate=lambda q, n: "[0.9] dir/my-note -- # Title\nbody\n[1] x -- \n[2] y -- z")).collect()
    assert [(x["slug"], x["score"], x["title"], x["wikilink"]) for x in told] == [("dir/my-note", 0.9, "Title", "[[My Note]]"), ("x", 1.0, "x", "[[X]]")]

    def down(q, n):
        raise OSError("down")

    assert api.ocean_search(o, "other", 2, api.Options(delegate=down)).first()["path"] == "b.md"
    b = api.seabed_get(r.withColumn("content", F.lit(None).cast("string")), "x", "verbatim", spark.createDataFrame([("x", "the file")], "slug string, body string"))
    assert b.first()["text"] == "the file" and api.seabed_get(r, "../x").count() == 0


def test_sources(spark, tmp_path):
    box = tmp_path / "state" / "bot7" / "inbox"
    box.mkdir(parents=True)
    (box / "3.json.delivered").write_text(json.dumps({"params": {"content": "two\nlines", "meta": {"chat_id": "c", "message_id": "8"}}}, indent=1))
    (box / "1.json").write_text(json.dumps({"params": {"content": "hi", "meta": {"chat_id": "c", "message_id": "9", "ts": "2026-04-15T09:30:00Z"}}}))
    (box / "2.json").write_text("{broken")
    got = files.inbox(files.whole_files(spark, str(tmp_path))).collect()
    assert sorted((r["bot_name"], r["source"], r["text"]) for r in got) == [("bot7", "telegram", "hi"), ("bot7", "telegram", "two\nlines")]
    log = spark.createDataFrame([("f", "orphan\n[t1] a → b (chat:1): one\nmore\n\n[t2] c → d (chat:2): two")], "path string, body string")
    r = files.relay_log(log, "bot").orderBy("ts").collect()
    assert [(x["text"], x["message_id"], x["chat_id"]) for x in r] == [("one\nmore", "2", "1"), ("two", "5", "2")]
    n = files.note(spark.createDataFrame([("/v/a.md", "---\ntags: x, y\ntitle: q: r\n---\n# Head\nbody *b*")], "path string, body string")).first()
    assert (n["title"], n["tags"], n["front"]["title"]) == ("Head", ["x", "y"], "q: r")


def test_stream_ingest_is_idempotent(spark, tmp_path):
    box, out, ck = tmp_path / "state" / "b" / "in", tmp_path / "out", tmp_path / "ck"
    box.mkdir(parents=True)
    put = lambda i: (box / f"{i}.json").write_text(json.dumps({"params": {"content": f"m{i}", "meta": {"chat_id": "c", "message_id": str(i % 2), "ts": str(i)}}}))
    for i in (0, 1, 2):
        put(i)
        stream.ingest(stream.inbox_stream(spark, str(tmp_path / "state")), str(out), str(ck)).awaitTermination(60)
    assert sorted(r["text"] for r in spark.read.parquet(str(out)).collect()) == ["m0", "m1"]


def test_stream_of_logs_and_reencoding(spark, tmp_path):
    logs, out, ck = tmp_path / "logs", tmp_path / "out", tmp_path / "ck"
    logs.mkdir()
    for i, extra in enumerate(("", "\nmore")):
        (logs / f"{i}.log").write_text(f"orphan\n[t{i}] a → b (chat:{i}): one{extra}\n")
        stream.ingest(stream.log_stream(spark, str(logs)), str(out), str(ck), lambda f: files.relay_log(f, "bot")).awaitTermination(60)
    assert sorted(r["text"] for r in spark.read.parquet(str(out)).collect()) == ["one", "one\nmore"]
    notes = lambda *xs: spark.createDataFrame([(f"/v/{n}.md", b) for n, b in xs], "path string, body string")
    t = str(tmp_path / "radar")
    assert sorted(r["slug"] for r in stream.reencode(notes(("a", "# A\nx"), ("b", "# B")), t, "1").collect()) == ["a", "b"]
    assert [(r["slug"], r["clsc"]) for r in stream.reencode(notes(("a", "# A2\nx"), ("b", "# B")), t, "2").collect()] == [("a", "[a|A2] ENT:A2")]
    assert stream.reencode(notes(("a", "# A2\nx"), ("b", "# B")), t, "3").count() == 0


def test_bundles_and_config(spark, tmp_path):
    lines = spark.createDataFrame([("g1", "[a|A] KEY:x"), ("g2", "[b|B]"), ("g1", "no line")], "`group` string, line string")
    files.write_bundle(lines, str(tmp_path / "b"))
    (tmp_path / "b" / "wiki-g3.clsc.md").write_text("[c|C]\nfree text\n")
    got = files.bundle(str(tmp_path / "b"), spark)
    assert sorted(map(tuple, got.collect())) == [("g1", "[a|A] KEY:x"), ("g2", "[b|B]"), ("g3", "[c|C]")] and [r[0] for r in files.groups(got).collect()] == ["g1", "g2", "g3"]
    zettel.save_config(str(tmp_path / "c.json"), {"Alice": "ALC", "alice": "ALC", "Bob": "BOB"}, ["gandalf"])
    assert zettel.load_config(str(tmp_path / "c.json")) == ({"Alice": "ALC", "Bob": "BOB"}, ["gandalf"])


def test_as_of_join_has_no_bounds(spark):
    f = [("1", None, None), ("2", "2024-05-10", "2024-05-20"), ("3", "2190-01-01", None), ("4", None, "1899-12-31"), ("5", "1999-12-31", "2000-01-01"), ("6", "2024-05-31", "2024-06-01")]
    days = [(d,) for d in ("1850-01-01", "1899-12-31", "1900-01-01", "2000-01-01", "2024-05-10", "2024-05-20", "2024-05-21", "2024-06-01", "2300-01-01", None, "2024-05-10")]
    facts, asked = spark.createDataFrame(f, "id string, valid_from string, valid_to string"), spark.createDataFrame(days, "day string")
    got = Counter((r["id"], r["day"]) for r in kg.as_of_join(facts, asked).collect())
    assert got == Counter((i, d) for i, a, b in f for (d,) in days if d and (a is None or a <= d) and (b is None or b >= d))
    assert kg.as_of_join(facts, asked.limit(0)).count() == 0 and kg.as_of_join(facts.limit(0), asked).count() == 0


def test_vectors_with_gaps(spark):
    """Null vectors, null elements, NaN and other lengths are no one's neighbours and crash nothing."""
    rows = [(i, [float(i), 1.0, -2.0]) for i in range(1, 9)] + [(20, None), (21, []), (22, [1.0, None, 2.0]), (23, [1.0, float("nan"), 2.0]), (24, [1.0, 2.0]), (25, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    assert {r["k"] for r in vector.knn(df, "k", "v", [1.0, 1.0, 1.0], 50).collect()} == set(range(1, 9))
    assert {r["k"] for r in vector.knn(df, "k", "v", [1.0, 1.0], 50, "l2").collect()} == {24, 25}
    fp = {r["k"]: r["fp"] for r in vector.fingerprints(df, "v", 2, 64).collect()}
    assert {k for k, x in fp.items() if x is None} == {20, 21, 22, 23}
    one = vector.fingerprints(spark.createDataFrame([(1, [1.0, 2.0])], "k long, v array<double>"), "v", 2, 64).first()["fp"]
    assert fp[24] == one
    q = df.select(F.col("k").alias("query_id"), F.col("v").alias("q"))
    for got in (vector.knn_batch(df, "k", "v", q, 9), vector.two_layer_batch(df, "k", "v", q, 9, 50, 2, 64)):
        pairs = {(r["query_id"], r["k"]) for r in got.collect()}
        assert pairs == {(a, b) for a in range(1, 9) for b in range(1, 9) if a != b} | {(24, 25), (25, 24)}
    assert {r["k"] for r in vector.simhash_knn(df, "k", "v", [1.0, 1.0, 1.0], 50, 64).collect()} == set(range(1, 9))
    near = vector.rescore(spark.createDataFrame([(20, 1), (1, 2), (24, 3)], "k long, rank int"), df, "k", "v", [1.0, 1.0, 1.0], 5)
    assert [r["k"] for r in near.orderBy("rank").collect()][0] == 1
    assert vector.knn_batch(df, "k", "v", q.where("query_id = 20"), 3).count() == 0


def test_vectors_meet_queries_in_bounded_matrices(spark, monkeypatch):
    """Whatever the batch, a matrix of rows and queries keeps to MATRIX numbers; the neighbours stay."""
    import pandas as pd

    from lorekeep.operators import vector

    monkeypatch.setattr(vector, "MATRIX", 12)
    got = list(vector._parts(iter([pd.DataFrame({"k": range(10)}), pd.DataFrame({"k": []})]), 4))
    assert [len(b) for b in got] == [3, 3, 3, 1] and [k for b in got for k in b["k"]] == list(range(10))
    assert [len(b) for b in vector._parts(iter([pd.DataFrame({"k": range(2)})]), 100)] == [1, 1]


def test_facts_of_one_month_are_dealt_to_parts(spark):
    from lorekeep.operators import kg

    facts = spark.range(500).selectExpr("concat('f', id) as id", "'2024-01-01' as valid_from", "'2024-01-31' as valid_to")
    days = spark.createDataFrame([("2024-01-05",), ("2024-01-05",), ("2024-02-05",)], "day string")
    got = kg.as_of_join(facts, days)
    assert got.count() == 1000 and "part" not in got.columns
    assert "part" in got._jdf.queryExecution().analyzed().toString()


def test_ratio_summary_makes_the_short_texts_once(spark):
    from lorekeep.operators import evaluation

    d = spark.createDataFrame([("a" * n, "b" * k) for n, k in ((10, 1), (10, 2), (10, 2), (4, 4))] + [("abc", None)], "o string, s string")
    r = evaluation.ratio_summary(d, "o", "s").first()
    assert (r["n"], r["missing"], r["mean"], r["median"]) == (4, 1, 0.375, 0.2)
    assert (r["under_10"], r["under_20"], r["under_30"], r["over_30"]) == (0, 1, 2, 1)
    plan = evaluation.ratio_summary(d, "o", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "count(r#" not in plan  # all figures come from the counts of equal ratios, whose shuffle is shared


def test_trigram_totals_are_those_of_plain_python(spark, monkeypatch):
    from collections import Counter

    from lorekeep.operators import fts, postings

    monkeypatch.setattr(postings, "PIECE", 5)
    texts = ["banana BANANA", None, "an", "😀知識結構x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = Counter(t.lower()[i : i + 3] for t in texts if t for i in range(len(t) - 2))
    assert {r["term"]: r["tf"] for r in fts.gram_counts(d, "text").collect()} == want


def test_a_filtered_index_line_is_made_once(spark):
    from lorekeep.operators import dialect

    n = spark.createDataFrame([("s", "t", "Some Body said a long thing. And more of it here.", ["x"], 400)], "slug string, title string, plain string, tags array<string>, raw_tokens long")
    d = dialect.encode_notes(n).where(F.lower("skeleton").contains("some"))
    assert d.count() == 1
    plan = d.select("skeleton")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ENT:") == 1


def test_key_sentences_and_codes_of_odd_texts(spark):
    """Both in one Arrow step, with what no sentence, ties, white space and letters beyond ASCII give."""
    texts = [None, "", "short. tiny", "First of the ties here. Other of the ties her!", "x" * 160 + ". A plain sentence of some length that goes on for more than fifty-five characters", "Because It Is DECIDED now\u212a. zz", " \u00a0Alone Bob \u00c9mile (Bobby) The Ann's  Carl\tDora", "\u0130 chose this one.\x0b\f And that one too?", "\U0001f600" * 60 + "!"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", dialect.key_sentence(F.col("t")).alias("s"), dialect.entity_codes(F.col("t")).alias("c"), dialect.entity_codes(F.col("t"), {"Alone": "ALO"}, 2).alias("k"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "split(" not in plan
    got = [tuple(r)[1:] for r in d.orderBy("i").collect()]
    assert [s for s, *_ in got] == ["", "", "", "First of the ties here", "A plain sentence of some length that goes on for mor...", "Because It Is DECIDED nowK".replace("K", "\u212a"), texts[6].strip(" \t"), "\u0130 chose this one", "\U0001f600" * 52 + "..."]
    assert [c for _, c, _ in got][:2] == [None, []] and got[3][1] == [] and got[6] == (texts[6].strip(" \t"), ["BOB", "ANN", "CAR"], ["ALO"]) and got[4][1] == []


def test_names_and_sentences_of_mixed_scripts(spark):
    """Patterns of names are tried only where a name may begin; words are those of the Unicode classes, of ASCII sentences and others."""
    t = "New York met Élan Vital; \u01c5abc \u0130zmir X1 and 台灣大學 in 台北市 a1_b Ω2 知識. Plain words, plain words. \u00bd\u2167 words \u0964 caf\u00e9 caf\u00e9 caf\u00e9 here."
    d = spark.createDataFrame([(t,), (None,), ("no names at all",)], "t string")
    rows = d.select(dialect.entities(F.col("t")).alias("e"), dialect.key_sentences(F.col("t"), F.lit(2), r"[.]+").alias("k"), dialect.key_sentences(F.col("t"), F.lit(2), r"\p{Po}+").alias("p")).collect()
    plain = F.regexp_extract_all("t", F.lit("(" + "|".join(dialect.NAMES.values()) + ")"), F.lit(1))
    want = d.select(F.array_distinct(plain).alias("w")).collect()
    assert [[x["text"] for x in r["e"]] for r in rows] == [r["w"] or [] for r in want] and len(rows[0]["e"]) > 5
    assert rows[0]["k"][1].startswith("\u00bd\u2167 words") and [r["k"] for r in rows[1:]] == [[], ["no names at all"]] and len(rows[0]["p"]) == 2
    assert dialect.entities(F.col("t"))._jc.toString().count("(?=") == 1
