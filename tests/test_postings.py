"""The positional index against the search that scans texts, against plain Python, and its upkeep against a new index."""

import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep import api
from lorekeep.operators import fts, postings, rank
from lorekeep.plans.boolean import SearchSyntaxError
from lorekeep.sources.shared import shared_dir, until_exit

COLS = ["slug", "clsc"]


@pytest.fixture(scope="module", autouse=True)
def few_buckets():
    with pytest.MonkeyPatch.context() as m:
        m.setattr(postings, "BUCKETS", 4)
        yield


def _rows(n=60, seed=2):
    rng = random.Random(seed)
    words = ["and", "hand", "handy", "the", "aaaa", "aaa", "banana", "知識結構", "É", "😀😀😀x", "İi", "of", "thing", "token", "with", "ing"]
    text = lambda: rng.choice([" ", "", "-", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
    rows = [(f"s{i}-{rng.choice(words)}", text()) for i in range(n)]
    return rows + [("null", None), ("empty", ""), ("two", "an"), (None, "no key and hand"), ("long", "hand in hand and " * 3000)]


@pytest.fixture(scope="module")
def radar(spark):
    return spark.createDataFrame(_rows(), "slug string, clsc string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, radar):
    path = f"{shared_dir(spark)}/positions-{uuid.uuid4().hex}"
    assert postings.refresh(radar, "slug", COLS, path)["n"] == 64
    return path


def _scores(rows, key):
    return {r[key]: round(r["score"], 6) for r in rows}


def _all(spark, path, terms):
    return _scores(postings.search(spark, path, terms, 1000).collect(), "key")


@pytest.mark.parametrize("terms", [["and"], ["hand", "thing"], ["aaa", "aaaa", "anana"], ["知識結構", "識結構"], ["😀😀😀"], ["hand in hand", "HANDY", "an", ""], ["nothing like it"], ["\nhand"]])
def test_scores_equal_those_of_a_scan(spark, radar, index, terms):
    want = fts.bm25(radar.where("slug is not null"), COLS, terms).collect()
    assert _all(spark, index, terms) == _scores(want, "slug")


@pytest.mark.parametrize(
    "query",
    ["and hand", "hand OR 知識結構", "and NOT token", 'clsc: "and"', "slug: thing OR clsc: ing", "NEAR(and hand, 2)", "NEAR(and hand thing, 40) NOT (token OR slug: s1)", "clsc: NEAR(aaa banana, 0)", "of OR hand", "hand NOT of", "NEAR(of hand)"],
)
def test_boolean_searches_equal_those_of_a_scan(spark, radar, index, query):
    want = fts.search_boolean(radar.where("slug is not null"), query, COLS, "slug", 1000).collect()
    got = postings.search_boolean(spark, index, query, COLS, 1000).collect()
    assert _scores(got, "key") == _scores(want, "slug") and [r["key"] for r in got] == [r["slug"] for r in want]


def test_syntax_errors_stay(spark, index):
    with pytest.raises(SearchSyntaxError):
        postings.search_boolean(spark, index, "what?", COLS)


def test_places_are_true_and_pieces_join(spark, radar, monkeypatch):
    """Every place of every gram, with texts taken in pieces of a few characters."""
    rng = random.Random(7)
    for piece in (1 << 20, 5, 1):
        monkeypatch.setattr(postings, "PIECE", piece)
        texts = ["".join(rng.choice("ab😀") for _ in range(rng.randrange(0, 40))) for _ in range(25)]
        parts = [(i, t, s) for i, x in enumerate(texts) for t, s in postings._cut(x, 1 << 40)]
        row, gram, place, ends = postings._runs([p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts])
        got = sorted((int(r), g, int(p) - (1 << 40)) for r, g, a, z in zip(row, gram, np.r_[0, ends[:-1]], ends, strict=True) for p in place[a:z])
        assert got == sorted((i, t[k : k + 3], k) for i, t in enumerate(texts) for k in range(len(t) - 2))


def test_upkeep_equals_a_new_index(spark, radar, index, tmp_path):
    path, rng = str(tmp_path / "index"), random.Random(1)
    now = {s: t for s, t in _rows() if s}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "slug string, clsc string")
    postings.refresh(frame(now), "slug", COLS, path)
    for step in range(3):
        gone = rng.sample(sorted(now), 5)
        now = {s: t for s, t in now.items() if s not in gone}
        new = {s: f"{step} hand and {t}" for s, t in now.items() if rng.random() < 0.2} | {f"new{step}": "a handy thing", gone[0]: "back with and"}
        if step == 2:  # deletions by key, then only what is new
            assert postings.remove(spark, spark.createDataFrame([(g,) for g in gone + ["unknown"]], "key string"), path)["removed"] == 5
            made = postings.refresh(frame(new), "slug", COLS, path, complete=False)
        else:
            made = postings.refresh(frame(now | new), "slug", COLS, path)
        now |= new
        assert made["n"] == len(now)
        for terms in (["hand", "and", "banana"],):
            assert _all(spark, path, terms) == _scores(fts.bm25(frame(now), COLS, terms).collect(), "slug")
    assert {r["key"] for r in postings.live(spark, path).collect()} == set(now)
    postings.compact(spark, path, str(tmp_path / "compact"))
    assert _all(spark, str(tmp_path / "compact"), ["hand", "and"]) == _all(spark, path, ["hand", "and"])
    assert postings.stats(spark, str(tmp_path / "compact"))["n"] == len(now)


def test_keys_are_unique_and_an_index_may_be_empty(spark, tmp_path):
    with pytest.raises(ValueError, match="not unique"):
        postings.refresh(spark.createDataFrame([("a", "x"), ("a", "y")], "slug string, clsc string"), "slug", COLS, str(tmp_path / "twice"))
    none = spark.createDataFrame([], "slug string, clsc string")
    assert postings.refresh(none, "slug", COLS, str(tmp_path / "none"))["n"] == 0
    assert postings.search(spark, str(tmp_path / "none"), ["hand"]).collect() == []
    assert postings.refresh(spark.createDataFrame([("a", "hand")], "slug string, clsc string"), "slug", COLS, str(tmp_path / "none"))["added"] == 1
    assert _all(spark, str(tmp_path / "none"), ["hand"]).keys() == {"a"}
    with pytest.raises(ValueError, match="no index"):
        postings.found(spark, str(tmp_path / "nowhere"), spark.createDataFrame([("abc",)], "term string"))


def test_plan_reads_few_buckets_and_no_texts(spark, index):
    asked = spark.createDataFrame([(0, "hand")], "query_id int, term string")
    plan = postings.bm25(spark, index, asked, ["hand"])._jdf.queryExecution().toString()
    assert "clsc" not in plan and "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("ReadSchema")[0] and "In(gram" in plan


def test_search_in_sql(spark, radar, index):
    postings.register(spark, index, "seek")
    rows = lambda q: spark.sql(q).collect()
    assert _scores(rows("SELECT * FROM seek('hand 知識結構 of anana', 1000)"), "key") == _all(spark, index, ["hand", "知識結構", "anana"])
    assert [r["rank"] for r in rows("SELECT * FROM seek('and', 3) ORDER BY rank")] == [1, 2, 3] and rows("SELECT * FROM seek('of', 3)") == []
    both = rows("SELECT q.x, s.key, s.rank FROM VALUES ('hand'), ('thing') AS q(x), LATERAL seek(q.x, 2) s")
    assert {x for x, *_ in both} == {"hand", "thing"} and len(both) == 4


def _meta(radar):
    n = F.abs(F.xxhash64("slug"))
    return radar.where("slug is not null").withColumn("access_count", n % 40).withColumn("status", F.when(n % 3 == 0, "archived").otherwise("active")).withColumn("clsc", F.coalesce("clsc", F.lit("")))


QUERIES = ["hand thing", "知識", "知識結構 hand", "an of", "zzz", "", "  ", "banana", "AAA Token", "HAND of", "İi", "an an 😀", "in hand"]


@pytest.mark.parametrize("options", [api.Options(), api.Options(routing="compat", boost="multiply"), api.Options(recall=3, expand=lambda q: [q, q + " and", "token " + q, "thing"], variants=2)])
def test_batch_search_equals_single_calls(spark, radar, index, options):
    d = _meta(radar)
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    variants = None
    if options.expand:
        variants = spark.createDataFrame([(i, v, k + 1) for i, q in enumerate(QUERIES) for k, v in enumerate([v for v in options.expand(q) if v != q])], "query_id int, query string, list_id int")
    got = api.radar_search_batch(d, asked, index, 4, options, variants).collect()
    for i, q in list(enumerate(QUERIES))[:: 1 if options == api.Options() else 3]:  # single calls take their time
        want = [(r["slug"], r["final_rank"], r["boost"]) for r in api.radar_search(d, q, 4, options).collect()]
        assert sorted((r["slug"], r["final_rank"], r["boost"]) for r in got if r["query_id"] == i) == sorted(want), q


def test_batch_search_with_vectors(spark, radar, index):
    d = _meta(radar)
    rng = np.random.RandomState(3)
    v = spark.createDataFrame([(r["slug"], [float(x) for x in rng.randn(4)]) for r in d.orderBy("slug").collect()], "slug string, embedding array<double>")
    q = {0: ("hand thing", [1.0, 0.0, 0.5, 0.0]), 1: ("zzz", [0.0, 1.0, 0.0, -1.0])}
    asked = spark.createDataFrame([(i, t) for i, (t, _) in q.items()], "query_id int, query string")
    of = spark.createDataFrame([(i, x) for i, (_, x) in q.items()], "query_id int, q array<double>")
    got = api.radar_search_batch(d, asked, index, 5, api.Options(knn=True), vectors=v, vector_of=of).collect()
    for i, (t, x) in q.items():
        want = {(r["slug"], r["final_rank"], tuple(r["sources"])) for r in api.radar_search(d, t, 5, api.Options(knn=True), v, x).collect()}
        assert {(r["slug"], r["final_rank"], tuple(r["sources"])) for r in got if r["query_id"] == i} == want


def test_batch_plan_is_one_lazy_plan(spark, radar, index, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    collect = DataFrame.collect
    seen = []
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(self.columns) or collect(self))
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a: 1 / 0)
    api.radar_search_batch(_meta(radar), spark.createDataFrame([(1, "hand")], "query_id int, query string"), index)
    assert all(set(c) == {"n", "total", "generation"} for c in seen)  # the one row of the index's statistics


def test_api_searches_through_the_index(spark, radar, index):
    d = _meta(radar)
    for q in ("hand thing", "zzz", "an", "知識 and"):
        rows = [[(r["slug"], r["final_rank"]) for r in api.radar_search(d, q, 5, api.Options(index=i)).collect()] for i in (None, index)]
        assert rows[0] == rows[1], q


def test_messages_through_the_index(spark, tmp_path):
    texts = ["hello world", "hello there hello", None, "", "知識結構", "other hello", "what? yes"]
    m = spark.createDataFrame([("bot", f"2024-01-0{i + 1}", "chat", "c", "u", str(i), t) for i, t in enumerate(texts)], "bot_name string, ts string, source string, chat_id string, user string, message_id string, text string")
    path = str(tmp_path / "messages")
    postings.refresh(m.select(F.concat_ws(":", "chat_id", "message_id").alias("slug"), "text"), "slug", ["text"], path)
    for q in ("hello", "hello world", "hello NOT there", "what?", "知識", "NEAR(hello there, 3)"):
        a, b = ([tuple(r) for r in api.messages_search(m, q, 10, options=api.Options(index=i)).orderBy("rank").collect()] for i in (None, path))
        assert a == b, q


def test_rank_by_query(spark):
    rows = [(q, 0, "a", r, s) for q in (1, 2) for r, s in enumerate(["x", "y", "z"][q - 1 :], 1)]
    got = rank.fused([spark.createDataFrame(rows, "query_id int, list_id int, source string, rank long, slug string")], 2, by=("query_id",)).collect()
    assert sorted((r["query_id"], r["slug"], r["rank"]) for r in got) == [(1, "x", 1), (1, "y", 2), (2, "y", 1), (2, "z", 2)]


def test_until_exit(spark, tmp_path):
    (tmp_path / "t").mkdir()
    until_exit(spark, str(tmp_path / "t"))
    assert (tmp_path / "t").exists()


@pytest.mark.parametrize("piece,block", [(7, 40), (1 << 20, 30), (50, 1 << 20)])
def test_blocks_of_any_size_give_the_same_hits(spark, tmp_path, monkeypatch, piece, block):
    """Texts in many pieces and blocks, phrases over pieces' edges, in Python and in SQL, after a compaction too."""
    monkeypatch.setattr(postings, "PIECE", piece)
    monkeypatch.setattr(postings, "BLOCK", block)
    rows = [(f"s{i}", t) for i, t in enumerate(["a hand in hand and handy thing", "banana", None, "an", "hand", "thing and token with", "nothing to hand over but hand"])] + [("and", "hand" * 9)]
    d, terms = spark.createDataFrame(rows, "slug string, clsc string").coalesce(1), ["hand", "and handy thing", "nana"]
    path, to = str(tmp_path / "index"), str(tmp_path / "compact")
    postings.refresh(d.withColumn("clsc", F.concat(F.lit("hand "), F.coalesce("clsc", F.lit("")))), "slug", COLS, path)
    postings.refresh(d.where("slug <> 's4'"), "slug", COLS, path)
    want = _scores(fts.bm25(d.where("slug <> 's4'"), COLS, terms).collect(), "slug")
    assert _all(spark, path, terms) == want
    postings.compact(spark, path, to)
    assert _all(spark, to, terms) == want
    for i, p in enumerate((path, to)):
        postings.register(spark, p, f"sized{i}")
        assert _scores(spark.sql(f"SELECT * FROM sized{i}('hand nana', 100)").collect(), "key") == _all(spark, p, ["hand", "nana"])


def test_build_shuffles_nothing_and_a_gram_is_one_row_of_a_block(spark, tmp_path):
    d = spark.createDataFrame([(f"k{i}", "a hand in hand") for i in range(50)], "slug string, clsc string").coalesce(1)
    rows = postings.gram_rows(d, "slug", ["clsc"])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.where("gram = 'han'").count() == 1 and rows.where("gram = 'han'").first()["places"] == sorted(15 * i + x for i in range(50) for x in (2, 10))


def _batch(spark, path, queries, limit):
    return sorted((r["query_id"], r["rank"], r["key"], round(r["score"], 6)) for r in postings.search_batch(spark, path, queries, limit).collect())


def test_blocks_are_matched_where_they_are_read(spark, radar, tmp_path, monkeypatch):
    """All blocks of a file are whole, so none is shuffled; rows dealt anew make them broken, and those give the same hits."""
    monkeypatch.setattr(postings, "BLOCK", 3000)
    path, dealt = str(tmp_path / "whole"), str(tmp_path / "dealt")
    postings.refresh(radar, "slug", COLS, path)
    for name, spread in (("postings", 5), ("rows", 1), ("stats", 1)):
        d = spark.read.parquet(f"{path}/{name}")
        (d.repartition(spread) if spread > 1 else d).write.partitionBy(*[c for c in ("generation", "bucket") if c in d.columns]).parquet(f"{dealt}/{name}")
    whole = []
    for p in (path, dealt):
        rows = postings._postings(spark, p, postings.stats(spark, p)).withColumn("split", F.xxhash64("_metadata.file_path", "_metadata.file_block_start"))
        seen = rows.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"whole": [postings._is_whole(t)]}) for t in postings._split_blocks(bs)), "whole boolean").collect()
        whole.append({r["whole"] for r in seen})
    assert whole == [{True}, {False}]
    q = spark.createDataFrame([(i, t) for i, ts in enumerate((["hand", "and"], ["thing", "aaa", "識結構"], ["hand in hand"], ["zzz"])) for t in ts], "query_id int, term string")
    want = sorted((r["query_id"], r["rank"], r["slug"], round(r["score"], 6)) for r in fts.bm25_batch(radar.where("slug is not null").withColumn("t", F.concat_ws("\x01\x01", *COLS)), "slug", "t", q, 7).collect())
    assert [x[:3] for x in _batch(spark, dealt, q, 7)] == [x[:3] for x in _batch(spark, path, q, 7)]
    # the best rows of a task are enough, at equal scores too
    every = postings.bm25(spark, path, q).collect()
    best = lambda i: sorted((round(r["score"], 12), r["key"]) for r in every if r["query_id"] == i)[:7]
    assert _batch(spark, path, q, 7) == sorted((i, n + 1, k, round(s, 6)) for i in range(4) for n, (s, k) in enumerate(best(i)))
    assert len(want) == len(_batch(spark, path, q, 7))


def test_best_rows_of_a_task():
    """Ties, several batches and blocks, and more rows than are held at a time."""
    rng, limit, parts = random.Random(4), 3, []
    for block in range(40):
        for k in range(rng.randrange(1, 400)):
            parts += [(q, str(block), f"{block}-{k}", rng.choice([0.25, 0.5, 1e-6, 1.0])) for q in range(60) if rng.random() < 0.5 for _ in range(2)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("n", "block", "key", "p"), x, strict=True)) for x in parts[i : i + 7001]]) for i in range(0, len(parts), 7001)]
    got = [r for b in postings._best(limit)(iter(batches)) for r in b.to_pylist()]
    sums: dict = {}
    for q, _, k, p in parts:
        sums[q, k] = sums.get((q, k), 0.0) + p
    first = lambda rows: {q: sorted((round(s, 12), k) for n, k, s in rows if n == q)[:limit] for q in range(60)}
    assert len(parts) > 400_000 and len(got) < len(sums) / 10
    assert first([(r["n"], r["key"], r["score"]) for r in got]) == first([(q, k, -s) for (q, k), s in sums.items()])
