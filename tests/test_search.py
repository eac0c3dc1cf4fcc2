import sqlite3

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators import fts
from lorekeep.plans.boolean import SearchSyntaxError, parse, phrases, predicate

ROWS = [("a-one", "hello world hello"), ("b-two", "Hello there"), ("c-three", "nothing here 知識結構 foo"), ("d", "知識結構知識結構"), ("e", "zzz")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "slug string, clsc string")


@pytest.mark.parametrize("term", ["hello", "知識結構", "ell", "aaa", "o w"])
def test_bm25_equals_sqlite(rows, term):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(slug, clsc, tokenize='trigram')")
    con.executemany("insert into t values (?, ?)", ROWS)
    want = {k: round(v, 9) for k, v in con.execute("select slug, bm25(t) from t where t match ?", (f'"{term}"',))}
    got = {r["slug"]: round(r["score"], 9) for r in fts.bm25(rows, ["slug", "clsc"], [term]).collect()}
    assert got == want


def test_short_terms_match_nothing_but_substrings_do(rows):
    assert fts.bm25(rows, ["clsc"], ["知識"]).count() == 0
    assert [r["slug"] for r in fts.recall_keywords(rows, ["知識"], ["clsc"], "slug", "clsc").collect()] == ["c-three", "d"]


@pytest.mark.parametrize("q", ["hello AND", "a-one", "what?", "(hello", ""])
def test_syntax_errors(q):
    with pytest.raises(SearchSyntaxError):
        parse(q)


@pytest.mark.parametrize(
    ("q", "want"),
    [("hello there", ["b-two"]), ("hello OR zzz", ["a-one", "b-two", "e"]), ("hello NOT world", ["a-one", "b-two"][1:]), ('"lo wo"', ["a-one"]), ("hel* world", ["a-one"]), ("slug:two OR slug:one", ["a-one", "b-two"]), ("zz OR zzz", ["e"]), ("hello NOT zz", ["a-one", "b-two"]), ("NEAR(hello world, 3)", ["a-one"])],
)
def test_boolean(rows, q, want):
    n = parse(q)
    assert sorted(r["slug"] for r in rows.where(predicate(n, ["slug", "clsc"])).collect()) == want
    assert all(len(p) >= 3 for p in phrases(n))


def test_batch_equals_single(rows):
    terms = rows.sparkSession.createDataFrame([(1, "hello"), (1, "there"), (2, "zzz")], "query_id int, term string")
    got = {(r["query_id"], r["slug"]): round(r["score"], 9) for r in fts.bm25_batch(rows, "slug", "clsc", terms).collect()}
    one = {(1, r["slug"]): round(r["score"], 9) for r in fts.bm25(rows, ["clsc"], ["hello", "there"]).collect()}
    assert got == one | {(2, "e"): got[2, "e"]}


def test_overlaps_and_trigrams(spark):
    d = spark.createDataFrame([("aaaaaaa",), ("a.b\\E(x",), (None,)], "t string")
    assert [r[0] for r in d.select(tx.occurrences(F.col("t"), "aaaa")).collect()] == [4, 0, None]
    assert d.select(F.size(tx.trigrams(F.lit("知識結構")))).first()[0] == 2


def test_cjk_router(spark):
    words = ["abc", "9", "知", "ひら", "한국", "! - /"]
    d = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in d.select(tx.has_cjk(F.col("w"))).collect()] == [False, False, True, False, False, False]
    assert [r[0] for r in d.select(tx.has_cjk(F.col("w"), True)).collect()] == [True, True, True, False, False, False]


def test_slugs(spark):
    d = spark.createDataFrame([("Wiki/a b/知識.md",)], "p string")
    assert d.select(tx.vault_slug(F.col("p"))).first()[0] == "Wiki-a-b"
    assert d.select(tx.note_group(F.lit("/x/Ocean/Research/n.md"))).first()[0] == "research"
    assert not spark.range(1).select(tx.valid_slug(F.lit("../../etc/passwd"))).first()[0]


def test_near_equals_sqlite(spark):
    """Any number of phrases, any order, overlapping ones too, and ones that are too short."""
    import random

    rng = random.Random(8)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["abcd", "abcabc", ""]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(clsc, tokenize='trigram')")
    con.executemany("insert into t (rowid, clsc) values (?, ?)", list(enumerate(texts, 1)))
    d = spark.createDataFrame(list(enumerate(texts, 1)), "i int, clsc string")
    for items, n in ((["abc", "bcd"], 0), (["abc", "bcd"], 3), (["abca", "dab"], 8), (["abc", "cab", "bca"], 12), (["abc", "a b", "dd"], 9), (["aab", "abc", "bcd", "cda"], 25), (["abc"], 1)):
        q = "NEAR(" + " ".join(f'"{x}"' for x in items) + f", {n})"
        want = [r[0] for r in con.execute("select rowid from t where t match ? order by rowid", (q,))]
        assert [r[0] for r in d.where(predicate(parse(q), ["clsc"])).orderBy("i").collect()] == want, q


def test_searches_without_words_or_with_bad_patterns(spark, rows):
    m = rows.select("slug", F.col("clsc").alias("text"), F.lit("b").alias("bot_name"), F.lit("t").alias("ts"))
    for q in ("", "  ", "NEAR()", "NEAR(alpha, x)", "("):
        assert fts.search_messages(m, q, 5).count() == 0
    assert fts.recall_keywords(rows, [], ["clsc"], "slug", "clsc").count() == 0
    notes = spark.createDataFrame([("a", "see f(x for it"), ("b", "nothing")], "path string, body string")
    assert [r["path"] for r in fts.search_regex(notes, "path", "body", ["f(x"]).collect()] == ["a"] and fts.search_regex(notes, "path", "body", [""]).count() == 0


def test_index_equals_table(spark, rows, tmp_path):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cé知") for _ in range(rng.randint(0, 40))) for _ in range(120)] + [None]
    d = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "slug string, clsc string").repartition(3)
    for _ in range(2):  # the second writing replaces the first
        fts.write_index(d, "slug", ["slug", "clsc"], str(tmp_path / "i"))
    for terms in (["ab c"], ["abc", "s11", "知a b"], ["zzzz"], ["ab"], []):
        want = [(r["slug"], round(r["score"], 9)) for r in fts.top(fts.bm25(d, ["slug", "clsc"], terms), [F.col("score"), F.col("slug")], 10).orderBy("rank").collect()] if terms and len(terms[0]) > 2 else []
        got = fts.search_index(spark, str(tmp_path / "i"), "slug", ["slug", "clsc"], terms, 10).orderBy("rank").collect()
        assert [(r["slug"], round(r["score"], 9)) for r in got] == want


def test_batch_in_blocks_and_with_ties(spark, monkeypatch):
    texts = ["alpha beta"] * 40 + ["alpha beta gamma", "aaaa aaaa", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string").repartition(3)
    terms = spark.createDataFrame([("x", "Alpha"), ("x", "beta"), ("y", "aaa"), ("z", "no"), ("w", "gamma")], "query_id string, term string")
    want = {"x": list(range(10)), "y": [41], "w": [40]}
    for size in (100_000, 1):
        monkeypatch.setattr(fts, "PASS_TERMS", size)
        got = {}
        for r in fts.bm25_batch(d, "k", "t", terms).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["k"])
        assert got == want
    one = {r["k"]: round(r["score"], 9) for r in fts.bm25(d, ["t"], ["aaa"]).collect()}
    assert {r["k"]: round(r["score"], 9) for r in fts.bm25_batch(d, "k", "t", terms.where("query_id = 'y'")).collect()} == one
    assert fts.bm25_batch(d, "k", "t", terms.limit(0)).count() == 0


def test_stored_index_is_made_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Texts in pieces of a few characters, keys in several rows of a gram, a text of none."""
    from lorekeep.operators import postings

    monkeypatch.setattr(postings, "PIECE", 7)
    texts = ["a hand in hand and handy", None, "an", "hand", "\U0001f600\U0001f600\U0001f600 hand", "HAND over hand"]
    d = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "slug string, clsc string").coalesce(1)
    rows = fts.gram_keys(d, "slug", ["slug", "clsc"])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r["gram"], r["key"]) for r in rows.select("gram", F.explode("keys").alias("key")).collect()}
    assert got == {(x[j : j + 3], f"s{i}") for i, t in enumerate(texts) for x in (f"s{i}", (t or "").lower()) for j in range(len(x) - 2)}
    fts.write_index(d, "slug", ["slug", "clsc"], str(tmp_path / "i"))
    want = [(r["slug"], round(r["score"], 9)) for r in fts.top(fts.bm25(d, ["slug", "clsc"], ["hand", "handy"]), [F.col("score"), F.col("slug")], 10).orderBy("rank").collect()]
    assert [(r["slug"], round(r["score"], 9)) for r in fts.search_index(spark, str(tmp_path / "i"), "slug", ["slug", "clsc"], ["hand", "handy"]).orderBy("rank").collect()] == want and len(want) == 4
