"""The two jobs: two runs over growing copies of the input, repeated and broken runs, the command line."""

import json
import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobs import archive_messages, queries, retrieval_report
from lorekeep.operators import evaluation, fts, postings
from lorekeep.streaming import ingest as stream

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module", autouse=True)
def few_buckets():
    with pytest.MonkeyPatch.context() as m:
        m.setattr(postings, "BUCKETS", 4)
        yield


def _plain(rows):
    """Messages and chats of rows (conv_id, turn, role, text), by plain Python."""
    m = {(c, t, r, x) for c, t, r, x in rows if x}
    text = lambda v: None if v is None else str(v)
    messages = Counter((text(c), text(t), r, x, len(x) // 4) for c, t, r, x in m)
    chats = {text(c): (sum(1 for y in m if y[0] == c), sum(len(y[3]) // 4 for y in m if y[0] == c), ",".join(sorted({y[2] for y in m if y[0] == c and y[2] is not None}))) for c, *_ in m}
    return messages, chats


def _found(spark, target):
    m, c = archive_messages.archived(spark, target)
    messages = Counter((r["chat_id"], r["message_id"], r["user"], r["text"], r["tokens"]) for r in m.collect())
    return messages, {r["chat_id"]: (r["messages"], r["tokens"], r["users"]) for r in c.collect()}


def _add(spark, rows, source):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(source)


FIRST = [(1, 0, "user", "hello"), (1, 1, "assistant", "知識 answer"), (1, 2, "user", None), (2, 0, "user", ""), (2, 1, None, "no user"), (None, 0, "user", "no chat"), (1, 0, "user", "hello")]
SECOND = [(1, 0, "user", "hello"), (1, 1, "assistant", "an edited answer"), (3, 0, "user", "x" * 50_000), (1, None, "system", "late"), (2, 1, None, "no user")]


def test_archive_takes_only_what_is_new(spark, tmp_path):
    source, at, ck = str(tmp_path / "in"), str(tmp_path / "archive"), str(tmp_path / "checkpoint")
    _add(spark, FIRST, source)
    one = archive_messages.run(spark, source, at, ck)
    assert (one["batches"], one["read"], one["added"]) == (1, len(FIRST), 4) and _found(spark, at) == _plain(FIRST)
    before = {p: os.path.getmtime(p) for p in _files(at)}
    assert archive_messages.run(spark, source, at, ck) == {"batches": 0, "read": 0, "added": 0}
    assert {p: os.path.getmtime(p) for p in _files(at)} == before

    _add(spark, SECOND, source)
    two = archive_messages.run(spark, source, at, ck)
    assert (two["batches"], two["read"], two["added"]) == (1, len(SECOND), 3)
    assert _found(spark, at) == _plain(FIRST + SECOND)
    kept = {p: t for p, t in before.items() if "/messages/" in p}
    assert {p: os.path.getmtime(p) for p in kept} == kept  # what was archived isn't written again
    m = archive_messages.archived(spark, at)[0].select("stream", "batch").distinct().collect()
    assert sorted(r["batch"] for r in m) == [0, 1] and len({r["stream"] for r in m}) == 1

    # another checkpoint over the same archive: everything is read, nothing is lost or added twice
    more = SECOND + [(9, 9, "user", "only now")]
    _add(spark, [(9, 9, "user", "only now")], source)
    three = archive_messages.run(spark, source, at, str(tmp_path / "other"))
    assert three["read"] == len(FIRST) + len(SECOND) + 1 and three["added"] == 1
    assert _found(spark, at) == _plain(FIRST + more)


def _files(top):
    return [os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.startswith("part-")]


def test_archive_of_many_batches_in_any_order(spark, tmp_path):
    """Files one by one, in another order, give the same archive as all at once."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"message {t % 7} of {c}") for c in range(9) for t in range(12)]
    config = archive_messages.load_config() | {"files_per_batch": 1, "buckets": 3}
    for n, order in enumerate((range(4), (3, 1, 0, 2))):
        source = str(tmp_path / f"in{n}")
        for k in order:
            _add(spark, rows[k * 20 : k * 20 + 48], source)
        got = archive_messages.run(spark, source, str(tmp_path / f"out{n}"), str(tmp_path / f"ck{n}"), config)
        assert got["batches"] == 4 and got["added"] == len(rows) < got["read"]
        assert _found(spark, str(tmp_path / f"out{n}")) == _plain(rows)


def test_archive_survives_a_broken_run(spark, tmp_path, monkeypatch):
    """A batch that wrote its messages but not its chats is run again, with the same result."""
    source, at, ck = str(tmp_path / "in"), str(tmp_path / "archive"), str(tmp_path / "checkpoint")
    _add(spark, FIRST, source)
    archive_messages.run(spark, source, at, ck)
    _add(spark, SECOND, source)
    with monkeypatch.context() as m:
        m.setattr(archive_messages, "chats_of", lambda _: 1 / 0)
        with pytest.raises(Exception, match="division"):
            archive_messages.run(spark, source, at, ck)
    assert _found(spark, at)[0] == _plain(FIRST + SECOND)[0]
    again = archive_messages.run(spark, source, at, ck)
    assert again["added"] == 3 and _found(spark, at) == _plain(FIRST + SECOND)


def test_archive_on_growing_copies_of_the_table(spark, tmp_path):
    source, at, ck = str(tmp_path / "in"), str(tmp_path / "archive"), str(tmp_path / "checkpoint")
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in c.collect()]
    _add(spark, rows[:40], source)
    archive_messages.run(spark, source, at, ck)
    _add(spark, rows[30:], source)
    archive_messages.run(spark, source, at, ck)
    assert _found(spark, at) == _plain(rows)
    got = queries.job1_archive_messages(spark, SF)
    assert got.where("part = 'message'").count() == sum(_plain(rows)[0].values())


def test_ledger_reads_only_buckets_of_the_batch(spark, tmp_path):
    at = str(tmp_path / "ledger")
    rows = spark.range(500).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("v"))
    assert len(stream.append_once(rows, "a", 0, at, "key", 8)) == 8
    few = rows.where("key in ('3', '4')").unionByName(spark.createDataFrame([("new", "v"), (None, "v")], "key string, v string"))
    here = stream.append_once(few, "a", 1, at, "key", 8)
    assert len(here) <= 3 and spark.read.parquet(at).count() == 501
    stream.append_once(few, "a", 1, at, "key", 8)  # the batch again
    assert spark.read.parquet(at).count() == 501 and stream.append_once(few.limit(0), "a", 2, at, "key", 8) == []
    assert stream.append_once(few, "b", 0, at, "key", 8) and spark.read.parquet(at).count() == 501  # another stream's first batch
    plan = stream._stored(spark, at, "key string, batch long, bucket int").where(F.col("bucket").isin(here))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_archive_command_line(spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "archive")
    _add(spark, FIRST, source)
    config = tmp_path / "config.json"
    config.write_text(json.dumps(archive_messages.load_config() | {"snippet": 3}))
    root = os.path.dirname(os.path.dirname(os.path.abspath(archive_messages.__file__)))
    args = [sys.executable, "-m", "jobs.archive_messages", "--source", source, "--target", at, "--checkpoint", str(tmp_path / "ck"), "--config", str(config)]
    for added in (4, 0):
        p = subprocess.run(args, cwd=root, capture_output=True, text=True, timeout=300)
        assert p.returncode == 0, p.stderr[-2000:]
        assert f"{added} messages added to" in p.stderr
    assert _found(spark, at) == _plain(FIRST)
    assert {r["snippet"] for r in archive_messages.archived(spark, at)[0].collect()} >= {"hel"}


def _documents(spark, source, path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    source(d).coalesce(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _expected(spark, docs, ask, config):
    """Hits of both forms by the search that scans the texts."""
    b = ask.select(F.col("item_id").alias("query_id"), evaluation.english_terms(F.col("text"), config["terms"]).alias("w"))
    out = set()
    for form, n in (("long", config["terms"]), ("short", config["short_terms"])):
        terms = b.select("query_id", F.explode(F.slice("w", 1, n)).alias("term"))
        out |= {(form, r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in fts.bm25_batch(docs, "doc_id", "text", terms, config["limit"]).collect()}
    return out


def test_report_follows_the_documents(spark, tmp_path):
    docs, at = str(tmp_path / "docs"), str(tmp_path / "report")
    config, ask = retrieval_report.load_config(), spark.read.parquet(f"{SF}/benchmark.parquet")
    hits = lambda: {(r["form"], r["query_id"], r["key"], r["score"], r["rank"]) for r in retrieval_report.output(spark, at).where("part = 'hit'").collect()}
    d = _documents(spark, lambda x: x.where("doc_id < 150"), docs)
    one = retrieval_report.run(spark, docs, f"{SF}/benchmark.parquet", at)
    assert (one["generation"], one["added"], one["n"]) == (0, d.count(), d.count()) and hits() == _expected(spark, d, ask, config)
    before = retrieval_report.output(spark, at).collect()
    two = retrieval_report.run(spark, docs, f"{SF}/benchmark.parquet", at)
    assert (two["generation"], two["added"], two["changed"], two["removed"]) == (0, 0, 0, 0)
    assert sorted(map(str, retrieval_report.output(spark, at).collect())) == sorted(map(str, before))

    text = F.when(F.col("doc_id") == 7, F.lit("an other text altogether")).when(F.col("doc_id") == 8, F.lit(None)).otherwise(F.col("text"))
    d = _documents(spark, lambda x: x.where("doc_id <> 3").withColumn("text", text).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source"))), docs)
    mark = {p: os.path.getmtime(p) for p in _files(f"{at}/index/postings")}
    three = retrieval_report.run(spark, docs, f"{SF}/benchmark.parquet", at)
    assert (three["generation"], three["removed"], three["changed"], three["n"]) == (1, 1, 2, d.count())
    assert hits() == _expected(spark, d, ask, config)
    assert {p: os.path.getmtime(p) for p in mark} == mark  # nothing of the first generation is written again


def test_report_counts(spark, tmp_path):
    at = str(tmp_path / "report")
    c = retrieval_report.run(spark, f"{SF}/documents.parquet", f"{SF}/benchmark.parquet", at)
    out = retrieval_report.output(spark, at)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ask = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rows = out.where("part = 'hit'").collect()
    best = {f: {q: min((r["rank"] for r in rows if (r["form"], r["query_id"]) == (f, q) and ask[q] in docs[r["key"]]), default=99) for q in ask} for f in ("long", "short")}
    relevant = {(r["form"], r["query_id"]): r["best"] for r in out.where("part = 'hit' and relevant").groupBy("form", "query_id").agg(F.min("rank").alias("best")).collect()}
    assert all(relevant.get((f, q), 99) == b for f, x in best.items() for q, b in x.items())
    for r in out.where("part = 'report'").collect():
        for name, f in (("long_rate", "long"), ("short_rate", "short")):
            assert r[name] == pytest.approx(sum(1 for q in ask if relevant.get((f, q), 99) <= r["k"]) / len(ask), abs=1e-4)
    missed = {r["query_id"]: r["form"] for r in out.where("part = 'miss'").collect()}
    for q in ask:
        gone = [f for f in ("long", "short") if (f, q) not in relevant]
        assert missed.get(q) == (None if not gone else "both" if len(gone) == 2 else gone[0])
    assert c["questions"] == len(ask) and c["misses"] == len(missed)


def test_report_repeats_after_a_broken_run(spark, tmp_path, monkeypatch):
    """An index generation without its statistics doesn't count; the next run writes it over."""
    at, docs = str(tmp_path / "report"), str(tmp_path / "docs")
    _documents(spark, lambda x: x.where("doc_id < 60"), docs)
    retrieval_report.run(spark, docs, f"{SF}/benchmark.parquet", at)
    d = _documents(spark, lambda x: x.where("doc_id < 90"), docs)
    with monkeypatch.context() as m:
        m.setattr(postings, "_write", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            retrieval_report.run(spark, docs, f"{SF}/benchmark.parquet", at)
    ask = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = retrieval_report.run(spark, docs, f"{SF}/benchmark.parquet", at)
    assert (got["generation"], got["n"]) == (1, d.count())
    hits = {(r["form"], r["query_id"], r["key"], r["score"], r["rank"]) for r in retrieval_report.output(spark, at).where("part = 'hit'").collect()}
    assert hits == _expected(spark, d, ask, retrieval_report.load_config())


def test_jobs_know_nothing_of_the_training_data_operators():
    top = os.path.dirname(os.path.abspath(archive_messages.__file__))
    for f in os.listdir(top):
        if f.endswith(".py"):
            with open(os.path.join(top, f), encoding="utf-8") as x:
                text = x.read()
            assert ".llm" not in text and "corpus_pipeline" not in text
