"""Growing logs, piece by piece, against the parse of whole logs."""

import os
import random

import pytest

from lorekeep.sources import files
from lorekeep.streaming import tail


def _log(seed, n=40):
    rng = random.Random(seed)
    lines = ["orphan"]
    for i in range(n):
        lines.append(f"[t{i}] u{rng.randrange(3)} → x (chat:c{rng.randrange(4)}): text {i} é知")
        lines += [rng.choice(["more", "", "[no header", "a → b"]) for _ in range(rng.randrange(4))]
    return rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])


def _cut(text, seed, n):
    at = sorted(random.Random(seed).sample(range(1, len(text)), n - 1))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]


def _whole(spark, logs):
    d = spark.createDataFrame(list(logs.items()), "path string, body string")
    return {(r["ts"], r["source"], r["chat_id"], r["user"], r["message_id"], r["text"]) for r in files.relay_log(d, "bot").collect()}


def test_reader_gives_the_whole_log_at_every_cut():
    for seed in range(6):
        text = _log(seed)
        for n in (2, 7, 60):
            r, seen = tail.Reader(), {}
            for p in _cut(text, seed + n, n):
                for m in r.feed(p):
                    seen[m["no"]] = m
                for m, _ in r.pending():
                    seen[m["no"]] = m
            one = tail.Reader()
            want = {m["no"]: m for m in one.feed(text)} | {m["no"]: m for m, _ in one.pending()}
            assert {k: {**v, "text": v["text"].rstrip("\n")} for k, v in seen.items()} == {k: {**v, "text": v["text"].rstrip("\n")} for k, v in want.items()}


def test_growing_logs_equal_whole_ones(spark, tmp_path):
    """Runs over growing input: pieces end within lines and messages, one comes before its predecessor, one comes twice."""
    logs = {f"l{i}": _log(i + 10, 12) for i in range(3)}
    cut = {name: _cut(text, 5, 6) for name, text in logs.items()}
    box, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    box.mkdir()

    def put(name, seq, folder="."):
        (box / folder).mkdir(exist_ok=True)
        (box / folder / f"{name}.log.{seq}").write_bytes(cut[name][seq].encode())

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for step in ([("l0", 0), ("l1", 0)], [("l0", 1), ("l0", 2), ("l1", 2), ("l2", 0)], [], [("l1", 1), ("l0", 3), ("l2", 1), ("l2", 2)]):
            for name, seq in step:
                put(name, seq)
            tail.tail_logs(spark, str(box), out, ck).awaitTermination(120)
        so_far = {"l0": 4, "l1": 3, "l2": 3}
        rows = tail.tailed(spark, out, "bot").collect()
        assert {os.path.basename(r["log"]) for r in rows} == {f"{n}.log" for n in logs}
        strip = lambda rs: {(r["ts"], r["source"], r["chat_id"], r["user"], r["message_id"], r["text"]) for r in rs}
        assert strip(rows) == _whole(spark, {n: "".join(cut[n][:k]) for n, k in so_far.items()})
        for name in logs:
            for seq in range(so_far[name], 6):
                put(name, seq)
        tail.tail_logs(spark, str(box), out, ck).awaitTermination(120)
        assert strip(tail.tailed(spark, out, "bot").collect()) == _whole(spark, logs)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("text", ["", "\n", "no header", "[t] a → b (chat:1): x"])
def test_short_logs(text):
    r = tail.Reader()
    assert list(r.feed(text)) == [] and [m["text"] for m, _ in r.pending()] == (["x"] if text.startswith("[") else [])
