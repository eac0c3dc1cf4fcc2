"""License scans and the divergence audit against plain Python, with nulls, long texts, ties, repeated rows, empty tables and extra columns."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import divergence, licenses

DOC = "doc_id long, text string, lang string, source string, label string, b string, n int, term string, total int"
EXTRA = ("clash", "clash", 1, "clash", 2)


def _plain_scan(text, templates, threshold):
    w = licenses.words_in(text or "")
    base = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    own, best = set(), 0.0
    for label, notice in templates:
        t = licenses.words_in(notice)
        step = 8
        while step < len(t):
            step *= 2
        for k in range(max(1, (len(w) - 1) // step)):
            both = len(set(t) & set(w[k * step : k * step + 2 * step]))
            if 100 * both >= threshold * len(set(t)):
                own.add(label)
                best = max(best, both / len(set(t)))
    named = {label for _, label in base}
    at = [i for i, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(named)), ",".join(sorted(named | own)), 1.0 if base else best


def _licensed(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "license", "software", "mit", "gnu", "cc"]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [None, "", " \n", "MIT", "cc by cc by", "GNU General Public License, GNU general-public license", "Apache\nLicense!", "émit license", "the MIT_License", prose(30_000)]
    for _, notice in licenses.TEMPLATES:
        w = notice.split()
        for drop in (0, len(w) // 20, len(w) // 8, len(w) // 3):
            some = w[:]
            for _ in range(drop):
                some[rng.randrange(len(some))] = rng.choice(vocab)
            texts.append(prose(rng.randrange(200)) + "\n" + " ".join(some).upper() + ".\n" + prose(rng.randrange(90)))
    texts += texts[:12]
    return [(i * 3, t, "en", "s", *EXTRA) for i, t in enumerate(texts)] + [(None, "cc by", "en", "s", *EXTRA)] * 2 + [(30, texts[10], "en", "s", *EXTRA)]


@pytest.mark.parametrize("threshold", [90, 60, 100])
def test_licenses_against_plain_python(spark, threshold):
    rows = _licensed()
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    got = Counter(tuple(r) for r in licenses.scan(docs, threshold=threshold).collect())
    assert got == Counter((r[0], *_plain_scan(r[1], licenses.TEMPLATES, threshold)) for r in rows)
    if threshold == 90:
        assert len({x for r in got for x in r[6].split(",")} - {"", "gpl", "apache", "cc-by", "mit"}) >= 10


def test_license_templates_are_a_parameter(spark):
    docs = spark.createDataFrame(_licensed(), DOC)
    mine = [("house", "all hands on deck"), ("house", "for internal use by the crew of this ship only, hands off"), ("tie", "deck on hands all")]
    more = docs.select("doc_id", F.concat_ws(" ", "text", F.lit("All hands, on deck!")).alias("text"))
    assert {r["labels"] for r in licenses.scan(more, templates=mine, phrases={"on deck": "deck"}).collect()} == {"deck,house,tie"}
    none = licenses.scan(docs, templates=[])
    assert {r["labels"] for r in none.collect()} == {r["base_labels"] for r in none.collect()}
    with pytest.raises(ValueError):
        licenses.prepared([("x", "...")])
    with pytest.raises(ValueError):
        licenses.prepared([("x", " ".join(f"w{i}" for i in range(licenses.MAX_WORDS + 1)))])


def test_license_matches_name_the_block(spark):
    w = ["x"] * 100
    w[37:42] = "released under the MIT License".split()
    docs = spark.createDataFrame([(7, " ".join(w)), (8, None)], "doc_id long, text string")
    got = licenses.matches(docs).collect()
    assert [(r["doc_id"], r["label"], r["first_word"], r["last_word"], r["containment"]) for r in got] == [(7, "mit", 32, 47, 1.0)]
    assert licenses.matches(docs.limit(0)).count() == 0 and licenses.scan(docs.limit(0)).count() == 0


def _plain_audit(rows):
    rx = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        text, lang, source = (x or "" for x in r[1:4])
        groups.add((lang, source))
        terms = rx.findall(text.translate(low))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        sources = sorted(s for la, s in groups if la == lang)
        kept = sorted((t for t, c in held[lang].items() if c >= 3), key=str.encode)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: B023, E731
        p = {s: [share(counts[lang, s][t], sum(counts[lang, s][x] for x in kept)) for t in kept] for s in sources}
        q = [share(whole[t], sum(whole.values())) for t in kept]
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(a, b) for a, b in zip(p[s], p[o], strict=True)), o.encode(), o) for o in sources if o != s]
            terms = [(-f(a, b), t.encode(), t) for t, a, b in zip(kept, p[s], q, strict=True) if counts[lang, s][t] and a > b]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out |= {(lang, s, part, x, -v, k + 1) for k, (v, _, x) in enumerate(items)}
    return out


def _sourced(seed=4):
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "abcdé日" for b in "xyzö" for c in "klmNO😀"] + ["A", "a", "ß", " ", " x"]
    rows = []
    for i in range(150):
        lang, source = rng.choice(["en", "en", "de", None, "", "ja"]), rng.choice(["hot"] * 4 + ["b", "é", None, "", "z"])
        text = rng.choice([" ", "\n", "-", "1", "\x7f"]).join(rng.choice(vocab[: 40 + 20 * (i % 6)]) for _ in range(rng.randrange(1, 60)))
        rows.append((i, text, lang, source, *EXTRA))
    rows += [(900, None, "en", "empty", *EXTRA), (901, "", "la", "only", *EXTRA), (902, "rare words here", "la", "two", *EXTRA), (None, "12 34", "xx", None, *EXTRA), (903, "word " * 40_000, "en", "hot", *EXTRA)]
    return rows + rows[:20]


@pytest.mark.parametrize(("chunk", "block", "cells"), [(8 << 20, 200_000, 1 << 21), (50, 40, 60)])
def test_divergence_against_plain_python(spark, monkeypatch, chunk, block, cells):
    monkeypatch.setattr(divergence, "BLOCK_ROWS", block)
    for name, value in (("CHUNK", chunk), ("CELLS", cells)):
        monkeypatch.setattr(divergence, name, value)
    rows = _sourced()
    got = [tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DOC).repartition(4)).collect()]
    assert len(got) == len(set(got)) and set(got) == _plain_audit(rows)
    assert any(r[2] == "pair" and r[0] == "la" and r[4] == 0 for r in got)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOC)).count() == 0
    one = divergence.audit(spark.createDataFrame([(1, None, None, None)], "doc_id long, text string, lang string, source string"))
    assert one.collect() == []


def test_colliding_hashes_are_told_apart_by_bytes():
    texts = pa.array(["ab ba ab", "", "cd ab", "dcba", "ba"])
    group = np.array([0, 0, 1, 1, 0])
    true = divergence.count_terms(texts, group)
    for digest in (len, lambda b: 7):
        g, t, n, d = divergence.count_terms(texts, group, digest)
        rows = lambda x: sorted(zip(x[0].tolist(), x[1].to_pylist(), x[2].tolist(), x[3].tolist(), strict=True))
        assert rows((g, t, n, d)) == rows(true) == [(0, "ab", 2, 1), (0, "ba", 2, 2), (1, "ab", 1, 1), (1, "cd", 1, 1), (1, "dcba", 1, 1)]


def test_shares_are_exact():
    rng = random.Random(1)
    for top in (10, 10**6, 9 * 10**15, 10**17):
        total = np.array([rng.randrange(top // 2, top) for _ in range(50)])
        count = np.array([rng.randrange(0, int(t)) for t in total])
        assert divergence.share(count, total).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]
