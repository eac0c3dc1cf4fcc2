"""Source divergence audit: how far the sources of a language are from each other in their terms, and which terms set them apart.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased. A byte-level tokenizer finds them: what parts terms is ASCII, so one lookup
table over the bytes of a batch's concatenated UTF-8 texts gives all boundaries, in numpy. Slices are grouped by xxhash; each
slice is compared byte by byte with the first of its group, and a slice that differs (a collision) is grouped by its bytes. Spark
adds the counts up, on the map side first. Kept terms are dealt to blocks of about BLOCK_ROWS rows of a language; a block is a CSR matrix
(terms by sources), whose row sums by `reduceat` are the language's counts and whose divergences are summed by `reduceat` too.

All arithmetic is in integers. A kept term's share is p = 1 + floor(10**9 * (count + 1) / (N + V)), with the number of occurrences N and of kept
terms V; the divergence is floor((p - q)**2 / q). Sums stay below 2**63 for up to 10**9 kept terms of a language.

Null text, lang and source are ''. A group without terms has pairs like any other; a language without kept terms has pairs of
value 0. Repeated rows count each. Texts of any length are read whole; a task holds some ten times its longest text. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Documents that a kept term needs, scale of the shares, ranks of the terms.
MIN_DOCS, SCALE, TOP = 3, 10**9, 200
#: Bytes of text that are cut into terms at a time, rows (term, source) of a block, cells of a dense part of one.
CHUNK, BLOCK_ROWS, CELLS = 8 << 20, 200_000, 1 << 21


def lower_table() -> np.ndarray:
    """For each byte its lower case, 0 where it parts terms."""
    b = np.arange(256, dtype=np.uint8)
    letter = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    return np.where(letter, np.where((b >= 65) & (b <= 90), b + 32, b), 0).astype(np.uint8)


def slices(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each term in concatenated texts (bytes after the table; ends: where each text ends)."""
    inside = data != 0
    opens, closes = inside.copy(), np.empty_like(inside)
    opens[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    opens[heads] = inside[heads]  # a text's first byte begins a term, whatever the text before ended with
    closes[:-1] = inside[:-1] & ~inside[1:]
    closes[-1:] = inside[-1:]
    cut = ends[(ends > 0) & (ends <= len(data))] - 1
    closes[cut] = inside[cut]
    a, z = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return a, z, np.searchsorted(ends, a, side="right")


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[a:a+n] equals data[b:b+n], for arrays of slices (n >= 1)."""
    out = np.ones(len(a), dtype=bool)
    step = 1 << 18
    for i in range(0, len(a), step):
        x, y, m = a[i : i + step], b[i : i + step], n[i : i + step]
        at = np.cumsum(m) - m
        run = np.arange(int(m.sum())) - np.repeat(at, m)
        out[i : i + step] = np.logical_and.reduceat(data[np.repeat(x, m) + run] == data[np.repeat(y, m) + run], at)
    return out


def xxh(b: memoryview) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b)


def grouped(data: np.ndarray, a: np.ndarray, z: np.ndarray, digest: Callable[[memoryview], int] = xxh) -> tuple[np.ndarray, np.ndarray]:
    """(term number of each slice, first slice of each term): equal numbers exactly where the bytes are equal."""
    view = memoryview(data)
    h = np.fromiter((digest(view[i:j]) for i, j in zip(a.tolist(), z.tolist(), strict=True)), np.uint64, len(a))
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    n, rep = z - a, first[which]
    ok = n == n[rep]
    same = np.flatnonzero(ok)
    ok[same] = same_bytes(data, a[same], a[rep[same]], n[same])
    if ok.all():
        return which, first
    more, firsts, which = {}, first.tolist(), which.copy()
    for i in np.flatnonzero(~ok).tolist():  # collisions
        t = (int(h[i]), data[a[i] : z[i]].tobytes())
        if t not in more:
            more[t] = len(firsts)
            firsts.append(i)
        which[i] = more[t]
    return which, np.array(firsts)


def count_terms(texts: pa.Array, group: np.ndarray, digest: Callable[[memoryview], int] = xxh) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of texts without nulls; group numbers the texts' groups."""
    texts = texts.cast(pa.large_string())
    _, off, raw = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = lower_table()[np.frombuffer(raw, np.uint8)[off[0] : off[-1]]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    a, z, doc = slices(data, off[1:] - off[0]) if len(data) else (np.zeros(0, np.int64),) * 3
    if not len(a):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    which, first = grouped(data, a, z, digest)
    cell, held = np.unique(doc * len(first) + which, return_counts=True)  # a text and a term
    doc, term = np.divmod(cell, len(first))
    order = np.lexsort((term, group[doc]))
    g, t, held = group[doc][order], term[order], held[order]
    at = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (t[1:] != t[:-1])])
    names = [data[a[i] : z[i]].tobytes() for i in first.tolist()]
    return g[at], pa.array(names, pa.binary()).cast(pa.string()).take(pa.array(t[at])), np.add.reduceat(held, at), np.diff(np.r_[at, len(g)])


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of up to `most` bytes, one row at least."""
    start, held = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and held + s > most:
            yield start, i
            start, held = i, 0
        held += s
    if len(sizes):
        yield start, len(sizes)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all documents (lang, source, text without nulls)."""
    names, most = ["lang", "source", "term", "n", "docs"], CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, source = (b.column(c).dictionary_encode() for c in ("lang", "source"))
            k = max(1, len(source.dictionary))
            group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * k + source.indices.to_numpy(zero_copy_only=False)
            for i, j in _chunks(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False), most):
                g, term, n, d = count_terms(b.column("text").slice(i, j - i), group[i:j])
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(g // k)), source.dictionary.take(pa.array(g % k)), term, pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=names)

    got = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return got.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), elementwise and exact; count + 1 <= total."""
    if int(total.max(initial=1)) >= 2**63 // 1001:
        return np.array([1 + SCALE * (int(c) + 1) // int(t) for c, t in np.broadcast(count, total)], dtype=np.int64).reshape(np.broadcast_shapes(count.shape, total.shape))
    whole, rest = np.divmod(count + 1, total)
    for _ in range(3):  # three digits at a time, so that nothing exceeds 64 bits
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return 1 + whole


def block_divergences(term: np.ndarray, source: np.ndarray, count: np.ndarray, totals: np.ndarray, kept: int, top: int = TOP, cells: int = CELLS) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one block in CSR order (term numbers ascending, source numbers, counts), with each source's occurrences and the number of kept terms of
    the language: the divergences of all pairs of sources, summed (sources by sources), and (source, term, value) of each source's best terms."""
    s = len(totals)
    heads = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    row = np.cumsum(np.r_[False, term[1:] != term[:-1]])
    whole = np.add.reduceat(count, heads)
    q = share(whole, np.array([int(totals.sum()) + kept]))[row]
    p = share(count, (totals + kept)[source])
    f = (p - q) * (p - q) // q
    own = np.flatnonzero((count > 0) & (p > q))
    own = own[np.lexsort((term[own], -f[own], source[own]))]
    begin = np.flatnonzero(np.r_[True, source[own][1:] != source[own][:-1]]) if len(own) else own
    place = np.arange(len(own)) - np.repeat(begin, np.diff(np.r_[begin, len(own)]))
    own = own[place < top]

    sums, indptr = np.zeros((s, s), dtype=np.int64), np.r_[heads, len(term)]
    none = share(np.zeros(s, dtype=np.int64), totals + kept)
    step = max(1, cells // s)
    for i in range(0, len(heads), step):
        m = min(step, len(heads) - i)
        lo, hi = indptr[i], indptr[i + m]
        dense = np.repeat(none[:, None], m, axis=1)
        dense[source[lo:hi], row[lo:hi] - i] = p[lo:hi]
        for k in range(s):
            d = dense[k] - dense
            sums[k] += np.add.reduceat((d * d // dense).ravel(), np.arange(s) * m)
    return sums, (source[own], term[own], f[own])


def _block(key: tuple, rows: pa.Table, groups: pa.Table, top: int, cells: int) -> pa.Table:
    """One block's part sums of pairs and candidates of terms. rows (term, source, n), groups (source, total, kept): all sources of the language."""
    names = groups.column("source").combine_chunks().sort()
    place = {x: i for i, x in enumerate(names.to_pylist())}
    totals = np.zeros(len(names), dtype=np.int64)
    totals[[place[x] for x in groups.column("source").to_pylist()]] = groups.column("total").to_numpy()
    rows = rows.sort_by([("term", "ascending"), ("source", "ascending")])
    terms = rows.column("term").combine_chunks().dictionary_encode()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    source = np.array([place[x] for x in rows.column("source").to_pylist()], dtype=np.int64)
    number = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)  # in order of the terms' bytes, since rows are
    kept = int(groups.column("kept")[0].as_py())
    sums, (s, t, f) = block_divergences(number, source, rows.column("n").to_numpy(), totals, kept, top, cells)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    take = lambda x, i: x.take(pa.array(i, pa.int64()))
    lang = pa.array([key[0].as_py()] * (len(a) + len(s)), pa.string())
    part = pa.array(["pair"] * len(a) + ["term"] * len(s), pa.string())
    who = pa.concat_arrays([take(names, a), take(names, s)])
    item = pa.concat_arrays([take(names, b), take(terms.dictionary, t)])
    return pa.table({"lang": lang, "source": who.cast(pa.string()), "part": part, "item": item.cast(pa.string()), "value": pa.array(np.r_[sums[a, b], f], pa.int64())})


def audit(docs: DataFrame, scratch: Scratch | None = None, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair holds every other source of the language, part term the terms that the source has more
    of than its language, `top` at most (that limit is the feature).

    Two tables go to the shared folder: kept counts and groups. A term's rows are one per source of its language; blocks are sized by a
    language's rows, so neither a large language nor a large source makes a large block."""
    own = scratch or Scratch(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    d = docs.select(text("lang"), text("source"), text("text"))
    term = Window.partitionBy("lang", "term")
    counts = term_counts(d).withColumn("held", F.sum("docs").over(term)).where(F.col("held") >= min_docs)
    kept = own.store(counts.select("lang", "source", "term", "n"), "kept-terms")
    total = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    size = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("kept"))
    groups = d.select("lang", "source").distinct().join(total, ["lang", "source"], "left").join(size, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
    groups = own.store(groups, "groups")
    deal = groups.groupBy("lang").agg(F.ceil(F.sum("rows") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = kept.join(deal, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).select("lang", "block", "term", "source", "n")
    sides = groups.join(deal.where("blocks > 0"), "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "kept")

    cells = CELLS

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # a block that no term fell in
            return pa.table({c: pa.array([], k) for c, k in zip(("lang", "source", "part", "item", "value"), (pa.string(),) * 4 + (pa.int64(),), strict=True)})
        return _block(key, left, right, top, cells)

    out = "lang string, source string, part string, item string, value long"
    got = own.store(rows.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInArrow(work, out), "divergences")
    sums = got.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")  # what the result holds
    pairs = every.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(order))
    terms = ranked(got.where("part = 'term'")).where(F.col("rank") <= top)
    return ranked(pairs).unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS held FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(held) >= 3), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d), m AS (SELECT g.lang, g.source, k.term, k.n AS whole, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS total FROM m GROUP BY ALL), sl AS (SELECT lang, sum(n) AS total FROM k GROUP BY lang),
p AS (SELECT m.lang, m.source, m.term, n, 1 + (1000000000::HUGEINT * (n + 1)::HUGEINT // (s.total + v.v)::HUGEINT) AS p, 1 + (1000000000::HUGEINT * (whole + 1)::HUGEINT // (sl.total + v.v)::HUGEINT) AS q
  FROM m JOIN s USING (lang, source) JOIN sl USING (lang) JOIN v USING (lang)),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pr.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= 200
"""
