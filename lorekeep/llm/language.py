"""Language identification by Bayesian evidence fusion.

Four kinds of evidence multiply. Text: naive Bayes over hashed character trigrams, its log-odds tempered (neighbouring
trigrams aren't independent). Declared markup language and address suffix: likelihoods of what is declared given the language.
Host: a prior smoothed in levels, host to site to corpus. The last three are counted by grouped aggregation of the text
posteriors of all rows, so a host or an author who declares nonsense is worth little. A row's own posterior is left out of
every count that is evidence for it, so its text speaks once.

Besides the languages of the labelled rows there is OTHER, for text in none of them: its likelihood is that of trigrams that come
as they please, each cell alike. A row it wins has the language it declares, if no labelled row has that one, else OTHER.

The trigram model is fitted on at most TRAIN_ROWS labelled rows (those with the smallest hash of id); counts and priors
cover every row. Null or empty texts rest on the other evidence, a row without any on the corpus prior. Null hosts share the
corpus prior. Repeated rows count as often as they occur, each for the others; extra columns pass through. Texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free, stored

#: Rows the text model is fitted on, hashed trigrams, tempering, and pseudo-counts of the host, site and likelihood levels.
TRAIN_ROWS, CELLS, TEMPER, FLOOR = 4000, 1 << 15, 0.25, 0.5
HOST_WEIGHT, SITE_WEIGHT, DECLARED_WEIGHT = 5.0, 20.0, 2.0
#: What text in no labelled language is called.
OTHER = "und"
#: Second labels below which a country's sites are registered.
SECOND = ["ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ne", "net", "or", "org"]
#: Rows of a table of declared values that is broadcast; a host with over 1 / HOT_SHARE of all rows (so HOT_SHARE at most) is, too.
SMALL, HOT_SHARE = 100_000, 10_000


def cells(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased text."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    return ((x[:-2] * 1000003 + x[1:-1]) * 1000003 + x[2:]) % 2147483647 % CELLS


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods[languages, CELLS]) of a bounded sample of labelled rows; the last is OTHER, if there is any other."""
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull())
    # the sample is drawn on ids alone; at most `rows` of them are broadcast to fetch the texts
    ids = known.select(key).distinct().orderBy(F.xxhash64(key, F.lit(3)), key).limit(rows)
    some = known.select(F.col(key), F.col(lang).alias("l"), F.col(text).alias("t")).join(F.broadcast(ids), key, "left_semi").select("l", "t")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for l, t in zip(b["l"], b["t"], strict=True):
                sums[l] = sums.get(l, 0) + np.bincount(cells(t), minlength=CELLS)
        for l, s in sums.items():
            hit = np.flatnonzero(s)
            yield pd.DataFrame({"l": l, "cell": hit, "n": s[hit]})

    got = some.mapInPandas(count, "l string, cell long, n long").groupBy("l", "cell").agg(F.sum("n").alias("n")).toPandas()  # languages x CELLS at most
    langs = sorted(set(got["l"]) - {OTHER})
    langs += [OTHER] * bool(langs)
    table = np.full((max(len(langs), 1), CELLS), FLOOR)  # the row of OTHER stays even
    for i, l in enumerate(langs[:-1]):
        g = got[got["l"] == l]
        table[i, g["cell"]] += g["n"]
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def text_scores(rows: DataFrame, model: tuple[list[str], np.ndarray], text: str, keep: list[str]) -> DataFrame:
    """keep columns with `ll`: tempered log-likelihoods, the largest 0; nulls and empty texts have zeros."""
    langs, table = model
    shared = rows.sparkSession.sparkContext.broadcast(table)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", ll array<double>"
    (own,) = free(rows, "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.ascontiguousarray(shared.value.T)
        for b in batches:
            out = []
            for x in b.column(own):
                s, x = np.zeros(len(langs)), x.as_py()
                if x:
                    c = cells(x)
                    for a in range(0, len(c), 1 << 16):
                        s += t[c[a : a + (1 << 16)]].sum(0)
                    s = (s - s.max()) * TEMPER
                out.append(s)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.list_(pa.float64()))], names=[*keep, "ll"])

    return rows.select(*keep, F.col(text).alias(own)).mapInArrow(run, schema)


def _softmax(ll: Column) -> Column:
    e = F.transform(ll, lambda x: F.exp(x - F.array_max(ll)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _sums(n: int, p: str = "post") -> Column:
    return F.array(*[F.sum(F.col(p)[i]) for i in range(n)])


def fuse(scored: DataFrame, langs: list[str], scratch: Scratch | None = None) -> DataFrame:
    """scored (…, ll, declared, suffix, host, site) with lang, confidence, posterior. Counts leave the row itself out.

    Tables of counts go to scratch; the result reads them."""
    n, zero = len(langs), F.array(*[F.lit(0.0)] * len(langs))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))  # noqa: E731  (rounding may fall below 0)
    s = scored.withColumn("post", _softmax(F.col("ll")))
    whole = s.agg(F.coalesce(_sums(n), zero).alias("all"), F.count("*").alias("rows"))

    def given(c: str) -> DataFrame:
        """Counts of c by language, their totals, number of values."""
        g = s.where(F.col(c).isNotNull()).groupBy(c).agg(_sums(n).alias("k"))
        total = g.agg(F.array(*[F.sum(F.col("k")[i]) for i in range(n)]).alias("t"), F.count("*").alias("v"))
        # one row of totals; the table has a row for each declared value
        g = g.crossJoin(F.broadcast(total)).select(F.col(c).alias(f"_{c}"), F.struct("k", "t", "v").alias(f"n_{c}"))
        g = stored(g, "declared", scratch)
        return F.broadcast(g) if g.count() <= SMALL else g

    def likelihood(c: str) -> Column:
        """log P(c | language) by the other rows' counts with pseudo-counts; no evidence where c is null."""
        k, t, v = (F.col(f"n_{c}")[x] for x in ("k", "t", "v"))
        p = F.zip_with(minus(k, F.col("post")), minus(t, F.col("post")), lambda k, t: F.log((k + DECLARED_WEIGHT / v) / (t + DECLARED_WEIGHT)))
        return F.when(F.col(f"n_{c}").isNull(), zero).otherwise(p)

    counted = lambda *by: s.where(F.col(by[0]).isNotNull()).groupBy(*by).agg(_sums(n).alias("k"), F.count("*").alias("m"))
    site = counted("site").select("site", F.struct("k", "m").alias("at_site"))
    host = counted("host", "site").join(site, "site", "left").select(F.col("host").alias("_host"), F.col("site").alias("_site"), F.struct("k", "m").alias("at_host"), "at_site")
    # a host that holds much of the corpus would be one task: those few reach their rows by broadcast, the rest by a join
    hot, same = host.where(F.col("at_host.m") > max(1, scored.count() // HOT_SHARE)), (F.col("host") == F.col("_host")) & F.col("site").eqNullSafe(F.col("_site"))
    warm = s.join(F.broadcast(hot), same)
    cold = s.join(F.broadcast(hot), same, "left_anti").join(host, same, "left")
    out = warm.unionByName(cold).crossJoin(F.broadcast(whole))
    for c in ("declared", "suffix"):
        out = out.join(given(c), F.col(c) == F.col(f"_{c}"), "left")

    def level(at: str, up: Column, weight: float) -> Column:
        """The prior by the other rows at this level, drawn to the one above."""
        p = F.zip_with(minus(F.col(at)["k"], F.col("post")), up, lambda k, u: (k + weight * u) / (F.col(at)["m"] - 1 + weight))
        return F.when(F.col(at).isNull(), up).otherwise(p)

    corpus = F.transform(minus(F.col("all"), F.col("post")), lambda x: (x + 1.0) / (F.col("rows") - 1 + float(n)))
    out = out.withColumn("_prior", level("at_host", level("at_site", corpus, SITE_WEIGHT), HOST_WEIGHT))
    total = plus(plus(F.col("ll"), F.transform("_prior", lambda x: F.log(x))), plus(likelihood("declared"), likelihood("suffix")))
    out = out.withColumn("_total", total).withColumn("posterior", _softmax(F.col("_total")))
    best = F.get(F.array(*[F.lit(x) for x in langs]), F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    unseen = (best == OTHER) & F.col("declared").isNotNull() & ~F.col("declared").isin(langs)
    return out.withColumn("confidence", F.array_max("posterior")).withColumn("lang", F.when(unseen, F.col("declared")).otherwise(best)).select(*scored.columns, "lang", "confidence", "posterior")


def page_evidence(pages: DataFrame) -> DataFrame:
    """pages with visible text, declared language, address suffix (a language directory or the top-level domain), host, site."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))
    directory = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", 1)), F.lit(""))
    d = pages.withColumn("visible", F.trim(F.regexp_replace(text, r"&[A-Za-z#0-9]{1,8};|\s+", " "))).withColumn("host", host)
    d = d.withColumn("site", F.nullif(F.regexp_extract(F.coalesce("host", F.lit("")), rf"((?:[^.]+\.(?:{'|'.join(SECOND)})\.[a-z]{{2}}|[^.]+\.[^.]+))$", 1), F.lit("")))
    d = d.withColumn("declared", F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2})", 1)), F.lit("")))
    return d.withColumn("suffix", F.coalesce(directory, F.nullif(F.concat(F.lit("."), F.regexp_extract(F.coalesce("host", F.lit("")), r"([^.]+)$", 1)), F.lit("."))))


def identify(docs: DataFrame, pages: DataFrame, rows: int = TRAIN_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, page_id, declared, lang, confidence): every document (text and source) and every page (all evidence).

    The documents' own language column is what the text model learns from and is no evidence for them."""
    model = fit(docs, rows)
    none = F.lit(None).cast("string")
    if not model[0]:
        blank = [F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence")]
        return docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), *blank).unionByName(pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", *blank))
    d = text_scores(docs.select("doc_id", "text", F.col("source").alias("host")), model, "text", ["doc_id", "host"]).withColumn("site", none).withColumn("declared", none).withColumn("suffix", none)
    p = text_scores(page_evidence(pages), model, "visible", ["page_id", "host", "site", "declared", "suffix"])
    pick = ["doc_id", "page_id", "declared", "lang", "confidence"]
    a = fuse(stored(d, "scores", scratch), model[0], scratch).withColumn("page_id", F.lit(None).cast("long")).select(*pick)
    b = fuse(stored(p, "scores", scratch), model[0], scratch).withColumn("doc_id", F.lit(None).cast("long")).select(*pick)
    return a.unionByName(b)
