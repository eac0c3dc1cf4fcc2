"""Quality rules, line first (DataFrame functions only).

Base rules count over the whole text. Then every line is judged by itself; failing lines are removed, and a document that
loses more than max_loss of its words is rejected.

A null text has no lines and no words: it fails the base rules. Empty texts likewise. Repeated rows are judged each by
itself. Extra columns pass through `passing` untouched, whatever they are called; `score` replaces those named like its results
(RESULTS). Texts of any length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free, let, words_of

#: The base rules' symbols, shortest document and largest share of repeated words (in hundredths).
SYMBOLS, MIN_WORDS, MAX_REPEAT, WINDOW = "#*$%&|<>", 20, 30, 8
#: Largest share of its words that a document may lose with its failing lines.
MAX_LOSS = 0.3
#: Phrases of page furniture, lower case.
PHRASES = [
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript", "accept cookies", "subscribe to our newsletter", "click here to",
    "alle rechte vorbehalten", "datenschutzerklärung", "tous droits réservés", "politique de confidentialité", "todos los derechos reservados", "política de privacidad",
]


def count_of(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def repeat_words(hashes: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more. Windows are sorted by hash within the row, so the
    cost is n log n; rows without a repeated window stop at the distinct count."""
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))

    def covered(w: Column) -> Column:
        def starts(s: Column) -> Column:
            same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        reach = lambda p: F.aggregate(F.transform(p, lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - a, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda t, x: t + x)
        return let(pairs, lambda s: let(starts(s), reach))

    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w))))


def judged_lines(text: Column) -> Column:
    """Lines as (line, words, ok). Rules: symbols, navigation bars, shouting, exclamation, stubs without end punctuation,
    page-furniture phrases, and lines that the text repeats three times or more (all but the first)."""

    def look(line: Column) -> Column:
        def rule(f: Column) -> Column:
            w, low = f["w"], f["low"]
            furniture = low.rlike("|".join(PHRASES))
            return (
                ((f["symbols"] >= 3) & (5 * f["symbols"] > w))
                | ((f["bars"] >= 3) & (6 * f["bars"] > w))
                | ((w >= 3) & (F.upper(line) == line) & (low != line))
                | ((w >= 3) & (3 * count_of(line, "!") > w))
                | ((w >= 1) & (w <= 3) & ~line.rlike(r"[.!?:;,…。！？]['\"”»)\]]*\s*$"))
                | ((w <= 30) & furniture)
            )

        facts = F.struct(F.regexp_count(line, F.lit(WORD)).alias("w"), F.lower(line).alias("low"), count_of(line, SYMBOLS).alias("symbols"), count_of(line, "|").alias("bars"))
        return let(facts, lambda f: F.struct(line.alias("line"), f["w"].alias("words"), (~rule(f)).alias("ok")))

    def repeated(ls: Column) -> Column:
        # sorted by line then place, a line's later occurrences follow its first; back in order of place after that
        def back(s: Column) -> Column:
            same = lambda x, j: F.coalesce(x["line"] == F.get(s, j)["line"], F.lit(False))
            late = F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), (same(x, j - 1) & (same(x, j - 2) | same(x, j + 1)) & x["line"].rlike(WORD)).alias("late")))
            return F.transform(F.array_sort(late), lambda r: let(F.get(ls, r["i"]), lambda z: F.struct(z["line"].alias("line"), z["words"].alias("words"), (z["ok"] & ~r["late"]).alias("ok"))))

        pairs = F.array_sort(F.transform(ls, lambda r, i: F.struct(r["line"].alias("line"), i.alias("i"))))
        return F.when(F.size(ls) < 3, ls).otherwise(let(pairs, back))

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), look), repeated)


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept", "clean_text"]


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with RESULTS: the base counts, base_failed, lost_words, kept and clean_text."""
    return _scored(docs, text, RESULTS)


def _scored(docs: DataFrame, text: str, names: list[str]) -> DataFrame:
    """docs with RESULTS under other names."""
    hashes, judged = free(docs, "_hashes", "_judged")
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, kept, clean_text = names
    t = F.coalesce(F.col(text), F.lit(""))
    n = lambda ls: F.filter(F.split(ls, "\n"), lambda x: x.rlike(WORD))
    d = docs.withColumn(hashes, F.transform(words_of(t), lambda w: F.xxhash64(w))).withColumn(judged, judged_lines(F.col(text)))
    d = d.withColumn(n_words, F.size(hashes).cast("long"))
    d = d.withColumn(word_chars, F.char_length(F.translate(t, " \t\n\u000b\f\r", "")).cast("long"))
    d = d.withColumn(n_symbols, count_of(t, SYMBOLS).cast("long"))
    d = d.withColumn(n_dup_lines, let(n(t), lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))
    d = d.withColumn(n_repeat_words, let(F.col(hashes), repeat_words))
    d = d.withColumn(base_failed, (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat_words) > MAX_REPEAT * F.col(n_words)))
    d = d.withColumn(lost_words, F.aggregate(judged, F.lit(0).cast("long"), lambda a, r: a + F.when(r["ok"], F.lit(0)).otherwise(r["words"])))
    d = d.withColumn(kept, ~F.col(base_failed) & (F.col(lost_words) <= F.col(n_words) * MAX_LOSS))
    d = d.withColumn(clean_text, F.array_join(F.transform(F.filter(judged, lambda r: r["ok"]), lambda r: r["line"]), "\n"))
    return d.drop(hashes, judged)


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs that are kept, with their text cleaned.

    The choice goes through a generator: a plain filter would be pushed below the columns it reads, which the optimizer
    would then compute again inside it, once for every mention."""
    names = free(docs, *[f"_{x}" for x in RESULTS])
    pick, got = free(docs, "_pick", "_got")
    d = _scored(docs, text, names).withColumn(pick, F.when(F.col(names[7]), F.array(F.struct(F.col(names[8]).alias("t")))).otherwise(F.array()))
    d = d.select(*[f"`{c}`" for c in docs.columns if c != text], F.explode_outer(pick).alias(got)).where(F.col(got).isNotNull())
    return d.withColumn(text, F.col(f"{got}.t")).select(*[f"`{c}`" for c in docs.columns])


_FURNITURE = "|".join(PHRASES)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t, text IS NULL AS nul FROM documents), w AS (SELECT n, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g0 AS (SELECT n, list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: array_to_string(ws[i:(i + {WINDOW - 1})], ' ')) AS gs FROM w WHERE len(ws) > {WINDOW}),
g1 AS (SELECT n, unnest(gs) AS g, generate_subscripts(gs, 1) AS i FROM g0), g2 AS (SELECT n, i, count(*) OVER (PARTITION BY n, g) AS c FROM g1),
g3 AS (SELECT n, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY n ORDER BY i) - i, {WINDOW})) AS k FROM g2 WHERE c > 1), rep AS (SELECT n, sum(k) AS k FROM g3 GROUP BY n),
l0 AS (SELECT n, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
l1 AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w, lower(line) AS low, length(line) - length(translate(line, '{SYMBOLS}', '')) AS sy, length(line) - length(replace(line, '|', '')) AS ba, length(line) - length(replace(line, '!', '')) AS ex,
  count(*) OVER (PARTITION BY n, line) AS c, row_number() OVER (PARTITION BY n, line ORDER BY i) AS r FROM l0),
l2 AS (SELECT *, (sy >= 3 AND 5 * sy > w) OR (ba >= 3 AND 6 * ba > w) OR (w >= 3 AND upper(line) = line AND low <> line) OR (w >= 3 AND 3 * ex > w)
  OR (w BETWEEN 1 AND 3 AND NOT regexp_matches(line, '[.!?:;,…。！？][''"”»)\]]*\s*$')) OR (w <= 30 AND regexp_matches(low, '{_FURNITURE}')) OR (c >= 3 AND r > 1 AND w > 0) AS bad FROM l1),
l3 AS (SELECT n, sum(CASE WHEN bad THEN w ELSE 0 END) AS lost, count(*) FILTER (w > 0) - count(DISTINCT line) FILTER (w > 0) AS dups FROM l2 GROUP BY n),
x AS (SELECT d.n, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(dups AS BIGINT) AS n_dup_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words, CAST(lost AS BIGINT) AS lost_words
  FROM d JOIN w ON d.n = w.n JOIN l3 ON d.n = l3.n LEFT JOIN rep ON d.n = rep.n),
y AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_words <= n_words * {MAX_LOSS}::DOUBLE AS kept, lost_words FROM y
"""
