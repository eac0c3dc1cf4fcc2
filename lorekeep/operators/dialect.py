"""Lossy summaries: emotions, flags, topics, key sentence and entity codes, joined into one index line; and the skeleton form."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, runs

#: Words that signal an emotion, with its code, in order.
EMOTIONS = {
    "decided": "determ", "prefer": "convict", "worried": "anx", "excited": "excite", "frustrated": "frust", "confused": "confuse", "love": "love", "hate": "rage", "hope": "hope", "fear": "fear", "trust": "trust",
    "happy": "joy", "sad": "grief", "surprised": "surprise", "grateful": "grat", "curious": "curious", "wonder": "wonder", "anxious": "anx", "relieved": "relief", "satisf": "satis", "disappoint": "grief", "concern": "anx",
}
#: Words that signal a flag, in order.
FLAGS = {
    "decided": "DECISION", "chose": "DECISION", "switched": "DECISION", "migrated": "DECISION", "replaced": "DECISION", "instead of": "DECISION", "because": "DECISION",
    "founded": "ORIGIN", "created": "ORIGIN", "started": "ORIGIN", "born": "ORIGIN", "launched": "ORIGIN", "first time": "ORIGIN",
    "core": "CORE", "fundamental": "CORE", "essential": "CORE", "principle": "CORE", "belief": "CORE", "always": "CORE", "never forget": "CORE",
    "turning point": "PIVOT", "changed everything": "PIVOT", "realized": "PIVOT", "breakthrough": "PIVOT", "epiphany": "PIVOT",
    "api": "TECHNICAL", "database": "TECHNICAL", "architecture": "TECHNICAL", "deploy": "TECHNICAL", "infrastructure": "TECHNICAL", "algorithm": "TECHNICAL", "framework": "TECHNICAL", "server": "TECHNICAL", "config": "TECHNICAL",
}
#: Codes of named emotions.
EMOTION_CODES = {
    "vulnerability": "vul", "vulnerable": "vul", "joy": "joy", "joyful": "joy", "fear": "fear", "mild_fear": "fear", "trust": "trust", "trust_building": "trust", "grief": "grief", "raw_grief": "grief", "wonder": "wonder", "philosophical_wonder": "wonder",
    "rage": "rage", "anger": "rage", "love": "love", "devotion": "love", "hope": "hope", "despair": "despair", "hopelessness": "despair", "peace": "peace", "relief": "relief", "humor": "humor", "dark_humor": "humor", "tenderness": "tender",
    "raw_honesty": "raw", "brutal_honesty": "raw", "self_doubt": "doubt", "anxiety": "anx", "exhaustion": "exhaust", "conviction": "convict", "quiet_passion": "passion", "warmth": "warmth", "curiosity": "curious", "gratitude": "grat",
    "frustration": "frust", "confusion": "confuse", "satisfaction": "satis", "excitement": "excite", "determination": "determ", "surprise": "surprise",
}
#: Words that are never topics.
STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into about between through during before after above below up down "
    "out off over under again further then once here there when where why how all each every both few more most other some such no nor not only own same so than too very just don now and but or if while that this "
    "these those it its i we you he she they me him her us them my your his our their what which who whom also much many like because since get got use used using make made thing things way well really want need"
).split()
#: Words that mark a decisive sentence.
DECISIVE = "decided because instead prefer switched chose realized important key critical discovered learned conclusion solution reason why breakthrough insight".split()


def signals(text: Column, table: dict[str, str], limit: int = 3) -> Column:
    """Codes of the table's words that the folded text holds, in table order, without repeats."""
    # array functions with a lambda aren't compiled, nor is what they are given: there, each mention of lower(text) would be computed
    got = let(F.lower(text), lambda low: F.array(*[F.when(low.contains(w), F.lit(code)) for w, code in table.items()]))
    return F.slice(F.array_distinct(F.filter(got, lambda x: x.isNotNull())), 1, limit)


def encode_emotions(codes: Column) -> Column:
    """Named emotions as codes (else their first four letters), without repeats, three at most, joined by +."""
    table = F.create_map(*[F.lit(x) for kv in EMOTION_CODES.items() for x in kv])
    return F.array_join(F.slice(F.array_distinct(F.transform(codes, lambda e: F.coalesce(F.try_element_at(table, e), F.substring(e, 1, 4)))), 1, 3), "+")


def topics(text: Column, n: int = 3) -> Column:
    """Array of the most frequent words; a capital or an inner mark counts two more each; ties by first occurrence. A null text has none.

    Counting words of a text needs a hash table, which no built-in expression has within a row: sorting them there took three times as long as this
    Arrow function (20 s against 6 s on 10,000 documents), and exploding them would shuffle every word."""

    @F.arrow_udf("array<string>")
    def count(s: pa.Array) -> pa.Array:  # a text is a Python string only while it is counted
        find, stop = re.compile("[a-zA-Z][a-zA-Z_-]{2,}").findall, set(STOP)

        def best(t: str | None) -> list[str]:
            score: dict[str, int] = {}  # in order of first occurrence
            for w, k in Counter(find(t or "")).items():
                low = w.lower()
                if low not in stop:
                    points = 1 + 2 * ("A" <= w[0] <= "Z") + 2 * ("_" in w or "-" in w or low[1:] != w[1:])
                    score[low] = score.get(low, 0) + points * k
            return sorted(score, key=lambda w: -score[w])[:n]

        return pa.array((best(t.as_py()) for t in s), pa.list_(pa.string()))

    return count(text)


def key_sentence(text: Column) -> Column:
    """The first best sentence: decisive words count 2 each, under 80 and under 40 characters 1 each, over 150 minus 2; cut at 55.

    An Arrow function, as in `topics`: array functions with a lambda aren't compiled, and sentences there took most of an index line's time."""

    @F.arrow_udf("string")
    def first(s: pa.Array) -> pa.Array:
        cut, white = re.compile(r"[.!?\n]+").split, " \t\n\x0b\f\r"

        def best(t: str | None) -> str:
            low = (t or "").lower()
            words = [w for w in DECISIVE if w in low]  # a sentence has no others
            top, found = None, ""
            for p in cut(t or ""):
                p = p.strip(white)
                if (n := len(p)) > 10:
                    points = (n < 80) + (n < 40) - 2 * (n > 150)
                    if words:
                        low = p.lower()
                        points += 2 * sum(w in low for w in words)
                    if top is None or points > top:
                        top, found = points, p
            return found[:52] + "..." if len(found) > 55 else found

        return pa.array((best(t.as_py()) for t in s), pa.string())

    return first(text)


def entity_codes(text: Column, known: dict[str, str] | None = None, n: int = 3) -> Column:
    """Codes of known names in the text; without any, three letters of capitalised words that don't begin the text."""
    low = F.lower(text)
    names = {k: v for k, v in (known or {}).items() if k != k.lower()}
    found = F.array_distinct(F.filter(F.array(*[F.when(low.contains(k.lower()), F.lit(v)) for k, v in names.items()]), lambda x: x.isNotNull())) if names else F.array().cast("array<string>")

    @F.arrow_udf("array<string>")
    def guess(s: pa.Array) -> pa.Array:  # as in `topics`; no further than the n-th code
        word, letters, capital, name, stop = re.compile(r"[^ \t\n\x0b\f\r]+").finditer, re.compile("[^a-zA-Z]+").sub, re.compile("[^a-zA-Z]*[A-Z]").match, re.compile("[A-Z][a-z]+").fullmatch, set(STOP)

        def codes(t: str) -> list[str]:
            got: dict[str, None] = {}
            ws = word(t)
            next(ws, None)
            for m in ws:
                # only words whose first letter is a capital are cleaned
                if capital(w := m[0]) and name(w := letters("", w)) and w.lower() not in stop:
                    got[w[:3].upper()] = None
                    if len(got) == n:
                        break
            return list(got)

        return pa.array((None if (t := x.as_py()) is None else codes(t) for x in s), pa.list_(pa.string()))

    return F.when(F.size(found) > 0, found).otherwise(guess(text))


def index_line(text: Column, known: dict[str, str] | None = None) -> Column:
    """0:ENTITIES|topics|"sentence"|emotions|FLAGS of a text, from that row alone; a null text gives what an empty one does."""
    t = F.coalesce(text, F.lit(""))
    some = lambda x: let(x, lambda v: F.when(v != "", v))
    parts = [
        F.concat(F.lit("0:"), F.coalesce(some(F.array_join(F.slice(entity_codes(t, known), 1, 3), "+")), F.lit("???"))),
        let(topics(t), lambda x: F.when(F.size(x) == 0, "misc").otherwise(F.array_join(x, "_"))),
        let(key_sentence(t), lambda q: F.when(q != "", F.concat(F.lit('"'), q, F.lit('"')))),
        some(F.array_join(signals(t, EMOTIONS), "+")),
        some(F.array_join(signals(t, FLAGS), "+")),
    ]
    return F.concat_ws("|", *parts)


def compress(df: DataFrame, key: str, text: str, known: dict[str, str] | None = None, header: bool = False) -> DataFrame:
    """(key, line) for every row of df, those with null or repeated keys as well. header=True puts wing|room|date|stem before,
    from such columns."""
    line = index_line(F.col(text), known)
    if header:
        c = lambda n: F.coalesce(F.nullif(F.col(n), F.lit("")), F.lit("?")) if n in df.columns else F.lit("?")
        line = F.concat(F.concat_ws("|", c("wing"), c("room"), c("date"), c("stem")), F.lit("\n"), line)
    return df.select(key, line.alias("line"))


def decode(c: Column) -> Column:
    """Struct (arc, header, zettels, tunnels) of a dialect text's lines."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    plain = lambda x: ~x.startswith("ARC:") & ~x.startswith("T:")
    zettel = lambda x: plain(x) & x.rlike(r"^[^|]*:")
    return F.struct(
        F.regexp_replace(F.get(F.filter(lines, lambda x: x.startswith("ARC:")), F.lit(0)), "^ARC:", "").alias("arc"),
        F.get(F.filter(lines, lambda x: plain(x) & ~zettel(x) & x.contains("|")), F.lit(0)).alias("header"),
        F.filter(lines, zettel).alias("zettels"),
        F.filter(lines, lambda x: x.startswith("T:")).alias("tunnels"),
    )


def key_sentences(text: Column, count: Column, split: str = r"[。！？\n]+", words=None) -> Column:
    """The `count` sentences (over 10 characters) whose words are most frequent in the text, ties by text, last first. A word's
    frequency counts all sentences, repeats too. words(sentence), a Column function, cuts a sentence; without it, runs of letters, digits and _ of
    two characters or more, counted by an Arrow function (see `topics`)."""
    if words is None:
        return _best_sentences(text, count, split)
    parts = F.filter(F.transform(F.split(text, split), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.char_length(x) > 10)

    def best(ss: Column) -> Column:
        # two sorts within the row: by word, to add up frequencies, then by sentence, to add up scores
        seen = F.flatten(F.transform(ss, lambda s, i: F.transform(words(s), lambda w: F.struct(w.alias("w"), i.alias("i")))))
        often = F.flatten(runs(F.sort_array(seen), lambda a, b: a["w"] == b["w"], lambda r: F.transform(r, lambda x: F.struct(x["i"].alias("i"), F.size(r).alias("tf")))))
        score = runs(F.sort_array(often), lambda a, b: a["i"] == b["i"], lambda r: let(F.get(r, F.lit(0))["i"], lambda i: F.struct(F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x["tf"]).alias("score"), F.get(ss, i).alias("s"))))
        return F.transform(F.slice(F.sort_array(score, asc=False), F.lit(1), count), lambda x: x["s"])

    return F.coalesce(let(parts, best), F.array().cast("array<string>"))


def _best_sentences(text: Column, count: Column, split: str) -> Column:
    @F.arrow_udf("array<string>")
    def best(texts: pa.Array, counts: pa.Array) -> pa.Array:  # as in `topics`
        import regex

        # re is the faster one: of ASCII its \w is the same class, and it takes patterns without \p
        try:
            cut = re.compile(split).split
        except re.error:
            cut = regex.compile(split).split
        ascii_words, words, white = re.compile(r"\w{2,}", re.ASCII).findall, regex.compile(r"[\p{L}\p{N}_]{2,}").findall, " \t\n\x0b\f\r"

        def of(t: str | None, n: int) -> list[str]:
            parts = [p for p in (x.strip(white) for x in cut(t or "")) if len(p) > 10]
            found = [ascii_words(p) if p.isascii() else words(p) for p in parts]
            often = Counter(w for ws in found for w in ws)
            scored = sorted(((sum(map(often.__getitem__, ws)), p) for p, ws in zip(parts, found, strict=True) if ws), reverse=True)
            return [p for _, p in scored[: int(n)]]

        return pa.array((of(t.as_py(), n.as_py()) for t, n in zip(texts, counts, strict=True)), pa.list_(pa.string()))

    return best(text, count)


def counts_for(tokens: Column) -> tuple[Column, Column]:
    """Numbers of entities and sentences a skeleton takes, by tokens of the source."""
    return F.greatest(F.lit(3), F.least(F.lit(10), F.floor(tokens / 300))).cast("int"), F.greatest(F.lit(2), F.least(F.lit(10), F.floor(tokens / 200))).cast("int")


#: Patterns of names by category, in the order they are tried: people, organisations, places, other names, nouns. They
#: stand in for a word segmenter, which `skeleton` takes from the caller instead if given.
NAMES = {
    "org": r"[\x{4E00}-\x{9FFF}]{2,8}(?:公司|集團|銀行|大學|基金|協會)",
    "place": r"[\x{4E00}-\x{9FFF}]{1,4}(?:市|縣|省|國|區)",
    "person": r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+",
    "proper": r"\p{Lu}[\p{L}\p{N}]+",
    "noun": r"[\x{4E00}-\x{9FFF}]{2,4}",
}


def entities(text: Column) -> Column:
    """Array of (text, category): names in the text, each once, in order of first occurrence."""
    # every name begins so: at other characters no pattern is tried
    found = F.regexp_extract_all(text, F.lit(r"(?=[\p{Lu}\x{4E00}-\x{9FFF}])(" + "|".join(NAMES.values()) + ")"), F.lit(1))
    kind = lambda w: F.coalesce(*[F.when(w.rlike(f"^(?:{rx})$"), F.lit(k)) for k, rx in NAMES.items()])
    return F.transform(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))), lambda w: F.struct(w.alias("text"), kind(w).alias("category")))


def chosen(names: Column, n: Column) -> Column:
    """Texts of the names a skeleton shows: n div 2 + 1 people and organisations, then n div 2 others."""
    first = lambda x: x["category"].isin("person", "org")
    half = F.floor(n / 2).cast("int")
    # each mention of names would look for them again
    return let(names, lambda ns: F.transform(F.concat(F.slice(F.filter(ns, first), F.lit(1), half + 1), F.slice(F.filter(ns, lambda x: ~first(x)), F.lit(1), half)), lambda x: x["text"]))


def skeleton(slug: Column, title: Column, names: Column, sentences: Column, tags: Column) -> Column:
    """[SLUG|TITLE] ENT:a,b KEY:s|t TAG:x,y on one line; empty parts left out."""
    part = lambda label, xs, sep: F.when(F.size(xs) > 0, F.concat(F.lit(label), F.array_join(xs, sep)))
    head = F.concat(F.lit("["), F.substring(slug, 1, 20), F.lit("|"), F.substring(title, 1, 40), F.lit("]"))
    return F.concat_ws(" ", head, part("ENT:", names, ","), part("KEY:", F.transform(sentences, lambda s: F.substring(s, 1, 80)), "|"), part("TAG:", F.slice(tags, 1, 3), ","))


def encode_notes(notes: DataFrame, split: str = r"[。！？\n]+", name_of=entities, words=None) -> DataFrame:
    """notes (slug, title, plain, tags, raw_tokens) with skeleton, skeleton_tokens, ratio (4 places) and saving_pct (1 place). name_of and
    words are a caller's segmenter, as Column functions."""
    n_ent, n_sent = counts_for(F.col("raw_tokens"))
    line = skeleton(F.col("slug"), F.col("title"), chosen(name_of(F.col("plain")), n_ent), key_sentences(F.col("plain"), n_sent, split, words), F.col("tags"))
    # a generated column: what mentions or filters the line doesn't make it again
    d = notes.withColumn("skeleton", F.explode(F.array(line))).withColumn("skeleton_tokens", F.floor(F.char_length("skeleton") / 4).cast("long"))
    ratio = F.when(F.col("raw_tokens") > 0, F.col("skeleton_tokens") / F.col("raw_tokens")).otherwise(1.0)
    return d.withColumn("ratio", F.bround(ratio, 4)).withColumn("saving_pct", F.bround((1 - ratio) * 100, 1))


def parse_skeleton(c: Column) -> Column:
    """Struct (slug, title, entities, sentences, tags) of a skeleton line; ENT and TAG end at white space."""
    items = lambda rx, sep: F.filter(F.split(F.regexp_extract(c, rx, 1), sep), lambda x: x != "")
    return F.struct(
        F.regexp_extract(c, r"^\[([^|\]]*)\|", 1).alias("slug"), F.regexp_extract(c, r"^\[[^|\]]*\|([^\]]*)\]", 1).alias("title"),
        items(r"ENT:(\S+)", ",").alias("entities"), items(r"KEY:(.*?)(?: TAG:\S*)?$", r"\|").alias("sentences"), items(r"TAG:(\S+)", ",").alias("tags"),
    )


def narrate(s: Column) -> Column:
    """A parsed skeleton as a sentence: 關於「title」：主要涉及 a、b。s1。s2。"""
    keys = F.filter(s["sentences"], lambda x: F.trim(x) != "")
    ents = F.when(F.size(s["entities"]) > 0, F.concat(F.lit("：主要涉及 "), F.array_join(s["entities"], "、"))).otherwise("")
    return F.concat(F.lit("關於「"), s["title"], F.lit("」"), ents, F.when(F.size(keys) > 0, F.concat(F.lit("。"), F.array_join(keys, "。"))).otherwise(""), F.lit("。"))


def strip_labels(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\[[^\]]*\]\s*", ""), r"(ENT|KEY|TAG):", ""))


def compression(original: Column, short: Column) -> Column:
    """Struct (tokens, short_tokens, ratio): word-based estimates and their ratio to one place, half to even."""
    from ..functions.text import tokens

    a, b = tokens(original, "words"), tokens(short, "words")
    return F.struct(a.alias("tokens"), b.alias("short_tokens"), F.bround(a / F.greatest(b, F.lit(1)), 1).alias("ratio"))
