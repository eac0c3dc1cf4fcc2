"""License scans: an exact set-similarity join of text blocks with license templates (DataFrame functions only).

Base labels come from phrases whose words stand consecutively. The method's labels come from templates (notices of common
licenses, a parameter): a block of a text gets a template's label if it holds at least THRESHOLD percent of the template's
distinct words. Blocks of a template of up to S words (S a power of two, 8 at least) are the windows of 2 * S words that begin at
every S-th word, so any S consecutive words lie in one of them; a text's last block may be shorter.

The join: the words of all templates are ordered by how often they occur in all the documents, rarest first. A block that
meets the threshold holds one of a template's n - need + 1 rarest words (prefix filter), has `need` template words at least
(length filter), and the places of the shared word in both orders leave room for `need` shared words (positional filter). Only texts
that hold a prefix word anywhere are cut into blocks, and of their blocks only those around one are made. Pairs that pass are verified
by their intersection, at their rarest common word alone, so that a pair comes up once. All that leaves a task is a few numbers for each text and
one row for each verified pair; texts are never shuffled. What is broadcast is the templates' words, MAX_WORDS at most (an error beyond).

A null text is an empty text: no words, no labels, score 0. Texts of any length are searched whole. Repeated rows are given
once each. Extra columns are ignored by `scan`. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: What parts words, and the base phrases with their labels.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Percent of a template's distinct words that a block must hold. Templates of less than ten words must be there in whole.
THRESHOLD = 90
#: Most words that all templates have together: what the join broadcasts.
MAX_WORDS = 100_000
#: Type of the blocks of a text.
BLOCKS = "array<struct<step:int,block:int,have:array<string>>>"
#: Label and notice text of the templates.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version."),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version of the License, or (at your option) any later version."),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


def words_in(text: str) -> list[str]:
    """Words of a driver's string, as `words_of` takes them from a column."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(SEPARATOR, folded) if w]


def folded(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.filter(F.split(folded(text), SEPARATOR), lambda w: w != "")


def prepared(templates: list[tuple[str, str]], threshold: int = THRESHOLD) -> list[dict]:
    """Templates with their distinct words, the number of them that a block needs, and the step of their blocks."""
    if not 1 <= threshold <= 100:
        raise ValueError("the threshold is a percentage")
    out = []
    for label, text in templates:
        words = words_in(text)
        if not words:
            raise ValueError(f"template of {label} without words")
        distinct = sorted(set(words))
        step = 8
        while step < len(words):
            step *= 2
        out.append({"label": label, "words": distinct, "n": len(distinct), "need": -(-threshold * len(distinct) // 100), "step": step})
    if sum(t["n"] for t in out) > MAX_WORDS:
        raise ValueError(f"templates of over {MAX_WORDS} words")
    return out


def word_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """Occurrences of the templates' words in all documents: a row per word of the vocabulary comes to the driver."""
    w = docs.select(F.explode(F.filter(words_of(F.col(text)), lambda x: x.isin(vocabulary))).alias("w"))
    return {r["w"]: r["n"] for r in w.groupBy("w").agg(F.count("*").alias("n")).collect()} if vocabulary else {}


def _strings(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items]).cast("array<string>")


class Index:
    """Templates (none: no matches) in the corpus's order of words: postings of prefixes, and the columns that look texts up in them."""

    def __init__(self, templates: list[dict], counts: dict[str, int]):
        self.rank = {w: i for i, w in enumerate(sorted({w for t in templates for w in t["words"]}, key=lambda w: (counts.get(w, 0), w)))}
        self.postings: list[tuple] = []
        self.steps = sorted({t["step"] for t in templates})
        self.prefix: dict[int, set[str]] = {s: set() for s in self.steps}
        self.words: dict[int, set[str]] = {s: set() for s in self.steps}
        self.least = {s: min(t["need"] for t in templates if t["step"] == s) for s in self.steps}
        for k, t in enumerate(templates):
            order = sorted(t["words"], key=self.rank.__getitem__)
            self.words[t["step"]] |= set(order)
            for i, w in enumerate(order[: t["n"] - t["need"] + 1]):
                self.prefix[t["step"]].add(w)
                self.postings.append((t["step"], w, k, t["label"], i, t["n"], t["need"], order))

    def ordered(self, words: set[str]) -> list[str]:
        return sorted(words, key=self.rank.__getitem__)

    def blocks(self, words: Column) -> Column:
        """Array of (step, block, have): blocks around prefix words, with the templates' words they hold, rarest first."""

        def of(step: int) -> Column:
            prefix = self.ordered(self.prefix[step])
            at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(prefix), i)), lambda i: i.isNotNull())
            last = F.greatest(F.floor((F.size(words) - 1) / step).cast("int") - 1, F.lit(0))
            near = F.flatten(F.transform(at, lambda i: let(F.floor(i / step).cast("int"), lambda b: F.array(b - 1, b))))
            known = _strings(self.ordered(self.words[step]))
            cut = lambda b: F.struct(F.lit(step).alias("step"), b.alias("block"), F.array_intersect(known, F.slice(words, b * step + 1, F.lit(2 * step))).alias("have"))
            made = F.transform(F.filter(F.array_distinct(near), lambda b: (b >= 0) & (b <= last)), cut)
            found = F.filter(made, lambda r: F.size(r["have"]) >= self.least[step])
            return F.when(F.arrays_overlap(words, _strings(prefix)), found).otherwise(F.array().cast(BLOCKS))

        return F.concat(F.array().cast(BLOCKS), *[of(s) for s in self.steps])

    def join(self, rows: DataFrame) -> DataFrame:
        """rows (..., b) with template, label and containment of each pair of a block b and a template that meets the threshold. A row whose b is
        null stays as it is, so that facts of texts and their blocks go through one pass."""
        kinds = "step int, word string, template int, label string, i int, n int, need int, words array<string>"
        posts = rows.sparkSession.createDataFrame(self.postings, kinds)
        every = sorted({w for s in self.steps for w in self.prefix[s]})
        d = rows.select("*", F.size("b.have").alias("have_n"), F.posexplode_outer("b.have").alias("j", "word")).where(F.col("b").isNull() | F.col("word").isin(every))
        d = d.withColumn("step", F.col("b.step")).join(F.broadcast(posts), ["step", "word"], "left")  # MAX_WORDS words at most
        room = F.least("i", "j") + 1 + F.least(F.col("n") - 1 - F.col("i"), F.col("have_n") - 1 - F.col("j"))
        both = F.array_intersect("words", "b.have")
        d = d.where(F.col("b").isNull() | ((F.col("have_n") >= F.col("need")) & (room >= F.col("need")) & (F.get(both, F.lit(0)) == F.col("word")) & (F.size(both) >= F.col("need"))))
        return d.withColumn("containment", F.when(F.col("b").isNotNull(), F.size(both) / F.col("n"))).drop("have_n", "j", "word", "step", "i", "n", "need", "words")


def base_places(text: Column, words: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """Array of (at, label): where a phrase's words stand. Texts without any phrase are told by one pattern."""
    split = {p: words_in(p) for p in phrases}
    guard = folded(text).rlike("|".join(SEPARATOR.join(w) for w in split.values()))

    def places(p: str) -> Column:
        hit = lambda i: [F.get(words, i + k) == w for k, w in enumerate(split[p])]
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.coalesce(_all(hit(i)), F.lit(False)))
        return F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(phrases[p]).alias("label")))

    return F.when(guard & (F.size(words) > 0), F.concat(*[places(p) for p in phrases])).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _blocked(docs: DataFrame, index: Index, key: str, text: str, phrases: dict[str, str]) -> DataFrame:
    """(key, digest, n_words, base, blocks) of every row. Words go through a generator, so that no expression is computed again for each mention."""
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("t"), F.explode(F.array(words_of(F.col(text)))).alias("w"))
    digest = F.sha2(F.encode(F.coalesce("t", F.lit("")), "utf-8"), 256)
    return d.select("key", digest.alias("digest"), F.size("w").cast("long").alias("n_words"), base_places(F.col("t"), F.col("w"), phrases).alias("base"), index.blocks(F.col("w")).alias("blocks"))


def index_of(docs: DataFrame, templates: list[tuple[str, str]] | None = None, text: str = "text", threshold: int = THRESHOLD) -> Index:
    made = prepared(TEMPLATES if templates is None else templates, threshold)
    return Index(made, word_counts(docs, sorted({w for t in made for w in t["words"]}), text))


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """(key, template, label, first_word, last_word, containment): every block that meets a template's threshold, by its first and last word."""
    index = index_of(docs, templates, text, threshold)
    d = _blocked(docs, index, key, text, PHRASES).select("key", "n_words", F.explode("blocks").alias("b"))
    first = (F.col("b.block") * F.col("b.step")).cast("long")
    last = F.least(F.col("n_words"), first + 2 * F.col("b.step")) - 1
    return index.join(d).select(F.col("key").alias(key), "template", "label", first.alias("first_word"), last.alias("last_word"), "containment")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: int = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row. score is the largest containment of a template
    that meets the threshold, 1 where a base phrase stands, else 0.

    Each row gives one row of facts, each verified pair another; they meet in one aggregation by key and digest of the text, which combines on
    the map side, so that no text's copies gather anywhere. Rows equal in both are counted and given back as many times."""
    index = index_of(docs, templates, text, threshold)
    d = _blocked(docs, index, key, text, phrases)
    fact = F.array(F.struct(F.col("n_words").alias("n_words"), F.col("base").alias("base"), F.lit(None).cast("struct<step:int,block:int,have:array<string>>").alias("b")))
    pair = F.transform("blocks", lambda b: F.struct(F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("array<struct<at:bigint,label:string>>").alias("base"), b.alias("b")))
    rows = index.join(d.select("key", "digest", F.explode(F.concat(fact, pair)).alias("r")).select("key", "digest", "r.*"))
    g = rows.groupBy("key", "digest").agg(F.max("n_words").alias("n_words"), F.max("base").alias("base"), F.count("n_words").alias("rows"), F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    base = F.array_sort(F.array_distinct(F.transform("base", lambda r: r["label"])))
    g = g.withColumn("named", base).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return g.select(
        F.col("key").alias(key), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.transform("base", lambda r: r["at"])).alias("first_word"), F.array_max(F.transform("base", lambda r: r["at"])).alias("last_word"),
        F.array_join("named", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("named", "own")), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    """SQL that holds every block against every template."""
    quoted = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
    made = prepared(TEMPLATES)
    rows = ", ".join(f"('{t['label']}', {quoted(t['words'])}, {t['need']}, {t['step']})" for t in made)
    steps = sorted({t["step"] for t in made})
    phrases = ", ".join(f"({quoted(words_in(p))}, '{label}')" for p, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATOR}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT * FROM (VALUES {phrases}) v(ws, label)), t AS (SELECT * FROM (VALUES {rows}) v(label, words, need, step)),
b AS (SELECT r, label, unnest(list_filter(range(0, len(w)), lambda i: w[(i + 1):(i + len(ws))] = ws)) AS pos FROM d, p),
bl AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS named FROM b GROUP BY r),
k AS (SELECT r, step, list_distinct(w[(i * step + 1):(i * step + 2 * step)]) AS have FROM (SELECT r, w, step, unnest(range(0, greatest(1, ((len(w) - 1) // step)::BIGINT))) AS i FROM d, (SELECT unnest({steps}) AS step))),
c AS (SELECT r, label, len(list_intersect(have, words)) AS hits, len(words) AS n, need FROM k JOIN t USING (step)),
m AS (SELECT r, list_distinct(list(label)) AS own, max(hits / n) AS best FROM c WHERE hits >= need GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(named, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(named, []), coalesce(own, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN bl ON d.r = bl.r LEFT JOIN m ON d.r = m.r
"""


ORACLE = _oracle()
