"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests (DataFrame functions only).

A paragraph is a sentence or line; one of more than LONG characters is cut again at content-defined places: after a word whose
hash, mixed with the word before, has LEVEL low zero bits, and where none is for FORCED words; a word of more than WORD_LONG
characters (text without white space) counts as its characters. So the number of paragraphs grows with the text and an edit moves
only those it touches, however long the text. A paragraph's digest is its 64-bit hash; a text is the set of its digests. A
sketch of s cells in each of three subtables holds count, XOR of digests and XOR of check hashes; cells that are empty aren't
stored, so a sketch takes time and room by its digests, whatever s. Two sketches subtract cell by cell; peeling pure cells
recovers the digests that differ, until they account for all that a subtable holds. The first sketches have room for the
difference that the SAMPLE smallest digests of both sets let expect; where peeling fails, sketches of eight times the cells are
peeled, and eight times those. Likeness is Jaccard's, from the set sizes and the number recovered.

Null texts are empty texts; two empty texts have likeness 1. Null ids come after all others and precede the first. Of rows
that share an id, all are fingerprinted, and the smallest text is what precedes their common predecessor's end. Columns of
named digests or fingerprint are replaced by `fingerprint`; other extra columns pass through it and
are left out by `compare_with_edits`. Arrays are linear in the text; the fingerprint as text is the smallest sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, successor, words_of

#: Cells in each subtable of the sketch that is given as text; of sketches that are compared, for each digest; most rounds of peeling.
SIZE, ROOM, ROUNDS = 8, 1, 40
#: Smallest digests by which the difference of two sets is estimated.
SAMPLE = 32
#: After what a paragraph ends besides a line, and how long (code points) one is before it is cut at words of LEVEL low zero bits,
#: about every 2**LEVEL.
ENDS, LONG, LEVEL = [". ", "! ", "? ", "。", "！", "？"], 400, 4
#: Most words of a part, and characters of a word that is taken as one.
FORCED, WORD_LONG = 64, 64


def _cut(words: Column) -> Column:
    """Digests of a long paragraph's parts, from its word hashes."""

    def ends(h: Column) -> Column:
        n = F.size(h)
        mixed = lambda i: F.get(h, i - 1).bitwiseXOR(F.shiftrightunsigned(F.coalesce(F.get(h, i - 2), F.lit(0)), 9))
        fired = F.filter(F.sequence(F.lit(1), n), lambda i: (mixed(i).bitwiseAND(F.lit((1 << LEVEL) - 1)) == 0) | (i == n))
        between = lambda b, e: F.when(e - b > FORCED, F.concat(F.sequence(b + FORCED, e - 1, F.lit(FORCED)), F.array(e))).otherwise(F.array(e))
        return let(fired, lambda p: F.flatten(F.transform(p, lambda e, k: between(F.coalesce(F.get(p, k - 1), F.lit(0)), e))))

    def cut(h: Column) -> Column:
        return let(ends(h), lambda p: F.transform(p, lambda e, k: let(F.coalesce(F.get(p, k - 1), F.lit(0)), lambda b: F.xxhash64(F.slice(h, b + 1, e - b)))))

    return let(words, lambda h: F.when(F.size(h) == 0, F.array().cast("array<long>")).otherwise(cut(h)))


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs."""
    t = F.coalesce(text, F.lit(""))
    for end in ENDS:  # plain replacements and a split at a single character need no pattern matching
        t = F.replace(t, F.lit(end), F.lit(end.strip() + "\n"))
    parts = F.filter(F.transform(F.split(t, "\n"), lambda p: F.trim(p)), lambda p: p != "")
    hashed = lambda w: F.when(F.char_length(w) <= WORD_LONG, F.array(F.xxhash64(w))).otherwise(F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c: F.xxhash64(c)))
    one = lambda p: F.when(F.char_length(p) <= LONG, F.array(F.xxhash64(p))).otherwise(_cut(F.flatten(F.transform(words_of(p), hashed))))
    return F.array_distinct(F.flatten(F.transform(parts, one)))


def _check(x: Column) -> Column:
    return F.xxhash64(x, F.lit(7))


def _placed(keys: Column, s: Column) -> Column:
    """Sorted longs: place in the upper half, counted on over the subtables, index of the key in the lower; three for each key."""
    place = lambda k, t: F.call_function("shiftleft", F.pmod(F.shiftrightunsigned(k, 20 * t), s) + t * s, F.lit(32))
    return F.sort_array(F.flatten(F.transform(keys, lambda k, i: F.array(*[place(k, t) + i for t in range(3)]))))


def _cells(keys: Column, n: Column, s: Column) -> Column:
    """Cells (p, c, x, g) in use of the sketch of the first n keys less that of the others, by place: each is made once, from the
    run of keys that share its place."""
    index = lambda e: e.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    key, sign = lambda e: F.get(keys, index(e)), lambda e: F.when(index(e) < n, 1).otherwise(-1)

    def cell(run: Column, first: Column) -> Column:
        c = F.aggregate(run, F.lit(0), lambda a, e: a + sign(e))
        x = F.aggregate(run, F.lit(0).cast("long"), lambda a, e: a.bitwiseXOR(key(e)))
        g = F.aggregate(run, F.lit(0).cast("long"), lambda a, e: a.bitwiseXOR(_check(key(e))))
        return F.struct(F.shiftright(first, 32).cast("int").alias("p"), c.alias("c"), x.alias("x"), g.alias("g"))

    def single(e: Column) -> Column:
        return let(key(e), lambda k: F.struct(F.shiftright(e, 32).cast("int").alias("p"), sign(e).alias("c"), k.alias("x"), _check(k).alias("g")))

    def cut(d: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda i: (i == 0) | (F.shiftright(F.get(d, i), 32) != F.shiftright(F.get(d, i - 1), 32)))
        one = lambda b, k: F.when(k == 1, single(F.get(d, b))).otherwise(cell(F.slice(d, b + 1, k), F.get(d, b)))
        return let(starts, lambda st: F.transform(st, lambda b, j: one(b, F.coalesce(F.get(st, j + 1), F.size(d)) - b)))

    made = let(_placed(keys, s), lambda d: F.when(F.size(d) > 0, cut(d)))
    none = F.array().cast("array<struct<p:int,c:int,x:bigint,g:bigint>>")
    return F.coalesce(F.filter(made, lambda c: (c["c"] != 0) | (c["x"] != 0)), none)


def _column(s: Column | int) -> Column:
    return F.lit(s) if isinstance(s, int) else s


def sketch(keys: Column, s: Column | int = SIZE) -> Column:
    """Cells (p, c, x, g) in use of 3*s: place, number of digests, XOR of digests, XOR of check hashes."""
    return _cells(keys, F.size(keys), _column(s))


def subtracted(a: Column, b: Column, s: Column | int) -> Column:
    """The sketch of a less that of b, cell by cell: at a place the cell of a's keys and that of b's are taken together."""
    return let(F.concat(a, b), lambda keys: _cells(keys, F.size(a), _column(s)))


def _without(cells: Column, plus: Column, minus: Column, s: Column) -> Column:
    """cells less the sketch of recovered digests; only for what a first round of peeling leaves."""
    add = lambda a, e: F.struct(e["p"].alias("p"), (a["c"] + e["c"]).alias("c"), a["x"].bitwiseXOR(e["x"]).alias("x"), a["g"].bitwiseXOR(e["g"]).alias("g"))
    gone = F.transform(subtracted(plus, minus, s), lambda c: F.struct(c["p"].alias("p"), (-c["c"]).alias("c"), c["x"].alias("x"), c["g"].alias("g")))

    def cut(d: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda i: (i == 0) | (F.get(d, i)["p"] != F.get(d, i - 1)["p"]))
        one = lambda b, k: F.when(k == 1, F.get(d, b)).otherwise(F.aggregate(F.slice(d, b + 2, k - 1), F.get(d, b), add))
        return F.filter(let(starts, lambda st: F.transform(st, lambda b, j: one(b, F.coalesce(F.get(st, j + 1), F.size(d)) - b))), lambda c: (c["c"] != 0) | (c["x"] != 0))

    return let(F.sort_array(F.concat(cells, gone)), lambda d: F.when(F.size(d) == 0, d).otherwise(cut(d)))


def peel(cells: Column, s: Column | int = SIZE) -> Column:
    """Digests that differ, recovered from a subtracted sketch; null if cells remain that can't be resolved. Every subtable holds every
    digest once, so a round is the last if what it finds has the count and XORs of the first subtable."""
    s = _column(s)
    of = lambda cs, n: F.array_distinct(F.transform(F.filter(cs, lambda c: (c["c"] == n) & (c["g"] == _check(c["x"]))), lambda c: c["x"]))
    both = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(f(x)))

    def whole(cs: Column, m: Column) -> Column:
        top, found = F.filter(cs, lambda c: c["p"] < s), F.concat(m["plus"], m["minus"])
        same = (F.aggregate(top, F.lit(0), lambda a, c: a + c["c"]) == F.size(m["plus"]) - F.size(m["minus"])) & (both(top, lambda c: c["x"]) == both(found, lambda x: x))
        return same & (both(top, lambda c: c["g"]) == both(found, _check))

    def step(acc: Column, _i: Column) -> Column:
        def more(m: Column) -> Column:
            found = F.concat(acc["found"], m["plus"], m["minus"])
            out = lambda cs, over: F.struct(cs.alias("cells"), found.alias("found"), over.alias("over"))
            stuck = F.size(m["plus"]) + F.size(m["minus"]) == 0
            return F.when(whole(acc["cells"], m), out(F.slice(acc["cells"], 1, 0), F.lit(True))).when(stuck, out(acc["cells"], F.lit(True))).otherwise(out(_without(acc["cells"], m["plus"], m["minus"], s), F.lit(False)))

        pure = F.struct(of(acc["cells"], 1).alias("plus"), of(acc["cells"], -1).alias("minus"))
        return F.when(acc["over"] | (F.size(acc["cells"]) == 0), acc).otherwise(let(pure, more))

    start = F.struct(cells.alias("cells"), F.array().cast("array<long>").alias("found"), F.lit(False).alias("over"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.when(F.size(acc["cells"]) == 0, acc["found"]))


def expected(a: Column, b: Column) -> Column:
    """Number of digests in one set only, estimated from the SAMPLE smallest of each (exact for sets of no more)."""
    low = lambda x: F.slice(F.sort_array(x), 1, SAMPLE)

    def of(x: Column, y: Column) -> Column:
        some = F.slice(F.sort_array(F.array_union(x, y)), 1, SAMPLE)
        same = F.size(F.array_intersect(F.array_intersect(x, y), some)) / F.greatest(F.size(some), F.lit(1))
        return (F.size(a) + F.size(b)) * (1 - same) / (1 + same)

    return let(low(a), lambda x: let(low(b), lambda y: of(x, y)))


def difference(a: Column, b: Column) -> Column:
    """Number of digests in one set only, peeled from subtracted sketches: with ROOM cells a subtable for each digest that is expected to differ,
    then eight times as many, then eight times those."""
    n = lambda found: F.aggregate(found, F.lit(0), lambda k, _: k + 1)
    need = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(float(SIZE)), expected(a, b) * ROOM)))).cast("long")
    at = lambda s: n(peel(subtracted(a, b, s), s))
    # digests that share their cells at every size don't peel: their number from the sets themselves
    last = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return let(need, lambda s: F.coalesce(at(s), let(8 * s, at), let(64 * s, at), last))


def likeness(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).when(a == b, F.lit(1.0)).otherwise(let(difference(a, b), lambda d: (total - d) / (total + d).cast("double")))


def as_text(keys: Column, cells: Column) -> Column:
    """A fingerprint: number of digests, then the cells of the smallest sketch in hexadecimal."""
    cell = lambda c: F.concat_ws(".", F.hex(c["p"]), F.hex(c["c"]), F.hex(c["x"]), F.hex(c["g"].bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.lower(F.concat_ws(":", F.size(keys).cast("string"), F.array_join(F.transform(cells, cell), ",")))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with digests and fingerprint of each text."""
    out = docs.withColumn("digests", digests(F.col(text)))
    return out.withColumn("fingerprint", as_text(F.col("digests"), sketch(F.col("digests"))))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likeness to the edited text and to the next document.

    Text and digests are shuffled once by doc_id (both joins share that exchange); of the next document only the quarter that
    the edit needs and its digests move again."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = base.where("doc_id is not null")
    # null-safe key in two columns; both joins below read this one exchange
    dealt = base.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("ka"), F.col("doc_id").isNull().cast("int").alias("kb"), "text", digests(F.col("text")).alias("digests")).repartition("ka", "kb")
    ids = known.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("longest"))
    first = ids.agg(F.min("doc_id").alias("first"))
    nxt = successor(ids, "doc_id", "next_id").join(ids, "doc_id").crossJoin(F.broadcast(first))  # one row: the smallest id
    nxt = nxt.select("doc_id", "longest", F.coalesce("next_id", "first").alias("next_id"))
    nulls = base.where("doc_id is null").agg(F.max(F.char_length("text")).alias("longest")).where("longest is not null")
    nxt = nxt.unionByName(nulls.crossJoin(F.broadcast(first)).select(F.lit(None).cast("long").alias("doc_id"), "longest", F.col("first").alias("next_id")))

    one = dealt.withColumn("r", F.row_number().over(Window.partitionBy("ka", "kb").orderBy("text"))).where("r = 1").drop("r")
    heads = one.select("ka", "kb", F.col("text").alias("next_text"), F.col("digests").alias("next_digests"))
    nxt = nxt.select("doc_id", "longest", F.col("next_id").alias("ka"), F.col("next_id").isNull().cast("int").alias("kb"))
    heads = heads.join(nxt, ["ka", "kb"]).select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("ka"),
        F.col("doc_id").isNull().cast("int").alias("kb"),
        F.substring("next_text", F.lit(1), F.floor(F.col("longest") / 4).cast("int")).alias("head"),
        "next_digests",
    )
    d = dealt.join(heads, ["ka", "kb"], "left").withColumn("doc_id", F.when(F.col("kb") == 0, F.col("ka")))
    d = d.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("quarter", F.floor(F.col("n_chars") / 4).cast("int"))
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("quarter")).cast("int")), F.substring(F.coalesce("head", F.lit("")), F.lit(1), F.col("quarter"))))
    d = d.withColumn("next_digests", F.coalesce("next_digests", F.array().cast("array<long>"))).withColumn("theirs", digests(F.col("edited")))
    d = d.withColumn("sketch", sketch(F.col("digests"))).withColumn("their_sketch", sketch(F.col("theirs")))
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        as_text(F.col("digests"), F.col("sketch")).alias("fingerprint"),
        as_text(F.col("theirs"), F.col("their_sketch")).alias("edited_fingerprint"),
        likeness(F.col("digests"), F.col("theirs")).alias("near_edited"),
        likeness(F.col("digests"), F.col("next_digests")).alias("near_next"),
    )
