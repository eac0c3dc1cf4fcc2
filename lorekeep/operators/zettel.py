"""Zettels (notes with people, topics, weight and emotions) in the dialect: flags, quote, line, tunnel, file, digest of the weightiest."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .dialect import encode_emotions

ZETTEL = (
    "struct<id: string, title: string, content: string, notes: string, origin_label: string, origin_moment: boolean, sensitivity: string, people: array<string>, topics: array<string>,"
    " emotional_weight: double, emotional_tone: array<string>, date_context: string>"
)
FILE = f"source_file string, emotional_arc string, zettels array<{ZETTEL}>, tunnels array<struct<`from`: string, `to`: string, label: string>>"
#: Words that make a quote weigh more, weight from which a zettel is essential, tunnels shown.
MOVING = "love fear remember soul feel stupid scared beautiful destroy respect trust consciousness alive forget waiting peace matter real guilt escape rest hope dream lost found".split()
ESSENTIAL, TUNNELS = 0.85, 8
#: What counts as a quote: in double quotes, in single ones that stand free, after a verb of saying.
QUOTES = [
    r'"([^"]{8,55})"',
    r"(?:^|[\s(])'([^']{8,55})'(?:[\s.,;:!?)]|$)",
    r"""(?i)(?:says?|said|articulates?|reveals?|admits?|confesses?|asks?):\s*["']?([^.!?]{10,55})[.!?]""",
]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Zettel files (*.json) below path: (file, source_file, emotional_arc, zettels, tunnels)."""
    d = spark.read.schema(FILE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return d.select(F.col("_metadata.file_name").alias("file"), "*")


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def entity_code(name: Column, codes: dict[str, str] | None = None, skip: list[str] | None = None) -> Column:
    """Code of a name: its own, that of a known name within it, else three letters; null for names to skip."""
    low, codes = F.lower(name), codes or {}
    table = [F.when((name == k) | (low == k.lower()), F.lit(v)) for k, v in codes.items()] + [F.when(low.contains(k.lower()), F.lit(v)) for k, v in codes.items()]
    code = F.coalesce(*table, F.upper(F.substring(name, 1, 3)))
    hidden = reduce(lambda a, b: a | b, [low.contains(x.lower()) for x in skip or []], F.lit(False))
    return F.when(~hidden, code)


def _codes(people: Column, codes: dict[str, str] | None, skip: list[str] | None) -> Column:
    """Sorted distinct codes; ??? if there are none."""
    found = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(people, F.array().cast("array<string>")), lambda p: entity_code(p, codes, skip)), lambda x: x.isNotNull())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("???")))


def flags(z: Column) -> Column:
    """Flags in order, joined by +. CORE and PIVOT are read from the notes alone, GENESIS from the origin's label as well."""
    notes = F.lower(empty(z["notes"]))
    return F.concat_ws(
        "+", F.when(z["origin_moment"], "ORIGIN"), F.when(F.upper(empty(z["sensitivity"])).startswith("MAXIMUM"), "SENSITIVE"), F.when(notes.contains("foundational pillar") | notes.contains("core"), "CORE"),
        F.when(notes.contains("genesis") | F.lower(empty(z["origin_label"])).contains("genesis"), "GENESIS"), F.when(notes.contains("pivot"), "PIVOT"),
    )


def key_quote(z: Column) -> Column:
    """The quote that weighs most, the first of equals; without one, what follows ' - ' in the title (45 characters)."""
    text = F.concat_ws(" ", empty(z["content"]), empty(z["origin_label"]), empty(z["notes"]))
    found = F.concat(*[F.regexp_extract_all(text, F.lit(rx), F.lit(1)) for rx in QUOTES])
    found = F.array_distinct(F.filter(F.transform(found, lambda q: F.trim(q)), lambda q: F.char_length(q) >= 8))

    def points(q: Column) -> Column:
        low = F.lower(q)
        moving = reduce(lambda a, b: a + b, [F.when(low.contains(w), 2).otherwise(0) for w in MOVING])
        return F.when(q.rlike(r"^\p{Lu}"), 2).otherwise(0) + moving + F.when(F.char_length(q) > 20, 1).otherwise(0) - F.when(q.rlike("^(The|This|She) "), 2).otherwise(0)

    best = F.array_max(F.transform(found, lambda q, i: F.struct(points(q).alias("p"), (-i).alias("i"), q.alias("q"))))["q"]
    title = empty(z["title"])
    return F.coalesce(best, F.when(title.contains(" - "), F.substring(_after(title), 1, 45)), F.lit(""))


def _after(title: Column) -> Column:
    return F.substring(title, F.instr(title, " - ") + 3, F.char_length(title))


def _last(ident: Column) -> Column:
    return F.regexp_extract(ident, r"([^-]*)$", 1)


def _quoted(q: Column) -> Column:
    return F.when(q != "", F.concat(F.lit('"'), q, F.lit('"')))


def encode(z: Column, codes: dict[str, str] | None = None, skip: list[str] | None = None) -> Column:
    """id:CODES|topics|"quote"|weight|emotions|FLAGS; empty parts left out."""
    names = F.array_join(_codes(z["people"], codes, skip), "+")
    about = F.nullif(F.array_join(F.slice(z["topics"], 1, 2), "_"), F.lit(""))
    mood = F.when(z["emotional_tone"].isNotNull(), encode_emotions(z["emotional_tone"]))
    return F.concat_ws("|", F.concat(_last(z["id"]), F.lit(":"), names), F.coalesce(about, F.lit("misc")), let(key_quote(z), _quoted), F.coalesce(z["emotional_weight"], F.lit(0.5)).cast("string"), F.nullif(mood, F.lit("")), F.nullif(flags(z), F.lit("")))


def encode_tunnel(t: Column) -> Column:
    """T:a<->b|label: the label up to a colon, else its first 30 characters."""
    label = empty(t["label"])
    return F.concat(F.lit("T:"), _last(t["from"]), F.lit("<->"), _last(t["to"]), F.lit("|"), F.when(label.contains(":"), F.substring_index(label, ":", 1)).otherwise(F.substring(label, 1, 30)))


def encode_file(source: Column, arc: Column, zettels: Column, tunnels: Column, codes: dict[str, str] | None = None, skip: list[str] | None = None) -> Column:
    """Header number|CODES|date|title, then ARC, a line per zettel, a line per tunnel."""
    name = F.coalesce(source, F.lit("unknown"))
    zs = F.coalesce(zettels, F.array().cast(f"array<{ZETTEL}>"))
    people = F.slice(_codes(F.flatten(F.transform(zs, lambda z: F.coalesce(z["people"], F.array().cast("array<string>")))), codes, skip), 1, 3)
    dashed = name.contains("-")
    plain = F.replace(name, F.lit(".txt"), F.lit(""))
    title = F.when(dashed, F.trim(F.regexp_replace(plain, r"^[^-]*-", ""))).otherwise(name)
    head = F.concat_ws("|", F.when(dashed, F.substring_index(name, "-", 1)).otherwise("000"), F.array_join(people, "+"), F.coalesce(F.get(zs, F.lit(0))["date_context"], F.lit("unknown")), title)
    lines = F.concat(F.array(head), F.when(empty(arc) != "", F.array(F.concat(F.lit("ARC:"), arc))).otherwise(F.array().cast("array<string>")), F.transform(zs, lambda z: encode(z, codes, skip)), F.coalesce(F.transform(tunnels, encode_tunnel), F.array().cast("array<string>")))
    return F.array_join(lines, "\n")


def compress_all(files: DataFrame, codes: dict[str, str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """(file, text) of every file, each ended by a line ---; written in order of file they are the combined document."""
    text = encode_file(F.col("source_file"), F.col("emotional_arc"), F.col("zettels"), F.col("tunnels"), codes, skip)
    return files.select("file", F.concat(text, F.lit("\n---")).alias("text"))


def essential(files: DataFrame, threshold: float = ESSENTIAL, codes: dict[str, str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """(day, position, line): zettels of threshold or more, of origin, or flagged so, by the file's date before a comma and then weight,
    heaviest first, ties by file and place. The number is what a digest shows; no list is gathered."""
    first = F.coalesce(F.get("zettels", F.lit(0))["date_context"], F.lit("unknown"))
    z = files.select("file", F.trim(F.substring_index(first, ",", 1)).alias("day"), F.posexplode("zettels").alias("place", "z")).withColumn("flags", flags(F.col("z")))
    weight = F.coalesce(F.col("z.emotional_weight"), F.lit(0.0))
    z = z.where((weight >= threshold) | F.coalesce(F.col("z.origin_moment"), F.lit(False)) | F.col("flags").rlike("ORIGIN|CORE|GENESIS"))
    title = empty(F.col("z.title"))
    hint = F.when(title.contains(" - "), F.substring(_after(title), 1, 30)).otherwise(F.coalesce(F.array_join(F.slice("z.topics", 1, 2), "_"), F.lit("")))
    quote = let(key_quote(F.col("z")), lambda q: F.when((q != hint) & (q != title), _quoted(q)))
    private = F.when((empty(F.col("z.sensitivity")) != "") & ~F.col("flags").contains("SENSITIVE"), "SENSITIVE")
    line = F.concat_ws("|", F.array_join(_codes(F.col("z.people"), codes, skip), "+"), F.nullif(hint, F.lit("")), quote, private, F.coalesce(F.col("z.emotional_weight"), F.lit(0.5)).cast("string"), F.nullif(F.col("flags"), F.lit("")))
    order = Window.partitionBy("day").orderBy(weight.desc(), "file", "place")
    return z.select("day", F.row_number().over(order).alias("position"), line.alias("line"))


def layer_one(files: DataFrame, today: str, identity: dict[str, list[str]] | None = None, threshold: float = ESSENTIAL, codes: dict[str, str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """(part, day, position, line) of the digest: head, identity sections, moments by date, tunnels. Sorted by the first three it is
    the text; `as_text` joins it."""
    spark = files.sparkSession
    head = ["## LAYER 1 -- ESSENTIAL STORY", f"## Auto-generated from zettel files. Updated {today}.", ""]
    for name, lines in (identity or {}).items():
        head += [f"={name}=", *lines, ""]
    top = spark.createDataFrame([(0, "", i, x) for i, x in enumerate(head)], "part int, day string, position int, line string")
    rows = essential(files, threshold, codes, skip)
    days = rows.select("day").distinct()
    moments = rows.select(F.lit(1).alias("part"), "day", "position", "line").unionByName(days.select(F.lit(1).alias("part"), "day", F.lit(0).alias("position"), F.concat(F.lit("=MOMENTS["), "day", F.lit("]=")).alias("line")))
    moments = moments.unionByName(days.select(F.lit(1).alias("part"), "day", F.lit((1 << 31) - 1).alias("position"), F.lit("").alias("line")))
    t = files.select("file", F.posexplode("tunnels").alias("i", "t")).orderBy("file", "i").limit(TUNNELS)  # the limit is the feature
    label = empty(F.col("t.label"))
    t = t.select(F.row_number().over(Window.orderBy("file", "i")).alias("position"), F.when(label.contains(":"), F.substring_index(label, ":", 1)).otherwise(F.substring(label, 1, 40)).alias("line"))
    t = t.select(F.lit(2).alias("part"), F.lit("").alias("day"), "position", "line")
    some = t.limit(1)
    ends = some.select("part", "day", F.lit(0).alias("position"), F.lit("=TUNNELS=").alias("line")).unionByName(some.select("part", "day", F.lit(TUNNELS + 1).alias("position"), F.lit("").alias("line")))
    return top.unionByName(moments).unionByName(t).unionByName(ends)


def as_text(digest: DataFrame) -> DataFrame:
    """The digest as one text; for a bot's context, so as long as that."""
    return digest.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "day", "position", "line"))), lambda x: x["line"]), "\n").alias("text"))


def assigned_codes(people: DataFrame, name: str = "name") -> DataFrame:
    """people with code: three letters in capitals, four where an earlier name (by order of name) has those three, five and so on where
    both are taken. Names are compared within their first three letters only."""
    d = people.withColumn("_three", F.upper(F.substring(name, 1, 3)))
    w = Window.partitionBy("_three").orderBy(name)
    n = F.row_number().over(w)
    return d.withColumn("_n", n).withColumn("code", F.when(F.col("_n") == 1, F.col("_three")).otherwise(F.upper(F.substring(F.col(name), F.lit(1), F.col("_n") + 2)))).drop("_three", "_n")


def load_config(path: str) -> tuple[dict[str, str], list[str]]:
    """(codes, names to skip) of a JSON file on the driver: {"entities": {name: code}, "skip_names": [...]}."""
    c = json.loads(Path(path).read_text(encoding="utf-8"))
    return dict(c.get("entities", {})), [n.lower() for n in c.get("skip_names", [])]


def save_config(path: str, codes: dict[str, str], skip: list[str]) -> None:
    """The same; of names with one code the first stays."""
    first = {code: name for name, code in reversed(codes.items())}
    Path(path).write_text(json.dumps({"entities": {n: c for n, c in codes.items() if first[c] == n}, "skip_names": skip}, indent=2, ensure_ascii=False), encoding="utf-8")
