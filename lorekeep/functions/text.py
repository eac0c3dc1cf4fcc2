"""Column expressions for text: folding, overlapping term counts, slugs, key normal forms, CJK tests, token estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The intended ideograph class, and the class that a misread range spelled.
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}]"
CJK_COMPAT = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{2000}0-\x{2A6D}f]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once; SQL lambdas have no other way to name a value."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(items: Column, same, fold) -> Column:
    """fold(run) for each run of neighbours that `same` holds for, in a sorted array; one pass, no pair of items compared twice."""

    def cut(d: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda i: F.when(i == 0, F.lit(True)).otherwise(~same(F.get(d, i), F.get(d, i - 1))))
        return let(starts, lambda st: F.transform(st, lambda b, j: fold(F.slice(d, b + 1, F.coalesce(F.get(st, j + 1), F.size(d)) - b))))

    return let(items, lambda d: F.when(F.size(d) > 0, cut(d)))


def fold(c: Column | str) -> Column:
    return F.lower(F.col(c) if isinstance(c, str) else c)


def literal_pattern(s: str) -> str:
    """s as a regular expression that matches it literally, in any flavour of escaping."""
    return "".join(f"\\x{{{ord(ch):X}}}" for ch in s)


def occurrences(c: Column, phrase: str) -> Column:
    """Overlapping occurrences of a folded phrase in a folded column, by a zero-width look-ahead."""
    return F.regexp_count(c, F.lit(f"(?={literal_pattern(phrase)})"))


def trigram_length(c: Column) -> Column:
    """Number of trigram tokens of a text."""
    return F.greatest(F.char_length(F.coalesce(c, F.lit(""))) - 2, F.lit(0))


def trigrams(c: Column) -> Column:
    """Folded trigrams in order; windows that start inside a supplementary character are left out."""
    return F.filter(F.regexp_extract_all(fold(c), F.lit("(?s)(?=(.{3}))"), F.lit(1)), lambda g: F.char_length(g) == 3)


def contains_all(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(c, F.lit(t)) for t in terms])


def match_count(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(t)).cast("int") for t in terms])


def has_cjk(c: Column, compat: bool = False) -> Column:
    return c.rlike(CJK_COMPAT if compat else CJK)


def shares_ideograph(c: Column, query: str) -> Column:
    chars = [ch for ch in query if "㐀" <= ch <= "鿿" or ord(ch) >= 0x20000]
    return c.rlike("[" + "".join(literal_pattern(ch) for ch in chars) + "]") if chars else F.lit(False)


def entity_key(c: Column) -> Column:
    """Key of an entity name: lower case, spaces to underscores, no apostrophes."""
    return F.replace(F.replace(F.lower(c), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def predicate_key(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def vault_slug(path: Column, digest: bool = False) -> Column:
    """Slug of a vault-relative path. digest=True appends six hex digits, since names without ASCII letters collide."""
    s = F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), r"[/\\ ]", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9\-_]", "-"), "-+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 200)
    return F.concat(s, F.lit("-"), F.right(F.md5(F.encode(path, "utf-8")), F.lit(6))) if digest else s


def file_slug(path: Column) -> Column:
    """file:{stem up to 40}-{last six hex digits of the path's MD5}; the stem in lower case, other characters as single hyphens."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, r"[^a-z0-9\-_]", "-"), "-{2,}", "-"), "^-+|-+$", "")
    return F.concat(F.lit("file:"), F.substring(stem, 1, 40), F.lit("-"), F.right(F.md5(F.encode(path, "utf-8")), F.lit(6)))


def path_slug(path: Column, root: str) -> Column:
    """Slug of a path below root that keeps its directories and other scripts: known suffixes off, spaces and unsafe characters to
    single hyphens, lower case. A path elsewhere has every other character than a-z, 0-9, ideographs and / _ - as a hyphen."""
    rel = F.regexp_replace(F.substring(path, len(root.rstrip("/")) + 2, 1 << 30), r"(?i)\.(md|canvas|base)$", "")
    inside = F.regexp_replace(F.lower(F.regexp_replace(rel, r"[ \\?]", "-")), "-{2,}", "-")
    outside = F.regexp_replace(F.lower(path), r"[^a-z0-9/_\-\x{4E00}-\x{9FFF}]", "-")
    return F.when(path.startswith(root.rstrip("/") + "/"), inside).otherwise(outside)


def display_name(slug: Column) -> Column:
    """Name of a slug's last part for a link: spaces and capitals, unless it holds ideographs."""
    last = F.regexp_extract(slug, r"([^/]*)$", 1)
    return F.when(last.rlike(r"[\x{4E00}-\x{9FFF}]"), last).otherwise(F.initcap(F.replace(last, F.lit("-"), F.lit(" "))))


def under_root(path: Column, root: str) -> Column:
    """Whether a path, its . and .. resolved, is root or below it. Links are resolved by `resolved_under_root` only."""
    root = root.rstrip("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    # a stack of names: .. takes the last one away
    flat = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))), lambda a: F.concat(F.lit("/"), F.array_join(a, "/")))
    return path.startswith("/") & ((flat == root) | flat.startswith(root + "/"))


class OutsideRoot(ValueError):
    """A path leads out of the vault."""


def resolved_under_root(path: str, root: str) -> str:
    """The real path of a driver's file, links followed; OutsideRoot if that is not root or below it."""
    import os

    real, base = os.path.realpath(path), os.path.realpath(os.path.expanduser(root))
    if real != base and not real.startswith(base + os.sep):
        raise OutsideRoot(f"{path} is outside {base}")
    return real


def valid_slug(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_:\-/.]{1,200}$") & ~c.contains("..") & ~c.startswith("/")


#: Note directories that are groups of their own.
GROUPS = ["research", "chart", "pearl", "concepts", "cards", "companies", "people", "deals", "reviews"]


def note_group(path: Column) -> Column:
    part = F.lower(F.regexp_extract(path, r"(?:^|/)(?:Ocean|Wiki)/([^/]+)", 1))
    return F.when(part.isin(GROUPS), part).otherwise(F.lit("general"))


def file_group(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.([^.]*)$", 1)
    return F.when(stem.rlike("release|changelog|relnote"), "docs-release-note").when(ext == "pdf", "docs-pdf").when(ext.isin("md", "txt", "doc", "docx"), "docs-spec").otherwise("raw")


def tokens(c: Column, method: str = "quarter") -> Column:
    """Token estimates: quarter (characters div 4) or words (1.3 a word, 1 at least)."""
    if method == "quarter":
        return F.floor(F.char_length(c) / 4).cast("long")
    return F.greatest(F.lit(1), F.floor(F.regexp_count(c, F.lit(r"\S+")) * F.lit(1.3))).cast("long")


def snippet(c: Column, phrase: str, width: int = 14) -> Column:
    """Window of `width` characters about the first hit, marked; an approximation of a best-window snippet."""
    at = F.instr(fold(c), phrase.lower())
    lo = F.greatest(at - (width - len(phrase)) / 2, F.lit(1)).cast("int")
    hit = F.substring(c, at, F.lit(len(phrase)))
    tail = F.substring(c, at + len(phrase), F.lit(width) - len(phrase) - (at - lo))
    return F.when(at > 0, F.concat(F.when(lo > 1, "…").otherwise(""), F.substring(c, lo, at - lo), F.lit("«"), hit, F.lit("»"), tail, F.when(at + width < F.char_length(c), "…").otherwise("")))
