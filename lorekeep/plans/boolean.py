"""Boolean search strings: a small grammar on the driver, a Column predicate for Catalyst.

query  := or ; or := and ("OR" and)* ; and := not+ ("AND" optional) ; not := unit ("NOT" unit)*
unit   := [column ":"] ( "phrase" | word["*"] | "(" or ")" | NEAR "(" words [, n] ")" )

Phrases are substrings of the folded text (a trigram index answers exactly that). Terms under three characters match nothing:
false in AND, ignored in OR and NEAR, a no-op in NOT. NEAR holds any number of phrases in any order: from the end of each to the
start of the last there may be n trigrams at most; phrases may overlap. A word that holds other characters than letters, digits and _ is a syntax error, and
callers fall back to plain substring search.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import literal_pattern


class SearchSyntaxError(ValueError):
    pass


@dataclass
class Node:
    kind: str  # phrase, and, or, not, near
    items: list["Node"] = field(default_factory=list)
    text: str = ""
    column: str | None = None
    n: int = 10


LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([(),:*])|([^\s"(),:*]+))')


def parse(query: str) -> Node:
    toks: list[tuple[str, str]] = []
    at = 0
    query = query.strip()
    if not query:
        raise SearchSyntaxError("empty query")
    while at < len(query):
        m = LEX.match(query, at)
        if not m:
            raise SearchSyntaxError(query)
        at = m.end()
        if m[1] is not None:
            toks.append(("phrase", m[1].replace('""', '"')))
        elif m[2]:
            toks.append((m[2], m[2]))
        elif m[3] in ("AND", "OR", "NOT"):
            toks.append((m[3], m[3]))
        elif re.fullmatch(r"[\w]+", m[3]):
            toks.append(("word", m[3]))
        else:
            raise SearchSyntaxError(m[3])
    pos = 0

    def peek(k: int = 0) -> str | None:
        return toks[pos + k][0] if pos + k < len(toks) else None

    def take(kind: str | None = None) -> str:
        nonlocal pos
        if pos >= len(toks) or (kind and toks[pos][0] != kind):
            raise SearchSyntaxError(query)
        pos += 1
        return toks[pos - 1][1]

    def unit() -> Node:
        column = None
        if peek() == "word" and peek(1) == ":":
            column = take()
            take(":")
        if peek() == "(":
            take()
            node = either()
            take(")")
        elif peek() == "word" and toks[pos][1] == "NEAR" and peek(1) == "(":
            take(), take("(")
            parts, n = [], 10
            while peek() in ("word", "phrase"):
                parts.append(Node("phrase", text=take()))
            if peek() == ",":
                take()
                n = int(number) if (number := take("word")).isdigit() else -1
                if n < 0:
                    raise SearchSyntaxError(query)
            take(")")
            if not parts:
                raise SearchSyntaxError(query)
            node = Node("near", parts, n=n)
        elif peek() in ("word", "phrase"):
            node = Node("phrase", text=take())
            if peek() == "*":
                take()  # a substring test answers prefixes as well
        else:
            raise SearchSyntaxError(query)
        if column:
            node.column = column
        return node

    def negated() -> Node:
        node = unit()
        while peek() == "NOT":
            take()
            node = Node("not", [node, unit()])
        return node

    def every() -> Node:
        parts = [negated()]
        while peek() not in (None, "OR", ")"):
            if peek() == "AND":
                take()
            parts.append(negated())
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def either() -> Node:
        parts = [every()]
        while peek() == "OR":
            take()
            parts.append(every())
        return parts[0] if len(parts) == 1 else Node("or", parts)

    node = either()
    if pos != len(toks):
        raise SearchSyntaxError(query)
    return node


def phrases(node: Node) -> list[str]:
    """Phrases that count for the score: all but those under NOT's right side."""
    if node.kind == "phrase":
        return [node.text.lower()] if len(node.text) >= 3 else []
    items = node.items[:1] if node.kind == "not" else node.items
    return [p for i in items for p in phrases(i)]


def _near(items: list[str], last: int, n: int) -> str:
    """Pattern of a place where the phrase `last` starts, each other one having started len - 2 + n characters before at most."""
    others = [x for i, x in enumerate(items) if i != last]
    behind = "".join(f"(?<=(?={literal_pattern(x)}).{{0,{len(x) - 2 + n}}})" for x in others)
    return f"(?s)(?={literal_pattern(items[last])}){behind}"


def predicate(node: Node, columns: list[str], only: str | None = None) -> Column:
    """Node as a condition on folded columns."""
    only = node.column or only
    cols = [only] if only else columns
    anywhere = lambda f: reduce(lambda a, b: a | b, [f(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in cols])
    if node.kind == "phrase":
        return anywhere(lambda c: c.contains(node.text.lower())) if len(node.text) >= 3 else F.lit(False)
    if node.kind == "near":
        items = [x.text.lower() for x in node.items if len(x.text) >= 3]
        return anywhere(lambda c: reduce(lambda a, b: a | b, [c.rlike(_near(items, i, node.n)) for i in range(len(items))])) if items else F.lit(False)
    if node.kind == "not":
        left, right = node.items
        keep = predicate(left, columns, only)
        return keep if right.kind == "phrase" and len(right.text) < 3 else keep & ~predicate(right, columns, only)
    parts = [x for x in node.items if not (node.kind == "or" and x.kind == "phrase" and len(x.text) < 3)]
    out = F.lit(node.kind == "and")
    for x in parts:
        out = out & predicate(x, columns, only) if node.kind == "and" else out | predicate(x, columns, only)
    return out
