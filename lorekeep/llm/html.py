"""HTML extraction by nearest-URL page differencing.

Pages of a host are ordered by URL path; each page pairs with the neighbour whose path shares the longer prefix. Text lines of
both pages (blocks, in page order) are aligned by longest common subsequence, and shared lines are deleted: what two pages
of a site have in common is its frame. Evidence besides limits that. Lines inside an <article> or <main> are content even where
a neighbour is a copy of the page, but for short lines (up to SHORT words) that a neighbour shares and that EVERYWHERE of the host's
versions have, MANY at least: a menu that stands inside. Lines in elements that are furniture by their meaning (navigation, footers, forms, scripts,
adverts, notices, comments) go even where no neighbour shares them. Differencing decides all other lines, on pages with an
article too. Since a neighbour may be a copy of the page, whole or updated, a shared line goes only if it is on OFTEN or more
versions of pages of the host (pages with the same lines are one version). On a host of fewer versions the neighbour alone
decides, unless its lines are all the same. A page alone on its host has no neighbour.

The order of URLs is a range sort, stored, with neighbours across partition bounds joined back; a host of any size is spread
over partitions. Null html is empty; a null url has no host and no neighbour. Of rows that share an id, one gives the lines
that a neighbour sees (the largest hash list), all are extracted. Extra columns are ignored; pages are parsed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Versions of pages of a host that a line of its frame is on at least; parts that the pages with a line are dealt to.
OFTEN, SALTS = 3, 16
#: Most words of a line that differencing takes out of an article, versions that must have it, and their share of the host's.
SHORT, MANY, EVERYWHERE = 4, 5, 0.8
#: Stands among the lines of every page, so that it is counted as often as its host has versions.
HOST = 0
#: Elements by their meaning in HTML, and names that page furniture goes by.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
GONE = set("applet aside audio button canvas datalist dialog embed footer form head iframe input map menu nav noscript object script search select style svg template textarea title video".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion related recommended recommendations respond search share sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar topbar widget".split()
)
#: Words that stand before such a name without changing what it is.
QUALIFIERS = set("bottom global left main page primary right secondary site top".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


def _named(token: str) -> bool:
    """Whether a class or id is a furniture's name as a whole: one of NAMES, several of them, or one after a qualifier. A word of it isn't enough:
    share-price and has-sidebar are no furniture."""
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if w]
    words = words[1:] if len(words) > 1 and words[0] in QUALIFIERS else words
    return bool(words) and all(w in NAMES for w in words)


def _furniture(tag: str, attrs: str, inside: bool) -> str:
    """How an element is told to be furniture: by what it is (element), by its name (name), or not at all."""
    if tag in GONE:
        return "element"
    if tag == "header":
        return "" if inside else "element"
    if not attrs or tag in ("html", "body", "article", "main"):
        return ""
    a = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTR.finditer(attrs)}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()):
        return "element"
    if a.get("role", "").lower() in ROLES:
        return "element"
    return "name" if any(_named(t) for t in f"{a.get('class', '')} {a.get('id', '')}".split()) else ""


def lines_of(html: str) -> list[tuple[str, int]]:
    """Blocks of text in page order with their place: 0 in furniture, 1 elsewhere, 2 in an article or main element. On a page without
    article and main, names that would take more than half of its text are taken to be no furniture's."""
    lines, named = _parsed(html, True)
    kept = sum(len(t) for t, place in lines if place)
    return _parsed(html, False)[0] if named > kept and not any(place == 2 for _, place in lines) else lines


def _parsed(html: str, by_name: bool) -> tuple[list[tuple[str, int]], int]:
    """Blocks with their place, and the number of characters that only names make furniture."""
    from html import unescape

    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements with the place inside them
    text: list[tuple[str, int]] = []  # pieces of the open block, each with its place
    place, at, named, outermost = 1, 0, 0, None  # outermost: depth of the open element that a name made furniture

    def close_block() -> None:
        # inline furniture (a button, an advert's span) leaves the block that it stands in
        at = max((p for _, p in text), default=0)
        line = " ".join("".join(t for t, p in text if p or not at).split())
        text.clear()
        if line:
            out.append((line, at))

    def pop(to: int) -> None:
        nonlocal place, outermost
        del stack[to:]
        outermost = None if outermost is not None and to <= outermost else outermost
        place = stack[-1][1] if stack else 1

    while at < len(html):
        m = TOKEN.search(html, at)
        if not m:
            text.append((unescape(html[at:]), place))
            break
        if m.start() > at:
            text.append((unescape(html[at : m.start()]), place))
            named += len(text[-1][0].strip()) if outermost is not None else 0
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            if tag in BLOCKS:
                close_block()
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None:
                pop(k)
            elif tag == "br":
                text.append((" ", place))
            continue
        attrs = m[3] or m[6] or ""
        if tag in BLOCKS:
            close_block()
            # an open paragraph, item or cell ends where the next begins
            ends = CLOSES.get(tag, {"p"})
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ends or stack[i][0] in ("p",)), None)
            if k is not None and not any(t in ("ul", "ol", "table", "dl", "div", "section", "article", "main", "nav", "aside", "blockquote", "form") for t, _ in stack[k + 1 :]):
                pop(k)
        elif tag in ("br", "td", "th", "img"):
            text.append((" ", place))
        if tag in VOID:
            continue
        inner = place
        why = _furniture(tag, attrs, place == 2) if place else ""
        if why == "element" or (why and by_name):
            inner = 0
        elif place == 1 and tag in ("article", "main"):
            inner = 2
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            stop = end.start() if end else len(html)
            if inner:
                text.append((unescape(html[at:stop]), place))
            at = end.end() if end else len(html)
            continue
        if not attrs.endswith("/") or tag in BLOCKS:
            outermost = len(stack) if outermost is None and why == "name" and inner == 0 else outermost
            stack.append((tag, inner))
            place = inner
    close_block()
    return out, named


def shared(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence with b: the longest rising run of matches, (len(a) + matches) log time."""
    from bisect import bisect_left

    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    nodes: list[tuple[int, tuple | None]] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    got, node = set(), nodes[-1] if nodes else None
    while node:
        got.add(node[0])
        node = node[1]
    return got


def neighbours(keys: DataFrame) -> DataFrame:
    """keys (host, path, page_id), distinct -> (page_id, pair_id), each page's nearest by path on its host."""
    spread = keys.repartitionByRange("host", "path", "page_id").withColumn("pid", F.spark_partition_id())
    k = stored(spread.where("host <> ''"), "urls").withColumn("me", F.struct("host", "path", "page_id"))
    own = Window.partitionBy("pid").orderBy("me")
    k = k.withColumn("prev", F.lag("me").over(own)).withColumn("next", F.lead("me").over(own))
    ends = k.groupBy("pid").agg(F.min("me").alias("lo"), F.max("me").alias("hi"))  # a row per partition
    order = Window.orderBy("pid")
    ends = ends.select("pid", F.lag("hi").over(order).alias("before"), F.lead("lo").over(order).alias("after"))
    k = k.join(F.broadcast(ends), "pid").withColumn("prev", F.coalesce("prev", "before")).withColumn("next", F.coalesce("next", "after"))

    def alike(c: str) -> Column:
        """Length of the paths' common prefix, found by halving; -1 on another host."""
        a, b = F.col("path"), F.col(c)["path"]
        most = F.least(F.length(a), F.length(b))
        bits = F.sequence(F.ceil(F.log2(most + 1)).cast("int"), F.lit(0), F.lit(-1))
        longer = lambda n, m: F.when((m <= most) & (F.left(a, m) == F.left(b, m)), m).otherwise(n)
        step = lambda n, i: longer(n, n + F.call_function("shiftleft", F.lit(1), i))
        return F.when(F.col(c)["host"] == F.col("host"), F.aggregate(bits, F.lit(0), step)).otherwise(F.lit(-1))

    k = k.withColumn("p", alike("prev")).withColumn("n", alike("next"))
    k = k.withColumn("p", F.coalesce("p", F.lit(-1))).withColumn("n", F.coalesce("n", F.lit(-1)))
    return k.select("page_id", F.when((F.col("p") < 0) & (F.col("n") < 0), None).when(F.col("p") >= F.col("n"), F.col("prev")["page_id"]).otherwise(F.col("next")["page_id"]).alias("pair_id"))


def _hashes(lines: list[tuple[str, int]]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t, place in lines if place < 2 or _short(t)]


def _short(line: str) -> bool:
    return len(line.split(None, SHORT)) <= SHORT


def _version(lines: list[tuple[str, int]]) -> int:
    """What pages with the same text have in common."""
    import xxhash

    return xxhash.xxh3_64_intdigest("\n".join(t for t, place in lines if place).encode()) - (1 << 63)


def recurring(lines: DataFrame, column: str = "free") -> DataFrame:
    """lines (page_id, host, version, free, inner) -> (page_id, often): the lines of each page that OFTEN versions of its host have; for column inner
    those that MANY of them and EVERYWHERE of all its versions have."""
    key = F.xxhash64("host", "line")
    once = lines.groupBy("host", "version").agg(F.max(column).alias("free"))
    if column == "inner":
        every = once.groupBy("host").agg(F.count("*").alias("of")).where(F.col("of") >= MANY)
        counts = once.select("host", F.explode("free").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= MANY)
        counts = counts.join(every, "host").where(F.col("n") >= EVERYWHERE * F.col("of")).groupBy("host").agg(F.collect_set("line").alias("menu"))  # a host's menu
        own = lines.join(counts, "host").select("page_id", F.array_intersect("inner", "menu").alias("often"))
        return own.where(F.size("often") > 0)
    counts = once.select("host", F.explode("free").alias("line")).groupBy(key.alias("k")).agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    counts = counts.select("k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = lines.select("page_id", "host", F.explode("free").alias("line")).select("page_id", "line", key.alias("k"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return own.join(counts, ["k", "salt"]).groupBy("page_id").agg(F.collect_list("line").alias("often"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, pair_id, n_shared): main text, the page it was compared with, lines deleted by that."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    keys = base.select(host.alias("host"), path.alias("path"), "page_id").where("page_id is not null").groupBy("page_id").agg(F.min(F.struct("host", "path")).alias("k")).select("k.host", "k.path", "page_id")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            theirs, free, inner, version = [], [], [], []
            for h in b.column("html"):
                lines = lines_of(h.as_py())
                theirs.append(_hashes(lines))
                free.append(sorted({HOST, *_hashes([x for x in lines if x[1] == 1])}))
                inner.append(sorted(set(_hashes([x for x in lines if x[1] == 2]))))
                version.append(_version(lines))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(theirs, longs), pa.array(free, longs), pa.array(inner, longs), pa.array(version, pa.int64())], names=["page_id", "theirs", "free", "inner", "version"])

    seen = base.where("page_id is not null").select("page_id", "html").mapInArrow(frames, "page_id long, theirs array<long>, free array<long>, inner array<long>, version long")
    seen = stored(seen.groupBy("page_id").agg(F.max(F.struct("theirs", "free", "inner", "version")).alias("s")).select("page_id", "s.*"), "lines")
    known = seen.join(keys.where("host <> ''"), "page_id").select("page_id", "host", "version", "free", "inner")
    often, menu = recurring(known), recurring(known, "inner").select("page_id", F.col("often").alias("menu"))
    theirs = seen.select(F.col("page_id").alias("pair_id"), "theirs", F.col("version").alias("their_version"))
    pairs = neighbours(keys).join(theirs, "pair_id", "left").join(often, "page_id", "left").join(menu, "page_id", "left").select(F.col("page_id").alias("_id"), "pair_id", "theirs", "their_version", "often", "menu")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, gone = [], []
            for h, theirs, other, often, menu in zip(*(b.column(c) for c in ("html", "theirs", "their_version", "often", "menu")), strict=True):
                lines = lines_of(h.as_py())
                mine, theirs, recur = _hashes(lines), theirs.as_py(), set(often.as_py() or ())
                same = shared(mine, theirs) if theirs is not None else set()
                outer = [i for i, (t, place) in enumerate(lines) if place < 2 or _short(t)]
                menu = set(menu.as_py() or ()) if other.as_py() != _version(lines) else set()
                common = {outer[i] for i in same if lines[outer[i]][1] < 2 or mine[i] in menu}
                if HOST in recur:
                    common -= {i for i, x in zip(outer, mine, strict=True) if lines[i][1] == 1 and x not in recur}
                elif other.as_py() == _version(lines):
                    common -= {i for i in outer if lines[i][1] == 1}
                out.append("\n".join(t for i, (t, place) in enumerate(lines) if place and i not in common))
                gone.append(len(common))
            got = [pa.array(out, pa.string()), pa.array(map(len, out), pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *got, b.column("pair_id")], names=["page_id", "url", "text", "n_chars", "n_shared", "pair_id"])

    joined = base.join(pairs, base["page_id"] == pairs["_id"], "left").drop("_id")
    return joined.mapInArrow(texts, "page_id long, url string, text string, n_chars long, n_shared long, pair_id long")
