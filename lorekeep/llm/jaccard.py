"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct k-word shingles, as 64-bit hashes. Two documents link when 100 * |A ∩ B| >= percent * |A ∪ B|.
1. Global order: words and shingles count into hashed counters over all documents. Shingles of usual load come first, those
   of the rarest words before all; shingles of heavy slots (passages that many documents share) come last, by magnitude.
   Any fixed order is right; this one makes it rare that unrelated documents share a shingle of their prefixes.
2. Prefix: the first n - ceil(t n) + 1 shingles in that order. Linked documents share one of them, and at the first that they
   share, what is left of both sets is long enough for the overlap: the place of a shingle filters pairs before any set is read.
3. Groups: documents with the same prefix and size collapse into one group, after documents with equal sets (linked without
   more ado). Each group's members pair with its leader, and groups that share a prefix shingle pair with that shingle's
   first group by hash: stars, never all pairs of a bucket.
4. Verify: pairs that pass the filters of size, place and odd sketch (parities of hashed bits, which never drop a link) are checked
   on full sets; links give components.
5. Rest: buckets that still span several components are expanded to members. In buckets of up to SMALL members, those of
   different components pair if size and place allow; larger ones make another star first. What is left of large buckets is
   compared across components block by block, by size and sketch: a cell gives a
   spanning forest of its components, which is verified as before; buckets with an end of a pair that failed are compared
   in full, on finer sketches. So every link between different components is found or joined by others, and components are exact.

Buckets of heavy shingles are counted with map-side combination and joined in SALTS parts, so no shingle makes a hot task.
Null and empty texts have the empty set and link with nothing. Fewer than k words are one shingle. Repeated rows and ids link
to themselves; a null id has its set counted but no component. Extra columns are ignored. Sets are whole, whatever the length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components

#: Counters of shingles and of words, and the blocks they travel in: SLOTS + RARE bytes are broadcast, whatever the corpus.
SLOTS, RARE, PARTS = 1 << 22, 1 << 18, 1024
#: Buckets of the bounded filter that selects texts to verify; members of a bucket compared at once.
BUCKETS, BLOCK = 1 << 20, 1024
#: Members up to which a bucket's rest is paired by a join; parts that rows of a heavy shingle are dealt to.
SMALL, SALTS = 16, 16
#: Columns of the texts as they go to Python: bytes, not decoded.
TEXTS = "doc_id long, text binary"


def texts_of(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))


def words_in(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 bytes, A-Z lowered: both methods of bytes know ASCII alone, and split at just the contract's white space."""
    return text.lower().split() if text else []


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)


def hashed(words: Iterator[bytes], n: int) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of word hashes, in order; fewer words are one window, none have none."""
    n = len(words)
    if n == 0:
        return words
    h = words[: max(n - k + 1, 1)] if n >= k else np.array([n], np.uint64)
    for j in range(1, k) if n >= k else range(n):
        h = _mix(h, words[j : n - k + 1 + j] if n >= k else words[j : j + 1])
    return h


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text."""
    for t in batch.column("text").to_pylist():
        w = words_in(t)
        yield np.unique(shingles(hashed(w, len(w)), k))


def slot(tokens: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    return (tokens >> np.uint64(20)).astype(np.int64) & (slots - 1)


def frequency_levels(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """uint8[SLOTS]: 0 for slots of usual load, else the binary magnitude over it; uint8[RARE]: rarity of words in bits. Counts
    cover every word and shingle of every document; each task sends compressed blocks of counters, which are added up
    as they stream in."""
    width, wide = SLOTS // PARTS, SLOTS + RARE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide, np.int64)

        def put(lists: list[list[bytes]]) -> None:
            size = [len(x) for x in lists]
            w = hashed(chain.from_iterable(lists), sum(size))
            if len(w) < k:
                return
            last = np.repeat(np.cumsum(size), size)  # where the word's text ends
            g = shingles(w, k)
            g = g[np.arange(k, len(w) + 1) <= last[: len(g)]]
            total[:SLOTS] += np.bincount(slot(g), minlength=SLOTS)
            total[SLOTS:] += np.bincount(slot(w, RARE), minlength=RARE)

        for b in batches:
            lists, held = [], 0
            for t in b.column("text").to_pylist():
                lists.append(words_in(t))
                held += len(lists[-1])
                if held > 1 << 20:
                    put(lists)
                    lists, held = [], 0
            put(lists)
        blocks = ((i, total[i * width : (i + 1) * width]) for i in range(wide // width))
        rows = [(i, zlib.compress(x.tobytes(), 1)) for i, x in blocks if x.any()]
        yield pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows], pa.int32()), "counts": pa.array([r[1] for r in rows], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, c in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(c), np.int64)
                sums[p] = sums[p] + x if p in sums else x
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())})

    schema = "part int, counts binary"
    parts: dict[int, bytes] = {}
    total, words = 0, 0
    for r in texts.mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).toLocalIterator():  # SLOTS + RARE counters in all, kept compressed
        parts[r["part"]] = bytes(r["counts"])
        n = int(np.frombuffer(zlib.decompress(parts[r["part"]]), np.int64).sum())
        total, words = (total + n, words) if r["part"] < PARTS else (total, words + n)
    usual, levels, rare = total / SLOTS, np.zeros(SLOTS, np.uint8), np.zeros(RARE, np.uint8)
    for p, c in parts.items():
        n = np.frombuffer(zlib.decompress(c), np.int64)
        if p < PARTS:
            levels[p * width : (p + 1) * width] = np.where(n > 4 * usual + 8, np.log2(np.maximum(n / (usual + 1), 1)).astype(np.uint8) + 1, 0)
        else:
            rare[(p - PARTS) * width : (p - PARTS + 1) * width] = np.log2(np.maximum(words / (n + 1), 1)).astype(np.uint8)
    return levels, rare


def profiles(texts: DataFrame, order: tuple[np.ndarray, np.ndarray], k: int, percent: int) -> DataFrame:
    """(doc_id, n, sig, bins, pre, prefix) of each document: set size, 128-bit digests of set and prefix, odd sketch, prefix. The
    lowest bit of a prefix shingle tells whether its slot is heavy."""
    shared = texts.sparkSession.sparkContext.broadcast((order[0].tobytes(), order[1].tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        levels, rare = (np.frombuffer(x, np.uint8) for x in shared.value)
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                w = words_in(t)
                w = hashed(w, len(w))
                s, at = np.unique(shingles(w, k), return_index=True)
                n, bits = len(s), rare[slot(w, RARE)].astype(np.int64)
                far = sum((bits[at + j] for j in range(k)), np.zeros(n, np.int64)) if len(w) >= k else np.zeros(n, np.int64)
                heavy = levels[slot(s)]
                first = np.lexsort((s, -far, heavy))[: n - -(-percent * n // 100) + 1] if n else at
                p = (s[first] & ~np.uint64(1)) | (heavy[first] > 0).astype(np.uint64)
                rows.append((n, xxhash.xxh3_128_digest(s.tobytes()), sketch(s), xxhash.xxh3_128_digest(p.tobytes()), p.view(np.int64)))
            n, sig, bins, pre, prefix = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.binary()), "bins": pa.array(bins, pa.binary()), "pre": pa.array(pre, pa.binary()), "prefix": pa.array(prefix, pa.list_(pa.int64())),
            })

    return texts.mapInArrow(run, "doc_id long, n long, sig binary, bins binary, pre binary, prefix array<long>")


def _size_fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _place_fits(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Whether the sets may link if the shingle at these places of their prefixes is the first that they share."""
    return _size_fits(na, nb, percent) & ((100 + percent) * F.least(na - pa_, nb - pb) >= percent * (na + nb))


def sketch(tokens: np.ndarray, bits: int = 2, top: int = 1 << 14) -> bytes:
    """Odd sketch: parities of the counts of tokens by their low bits; a power of two of bits, `bits` a token or more, within
    512 and top."""
    m = 512
    while m < min(bits * len(tokens), top):
        m *= 2
    return np.packbits(np.bincount((tokens & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(rows: list[bytes], size: int) -> np.ndarray:
    """Sketches of equal length as rows of 64-bit words, brought down to size bytes: halves add up by exclusive or."""
    x = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    while x.shape[1] > size:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return np.ascontiguousarray(x).view(np.uint64)


def _close(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches differ by no more than linked sets can: odd bits of the difference never exceed its size."""
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64) * (100 + percent) <= (100 - percent) * sizes


def words_among(ids: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """texts_of the documents in ids (distinct doc_id): a table of at most BUCKETS hash values is broadcast to leave other
    texts unread by Python, and the caller's join on ids does the rest."""
    bucket = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
    few = ids.select(bucket().alias("h")).distinct()
    return texts_of(docs, text).withColumn("h", bucket()).join(F.broadcast(few), "h", "left_semi").drop("h")


def _bins_fit(percent: int):
    """Keeps the pairs whose sketches differ by no more than linked sets of their sizes can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (b.column(c).to_pylist() for c in ("ba", "bb"))
            n = np.asarray(b.column("na")) + np.asarray(b.column("nb"))
            lengths = np.array([(len(u), len(v)) for u, v in zip(x, y, strict=True)])
            ok = np.zeros(b.num_rows, bool)
            for lx, ly in np.unique(lengths, axis=0):
                at = np.flatnonzero((lengths == (lx, ly)).all(1))
                ok[at] = _close(folded([x[i] for i in at], min(lx, ly)), folded([y[i] for i in at], min(lx, ly)), n[at], percent)
            yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b")}).filter(pa.array(ok))

    return run


def filtered(pairs: DataFrame, prof: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a <> b, whose sketches may be of linked sets."""
    side = lambda x: prof.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"b{x}"))
    p = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    p = p.join(side("a"), "a").join(side("b"), "b")
    return p.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(_bins_fit(percent), "a long, b long").distinct()


def sketches(ids: DataFrame, docs: DataFrame, k: int, bits: int, top: int, text: str = "text") -> DataFrame:
    """(doc_id, bins) of the documents in ids: odd sketches of `bits` bits a shingle, up to top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "bins": pa.array([sketch(s, bits, top) for s in shingle_sets(b, k)], pa.binary())})

    return words_among(ids, docs, text).mapInArrow(run, "doc_id long, bins binary").join(ids, "doc_id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, own: Scratch, text: str = "text") -> DataFrame:
    """A table of the pairs (a, b) that link, checked on full sets. Sets are made of texts in the pairs only."""
    pairs = own.store(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "s": pa.array([s.view(np.int64) for s in shingle_sets(b, k)], pa.list_(pa.int64()))})

    full = own.store(words_among(ids, docs, text).mapInArrow(sets, "doc_id long, s array<long>").join(ids, "doc_id", "left_semi"), "sets")
    p = pairs.join(full.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            va, vb = (np.asarray(b.column(c).flatten()) for c in ("sa", "sb"))
            oa, ob = (np.asarray(b.column(c).offsets) - b.column(c).offsets[0].as_py() for c in ("sa", "sb"))
            ok = []
            for i in range(b.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                z = np.sort(np.concatenate((x, y)), kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b")}).filter(pa.array(ok, pa.bool_()))

    out = own.store(p.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long").distinct(), "links")
    own.drop(pairs, full)
    return out


def _beside(rows: DataFrame, facts: DataFrame, spread: str) -> DataFrame:
    """rows joined with facts, a row per token; rows of heavy tokens are dealt to SALTS parts by their column `spread`."""
    heavy = F.col("token").bitwiseAND(F.lit(1)) == 1
    some = facts.withColumn("salt", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return rows.withColumn("salt", F.when(heavy, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).join(some, ["token", "salt"]).drop("salt")


def buckets_of(leaders: DataFrame) -> DataFrame:
    """leaders (gid, n, prefix) -> (token, pos, n, gid, hg, hn, hp): prefix shingles that two groups or more have, beside the
    first group by hash. Shingles of usual load are counted where they meet, heavy ones by aggregation before they move."""
    tokens = leaders.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    heavy, head = F.col("token").bitwiseAND(F.lit(1)) == 1, F.min(F.struct(F.xxhash64("gid").alias("h"), F.col("gid").alias("hg"), F.col("n").alias("hn"), F.col("pos").alias("hp")))
    meet = Window.partitionBy("token")
    usual = tokens.where(~heavy).withColumn("c", F.count("*").over(meet)).where("c > 1").withColumn("head", head.over(meet))
    facts = tokens.where(heavy).groupBy("token").agg(F.count("*").alias("c"), head.alias("head")).where("c > 1")
    return usual.unionByName(_beside(tokens.where(heavy), facts, "gid")).select("token", "pos", "n", "gid", "head.hg", "head.hn", "head.hp")


def _across(percent: int, forest: bool):
    """Streams rows sorted by cell (token, i, j); of each cell gives the pairs of different components that pass the filters.
    With forest, pairs that only join what the cell's earlier pairs join are left out: at most one less than its components."""

    def pairs_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        side, ids, comp, n = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        length = np.array([len(r[4]) for r in rows])
        parts = {}
        for size in np.unique(length):  # sketches of at least this length, folded to it
            parts[size] = np.zeros((len(rows), size // 8), np.uint64)
            for own in np.unique(length[length >= size]):
                at = np.flatnonzero(length == own)
                parts[size][at] = folded([rows[i][4] for i in at], size)
        label, out_a, out_b = comp.copy(), [], []
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 0: left, 1: right, 2: both
        for i in left:
            js = right[right > i] if side[i] == 2 else right
            js = js[(label[js] != label[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]
            if len(js):
                ok = np.zeros(len(js), bool)
                for size, part in parts.items():
                    if size <= length[i]:
                        at = np.flatnonzero(length[js] >= size if size == length[i] else length[js] == size)
                        ok[at] = _close(part[js[at]], part[i], n[js[at]] + n[i], percent)
                js = js[ok]
            if len(js) and forest:
                old, at = np.unique(label[js], return_index=True)
                js = js[at]
                label[np.isin(label, old)] = label[i]
            if len(js):
                out_a.append(np.full(len(js), ids[i]))
                out_b.append(ids[js])
        empty = np.zeros(0, np.int64)
        return np.concatenate(out_a or [empty]), np.concatenate(out_b or [empty])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, seen = None, [], set()
        give = lambda a, b: pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        def close() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                a, b = pairs_of(rows)
                fresh = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if (x, y) not in seen]
                if len(seen) > 1 << 18:
                    seen.clear()  # it only spares repeats; the caller makes pairs distinct
                seen.update(fresh)
                if fresh:
                    yield give([x for x, _ in fresh], [y for _, y in fresh])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("token", "i", "j", "side", "doc_id", "comp", "n", "bins")), strict=True):
                if r[:3] != key:
                    yield from close()
                    key, rows = r[:3], []
                rows.append(r[3:])
        yield from close()

    return run


def across(buckets: DataFrame, bins: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Distinct candidate pairs (a, b) of different components within the buckets (token, doc_id, comp, n); of buckets with the
    same members one is read. Large buckets are dealt over cells of two blocks, so no task gets a whole one."""
    digest = lambda i: F.sum(F.xxhash64("doc_id", F.lit(i)).cast("decimal(20,0)")).alias(f"d{i}")
    open_ = buckets.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), digest(0), digest(1)).where("lo <> hi")
    open_ = open_.groupBy("c", "d0", "d1").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    rest = _beside(buckets, open_, "doc_id").withColumn("b", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    cells = rest.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("token", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1).cast("long").alias("side"), "doc_id", "comp", "n")
    cells = cells.join(bins, "doc_id").select("token", "i", "j", "side", "doc_id", "comp", "n", "bins")
    found = cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_across(percent, forest), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_components(docs: DataFrame, k: int = 3, percent: int = 90, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs. The result reads two tables of scratch."""
    own = scratch or Scratch(docs.sparkSession)
    texts = texts_of(docs, text)
    prof = own.store(profiles(texts, frequency_levels(texts, k), k, percent), "profiles")
    some = prof.where("n > 0 and doc_id is not null")
    same = own.store(some.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("pre").alias("pre"), F.count("*").alias("copies")), "same")
    copies = some.join(same.where("copies > 1").select("sig", "rep"), "sig").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")

    # groups: equal prefix and size; the leader is the smallest id, found before the rows move
    member = Window.partitionBy("pre", "n").orderBy("doc_id")
    leaders = own.store(some.select("doc_id", "n", "pre", "prefix").withColumn("r", F.row_number().over(member)).where("r = 1").select(F.col("doc_id").alias("gid"), "n", "prefix"), "leaders")
    groups = same.groupBy("pre", "n").agg(F.min("rep").alias("gid"), F.count("*").alias("m")).where("m > 1")
    inside = own.store(same.join(groups, ["pre", "n"]).select("gid", F.col("rep").alias("doc_id"), "n", "m").where("gid <> doc_id"), "groups")
    shared = own.store(buckets_of(leaders), "buckets")
    own.drop(leaders)
    stars = shared.where((F.col("gid") != F.col("hg")) & _place_fits(F.col("n"), F.col("pos"), F.col("hn"), F.col("hp"), percent)).select(F.col("hg").alias("a"), F.col("gid").alias("b"))
    links = inside.select(F.col("gid").alias("a"), F.col("doc_id").alias("b")).unionByName(stars)
    links = verified(filtered(links, some, percent), docs, k, percent, own, text)

    def label(df: DataFrame, comp: DataFrame) -> DataFrame:
        """df with comp, the component of doc_id; ids without a link are their own."""
        return df.drop("comp").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component_id", "doc_id")).drop("component_id")

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows (token, doc_id, comp, ...) of buckets of several components, with the bucket's size."""
        facts = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("token", "size")
        return _beside(rows.drop("size"), facts, "doc_id")

    # groups in buckets that span several components are expanded to their members; a group is a bucket of its own as well
    linked = components(links, scratch=own)
    ids = shared.select("gid").distinct().select("gid", F.col("gid").alias("doc_id")).unionByName(inside.select("gid", "doc_id"))
    ids = own.store(label(ids, linked), "members")
    spans = ids.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    near = shared.select("token", "pos", "n", "gid").join(spans, "gid")
    facts = near.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token")
    near = _beside(near.select("token", "pos", "n", "gid"), facts, "gid")
    group = F.xxhash64("gid", F.lit("group"))
    group = F.when(F.col("m") > SMALL, group.bitwiseOR(F.lit(1))).otherwise(group.bitwiseAND(F.lit(-2)))
    alone = inside.select(group.alias("token"), F.lit(0).alias("pos"), "n", "doc_id").unionByName(inside.select(group.alias("token"), F.lit(0).alias("pos"), "n", F.col("gid").alias("doc_id")).distinct())
    rows = near.join(ids, "gid").select("token", "pos", "n", "doc_id", "comp").unionByName(label(alone, linked).select("token", "pos", "n", "doc_id", "comp"))
    rows = own.store(mixed(rows), "buckets")
    own.drop(shared, ids)

    # small buckets: members of different components; large ones: another star
    small, large = rows.where(F.col("size") <= SMALL), rows.where(F.col("size") > SMALL)
    x, y = small.select("token", *[F.col(c).alias(f"{c}_a") for c in ("pos", "n", "doc_id", "comp")]), small.select("token", *[F.col(c).alias(f"{c}_b") for c in ("pos", "n", "doc_id", "comp")])
    fits = (F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("comp_a") != F.col("comp_b")) & _place_fits(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"), percent)
    pairs = x.join(y, (x["token"] == y["token"]) & fits).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))
    centre = F.min(F.struct(F.xxhash64("doc_id", F.lit(1)).alias("h"), F.col("doc_id").alias("id"), F.col("comp").alias("c"), F.col("n").alias("hn"), F.col("pos").alias("hp")))
    star = _beside(large, large.groupBy("token").agg(centre.alias("m")), "doc_id").where((F.col("comp") != F.col("m.c")) & _place_fits(F.col("n"), F.col("pos"), F.col("m.hn"), F.col("m.hp"), percent))
    more = verified(filtered(pairs.unionByName(star.select(F.col("doc_id").alias("a"), F.col("m.id").alias("b"))), some, percent), docs, k, percent, own, text)
    links = links.unionByName(more)

    # what is left: large buckets that still span several components
    left = large.select("token", "doc_id", "n")
    if not left.isEmpty():
        left = own.store(mixed(label(left, components(links, scratch=own))), "buckets")
    if not left.isEmpty():
        tried = own.store(across(left, some.select("doc_id", "bins"), percent, True), "pairs")
        second = verified(tried, docs, k, percent, own, text)
        links = links.unionByName(second)
        failed = own.store(tried.join(second, ["a", "b"], "left_anti"), "pairs")
        if not failed.isEmpty():
            # a pair that proved no link may have stood for others of its cells: those buckets are compared in full
            ends = failed.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
            redo = left.join(ends, "doc_id", "left_semi").select("token").distinct()
            again = own.store(label(left.join(redo, "token", "left_semi"), components(links, scratch=own)), "buckets")
            fine = own.store(sketches(again.select("doc_id").distinct(), docs, k, 16, 1 << 16, text), "sketches")
            third = across(again, fine, percent, False).join(failed, ["a", "b"], "left_anti")
            links = links.unionByName(verified(third, docs, k, percent, own, text))
    found = components(copies.unionByName(links), scratch=own).withColumnRenamed("id", "_id")
    out = prof.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("_id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs without those whose component has a smaller id. Of rows that share an id, which are one document here, the one with
    the smallest text stays; rows without an id all stay."""
    found = link_components(docs, k, percent, text, scratch)
    keep = found.where("component_id = doc_id or doc_id is null").groupBy("doc_id").agg(F.count("*").alias("_n"))
    out = docs.join(keep.select(F.col("doc_id").alias("_id")), docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    twice = (scratch or Scratch(docs.sparkSession)).store(keep.where("_n > 1 and doc_id is not null").select(F.col("doc_id").alias("_id")), "repeated")
    if twice.isEmpty():
        return out
    first = Window.partitionBy("doc_id").orderBy(F.col(text).asc_nulls_first())
    again = out.join(twice, out["doc_id"] == F.col("_id"), "left_semi").withColumn("_id", F.row_number().over(first)).where("_id = 1").drop("_id")
    return out.join(twice, out["doc_id"] == F.col("_id"), "left_anti").unionByName(again)
