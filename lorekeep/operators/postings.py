"""A positional text index in ordinary Spark tables: phrases, NEAR and BM25 scores from postings alone, without the texts.

Tables below a path, all of them Parquet:

* `postings/generation=G/bucket=-1`: (block, gram, places, keys, lens), a file's blocks one behind the other, sorted by gram. Rows lie in blocks, whole ones of about
  BLOCK characters: their columns' texts one behind the other with a gap between, so that no phrase spans two. A gram is three folded characters, places are where it
  starts in the block; a gram of a block is one row, or a few. The row of the empty gram has the block's keys, their lengths in trigrams (lens) and where
  each column of theirs begins (places, and the end of the last). The row of the gram END is a block's last one; its lens has the number of rows of the empty gram.
  A block is made by one task, so nothing is shuffled to build an index, and a search matches it where it is read: only blocks that lie in two splits of a file are
  shuffled. Indexes of earlier versions have BUCKETS directories by gram and no END; all their blocks are shuffled.
* `rows/generation=G`: (key, len, source_hash, gone), one row for each row that generation wrote or, with gone, took away.
* `stats/generation=G`: one row (n, total): live rows and their length after that generation; written last, so it tells which generations are whole.

`refresh` compares a table with the index and writes one generation with what is new or changed and what is gone; nothing else is
touched. A row is live in its last generation; searches drop hits of earlier ones. `compact` writes the live rows as generation 0 of another path.
A generation is written with overwrite below its own directory, so a run that was cut off is repeated without harm.

Keys are unique (an error otherwise); rows with a null key aren't indexed. Null columns are empty texts. Terms under three characters match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trigram_length
from ..plans.boolean import Node, parse, phrases
from .fts import IDF_FLOOR, K1, B, _total, top

#: Directories of postings by gram in earlier indexes and the one of all grams, characters taken at a time, characters of a block, grams that a scan is asked for.
BUCKETS, WHOLE, PIECE, BLOCK, PUSHED = 16, -1, 1 << 20, 1 << 20, 1000
#: The gram of a block's last row, behind all of three characters.
END = "\U0010ffff" * 4
#: Bits of a place that a column's number stands above; places of a block that a search in SQL deals to one cell.
COLUMN, CELL = 40, 4096


def _cut(text: str, start: int) -> Iterator[tuple[str, int]]:
    """text in pieces of PIECE characters that share two, with the place each begins at: every three neighbours are in one piece."""
    for i in range(0, max(1, len(text) - 2), PIECE):
        yield text[i : i + PIECE + 2], start + i


def _runs(rows: list[int], texts: list[str], starts: list[int]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(row, gram, places, ends) of texts: a run for each row and gram; places lie one run after the other."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(size)
    c = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    which = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(c) - 2)
    at = at[at + 3 <= ends[which[: len(c) - 2]]] if len(c) > 2 else np.zeros(0, np.int64)
    code = c[at] << 42 | c[at + 1] << 21 | c[at + 2]
    row, place = np.array(rows)[which[at]], np.array(starts)[which[at]] + at - (ends - size)[which[at]]
    order = np.lexsort((place, code, row))
    row, code, place = row[order], code[order], place[order]
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(row) else np.zeros(0, np.int64)
    kinds, kind = np.unique(code[head], return_inverse=True)
    chars = np.stack([kinds >> 42, kinds >> 21 & 0x1FFFFF, kinds & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    names = [chars[i : i + 3] for i in range(0, len(chars), 3)]
    return row[head], [names[k] for k in kind.tolist()], place, np.r_[head[1:], len(row)] if len(row) else head


def gram_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(block, gram, places, keys, lens) of df, as they are stored. Texts are taken by about PIECE characters, a long one in pieces, so a gram may have
    several rows in a block; searches put them together."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    names = [f"t{i}" for i in range(len(cols))]
    d = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), _total([trigram_length(c) for c in cols]).cast("long").alias("len"), *[F.lower(c).alias(n) for c, n in zip(cols, names, strict=True)])
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, at, end = TaskContext.get().partitionId(), 0, 0, 0  # at: the block's next free place; end: that behind its last whole row
        texts, places, keys, lens, starts, held, flushed = [], [], [], [], [], 0, 0

        def flush(types: dict, last: bool) -> pa.RecordBatch:
            nonlocal flushed
            flushed = flushed + 1
            _, gram, place, ends = _runs([0] * len(texts), texts, places)
            first = [*starts, end] if keys else []
            ends = np.r_[0, len(first), len(first) + ends]
            own = np.r_[0, np.full(len(ends) - 1, len(keys))]  # keys and lens belong to the first row
            grams, sizes, own_lens = ["", *gram], lens, own
            if last:
                grams, sizes, ends, own, own_lens = [*grams, END], [*lens, flushed], np.r_[ends, ends[-1]], np.r_[own, own[-1]], np.r_[own, own[-1] + 1]
                flushed = 0
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.r_[np.array(first, np.int64), place].astype(np.int64)).cast(pa.int32())), pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(keys, types["key"])), pa.ListArray.from_arrays(pa.array(own_lens, pa.int32()), pa.array(sizes, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([f"{task}.{number}"] * len(grams), pa.string()), pa.array(grams, pa.string()), *lists], names=["block", "gram", "places", "keys", "lens"])

        types: dict = {}
        for b in batches:
            types = {"key": b.schema.field("key").type}
            for i in range(b.num_rows):
                begins = []
                for n in names:
                    t = b.column(n)[i].as_py()
                    begins.append(at)
                    for piece, start in _cut(t, at):
                        texts.append(piece), places.append(start)
                        held += len(piece)
                        if held >= PIECE:
                            yield flush(types, False)
                            texts, places, keys, lens, starts, held = [], [], [], [], [], 0
                    at += len(t) + 1
                keys.append(b.column("key")[i].as_py()), lens.append(b.column("len")[i].as_py()), starts.extend(begins)
                end = at
                if at >= BLOCK:
                    yield flush(types, True)
                    texts, places, keys, lens, starts, held = [], [], [], [], [], 0
                    number, at, end = number + 1, 0, 0
        if keys or flushed:
            yield flush(types, True)

    return d.mapInArrow(run, f"block string, gram string, places array<int>, keys array<{kind}>, lens array<long>")


def _hash(columns: list[str]) -> Column:
    """Digest of a row's columns; lengths are in it, so that no shift between columns goes unseen."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.encode(F.concat_ws("|", *[F.char_length(t) for t in texts], *texts), "utf-8"), 256)


def stats(spark: SparkSession, path: str) -> dict | None:
    """The last whole generation: generation, n, total. None where nothing was indexed yet."""
    from pyspark.errors import AnalysisException

    try:
        d = spark.read.parquet(f"{path}/stats")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    row = d.orderBy(F.col("generation").desc()).limit(1).collect()  # one row
    return row[0].asDict() if row else None


def _at(spark: SparkSession, path: str, name: str, upto: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").where(F.col("generation") <= upto)


def live(spark: SparkSession, path: str) -> DataFrame:
    """(key, len, source_hash, generation) of the rows that are indexed now."""
    known = stats(spark, path)
    d = _at(spark, path, "rows", known["generation"])
    if known["generation"]:
        d = d.groupBy("key").agg(F.max_by(F.struct("len", "source_hash", "gone", "generation"), "generation").alias("r")).select("key", "r.*")
    return d.where("not gone").select("key", "len", "source_hash", "generation")


def _store(rows: DataFrame, path: str, generation: int) -> None:
    # rows come block by block and stay so: no sort. Ints as packed differences; small pages, which a scan for few grams passes over
    form = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.page.row.count.limit": "100"}
    rows.write.mode("overwrite").options(**form).parquet(f"{path}/postings/generation={generation}/bucket={WHOLE}")


def _write(df: DataFrame, key: str, columns: list[str], path: str, generation: int) -> None:
    _store(gram_rows(df, key, columns), path, generation)


def refresh(df: DataFrame, key: str, columns: list[str], path: str, complete: bool = True) -> dict:
    """Brings the index at path up to df; gives generation, added, changed, removed, n. complete: rows that df lacks are gone; else df holds
    only what may be new. Nothing is written where nothing changed. Texts are read once for their digests, those of changed rows once more."""
    spark = df.sparkSession
    known = stats(spark, path)
    length = _total([trigram_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]).cast("long")
    now = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), length.alias("len"), _hash(columns).alias("source_hash"))
    generation = known["generation"] + 1 if known else 0
    if known:
        old = live(spark, path).select("key", F.col("len").alias("old_len"), F.col("source_hash").alias("old_hash"))
        both = now.join(old, "key", "full")
        fresh = F.col("source_hash").isNotNull() & ~F.col("source_hash").eqNullSafe(F.col("old_hash"))
        gone = F.col("source_hash").isNull() if complete else F.lit(False)
        delta = both.where(fresh | gone).select("key", F.coalesce("len", F.lit(0)).alias("len"), "source_hash", F.col("source_hash").isNull().alias("gone"), "old_len")
    else:
        delta = now.select("*", F.lit(False).alias("gone"), F.lit(None).cast("long").alias("old_len"))
    at = f"{path}/rows/generation={generation}"
    delta.write.mode("overwrite").parquet(at)
    delta = spark.read.schema(delta.schema).parquet(at)
    one = delta.agg(F.count_if(~F.col("gone")).alias("put"), F.count_if(~F.col("gone") & F.col("old_len").isNotNull()).alias("changed"), F.count_if("gone").alias("removed"), F.coalesce(F.sum("len"), F.lit(0)).alias("plus"), F.coalesce(F.sum("old_len"), F.lit(0)).alias("minus"), F.count("*").alias("all"), F.count_distinct("key").alias("keys")).first()
    if one["all"] != one["keys"]:
        raise ValueError(f"{key} is not unique")
    out = {"generation": generation, "added": one["put"] - one["changed"], "changed": one["changed"], "removed": one["removed"]}
    if known and not one["all"]:
        return out | {"generation": known["generation"], "n": known["n"]}
    put = df if not known else df.join(delta.where("not gone").select(F.col("key").alias(key)), key, "left_semi")
    _write(put, key, columns, path, generation)
    n, total = (known["n"], known["total"]) if known else (0, 0)
    n, total = n + out["added"] - out["removed"], total + one["plus"] - one["minus"]
    spark.createDataFrame([(n, total)], "n long, total long").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/generation={generation}")
    return out | {"n": n}


def remove(spark: SparkSession, keys: DataFrame, path: str) -> dict:
    """Takes rows (key) out of the index: a generation of their removal."""
    known = stats(spark, path)
    generation = known["generation"] + 1
    old = live(spark, path).join(keys.select("key").distinct(), "key", "left_semi")
    at = f"{path}/rows/generation={generation}"
    d = old.select("key", F.lit(0).cast("long").alias("len"), F.lit(None).cast("string").alias("source_hash"), F.lit(True).alias("gone"), F.col("len").alias("old_len"))
    d.write.mode("overwrite").parquet(at)
    one = spark.read.schema(d.schema).parquet(at).agg(F.count("*").alias("n"), F.coalesce(F.sum("old_len"), F.lit(0)).alias("minus")).first()
    spark.createDataFrame([(known["n"] - one["n"], known["total"] - one["minus"])], "n long, total long").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/generation={generation}")
    return {"generation": generation, "added": 0, "changed": 0, "removed": one["n"], "n": known["n"] - one["n"]}


def _postings(spark: SparkSession, path: str, known: dict) -> DataFrame:
    kind = dict(_at(spark, path, "rows", known["generation"]).dtypes)["key"]
    # an index of no grams has no file to tell the columns
    d = spark.read.schema(f"block string, gram string, places array<int>, keys array<{kind}>, lens array<long>, generation int, bucket int").parquet(f"{path}/postings")
    return d.where(F.col("generation") <= known["generation"])


def _starts(gram: Column, places: pa.ListArray, keys: pa.ListArray, lens: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray, int]:
    """(starts, keys, lens, columns) of a block, in order of place, from its rows of the empty gram; starts are those of each row's columns."""
    own = [i for i, g in enumerate(gram) if g == "" and len(keys[i].values)]
    own.sort(key=lambda i: places[i].values[0].as_py())
    n = sum(len(keys[i].values) for i in own)
    starts = np.concatenate([places[i].values.to_numpy(zero_copy_only=False)[:-1] for i in own])
    return starts.astype(np.int64), pa.concat_arrays([keys[i].values for i in own]), np.concatenate([lens[i].values.to_numpy(zero_copy_only=False) for i in own]), len(starts) // n


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The live rows of an index as generation 0 of another path, from its postings alone."""
    known = stats(spark, path)
    rows = live(spark, path)
    p = _postings(spark, path, known).drop("bucket")
    kept = p.where("gram = ''").select("generation", "block", F.explode("keys").alias("key")).join(rows.select("key", "generation"), ["key", "generation"], "left_semi")
    kept = kept.groupBy("generation", "block").agg(F.collect_list("key").alias("keys")).select("generation", "block", F.lit(None).cast("string").alias("gram"), F.lit(None).cast("array<int>").alias("places"), "keys", F.lit(None).cast("array<long>").alias("lens"))

    def drop(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        gram, places, keys, lens = (t.column(c).combine_chunks() for c in ("gram", "places", "keys", "lens"))
        gram = gram.to_pylist()
        alive = {k for i, g in enumerate(gram) if g is None for k in keys[i].as_py()}
        out = {"block": [], "gram": [], "places": [], "keys": [], "lens": []}
        put = lambda g, p, k, n: [out[c].append(v) for c, v in zip(out, (f"{t['generation'][0]}:{t['block'][0]}", g, p, k, n), strict=True)]
        starts, of, sizes, columns = _starts(gram, places, keys, lens)
        is_live = np.array([k in alive for k in of.to_pylist()])
        ends = {int(places[i].values[0].as_py()): int(places[i].values[-1].as_py()) for i, g in enumerate(gram) if g == "" and len(keys[i].values)}
        for i, g in enumerate(gram):
            if g and g != END:
                at = places[i].values.to_numpy(zero_copy_only=False)
                at = at[is_live[(np.searchsorted(starts, at, side="right") - 1) // columns]]
                if len(at):
                    put(g, at, [], [])
        by_row, names = starts.reshape(-1, columns), of.to_pylist()
        for j in np.flatnonzero(is_live):  # a row of the empty gram for each; a row ends where the next one began
            end = int(by_row[j + 1][0]) if j + 1 < len(by_row) else max(ends.values())
            put("", [*by_row[j], end], [names[j]], [sizes[j]])
        if is_live.any():
            put(END, [], [], [int(is_live.sum())])
        return pa.table({c: pa.array(v, t.schema.field(c).type) for c, v in out.items()})

    kind = p.schema["keys"].dataType.simpleString()
    whole = p.select("generation", "block", "gram", "places", "keys", "lens").unionByName(kept).groupBy("generation", "block").applyInArrow(drop, f"block string, gram string, places array<int>, keys {kind}, lens array<long>")
    _store(whole, to, 0)
    rows.select("key", "len", "source_hash", F.lit(False).alias("gone"), F.lit(None).cast("long").alias("old_len")).write.mode("overwrite").parquet(f"{to}/rows/generation=0")
    spark.createDataFrame([(known["n"], known["total"])], "n long, total long").coalesce(1).write.mode("overwrite").parquet(f"{to}/stats/generation=0")


def offsets(term: Column) -> Column:
    """Where a term's grams are looked up: every third character and the last three."""
    n = F.char_length(term)
    return F.array_distinct(F.concat(F.sequence(F.lit(0), n - 3, F.lit(3)), F.array(n - 3)))


def _matcher(counts: bool) -> Callable[[pa.Table], pa.Table]:
    """Of a block's rows (block, generation, gram, places, keys, lens, uses) those that hold a term: (term, key, generation, len, tf) or with places for tf."""

    def match(t: pa.Table) -> pa.Table:
        gram, places, keys, lens, uses = (t.column(c).combine_chunks() for c in ("gram", "places", "keys", "lens", "uses"))
        gram = gram.to_pylist()
        starts, names, sizes, columns = _starts(gram, places, keys, lens)
        at: dict[str, list] = {}
        asked: dict[str, dict] = {}
        for i, g in enumerate(gram):
            if g and g != END:
                if g not in at:
                    for u in uses[i].as_py():
                        asked.setdefault(u["term"], {})[u["offset"]] = (g, u["need"])
                at.setdefault(g, []).append(places[i].values.to_numpy(zero_copy_only=False))
        whole = {g: x[0] if len(x) == 1 else np.sort(np.concatenate(x)) for g, x in at.items()}
        terms, rows, values, sums = [], [], [], []
        for term, parts in asked.items():
            if len(parts) < next(iter(parts.values()))[1]:
                continue
            (first, o), *more = sorted(((whole[g], o) for o, (g, _) in parts.items()), key=lambda x: len(x[0]))
            hit = first.astype(np.int64) - o
            for x, o in more:
                where = np.minimum(np.searchsorted(x, hit + o), len(x) - 1)
                hit = hit[x[where] == hit + o]
            if not len(hit):
                continue
            field = np.searchsorted(starts, hit, side="right") - 1
            row, n = np.unique(field // columns, return_counts=True)
            terms.append((term, len(row))), rows.append(row), sums.append(n)
            if not counts:
                values.append((field % columns << COLUMN) + hit - starts[field])
        row, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, sums))
        kinds = pa.array([x for x, _ in terms], pa.string())
        term = kinds.take(pa.array(np.repeat(np.arange(len(terms)), [n for _, n in terms]), pa.int64()))
        generation = pa.array(np.full(len(row), t["generation"][0].as_py(), np.int32))
        last = pa.array(tf, pa.int64()) if counts else pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tf)], pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()))
        block = pa.array([t["block"][0].as_py()] * len(row), pa.string())
        return pa.table([term, names.take(pa.array(row, pa.int64())), generation, block, pa.array(sizes[row], pa.int64()), last], names=["term", "key", "generation", "block", "len", "tf" if counts else "places"])

    return match


def _split_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block of a split, which lie one behind the other."""
    one = lambda b: tuple(b.column(c)[0].as_py() for c in ("generation", "block", "split"))
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        other = np.zeros(b.num_rows - 1, bool)
        for c in ("generation", "block", "split"):
            x = b.column(c)
            other |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(other) + 1).tolist(), b.num_rows]
        for i, z in zip(cuts, cuts[1:], strict=False):
            part = b.slice(i, z - i)
            if held and one(held[-1]) != one(part):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _is_whole(t: pa.Table) -> bool:
    """Whether a split has all rows of a block: its last one, and as many of the empty gram, its first, as that tells; all others lie between."""
    gram, lens = t.column("gram"), t.column("lens")
    ends = pc.indices_nonzero(pc.equal(gram, END)).to_pylist()
    return len(ends) == 1 and lens[ends[0]].as_py()[0] == pc.sum(pc.equal(gram, "")).as_py()


def _hits(spark: SparkSession, path: str, terms: DataFrame, asked: list[str] | None, counts: bool) -> DataFrame:
    """(term, key, generation, block, len, places or tf) of live rows; see `found`. In generation 0 a task has all rows of a block's keys, one behind the other."""
    known = stats(spark, path)
    if known is None:
        raise ValueError(f"no index at {path}")
    q = terms.where(F.char_length("term") >= 3).select("term", offsets(F.col("term")).alias("o")).select("term", F.size("o").alias("need"), F.explode("o").alias("offset"))
    q = q.withColumn("gram", F.substring(F.col("term"), F.col("offset") + 1, F.lit(3)))
    q = q.groupBy("gram").agg(F.collect_list(F.struct("term", "offset", "need")).alias("uses"))
    p = _postings(spark, path, known)
    kind = p.schema["keys"].dataType.elementType.simpleString()
    p = p.withColumn("split", F.xxhash64("_metadata.file_path", "_metadata.file_block_start"))
    grams = sorted({t[i : i + 3] for t in asked for i in {*range(0, len(t) - 2, 3), len(t) - 3} if len(t) >= 3}) if asked is not None else []
    if grams and len(grams) <= PUSHED:
        grams = ["", *grams, END]
        buckets = [r["b"] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]  # BUCKETS at most
        p = p.where(F.col("bucket").isin(WHOLE, *buckets) & F.col("gram").isin(grams))
    rows = p.join(F.broadcast(q), "gram", "left").where(F.col("uses").isNotNull() | F.col("gram").isin("", END))  # a batch's grams
    rows = rows.select("generation", "block", "gram", "places", "keys", "lens", "uses", "split")
    match = _matcher(counts)
    form = f"term string, key {kind}, generation int, block string, len long, " + ("tf long" if counts else "places array<long>")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _split_blocks(batches):
            if _is_whole(t):
                yield from match(t).to_batches(max_chunksize=100_000)

    def broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _split_blocks(batches):
            if not _is_whole(t):
                yield from t.to_batches()

    hits = rows.mapInArrow(whole, form).unionByName(rows.mapInArrow(broken, rows.schema).groupBy("generation", "block").applyInArrow(match, form))
    if known["generation"]:  # rows that a later generation wrote or took away
        later = _at(spark, path, "rows", known["generation"]).where("generation > 0").groupBy("key").agg(F.max("generation").alias("last"))
        hits = hits.join(later, "key", "left").where("last is null or last = generation").drop("last")
    return hits


def found(spark: SparkSession, path: str, terms: DataFrame, asked: list[str] | None = None, counts: bool = False) -> DataFrame:
    """(term, key, len, places) of live rows that hold a term, for terms (term), distinct and folded; with counts tf for places. asked: the terms, where
    they are few, so that the scan is told their grams.

    A term stands where all its grams do at their distance. The terms' grams are broadcast, and a block is matched as a whole by the task that reads it; the
    postings of a block that lies in two splits are shuffled."""
    return _hits(spark, path, terms, asked, counts).select("term", "key", "len", "tf" if counts else "places")


def _parts(spark: SparkSession, path: str, known: dict, queries: DataFrame, asked: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """(n, generation, block, key, p): what each term adds to the score of a row for a query; and the queries' numbers (query_id, n)."""
    n, mean = known["n"], known["total"] / max(known["n"], 1)
    # terms that differ in case only count each, as in a scan
    q = queries.where(F.char_length("term") >= 3).select("query_id", "term").distinct().withColumn("term", F.lower("term"))
    ids = q.select("query_id").distinct().withColumn("n", F.row_number().over(Window.orderBy("query_id")))  # a batch of queries
    hits = _hits(spark, path, q.select("term").distinct(), asked, True)
    rows = hits.groupBy("term").agg(F.count("*").alias("rows"))
    idf = F.log((F.lit(n) - F.col("rows") + 0.5) / (F.col("rows") + 0.5))
    weight = rows.select("term", F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)).alias("w"))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(mean) or 1.0)))
    # terms and queries are broadcast, as their grams are; hits stay where they were found
    parts = hits.join(F.broadcast(weight), "term").select("term", "generation", "block", "key", part.alias("p"))
    return parts.join(F.broadcast(q.join(F.broadcast(ids), "query_id").select("n", "term")), "term").select("n", "generation", "block", "key", "p"), ids


def bm25(spark: SparkSession, path: str, queries: DataFrame, asked: list[str] | None = None) -> DataFrame:
    """(query_id, key, score) for queries (query_id, term): the scores of fts.bm25, of all rows that hold a term, from postings alone."""
    parts, ids = _parts(spark, path, stats(spark, path), queries, asked)
    return parts.groupBy("n", "key").agg((-F.sum("p")).alias("score")).join(F.broadcast(ids), "n").select("query_id", "key", "score")


def _best(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's parts (n, block, key, p), block by block, the rows (n, key, score) that may be among a query's first `limit`."""

    def cut(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("n", "ascending"), ("score", "ascending"), ("key", "ascending")])).combine_chunks()
        n, score = (t.column(c).to_numpy() for c in ("n", "score"))
        at = np.arange(len(n))
        first = np.maximum.accumulate(np.where(np.r_[True, n[1:] != n[:-1]], at, 0))
        run = np.maximum.accumulate(np.where(np.r_[True, (n[1:] != n[:-1]) | (score[1:] != score[:-1])], at, 0))
        size = np.r_[first[1:][first[1:] != first[:-1]], len(n)] - np.unique(first)
        edge = np.repeat(score[np.unique(first) + np.minimum(size, limit) - 1], size)
        # scores are compared when rounded to twelve places; of equal ones the first by key
        return t.filter(pa.array((score <= edge + 2e-12) & (at - run < limit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, rows = None, [], 0

        def take() -> pa.Table | None:
            t = pa.Table.from_batches(held).group_by(["n", "key"]).aggregate([("p", "sum")])
            t = pa.table([t.column("n"), t.column("key"), pc.negate(t.column("p_sum"))], names=["n", "key", "score"])
            return cut(t if best is None else pa.concat_tables([best, t]))

        for b in batches:
            if not b.num_rows:
                continue
            block = b.column("block")
            if held and rows > 200_000:  # up to the end of the block that goes on
                same = pc.equal(block, held[-1].column("block")[-1]).to_numpy(zero_copy_only=False)
                i = int(np.argmin(same)) if not same.all() else len(same)
                if i < len(same):
                    held.append(b.slice(0, i))
                    best, held, rows = take(), [], 0
                    b = b.slice(i)
            held.append(b)
            rows += b.num_rows
        if held:
            best = take()
        if best is not None:
            yield from best.to_batches()

    return run


def search_batch(spark: SparkSession, path: str, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, key, score, rank): the first `limit` rows of every query by score and key, one lazy plan for all queries. Sums are rounded to
    twelve places first, since their order isn't fixed. Of generation 0 a task keeps its best rows of each query, and only those are shuffled."""
    known = stats(spark, path)
    if known is None:
        raise ValueError(f"no index at {path}")
    parts, ids = _parts(spark, path, known, queries, None)
    if known["generation"]:
        scores = parts.groupBy("n", "key").agg((-F.sum("p")).alias("score"))
    else:
        scores = parts.select("n", "block", "key", "p").mapInArrow(_best(limit), f"n int, key {parts.schema['key'].dataType.simpleString()}, score double")
    w = Window.partitionBy("n").orderBy(F.round("score", 12), "key")
    scores = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return scores.join(F.broadcast(ids), "n").select("query_id", "key", "score", "rank")


def search(spark: SparkSession, path: str, terms: list[str], limit: int = 10) -> DataFrame:
    """(key, score, rank) of the rows that hold any of terms."""
    q = spark.createDataFrame([(0, t) for t in dict.fromkeys(terms)], "query_id int, term string")
    return top(bm25(spark, path, q, [t.lower() for t in terms]).select("key", "score"), [F.col("score"), F.col("key")], limit)


def _of_column(places: Column, number: int | None) -> Column:
    return places if number is None else F.filter(places, lambda x: F.shiftright(x, COLUMN) == number)


def condition(node: Node, places: dict[str, Column], columns: list[str], only: str | None = None) -> Column:
    """A boolean search as a condition on places of its phrases; the rules of plans.boolean.predicate."""
    only = node.column or only
    at = lambda p: _of_column(F.coalesce(places[p], F.array().cast("array<bigint>")), columns.index(only) if only else None)
    if node.kind == "phrase":
        return F.size(at(node.text.lower())) > 0 if len(node.text) >= 3 else F.lit(False)
    if node.kind == "near":
        items = [x.text.lower() for x in node.items if len(x.text) >= 3]
        behind = lambda s, p: F.exists(at(p), lambda x: (x <= s) & (s - x <= len(p) - 2 + node.n) & (F.shiftright(x, COLUMN) == F.shiftright(s, COLUMN)))
        last = lambda i: F.exists(at(items[i]), lambda s: reduce(lambda a, b: a & b, [behind(s, p) for j, p in enumerate(items) if j != i], F.lit(True)))
        return reduce(lambda a, b: a | b, [last(i) for i in range(len(items))], F.lit(False))
    if node.kind == "not":
        left, right = node.items
        keep = condition(left, places, columns, only)
        return keep if right.kind == "phrase" and len(right.text) < 3 else keep & ~condition(right, places, columns, only)
    parts = [x for x in node.items if not (node.kind == "or" and x.kind == "phrase" and len(x.text) < 3)]
    out = F.lit(node.kind == "and")
    for x in parts:
        out = out & condition(x, places, columns, only) if node.kind == "and" else out | condition(x, places, columns, only)
    return out


def _texts(node: Node) -> list[str]:
    return [node.text.lower()] if node.kind == "phrase" else [t for x in node.items for t in _texts(x)]


def search_boolean(spark: SparkSession, path: str, query: str, columns: list[str], limit: int = 10) -> DataFrame:
    """(key, score, rank) of a boolean search, as fts.search_boolean gives them; columns are those indexed, in their order. Every row that meets a
    search holds one of its phrases (NOT has a left side), so the phrases' postings are enough."""
    node = parse(query)
    words, scored = sorted({t for t in _texts(node) if len(t) >= 3}), {p for p in phrases(node)}
    known = stats(spark, path)
    mean = float(known["total"] / max(known["n"], 1)) or 1.0
    hits = found(spark, path, spark.createDataFrame([(t,) for t in words], "term string"), words)
    if not words:  # terms under three characters match nothing
        return hits.select("key", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    one = hits.groupBy("key").agg(F.first("len").alias("len"), *[F.first(F.when(F.col("term") == t, F.col("places")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(words)])
    counts = hits.groupBy().agg(*[F.count_if(F.col("term") == t).alias(f"n{i}") for i, t in enumerate(words)])
    place = {t: F.col(f"p{i}") for i, t in enumerate(words)} | {t: F.array().cast("array<bigint>") for t in _texts(node) if len(t) < 3}
    d = one.where(condition(node, place, columns)).crossJoin(F.broadcast(counts))  # one row
    score = F.lit(0.0)
    for i, t in enumerate(words):
        if t in scored:
            idf = F.log((F.lit(known["n"]) - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
            tf = F.size(F.coalesce(f"p{i}", F.array().cast("array<bigint>")))
            score = score + F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    return top(d.select("key", (-score).alias("score")), [F.col("score"), F.col("key")], limit)


def register(spark: SparkSession, path: str, name: str = "text_search") -> None:
    """Makes the index searchable in SQL: SELECT * FROM text_search('hand tion', 20) gives (key, score, rank), rows that hold any of the query's words.

    A SQL table function over the index's tables, so a search is part of the statement's own plan and takes columns of a lateral
    join as well. Temporary, like the views it reads (named after it)."""
    known = stats(spark, path)
    p = _postings(spark, path, known)
    p.createOrReplaceTempView(f"{name}_postings")
    # where each live row begins and ends, in each cell of its block that it touches
    width = (F.size("places") - 1) / F.size("keys")
    r = p.where("gram = '' and size(keys) > 0").select("generation", "block", "places", "lens", width.cast("int").alias("width"), F.posexplode("keys").alias("i", "key"))
    r = r.select("generation", "block", "key", F.get("lens", F.col("i")).alias("len"), F.get("places", F.col("i") * F.col("width")).alias("begin"), F.get("places", (F.col("i") + 1) * F.col("width")).alias("end"))
    r = r.join(live(spark, path).select("key", "generation"), ["key", "generation"], "left_semi")
    cell = lambda c: F.floor(F.col(c) / CELL)
    r.withColumn("cell", F.explode(F.sequence(cell("begin"), cell("end")))).createOrReplaceTempView(f"{name}_rows")
    kind = p.schema["keys"].dataType.elementType.simpleString()
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING, most INT) RETURNS TABLE (key {kind}, score DOUBLE, rank INT) RETURN
WITH word AS (SELECT lower(w) AS term, count(*) AS times FROM (SELECT explode(array_distinct(filter(split({name}.query, ' '), x -> char_length(x) >= 3))) AS w) GROUP BY lower(w)),
gram AS (SELECT term, size(o) AS need, explode(o) AS off FROM (SELECT term, array_distinct(concat(sequence(0, char_length(term) - 3, 3), array(char_length(term) - 3))) AS o FROM word)),
hit AS (SELECT g.term, g.need, p.generation, p.block, explode(transform(p.places, x -> x - g.off)) AS at FROM {name}_postings p JOIN gram g ON p.gram = substring(g.term, g.off + 1, 3)),
stands AS (SELECT term, generation, block, at FROM hit GROUP BY term, need, generation, block, at HAVING count(*) = need),
kept AS (SELECT s.term, r.key, r.len, count(*) AS tf FROM stands s JOIN {name}_rows r ON s.generation = r.generation AND s.block = r.block AND floor(s.at / {CELL}) = r.cell AND s.at >= r.begin AND s.at < r.end GROUP BY s.term, r.key, r.len),
df AS (SELECT term, count(*) AS n FROM kept GROUP BY term),
idf AS (SELECT term, CASE WHEN ln(({known["n"]} - n + 0.5) / (n + 0.5)) > 0 THEN ln(({known["n"]} - n + 0.5) / (n + 0.5)) ELSE {IDF_FLOOR}D END AS w FROM df),
sc AS (SELECT key, -sum(times * w * tf * {K1 + 1}D / (tf + {K1}D * ({1 - B}D + {B}D * len / {float(known["total"] / max(known["n"], 1)) or 1.0}D))) AS score FROM kept JOIN idf USING (term) JOIN word USING (term) GROUP BY key)
SELECT key, score, rank FROM (SELECT key, score, CAST(row_number() OVER (ORDER BY round(score, 12), key) AS INT) AS rank FROM sc) WHERE rank <= {name}.most""")
