"""Sharding by extendible hashing (DataFrame functions only).

A row's key hashes to 60 bits. A bucket is a prefix of those bits; only a bucket over the byte limit splits, on its next
bit, until every bucket fits. The directory maps prefixes to shards. Instead of splitting row by row, bytes are summed by
prefix, STEP bits at a time (map-side combined, so a round moves at most 2**STEP sums for each oversized bucket and map
task), each split decision is taken on those sums, and only rows of buckets still too large take part in the next round.

Rows that agree in key and text share all bits and can't be told apart by splitting; their bucket stays at full depth and is
marked oversized (as does one row above the limit). Null keys hash as the empty string, null texts have no bytes. An empty
table gives no shards. A hot key doesn't make a hot shard: the hash takes the text in as well. Extra columns pass through
`write_shards`, but one named shard is replaced; result columns that the key's own name clashes with get an underscore before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free

BITS, STEP = 60, 12
#: A shard's byte limit, and rows of a directory that is broadcast at most.
LIMIT, SMALL_DIRECTORY = 1 << 20, 100_000


def key_hash(*cols: str) -> Column:
    """60 bits, of the MD5 of the columns joined by a zero byte."""
    text = F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(F.encode(text, "utf-8")), 1, 15), 16, 10).cast("long")


def prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, F.lit(BITS) - depth)


def shards(rows: DataFrame, limit: int = LIMIT, scratch: Scratch | None = None) -> DataFrame:
    """rows (h, bytes) -> directory (prefix, depth, bytes, n, oversized): one row per shard, prefixes free of overlap."""
    own = scratch or Scratch(rows.sparkSession)
    total = rows.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).where("n > 0")
    root = own.store(total.select(F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("depth"), "bytes", "n"), "shards")
    found, open_ = root.where(F.col("bytes") <= limit), root.where(F.col("bytes") > limit)
    done, depth = [found], 0
    left = rows
    while depth < BITS and not open_.isEmpty():
        below = depth + STEP
        left = left.join(open_.select(F.col("prefix").alias("p")), prefix(F.col("h"), depth) == F.col("p"), "left_semi") if depth else left
        sums = own.store(left.groupBy(prefix(F.col("h"), below).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "shards")
        ups = sums.select("bytes", "n", "cell", F.explode(F.sequence(F.lit(1), F.lit(STEP))).alias("k"))
        tree = ups.groupBy(F.call_function("shiftright", "cell", F.lit(STEP) - F.col("k")).alias("prefix"), (F.col("k") + depth).alias("depth")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        tree = own.store(tree, "shards")
        own.drop(sums)
        # a bucket exists if its parent was too large; it is a shard if it fits itself
        over = tree.where(F.col("bytes") > limit).select(F.col("prefix").alias("pp"), (F.col("depth") + 1).alias("pd"))
        born = tree.where(F.col("depth") == depth + 1).unionByName(tree.join(over, (F.call_function("shiftright", "prefix", F.lit(1)) == F.col("pp")) & (F.col("depth") == F.col("pd")), "left_semi").where(F.col("depth") > depth + 1))
        done.append(born.where(F.col("bytes") <= limit))
        open_ = born.where((F.col("bytes") > limit) & (F.col("depth") == below)).select("prefix", "depth", "bytes", "n")
        depth = below
    done.append(open_)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d.select("prefix", "depth", "bytes", "n"))
    return out.withColumn("oversized", F.col("bytes") > limit)


def assign(rows: DataFrame, directory: DataFrame, own: Scratch) -> DataFrame:
    """rows (h, ...) with their shard: a struct (prefix, depth, oversized) in column _shard. Depths are few (at most BITS + 1, typically two or
    three) and a row's prefix is in the directory at one of them. A directory of SMALL_DIRECTORY rows at most is broadcast; with a larger
    one each row looks up a prefix for every depth, so rows should be light."""
    directory = own.store(directory, "directory")
    depths = [r[0] for r in directory.select("depth").distinct().orderBy("depth").collect()]  # at most 61 small numbers
    found = F.struct("prefix", "depth", "oversized")
    if directory.count() <= SMALL_DIRECTORY:
        for d in depths:
            at = directory.where(F.col("depth") == d).select(F.col("prefix").alias("_p"), found.alias(f"_at{d}"))
            rows = rows.join(F.broadcast(at), prefix(F.col("h"), d) == F.col("_p"), "left").drop("_p")
        kind = "struct<prefix:bigint,depth:int,oversized:boolean>"
        return rows.withColumn("_shard", F.coalesce(*[F.col(f"_at{d}") for d in depths], F.lit(None).cast(kind))).drop(*[f"_at{d}" for d in depths])
    tries = F.array(*[F.struct(F.lit(d).alias("depth"), prefix(F.col("h"), d).alias("prefix")) for d in depths])
    one = directory.select(F.struct("depth", "prefix").alias("_t"), found.alias("_shard"))
    return rows.withColumn("_t", F.explode(tries)).join(one, "_t").drop("_t")


def shard_name(shard: Column, root: str = "") -> Column:
    """The prefix in binary; root for a single shard."""
    return F.when(shard["depth"] == 0, F.lit(root)).otherwise(F.lpad(F.conv(shard["prefix"].cast("string"), 10, 2), shard["depth"], F.lit("0")))


def _bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def shard_documents(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(key, bytes, shard, depth, oversized) for each row; shard is the prefix in binary, '' for a single shard."""
    own = scratch or Scratch(docs.sparkSession)
    light = own.store(docs.select(F.struct(F.col(key).alias("k")).alias("_key"), _bytes(text).alias("_bytes"), key_hash(key, text).alias("h")), "shards")
    out = assign(light, shards(light.select("h", F.col("_bytes").alias("bytes")), limit, own), own)
    names = free(docs.select(key), "bytes", "shard", "depth", "oversized")
    return out.select(F.col("_key.k").alias(key), *[c.alias(n) for c, n in zip((F.col("_bytes"), shard_name(F.col("_shard")), F.col("_shard.depth"), F.col("_shard.oversized")), names, strict=True)])


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Writes docs partitioned by shard, one directory each. With a small directory rows find their shard where they are; with a large one by
    a join on the hash, for which no text is copied."""
    own = Scratch(docs.sparkSession)
    light = own.store(docs.select(key_hash(key, text).alias("h"), _bytes(text).alias("bytes")), "shards")
    of = assign(light.select("h").distinct(), shards(light, limit, own), own).select(F.col("h").alias("_h"), shard_name(F.col("_shard"), "all").alias("_name"))
    of = own.store(of, "shards")
    (row,) = free(docs, "_row")
    rest = [c for c in docs.columns if c.lower() != "shard"]
    named = docs.select(*rest, key_hash(key, text).alias(row)).join(of, F.col(row) == F.col("_h"))
    named.select(*rest, F.col("_name").alias("shard")).repartition("shard").write.partitionBy("shard").parquet(path)
    own.close()


ORACLE = f"""
WITH r AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), chr(0), coalesce(text, ''))) AS m FROM documents),
b AS (SELECT doc_id, bytes, array_to_string(list_transform(range(1, 16), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(m, i, 1))]), '') AS bits,
  row_number() OVER () AS n FROM r),
p AS (SELECT n, d, substr(bits, 1, d) AS shard, sum(bytes) OVER (PARTITION BY d, substr(bits, 1, d)) AS s FROM b, (SELECT unnest(range(0, {BITS + 1})) AS d) z),
f AS (SELECT n, min(d) AS d FROM p WHERE s <= {LIMIT} OR d = {BITS} GROUP BY n)
SELECT doc_id, bytes, shard, CAST(f.d AS INT) AS depth, s > {LIMIT} AS oversized FROM b JOIN f ON b.n = f.n JOIN p ON p.n = f.n AND p.d = f.d
"""
