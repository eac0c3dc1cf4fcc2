"""Mixing sources to target weights by weighted fair queueing.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share `share` times all words; no target exceeds
REPEATS times its source's words, and what is cut off is shared anew by weight until no target is above (water filling).

Each source is a queue of its documents in a fixed shuffle (MD5 of seed and doc_id), run through REPEATS times. A document
enters in packets of up to QUANTUM words. A packet's virtual finish time is the source's words up to and including it,
divided by the source's target; a document's is that of its last packet. All packets are sorted by finish time (at ties by
source, null last) in ranges over the cluster; running sums within the ranges, added to the sums of the ranges before, cut the
sequence at the total budget, floor(sum of targets). The packet that crosses the budget is taken in part. So a source
misses its target by a packet or so, whatever the length of its documents. `mixed` gives the sequence of whole documents.

No queue is ever in one task: running sums are taken over SLICES hash ranges of each source, then within a range. Null texts
have size 0 and are never taken; null sources form one source, last. Documents that share an id and size are alike, and which
of them is taken doesn't show. An empty table gives an empty result. Extra columns pass through `mixed`; one named
virtual_finish is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, free

#: Fixed values of the target rule.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Hexadecimal digits of the hash that name a slice of a source: 16**3 slices.
DIGITS, SEED = 3, 7
#: Words of a packet.
QUANTUM = 64


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, size) -> (source, source_size, target). One row per source takes part; those are ordered in one window."""
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1))
    s = s.withColumn("cap", (F.col("source_size") * REPEATS).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    every = Window.partitionBy()
    order = Window.orderBy("ratio", "rank")
    s = s.withColumn("budget", F.sum("source_size").over(every) * SHARE)
    s = s.withColumn("below", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("budget") - F.col("below")) / F.col("rest"))
    s = s.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank"))).over(every))
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce("level", F.lit(0.0)) * F.col("w")).alias("target"))


def shuffle_key(doc_id: Column, seed: int = SEED) -> Column:
    return F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "utf-8"))


def queued(light: DataFrame, goal: DataFrame, seed: int = SEED) -> DataFrame:
    """light (doc_id, source, size) with source_size, target and `start`, the source's words before the document in its first run."""
    d = light.withColumn("u", shuffle_key(F.col("doc_id"), seed)).withColumn("slice", F.substring("u", 1, DIGITS))
    cells = d.groupBy("source", "slice").agg(F.sum("size").alias("s"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("s").over(ahead), F.lit(0)))
    cells = cells.join(goal, cells["source"].eqNullSafe(goal["source"])).select(cells["source"].alias("cs"), F.col("slice").alias("ck"), "ahead", "source_size", "target")
    within = Window.partitionBy("source", "slice").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(cells, d["source"].eqNullSafe(F.col("cs")) & (d["slice"] == F.col("ck")))
    return d.withColumn("start", F.col("ahead") + F.col("before")).drop("cs", "ck", "ahead", "before", "slice")


def light_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def served(queue: DataFrame, goal: DataFrame, own: Scratch) -> DataFrame:
    """(source, start, taken) of the documents of queue that are served: all packets range-sorted by finish time and cut at the
    budget. source and start name a document with words, since runs of one source don't overlap."""
    d = queue.where("size > 0").select("source", "start", "size", "source_size", "target")
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("run"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(QUANTUM).cast("long"))).alias("at"))
    words = F.least(F.lit(QUANTUM).cast("long"), F.col("size") - F.col("at"))
    finish = (F.col("run") * F.col("source_size") + F.col("start") + F.col("at") + words) / F.col("target")
    packets = d.where("target > 0").select("source", "start", words.alias("words"), finish.alias("finish"))
    # a table, so that ranges are the same for all that reads them
    packets = own.store(packets.repartitionByRange("finish", F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "packets")
    within = Window.partitionBy("part").orderBy("finish", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    parts = packets.groupBy("part").agg(F.sum("words").alias("s"))  # a row per range
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("ahead"))
    budget = goal.agg(F.floor(F.sum("target")).alias("budget"))
    p = packets.withColumn("before", F.coalesce(F.sum("words").over(within), F.lit(0))).join(F.broadcast(parts), "part").crossJoin(F.broadcast(budget))
    got = F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - F.col("ahead") - F.col("before")))
    return p.select("source", "start", got.alias("got")).where("got > 0").groupBy("source", "start").agg(F.sum("got").cast("long").alias("taken"))


def mix_sizes(docs: DataFrame, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, start, u, virtual_finish, taken) for every document; virtual_finish is that
    of its first run."""
    own = scratch or Scratch(docs.sparkSession)
    light = own.store(light_of(docs), "mix")
    goal = targets(light)
    q = own.store(queued(light, goal, seed).withColumn("virtual_finish", F.try_divide(F.col("start") + F.col("size"), F.col("target"))), "queues")
    s = served(q, goal, own).select(F.col("source").alias("_s"), F.col("start").alias("_b"), "taken")
    out = q.join(s, q["source"].eqNullSafe(F.col("_s")) & (q["start"] == F.col("_b")) & (q["size"] > 0), "left").drop("_s", "_b")
    return out.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed(docs: DataFrame, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """docs in the order of service, as often as each is taken (a part counts if it is half or more), with virtual_finish.

    Range-sorted by virtual finish time: partition after partition is the sequence."""
    out = [c for c in docs.columns if c.lower() != "virtual_finish"]
    plan = mix_sizes(docs, seed, scratch)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.greatest("size", F.lit(1))))).cast("int")
    # rows alike in id, source and size share their copies evenly
    plan = plan.groupBy("doc_id", "source", "size").agg(F.round(F.sum(copies) / F.count("*")).cast("int").alias("copies"), *[F.min(c).alias(c) for c in ("start", "source_size", "target", "u")])
    size, run, finish, row = free(docs, "_size", "_run", "_finish", "_plan")
    p = plan.where("copies > 0").select(F.struct(*plan.columns).alias(row))
    d = docs.withColumn(size, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))
    d = d.join(p, d["doc_id"].eqNullSafe(F.col(f"{row}.doc_id")) & d["source"].eqNullSafe(F.col(f"{row}.source")) & (d[size] == F.col(f"{row}.size")))
    d = d.withColumn(run, F.explode(F.sequence(F.lit(0), F.col(f"{row}.copies") - 1)))
    d = d.withColumn(finish, (F.col(f"{row}.start") + F.col(size) + F.col(run) * F.col(f"{row}.source_size")) / F.col(f"{row}.target"))
    d = d.repartitionByRange(finish, f"{row}.u").sortWithinPartitions(finish, f"{row}.u")
    return d.select(*[f"`{c}`" for c in out], F.col(finish).alias("virtual_finish"))


ORACLE = r"""
WITH light AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM light GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM s0),
s2 AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, (2 * source_size)::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, cap / w AS ratio, (SELECT sum(source_size) * 1.5::DOUBLE FROM s0) AS budget FROM s2),
s4 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER (ORDER BY ratio, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s3),
lv AS (SELECT lvl FROM s4 WHERE lvl <= ratio ORDER BY ratio, rnk LIMIT 1),
goal AS (SELECT source, source_size, least(cap, coalesce((SELECT lvl FROM lv), 0) * w) AS target FROM s4),
q AS (SELECT l.*, g.source_size, g.target, coalesce(sum(l.size) OVER (PARTITION BY l.source ORDER BY md5('7:' || l.doc_id), l.doc_id, l.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
   FROM light l JOIN goal g ON l.source IS NOT DISTINCT FROM g.source),
pk AS (SELECT source, st, least(64, size - pos) AS words, (run * source_size + st + pos + least(64, size - pos)) / target AS finish
   FROM (SELECT source, st, size, source_size, target, unnest([0, 1]) AS run FROM q WHERE size > 0) r, LATERAL (SELECT unnest(range(0, size, 64)) AS pos) z),
sv AS (SELECT source, st, greatest(0, least(words, (SELECT floor(sum(target)) FROM goal)
   - coalesce(sum(words) OVER (ORDER BY finish, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS got FROM pk),
tk AS (SELECT source, st, sum(got) AS taken FROM sv GROUP BY source, st)
SELECT doc_id, size, q.source_size, target, (q.st + size) / target AS virtual_finish, CAST(CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END AS BIGINT) AS taken
FROM q LEFT JOIN tk ON q.source IS NOT DISTINCT FROM tk.source AND q.st = tk.st
"""
