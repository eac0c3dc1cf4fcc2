"""Helpers the training-data operators share: scratch tables, global successor, components, let-binding, free names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let  # noqa: F401  (operators import it from here)
from ..sources.shared import shared_dir, until_exit

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

class Scratch:
    """Tables that one computation writes to the shared folder. `drop` deletes those that a later table has replaced, `close`
    the rest, once the results that read them are written; what nobody closes goes when the application ends. Other
    computations' tables are never touched."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, tag: str) -> DataFrame:
        """Writes df and reads it back: cuts lineage and survives lost executors."""
        path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        until_exit(self.spark, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            del self.paths[path]

    def close(self) -> None:
        self.drop(*self.paths.values())


def stored(df: DataFrame, tag: str, scratch: Scratch | None = None) -> DataFrame:
    """df as a table of scratch; without one, a table that stays in the shared folder, since lazy results may read it."""
    return (scratch or Scratch(df.sparkSession)).store(df, tag)


def free(df: DataFrame, *names: str) -> list[str]:
    """names, with underscores put before until none is a column of df: for columns that come and go inside an operator."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def words_of(text: Column) -> Column:
    """Array of words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def successor(ids: DataFrame, col: str, to: str, step: int = 16) -> DataFrame:
    """ids (distinct longs in col) with the next larger one in `to`; null after the last.

    A window over everything would be one task, so the order is resolved by ranges of 2**step values, then by ranges of
    ranges: no window partition exceeds 2**step rows, whatever the ids are, and only heads of ranges move between levels."""

    def level(df: DataFrame, key: str, shift: int) -> DataFrame:
        # df: (k, v): k is the range number at this level, v its smallest id
        if shift >= 64:
            return df.select("k", F.lead("v").over(Window.orderBy("k")).alias("n"))
        up = F.shiftright(F.col("k"), step)
        near = df.select("k", up.alias("u"), F.lead("v").over(Window.partitionBy(up).orderBy("k")).alias("n"))
        heads = df.groupBy(up.alias("k")).agg(F.min("v").alias("v"))
        over = level(heads, "k", shift + step).select(F.col("k").alias("u"), F.col("n").alias("far"))
        return near.join(over, "u", "left").select("k", F.coalesce("n", "far").alias("n"))

    start = ids.select(F.col(col).alias("k"), F.col(col).alias("v"))
    return level(start, "k", step).select(F.col("k").alias(col), F.col("n").alias(to))


#: Edges up to which all centres of a round are broadcast (a few MB); of more, only centres with over 1 / HOT_SHARE of them are.
FEW_EDGES, HOT_SHARE = 1 << 17, 10_000


def components(edges: DataFrame, tag: str = "links", limit: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component_id), the smallest id reachable, for every id in an edge.

    Alternating large-star and small-star rounds; each round's edges go to a table in the shared folder, so lineage stays
    short, and replace the last round's. A star's centre is found by aggregation and joined back, so no neighbour list is
    gathered anywhere, and no centre's leaves meet in one task: centres with over 1 / HOT_SHARE of the edges, 2 * HOT_SHARE at
    most, are broadcast; so are all of them while there are FEW_EDGES edges at most, by count."""
    own = scratch or Scratch(edges.sparkSession)
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now, seen = own.store(edges.select("a", "b").where("a <> b").distinct(), tag), None
    total = now.count()

    def beside(rows: DataFrame, least: DataFrame) -> DataFrame:
        # least: (a, m, c), a row per a
        if total <= FEW_EDGES:
            return rows.join(F.broadcast(least.drop("c")), "a")
        hot = least.where(F.col("c") > max(2, total // HOT_SHARE))
        cold = rows.join(F.broadcast(hot.select("a")), "a", "left_anti").join(least.drop("c"), "a")
        return cold.unionByName(rows.join(F.broadcast(hot.drop("c")), "a"))

    for _ in range(limit):
        two = both(now)
        low = two.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("c"))
        large = beside(two, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        small = beside(down, least).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        last, now = now, own.store(small, tag)
        own.drop(last)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        total = mark["n"]
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not converge")
    low = now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return low.unionByName(low.select(F.col("component_id").alias("id"), "component_id").distinct())
