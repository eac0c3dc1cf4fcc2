"""Temporal knowledge graph: facts (id, subject, predicate, object, valid_from, valid_to, ...) with closed validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_key, predicate_key

#: Parts that a month's facts are dealt to.
SPREAD = 32


def valid_at(day: Column | str | None) -> Column:
    """Facts that hold on a day; both ends belong to the interval, null ends are open. None: all facts."""
    if day is None:
        return F.lit(True)
    day = F.lit(day) if isinstance(day, str) else day
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))


FACT = ["direction", "subject", "predicate", "object", "valid_from", "valid_to", "confidence", "source_ref", "current"]


def query_entity(facts: DataFrame, entities: DataFrame, name: str, as_of: str | None = None, direction: str = "outgoing") -> DataFrame:
    """Facts from an entity, to it, or both (a self-loop then counts twice); the other side by name, the asked name echoed."""
    key = entity_key(F.lit(name))
    e = entities.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    live = facts.where(valid_at(as_of)).withColumn("current", F.col("valid_to").isNull())
    out = live.where(F.col("subject") == key).join(e, F.col("object") == F.col("_id")).withColumn("subject", F.lit(name)).withColumn("object", F.col("_name")).withColumn("direction", F.lit("outgoing"))
    back = live.where(F.col("object") == key).join(e, F.col("subject") == F.col("_id")).withColumn("object", F.lit(name)).withColumn("subject", F.col("_name")).withColumn("direction", F.lit("incoming"))
    parts = {"outgoing": out, "incoming": back, "both": out.unionByName(back)}
    return parts.get(direction, out.where(F.lit(False))).select(*FACT)


def _named(facts: DataFrame, entities: DataFrame) -> DataFrame:
    s = entities.select(F.col("id").alias("_s"), F.col("name").alias("subject_name"))
    o = entities.select(F.col("id").alias("_o"), F.col("name").alias("object_name"))
    return facts.join(s, F.col("subject") == F.col("_s")).join(o, F.col("object") == F.col("_o")).withColumn("current", F.col("valid_to").isNull())


NAMED = ["id", "subject_name", "predicate", "object_name", "valid_from", "valid_to", "current"]


def query_relationship(facts: DataFrame, entities: DataFrame, predicate: str, as_of: str | None = None) -> DataFrame:
    return _named(facts.where((F.col("predicate") == predicate_key(F.lit(predicate))) & valid_at(as_of)), entities).select(*NAMED)


def query_all(facts: DataFrame, entities: DataFrame, as_of: str | None = None, limit: int = 500) -> DataFrame:
    """The limit is the feature: a page of facts in order of valid_from, nulls last, then id."""
    return _named(facts.where(valid_at(as_of)), entities).orderBy(F.col("valid_from").asc_nulls_last(), "id").limit(limit).select(*NAMED)


def timeline(facts: DataFrame, entities: DataFrame, entity: str | None = None, limit: int = 100) -> DataFrame:
    if entity is not None:
        key = entity_key(F.lit(entity))
        facts = facts.where((F.col("subject") == key) | (F.col("object") == key))
    return query_all(facts, entities, None, limit)


def stats(facts: DataFrame, entities: DataFrame) -> DataFrame:
    f = facts.agg(F.count("*").alias("triples"), F.count_if(F.col("valid_to").isNull()).alias("current_facts"), F.count_if(F.col("valid_to").isNotNull()).alias("expired_facts"), F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates"))
    return entities.agg(F.count("*").alias("entities")).crossJoin(f)  # one row each


def add_triples(facts: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """facts and those of new (subject, predicate, object, valid_from, ...) that no open fact equals. valid_from defaults to now."""
    n = new.withColumn("subject", entity_key(F.col("subject"))).withColumn("predicate", predicate_key(F.col("predicate"))).withColumn("object", entity_key(F.col("object")))
    n = n.withColumn("valid_from", F.coalesce("valid_from", F.lit(now))).dropDuplicates(["subject", "predicate", "object"])
    n = n.join(facts.where("valid_to is null").select("subject", "predicate", "object"), ["subject", "predicate", "object"], "left_anti")
    tag = F.substring(F.md5(F.encode(F.concat_ws("|", "subject", "predicate", "object", "valid_from"), "utf-8")), 1, 8)
    n = n.withColumn("id", F.concat_ws("_", F.lit("t"), "subject", "predicate", "object", tag))
    return facts.unionByName(n, allowMissingColumns=True)


def entities_of(facts: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Entities (id, name), those that facts mention but the table lacks created with their key as name."""
    ids = facts.select(F.col("subject").alias("id")).unionByName(facts.select(F.col("object").alias("id"))).where("id is not null").distinct()
    made = ids.withColumn("name", F.col("id"))
    return made if entities is None else entities.unionByName(made.join(entities, "id", "left_anti"), allowMissingColumns=True)


def add_entities(entities: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """entities (id, name, type, properties, created_at) after new (name, type, properties map): an entity with the same key is replaced, properties as
    JSON. Of new rows with one key the last by name stays."""
    one = Window.partitionBy("id").orderBy(F.col("name").desc())
    n = new.withColumn("id", entity_key(F.col("name"))).withColumn("_r", F.row_number().over(one)).where("_r = 1")
    n = n.select("id", "name", F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce(F.to_json("properties"), F.lit("{}")).alias("properties"), F.lit(now).alias("created_at"))
    return entities.join(n.select("id"), "id", "left_anti").unionByName(n, allowMissingColumns=True)


def invalidate(facts: DataFrame, subject: str, predicate: str, object_: str, ended: str) -> DataFrame:
    hit = (F.col("subject") == entity_key(F.lit(subject))) & (F.col("predicate") == predicate_key(F.lit(predicate))) & (F.col("object") == entity_key(F.lit(object_))) & F.col("valid_to").isNull()
    return facts.withColumn("valid_to", F.when(hit, F.lit(ended)).otherwise(F.col("valid_to")))


def upsert_latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with the same key; columns new lacks keep old's values."""
    n = new.select(*[F.col(c).alias(c if c == key else f"_n_{c}") for c in new.columns]).withColumn("_hit", F.lit(True))
    j = old.join(n, key, "full")
    return j.select(key, *[F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in new.columns else F.col(c) for c in old.columns if c != key])


def as_of_join(facts: DataFrame, days: DataFrame) -> DataFrame:
    """Facts that hold on each of many days (column day, any dates): an equi-join by month, the interval as residual, so no nested loop.

    A fact is dealt to those months of the days asked that its interval touches; the months come as one row (a calendar's worth), so open ends need
    no bound and days before, between and after all facts are met alike. A month's facts are dealt to SPREAD parts, each with the month's days, so that
    facts of a single month aren't one task. A fact meets each row of days once; null days meet none."""
    month = lambda c: F.date_format(F.to_date(c), "yyyy-MM")
    d = days.where("day is not null").withColumn("bucket", month(F.col("day")))
    asked = d.agg(F.array_sort(F.collect_set("bucket")).alias("_months"))
    within = lambda m: (F.col("valid_from").isNull() | (month(F.col("valid_from")) <= m)) & (F.col("valid_to").isNull() | (month(F.col("valid_to")) >= m))
    f = facts.crossJoin(F.broadcast(asked)).withColumn("bucket", F.explode(F.filter("_months", within))).drop("_months")  # one row
    f = f.withColumn("part", F.pmod(F.xxhash64(*[c for c, kind in facts.dtypes if "map<" not in kind]), F.lit(SPREAD)).cast("int"))
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return f.join(d, ["bucket", "part"]).where(valid_at(F.col("day"))).drop("bucket", "part")


def latest_before(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """As-of join: left rows with right's last `value` at or before their time, per key, in one sort of both."""
    u = left.withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType)).unionByName(right.select(key, at, value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").drop("_side")
