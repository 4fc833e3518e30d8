"""Linking entities by equal values: edges, references, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_value_edges(inc: DataFrame) -> DataFrame:
    """(src, dst, key, value), src > dst, for entities that share a value.

    Pairs of a value grow with the square of its entities: for operators that need pairs.  Counts use
    ``edge_counts``, which never makes them.  Values of one entity are dropped before the join.
    """
    shared = inc.groupBy("key", "value").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key", "value")
    rows = inc.join(shared, ["key", "value"])
    other = rows.select("key", "value", F.col("entity_id").alias("dst"))
    return rows.withColumnRenamed("entity_id", "src").join(other, ["key", "value"]).filter("src > dst").select("src", "dst", "key", "value")


def edge_counts(inc: DataFrame) -> DataFrame:
    """(key, value, entities, edges) of every value, edges = n (n - 1) / 2."""
    n = F.count(F.lit(1))
    return inc.groupBy("key", "value").agg(n.alias("entities"), F.expr("count(1) * (count(1) - 1) div 2").cast("long").alias("edges"))


def add_edges(edges: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual edges joined to the others: an edge with the same ends, key and value keeps one row and gets the new attributes."""
    a = edges.select("src", "dst", "key", "value", F.lit(None).cast("string").alias("attrs"))
    both = a.unionByName(manual.select("src", "dst", "key", "value", "attrs"))
    return both.groupBy("src", "dst", "key", "value").agg(F.max("attrs").alias("attrs"))


def manual_values(inc: DataFrame, manual: DataFrame) -> DataFrame:
    """Incidence rows with those that manual edges (src, dst, key, value) give to both of their ends."""
    ends = manual.select(F.explode(F.array("src", "dst")).alias("entity_id"), "key", "value")
    return inc.select("entity_id", "key", "value").unionByName(ends.filter("value is not null")).distinct()


def attach(payloads: DataFrame, inc: DataFrame, key: str, on: str) -> DataFrame:
    """Payload rows attached to every entity that has ``key`` = the row's ``on``; rows without one are dropped."""
    holders = inc.filter(F.col("key") == key).select("entity_id", F.col("value").alias("_value"))
    return payloads.join(holders, F.col(on) == F.col("_value")).drop("_value")


def register_if_absent(known: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """``known`` and those rows of ``new`` (once each) whose ``columns`` it lacks."""
    fresh = new.join(known.select(*columns).distinct(), columns, "left_anti").dropDuplicates(columns)
    return known.unionByName(fresh.select(*known.columns))


def find_all(inc: DataFrame, key: str, values: list) -> DataFrame:
    """Entities that have every one of the values."""
    hit = inc.filter((F.col("key") == key) & F.col("value").isin(values))
    return hit.groupBy("entity_id").agg(F.countDistinct("value").alias("_n")).filter(F.col("_n") == len(set(values))).select("entity_id")


def find_any(inc: DataFrame, key: str, values: list) -> DataFrame:
    """Entities of the one value that has most of them; of equals the first listed."""
    rank = F.array_position(F.array(*map(F.lit, values)), F.col("value"))
    hit = inc.filter((F.col("key") == key) & F.col("value").isin(values))
    best = hit.groupBy("value").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("value", F.struct("n", -rank)).alias("value"))
    return hit.join(F.broadcast(best), "value").select("entity_id")


def cross_source(inc: DataFrame, source: Column) -> DataFrame:
    """(s1, s2, n1, n2): distinct entities of each pair of sources that share a value."""
    per = inc.withColumn("s", source).select("key", "value", "entity_id", "s")
    values = per.select("key", "value", "s").distinct()
    # an entity meets a source at a value; entities are never paired with each other
    meets = per.withColumnRenamed("s", "s1").join(values.withColumnRenamed("s", "s2"), ["key", "value"]).filter("s1 <> s2").groupBy("s1", "s2").agg(F.countDistinct("entity_id").alias("n1"))
    back = meets.select(F.col("s2").alias("s1"), F.col("s1").alias("s2"), F.col("n1").alias("n2"))
    return meets.join(back, ["s1", "s2"])


def latest(payloads: DataFrame, entity: str, *order: Column) -> DataFrame:
    """The first row of each entity in the given order."""
    w = Window.partitionBy(entity).orderBy(*order)
    return payloads.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
