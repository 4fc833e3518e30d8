"""Paths and trees: frontiers that advance one join per step."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.storage import written


def rounds(most: int | None) -> Iterable[int]:
    """As many as the caller allows; without a bound a loop ends with its frontier."""
    return count() if most is None else range(most)


def bfs_path(edges: DataFrame, start, goal, keys: list[str] | None = None, most: int | None = None) -> DataFrame:
    """The first shortest path (array ``path``) from start to goal over edges of the keys, or no row.

    The frontier keeps one path per node, the least in order, so it never outgrows the nodes.
    """
    e = edges if keys is None else edges.filter(F.col("key").isin(keys))
    e = written(e.select("src", "dst").union(e.select("dst", "src")).distinct(), "edges")
    kind = e.schema["src"].dataType.simpleString()
    spark = edges.sparkSession
    front = spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.array(F.lit(start).cast(kind)).alias("path"))
    seen = front
    for _ in rounds(most):
        hit = seen.filter(F.col("node") == F.lit(goal))
        if not hit.isEmpty():
            return hit.select("path")
        step = front.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = written(step.join(seen.select("node"), "node", "left_anti").select("node", "path"), "front")
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front), "seen")
    return seen.filter(F.col("node") == F.lit(goal)).select("path")


def ancestor_paths(parents: DataFrame, most: int | None = None) -> DataFrame:
    """(start, path): maximal simple paths along (child, parent) from every child; a node met before ends a path."""
    here = written(parents.select("child", "parent").distinct(), "parents")
    open_ = here.select(F.col("child").alias("start"), F.array("child", "parent").alias("path"))
    done = None
    for _ in rounds(most):
        last = F.element_at("path", -1)
        grown = open_.join(here, last == F.col("child"), "left").withColumn("ok", F.col("parent").isNotNull() & ~F.array_contains("path", F.col("parent")))
        grown = written(grown, "paths")
        ended = grown.groupBy("start", "path").agg(F.max("ok").alias("ok")).filter(~F.col("ok")).select("start", "path")
        done = ended if done is None else done.unionByName(ended)
        open_ = grown.filter("ok").select("start", F.concat("path", F.array("parent")).alias("path"))
        if open_.isEmpty():
            return done
    return done.unionByName(open_)


def depths(parents: DataFrame, root: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth) below the roots; the least depth where paths differ."""
    here = written(parents.select("child", "parent").distinct(), "parents")
    out = root.select(F.col("node"), F.lit(0).alias("depth"))
    front = out
    for d in count(1) if most is None else range(1, most):
        step = front.join(here, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct().join(out.select("node"), "node", "left_anti")
        front = written(step.withColumn("depth", F.lit(d)), "front")
        if front.isEmpty():
            break
        out = written(out.unionByName(front), "depths")
    return out


def leaves(parents: DataFrame, root: DataFrame) -> DataFrame:
    """Descendants of the roots that are nobody's parent."""
    below = depths(parents, root).filter("depth > 0")
    return below.join(parents.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select("node")


def within_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(start, node, hops): nodes at 1..hops steps, with the least number of steps."""
    e = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    out = front = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"))
    for d in range(1, hops + 1):
        front = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct().join(out.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(d))
        out = out.unionByName(front)
    return out.filter("hops > 0")


def expand(inc: DataFrame, entity, key: str | None = None) -> DataFrame:
    """Entities that share a value (of ``key``) with the entity, itself included."""
    mine = inc.filter(F.col("entity_id") == F.lit(entity))
    mine = mine if key is None else mine.filter(F.col("key") == key)
    return inc.join(mine.select("key", "value"), ["key", "value"]).select("entity_id").distinct()
