"""Edits of incidence and payload rows, comparisons of clusterings, consistency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delete_value(inc: DataFrame, key: str, value) -> DataFrame:
    """Incidence without a value; components are then found anew, so a lost link can split one."""
    return inc.filter(~((F.col("key") == key) & (F.col("value") == F.lit(value))))


def delete_entities(inc: DataFrame, gone: DataFrame) -> DataFrame:
    return inc.join(gone.select("entity_id"), "entity_id", "left_anti")


def update_values(inc: DataFrame, key: str, old: Column, new: Column) -> DataFrame:
    """Values of a key equal to ``old`` become ``new``; the result is a set again."""
    hit = (F.col("key") == key) & (F.col("value") == old)
    return inc.withColumn("value", F.when(hit, new).otherwise(F.col("value"))).distinct()


def curate(rows: DataFrame, edits: DataFrame, entity: str, column: str) -> DataFrame:
    """Applies (entity, action, value) edits to an array column: replace, remove or add; logs what was done."""
    by = edits.groupBy(entity).agg(
        F.collect_list(F.when(F.col("action") == "add", F.col("value"))).alias("_add"),
        F.collect_list(F.when(F.col("action") == "remove", F.col("value"))).alias("_del"),
        F.max(F.when(F.col("action") == "replace", F.col("value"))).alias("_set"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "action", "value"))), ";").alias("curation"),
    )
    empty = F.expr("cast(array() as array<string>)")
    joined = rows.join(by, entity, "left")
    base = F.when(F.col("_set").isNotNull(), F.array("_set")).otherwise(F.col(column))
    done = F.array_union(F.array_except(base, F.coalesce("_del", empty)), F.coalesce("_add", empty))
    return joined.withColumn(column, done).drop("_add", "_del", "_set")


def deprecate(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """Moves a value of an array column to <column>_deprecated."""
    has = F.array_contains(column, value)
    return rows.withColumn(f"{column}_deprecated", F.when(has, F.array(value)).otherwise(F.expr("cast(array() as array<string>)"))).withColumn(column, F.array_except(column, F.array(value)))


def clustering_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_cluster, new_cluster, moved): members by their clusters before and after."""
    return old.select("member", F.col("cluster").alias("old_cluster")).join(new.select("member", F.col("cluster").alias("new_cluster")), "member", "full").groupBy("old_cluster", "new_cluster").agg(F.count(F.lit(1)).alias("moved"))


def clashes(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n): groups with more than one distinct value."""
    return rows.groupBy(group).agg(F.countDistinct(value).alias("n")).filter("n > 1")
