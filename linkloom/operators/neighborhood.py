"""Neighbours, triples and similarities of linked entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end; ``reverse`` marks the way back."""
    return edges.withColumn("reverse", F.lit(False)).unionByName(turned(edges).withColumn("reverse", F.lit(True)))


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def neighbors(edges: DataFrame, direction: str = "both", key: str | None = None, itself: bool = False) -> DataFrame:
    """(entity_id, neighbor), distinct; ``itself`` adds an entity that has any neighbour."""
    e = edges if key is None else edges.filter(F.col("key") == key)
    e = both_ways(e) if direction == "both" else e if direction == "out" else turned(e)
    out = e.select(F.col("src").alias("entity_id"), F.col("dst").alias("neighbor")).distinct()
    if itself:
        out = out.unionByName(out.select("entity_id", F.col("entity_id").alias("neighbor"))).distinct()
    return out


def edge_keys(inc: DataFrame) -> DataFrame:
    """(entity_id, key, merged values) of the values that an entity shares with others, without pairs."""
    shared = inc.groupBy("key", "value").agg(F.countDistinct("entity_id").alias("_n")).filter("_n > 1").select("key", "value")
    return inc.join(shared, ["key", "value"], "left_semi").groupBy("entity_id", "key").agg(F.array_sort(F.collect_set("value")).alias("merged"))


def triples(edges: DataFrame) -> DataFrame:
    """(src, dst, n_keys, n_values, keys): one row per linked pair, most keys first when ordered so."""
    return edges.groupBy("src", "dst").agg(F.countDistinct("key").alias("n_keys"), F.count(F.lit(1)).alias("n_values"), F.concat_ws(",", F.array_sort(F.collect_set("key"))).alias("key_list"))


def value_jaccard(inc: DataFrame, edges: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(src, dst, similarity) of linked pairs: shared values over all values; 1 for pairs of ``same``."""
    size = inc.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    shared = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("ov"))
    out = shared.join(size.select(F.col("entity_id").alias("src"), F.col("n").alias("a")), "src").join(size.select(F.col("entity_id").alias("dst"), F.col("n").alias("b")), "dst")
    value = F.round(F.col("ov") / (F.col("a") + F.col("b") - F.col("ov")), 6)
    if same is None:
        return out.select("src", "dst", value.alias("similarity"))
    return out.join(same.select("src", "dst", F.lit(True).alias("_same")), ["src", "dst"], "left").select("src", "dst", F.when(F.col("_same"), 1.0).otherwise(value).alias("similarity"))


def structural_similarity(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """(src, dst, similarity) of linked pairs: |N[u] & N[v]| / sqrt(|N[u]| |N[v]|) over closed neighbourhoods."""
    n = neighbors(edges, itself=True)
    size = n.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = edges.select("src", "dst").distinct()
    a = n.select(F.col("entity_id").alias("src"), "neighbor")
    b = n.select(F.col("entity_id").alias("dst"), "neighbor")
    common = pairs.join(a, "src").join(b, ["dst", "neighbor"]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))
    out = common.join(size.select(F.col("entity_id").alias("src"), F.col("n").alias("x")), "src").join(size.select(F.col("entity_id").alias("dst"), F.col("n").alias("y")), "dst")
    return out.select("src", "dst", F.round(F.col("c") / F.sqrt(F.col("x") * F.col("y")), 6).alias("similarity")).filter(F.col("similarity") >= least)


def triple_scores(inc: DataFrame, edges: DataFrame, priorities: DataFrame) -> DataFrame:
    """(src, dst, score): minus the sum over keys of Jaccard x priority x ln(share of the value's edges), logs summed over values."""
    counts = edges.groupBy("key", "value").agg(F.count(F.lit(1)).alias("c"))
    totals = edges.groupBy("key").agg(F.count(F.lit(1)).alias("t"))
    size = inc.groupBy("entity_id", "key").agg(F.count(F.lit(1)).alias("n"))
    per = edges.join(counts, ["key", "value"]).join(F.broadcast(totals), "key").groupBy("src", "dst", "key").agg(F.count(F.lit(1)).alias("ov"), F.sum(F.log(F.col("c") / F.col("t"))).alias("ln"))
    per = per.join(size.select(F.col("entity_id").alias("src"), "key", F.col("n").alias("a")), ["src", "key"]).join(size.select(F.col("entity_id").alias("dst"), "key", F.col("n").alias("b")), ["dst", "key"])
    per = per.join(F.broadcast(priorities.select("key", "priority")), "key")
    term = F.col("ov") / (F.col("a") + F.col("b") - F.col("ov")) * F.col("priority") * F.col("ln")
    return per.groupBy("src", "dst").agg(F.round(-F.sum(term), 6).alias("score"))
