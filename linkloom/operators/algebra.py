"""Sub-components, restricted cliques, metrics of a part of the graph, and walks inside a component."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.cliques import value_cliques
from linkloom.operators.components import component_sizes, incidence_components
from linkloom.operators.linking import edge_counts
from linkloom.operators.neighborhood import both_ways


def with_value(inc: DataFrame, nodes: DataFrame, key: str, value) -> DataFrame:
    """(entity_id): the nodes of a component that have key = value."""
    hit = inc.filter((F.col("key") == key) & (F.col("value") == F.lit(value))).select("entity_id").distinct()
    return nodes.select("entity_id").join(hit, "entity_id", "left_semi")


def extended(nodes: DataFrame, candidates: DataFrame, edges: DataFrame, keys: list[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """(entity_id): the nodes and those candidates that an edge of the keys, for which the predicate on
    (neighbor, key, value) holds, leads into them."""
    e = both_ways(edges) if keys is None else both_ways(edges).filter(F.col("key").isin(keys))
    e = e.select(F.col("src").alias("entity_id"), F.col("dst").alias("neighbor"), "key", "value")
    e = e if predicate is None else e.filter(predicate)
    near = e.join(nodes.select(F.col("entity_id").alias("neighbor")), "neighbor", "left_semi").join(candidates.select("entity_id"), "entity_id", "left_semi")
    return nodes.select("entity_id").union(near.select("entity_id")).distinct()


def overlaps(a: DataFrame, b: DataFrame) -> bool:
    """Do two node sets (entity_id) share a node?"""
    return not a.join(b.select("entity_id"), "entity_id", "left_semi").isEmpty()


def connected(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """(a, b, connected) for pairs (a, b): same component; unknown entities are connected with nothing."""
    side = lambda c: comp.select(F.col("entity_id").alias(c), F.col("comp").alias(f"_{c}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("connected"))


def cliques_among(inc: DataFrame, nodes: DataFrame | None = None, key: str | None = None, value=None, inclusion: int = 0, least: int = 2) -> DataFrame:
    """Value cliques after entities, key or value are restricted; ``inclusion``: at least so many members
    must be among ``nodes`` (then other members stay in), 0: all members must."""
    rows = inc if key is None else inc.filter(F.col("key") == key)
    rows = rows if value is None else rows.filter(F.col("value") == F.lit(value))
    if nodes is None:
        return value_cliques(rows, least)
    if not inclusion:
        return value_cliques(rows.join(nodes.select("entity_id"), "entity_id", "left_semi"), least)
    found = value_cliques(rows, least)
    inside = found.select("members", F.explode("members").alias("entity_id")).join(nodes.select("entity_id"), "entity_id", "left_semi").groupBy("members").count().filter(F.col("count") >= inclusion)
    return found.join(inside.select("members"), "members", "left_semi")


def part_metrics(inc: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: entities, edges, components and singletons of the graph on some of its entities."""
    part = inc.join(nodes.select("entity_id").distinct(), "entity_id", "left_semi")
    sizes = component_sizes(incidence_components(part))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("entities"), F.count(F.lit(1)).alias("components"), F.count_if(F.col("size") == 1).alias("singletons"))
    edges = edge_counts(part).agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))
    return total.join(edges)  # one row each


def count_labelled(entities: DataFrame, labels: list[str]) -> DataFrame:
    """(n): entities (labels: array) that have all labels."""
    return entities.filter(F.size(F.array_except(F.array(*map(F.lit, labels)), "labels")) == 0).agg(F.count(F.lit(1)).alias("n"))


def small_groups(rows: DataFrame, by: str, collected: str, below: int) -> DataFrame:
    """(by, items): groups whose distinct values are fewer than ``below``; the others are never gathered."""
    few = rows.groupBy(by).agg(F.countDistinct(collected).alias("_n")).filter(F.col("_n") < below).select(by)
    return rows.join(few, by, "left_semi").groupBy(by).agg(F.array_sort(F.collect_set(collected)).alias("items"))


def mapped_entities(entities: DataFrame, func: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, labels: list[str] | None = None) -> DataFrame:
    """``func`` over batches of the entities that have all labels."""
    kept = entities if labels is None else entities.filter(F.size(F.array_except(F.array(*map(F.lit, labels)), "labels")) == 0)
    return kept.mapInPandas(func, schema)


def depth_first(edges: DataFrame, comp: DataFrame, starts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(start, path): from each start (entity_id) the depth-first walk's paths that end where all neighbours
    were visited before; neighbours are taken in order.  A component with a start is one task; others are not read."""
    e = edges if keys is None else edges.filter(F.col("key").isin(keys))
    kind = comp.schema["entity_id"].dataType.simpleString()
    asked = starts.join(comp, "entity_id").select("comp", F.col("entity_id").alias("start"))
    inside = e.join(comp.select(F.col("entity_id").alias("src"), F.col("comp").alias("within")), "src").join(asked.select(F.col("comp").alias("within")).distinct(), "within", "left_semi").select("within", "src", "dst").distinct()

    def walk(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(rows.src.tolist(), rows.dst.tolist()):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        out = []
        for start in asked.start.tolist():
            seen, path = {start}, [start]
            stack = [iter(sorted(near.get(start, ())))]
            grew = [False]
            while stack:
                step = next((x for x in stack[-1] if x not in seen), None)
                if step is None:
                    if not grew[-1] and len(path) > 1:
                        out.append((start, list(path)))
                    stack.pop(), path.pop(), grew.pop()
                    continue
                grew[-1] = True
                seen.add(step)
                path.append(step)
                stack.append(iter(sorted(near[step])))
                grew.append(False)
        return pd.DataFrame(out, columns=["start", "path"])

    return asked.groupBy("comp").cogroup(inside.groupBy("within")).applyInPandas(lambda a, r: walk(a, r), f"start {kind}, path array<{kind}>")
