"""Cliques: complete groups under one or more keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.model import KEYS
from linkloom.storage import written


def value_cliques(inc: DataFrame, least: int = 2) -> DataFrame:
    """(members, keys, n_values, size): a value's holders are a clique; equal member sets merge their keys.

    Found by two aggregates, without pairs.
    """
    held = inc.groupBy("key", "value").agg(F.array_sort(F.collect_set("entity_id")).alias("members")).filter(F.size("members") >= least)
    return held.groupBy("members").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.count(F.lit(1)).alias("n_values")).withColumn("size", F.size("members"))


def clique_id(members: str = "members"):
    return F.md5(F.concat_ws(",", F.col(members)))


def maximal(cliques: DataFrame) -> DataFrame:
    """Cliques that no other clique holds: a holder shares the rarest member, so only such pairs meet."""
    c = cliques.withColumn("_id", clique_id())
    each = c.select("_id", "size", F.explode("members").alias("m"))
    degree = each.groupBy("m").count()
    rare = each.join(degree, "m").groupBy("_id").agg(F.min_by("m", F.struct("count", "m")).alias("m"))
    small = c.select("_id", "members", "size").join(rare, "_id")
    large = each.select("m", F.col("_id").alias("_big"), F.col("size").alias("_size"))
    held = small.join(large, "m").filter("_size > size").join(c.select(F.col("_id").alias("_big"), F.col("members").alias("_all")), "_big")
    inside = held.filter(F.size(F.array_except("members", "_all")) == 0).select("_id").distinct()
    return c.join(inside, "_id", "left_anti").drop("_id")


def potential(cliques: DataFrame) -> DataFrame:
    """Highest priority x size^0.3 x keys^0.7."""
    priority = F.create_map(*[x for k, v in KEYS.items() for x in (F.lit(k), F.lit(v[0]))])
    top = F.array_max(F.transform("keys", lambda k: priority[k]))
    return cliques.withColumn("potential", F.round(top * F.pow("size", F.lit(0.3)) * F.pow(F.size("keys"), F.lit(0.7)), 6))


def key_rank(keys: str = "keys"):
    """One bit per key."""
    bit = F.create_map(*[x for i, k in enumerate(KEYS) for x in (F.lit(k), F.lit(1 << i))])
    return F.aggregate(F.col(keys), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(bit[k].cast("long")))


def high_confidence(cliques: DataFrame) -> DataFrame:
    """Cliques whose members are in no other clique."""
    c = cliques.withColumn("_id", clique_id())
    shared = c.select("_id", F.explode("members").alias("m")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("m"))).filter("_n > 1").select("_id").distinct()
    return c.join(shared, "_id", "left_anti").drop("_id")


def greedy_disjoint(cliques: DataFrame) -> DataFrame:
    """Cliques taken one by one, largest first (members times edges, then the least members), each without a
    member of one taken before.

    In a round every clique that is the best among those it shares a member with is taken, and what touches it
    goes, which gives the same cliques as taking them one by one.
    """
    score = (F.col("size") * F.col("size") * (F.col("size") - 1) / 2).cast("long")
    left = written(cliques.withColumns({"_id": clique_id(), "_score": score}), "cliques")
    out = left.filter("false")
    while not left.isEmpty():
        each = left.select("_id", "_score", F.col("members").alias("_all"), F.explode("members").alias("m"))
        order = F.struct((-F.col("_score")).alias("s"), "_all", "_id")
        best = each.groupBy("m").agg(F.min(order).alias("o")).select("m", F.col("o._id").alias("_best"))
        each = written(each.join(best, "m").select("_id", "m", "_best"), "best")
        taken = written(each.groupBy("_id").agg(F.min(F.col("_best") == F.col("_id")).alias("ok")).filter("ok").select("_id"), "taken")
        out = written(out.unionByName(left.join(taken, "_id", "left_semi").select(*left.columns)), "chosen")
        used = each.join(taken, "_id", "left_semi").select("m").distinct()
        gone = each.join(used, "m", "left_semi").select("_id").distinct()
        left = written(left.join(gone, "_id", "left_anti").select(*left.columns), "cliques")
    return out.drop("_id", "_score")


def clique_values(inc: DataFrame, least: int = 2) -> DataFrame:
    """(members, key, merged): of each clique and key the values that all members share."""
    held = inc.groupBy("key", "value").agg(F.array_sort(F.collect_set("entity_id")).alias("members")).filter(F.size("members") >= least)
    return held.groupBy("members", "key").agg(F.array_sort(F.collect_set("value")).alias("merged"))


def propagate_keys(cliques: DataFrame) -> DataFrame:
    """Each clique also gets the keys of the cliques that hold it or that it holds."""
    c = cliques.withColumn("_id", clique_id())
    each = c.select("_id", "size", F.explode("members").alias("m"))
    pair = each.alias("a").join(each.alias("b"), "m").filter("a._id <> b._id and a.size <= b.size").groupBy(F.col("a._id").alias("x"), F.col("b._id").alias("y"), F.col("a.size").alias("s")).agg(F.count(F.lit(1)).alias("n")).filter("n = s")
    both = pair.select("x", "y").union(pair.select("y", "x"))
    got = both.join(c.select(F.col("_id").alias("y"), "keys"), "y").groupBy("x").agg(F.flatten(F.collect_list("keys")).alias("more"))
    return c.join(got, F.col("_id") == F.col("x"), "left").withColumn("keys", F.array_sort(F.array_union("keys", F.coalesce("more", "keys")))).drop("x", "more", "_id")


def bron_kerbosch(adjacency: dict, least: int = 2) -> Iterator[list]:
    """Maximal cliques of a small graph, with pivots and an explicit stack."""
    stack = [(set(), set(adjacency), set())]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            if len(r) >= least:
                yield sorted(r)
            continue
        pivot = max(p | x, key=lambda v: len(adjacency[v] & p))
        for v in sorted(p - adjacency[pivot]):
            stack.append((r | {v}, p & adjacency[v], x & adjacency[v]))
            p = p - {v}
            x = x | {v}


def clique_rows(group: pa.Table, found: list[list]) -> pa.Table:
    """The rows (comp, key, members) of the cliques found in a group (comp, key, ...); there may be none."""
    kind, n = group.schema.field("comp").type, len(found)
    return pa.table({"comp": pa.array([group["comp"][0].as_py()] * n, kind), "key": pa.array([group["key"][0].as_py()] * n, pa.string()), "members": pa.array(found, pa.list_(kind))})


def component_cliques(edges: DataFrame, comp: DataFrame, least: int = 2) -> DataFrame:
    """(comp, key, members): maximal cliques of each component's graph of one key, one component and key a task."""
    e = edges.join(comp.select(F.col("entity_id").alias("src"), "comp"), "src").select("comp", "key", "src", "dst").distinct()

    def solve(rows: pa.Table) -> pa.Table:
        adjacency: dict = {}
        for a, b in zip(rows["src"].to_pylist(), rows["dst"].to_pylist()):
            adjacency.setdefault(a, set()).add(b)
            adjacency.setdefault(b, set()).add(a)
        return clique_rows(rows, list(bron_kerbosch(adjacency, least)))

    kind = comp.schema["comp"].dataType.simpleString()
    return e.groupBy("comp", "key").applyInArrow(solve, f"comp {kind}, key string, members array<{kind}>")


def key_cliques(inc: DataFrame, comp: DataFrame, least: int = 2) -> DataFrame:
    """(comp, key, members) as ``component_cliques`` gives over all pairs that share a value of a key, without the pairs.

    The holders of a value are the clique where none of them shares another value of the key.  Of the rest, entities
    with the same values have the same neighbours and are in the same cliques, so a task walks one node for each such
    set of values, one connected graph at a time.
    """
    shared = inc.groupBy("key", "value").agg(F.countDistinct("entity_id").alias("_n")).filter("_n > 1").select("key", "value")
    rows = inc.select("entity_id", "key", "value").distinct().join(shared, ["key", "value"])
    rows = rows.join(rows.groupBy("entity_id", "key").agg((F.count(F.lit(1)) > 1).alias("_many")), ["entity_id", "key"])
    mixed = rows.groupBy("key", "value").agg(F.max("_many").alias("_mixed"))
    rows = written(rows.join(mixed, ["key", "value"]).select("entity_id", "key", "value", "_mixed"), "holders")
    plain = rows.filter("not _mixed").groupBy("key", "value").agg(F.array_sort(F.collect_list("entity_id")).alias("members")).filter(F.size("members") >= least)
    plain = plain.withColumn("entity_id", F.col("members")[0]).join(comp, "entity_id").select("comp", "key", "members")
    twins = rows.filter("_mixed").groupBy("entity_id", "key").agg(F.array_sort(F.collect_list(F.xxhash64("value"))).alias("values")).join(comp, "entity_id").select("comp", "key", "entity_id", "values")

    def solve(rows: pa.Table) -> pa.Table:
        members: dict = {}
        for e, v in zip(rows["entity_id"].to_pylist(), rows["values"].to_pylist()):
            members.setdefault(tuple(v), []).append(e)
        holders: dict = {}
        for t in members:
            for v in t:
                holders.setdefault(v, []).append(t)
        found, done = [], set()
        for start in members:
            if start in done:
                continue
            part, todo = {}, [start]
            done.add(start)
            while todo:
                t = todo.pop()
                part[t] = {u for v in t for u in holders[v]} - {t}
                todo += part[t] - done
                done |= part[t]
            found += [c for c in (sorted(e for t in q for e in members[t]) for q in bron_kerbosch(part, 1)) if len(c) >= least]
        return clique_rows(rows, found)

    kind = comp.schema["comp"].dataType.simpleString()
    return plain.unionByName(twins.groupBy("comp", "key").applyInArrow(solve, f"comp {kind}, key string, members array<{kind}>"))
