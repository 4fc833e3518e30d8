"""Resolving components into classes of equal entities.

Merges that depend on nothing else (equal values, exact matches) are connected components over
DataFrames.  Guarded merges depend on their order, so they run in a fixed order inside one task per
component, on a graph that the free merges have already contracted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.components import connected_components, incidence_components
from linkloom.storage import written

#: Order of the guarded merges: a stronger key first.
ORDER = ["R_activeMoiety", "I_UNII", "H_LyChI_L5", "H_LyChI_L4", "I_CAS", "I_DB", "I_ChEMBL", "I_CODE", "N_Name"]
#: 64-bit words of a value's signature.
SIGNATURE = 4


class UnionFind:
    """Disjoint sets whose root can be chosen; classes come largest first, then by smallest member."""

    def __init__(self, nodes=()):
        self.parent = {n: n for n in nodes}

    def root(self, n):
        self.parent.setdefault(n, n)
        while self.parent[n] != n:
            self.parent[n] = n = self.parent[self.parent[n]]
        return n

    def union(self, a, b, keep_first: bool = False):
        a, b = self.root(a), self.root(b)
        if a != b:
            a, b = (a, b) if keep_first or a < b else (b, a)
            self.parent[b] = a
        return a

    def classes(self) -> list[list]:
        out: dict = {}
        for n in self.parent:
            out.setdefault(self.root(n), []).append(n)
        return sorted((sorted(c) for c in out.values()), key=lambda c: (-len(c), c[0]))


def stars(groups: DataFrame, *by: str) -> DataFrame:
    """(src, dst): each member of a group and the group's least; rows are (entity_id, *by).  n members make n - 1 pairs."""
    hub = groups.groupBy(*by).agg(F.min("entity_id").alias("dst"))
    return groups.join(hub, list(by)).filter("entity_id <> dst").select(F.col("entity_id").alias("src"), "dst").distinct()


def merge_free(inc: DataFrame, keys: list[str]) -> DataFrame:
    """(node, comp): classes that sharing a value of some keys makes without any condition; entities that share none are left out."""
    return connected_components(stars(inc.filter(F.col("key").isin(keys)), "key", "value"))


def guarded_classes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, cls) within each component.

    ``entities``: entity_id, comp, guard (a value that must not differ within a class, or null) and
    is_root; ``edges``: src, dst, key.  In the order of keys, then (src, dst), two classes merge unless
    both hold a root or their guards differ.  ``comp`` are the components of ``edges``.
    """
    kind = entities.schema["entity_id"].dataType.simpleString()
    # a component with one root and one guard at most refuses nothing: it is a class, in whatever order it merges
    calm = entities.groupBy("comp").agg(F.count_if("is_root").alias("_r"), F.countDistinct("guard").alias("_g"), F.coalesce(F.min(F.when(F.col("is_root"), F.col("entity_id"))), F.min("entity_id")).alias("cls"))
    calm = written(calm.select("comp", "cls", ((F.col("_r") <= 1) & (F.col("_g") <= 1)).alias("calm")), "calm")
    whole = entities.join(calm.filter("calm"), "comp").select("entity_id", "cls")
    entities = entities.join(calm.filter("not calm").select("comp"), "comp", "left_semi")
    placed = edges.join(entities.select(F.col("entity_id").alias("src"), "comp"), "src").select(F.col("comp").alias("within"), "src", "dst", "key")

    def solve(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        guard = dict(zip(nodes.entity_id, nodes.guard))
        rooted = dict(zip(nodes.entity_id, nodes.is_root))
        uf = UnionFind(sorted(nodes.entity_id))
        rank = {k: i for i, k in enumerate(ORDER)}
        order = sorted(zip(links.key.map(lambda k: rank.get(k, len(ORDER))), links.src, links.dst))
        for _, a, b in order:
            a, b = uf.root(a), uf.root(b)
            if a == b or (rooted[a] and rooted[b]) or (guard[a] is not None and guard[b] is not None and guard[a] != guard[b]):
                continue
            first = a if rooted[a] or (not rooted[b] and a < b) else b
            other = b if first == a else a
            uf.union(first, other, keep_first=True)
            guard[first] = guard[first] if guard[first] is not None else guard[other]
        return pd.DataFrame({"entity_id": list(uf.parent), "cls": [uf.root(n) for n in uf.parent]})

    return whole.unionByName(entities.groupBy("comp").cogroup(placed.groupBy("within")).applyInPandas(solve, f"entity_id {kind}, cls {kind}"))


def guarded_values(entities: DataFrame, inc: DataFrame) -> DataFrame:
    """(entity_id, cls) as ``guarded_classes`` gives over all pairs of entities that share a value, without the pairs.

    ``entities``: entity_id, guard, is_root; ``inc``: incidence rows.  Entities whose guards differ never merge, so a
    value none of whose holders lacks a guard is cut by guard before components are made; most hold one guard and one
    root then and are classes.  In the others an entity meets, of a value's earlier holders, the first of each class:
    holders of a value that were seen are merged or stay apart for good.  A task holds rows, never pairs.
    """
    kind = entities.schema["entity_id"].dataType.simpleString()
    rows = inc.select("entity_id", "key", "value").distinct().join(entities.select("entity_id", F.col("guard").cast("string").alias("guard")), "entity_id")
    loose = rows.groupBy("key", "value").agg(F.max(F.col("guard").isNull()).alias("_open"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    cut = F.struct(F.col("value").alias("v"), F.when(F.col("_open"), "").otherwise(F.coalesce("guard", F.lit(""))).alias("g"), "_open")
    rows = written(rows.join(loose, ["key", "value"]).select("entity_id", "key", cut.alias("value")), "cut")
    comp = incidence_components(rows)
    entities = written(entities.select("entity_id", "guard", "is_root").join(comp, "entity_id", "left").withColumn("comp", F.coalesce("comp", "entity_id")), "entities")
    calm = entities.groupBy("comp").agg(F.count_if("is_root").alias("_r"), F.countDistinct("guard").alias("_g"), F.coalesce(F.min(F.when(F.col("is_root"), F.col("entity_id"))), F.min("entity_id")).alias("cls"))
    calm = written(calm.select("comp", "cls", ((F.col("_r") <= 1) & (F.col("_g") <= 1)).alias("calm")), "calm")
    whole = entities.join(calm.filter("calm"), "comp").select("entity_id", "cls")
    hard = entities.join(calm.filter("not calm").select("comp"), "comp", "left_semi")
    number = F.coalesce(F.array_position(F.array(*map(F.lit, ORDER)), F.col("key")) - 1, F.lit(-1))
    rank = F.when(number < 0, len(ORDER)).otherwise(number).cast("int")
    held = rows.join(hard.select("entity_id", "comp"), "entity_id").select(F.col("comp").alias("within"), "entity_id", rank.alias("rank"), F.xxhash64("key", "value").alias("value"))

    def solve(nodes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        guard = dict(zip(nodes.entity_id, (None if pd.isna(g) else g for g in nodes.guard)))
        rooted = dict(zip(nodes.entity_id, nodes.is_root.tolist()))
        uf = UnionFind(sorted(nodes.entity_id))
        # of each value the least holder of every class seen, those of classes without a root apart
        seen: dict = {}
        rows = rows.sort_values(["rank", "entity_id"])
        for (_, x), values in rows.groupby(["rank", "entity_id"], sort=False).value:
            lists = [seen.setdefault(v, ([], [])) for v in values]
            for free, fixed in lists:
                for y in [y for y in free if rooted[uf.root(y)]]:
                    free.remove(y)
                    fixed.append(y)
            a = uf.root(x)
            met = sorted({y for free, fixed in lists for y in (free if rooted[a] else free + fixed)})
            for y in met:
                a, b = uf.root(x), uf.root(y)
                if a == b or (rooted[a] and rooted[b]) or (guard[a] is not None and guard[b] is not None and guard[a] != guard[b]):
                    continue
                first = a if rooted[a] or (not rooted[b] and a < b) else b
                other = b if first == a else a
                uf.union(first, other, keep_first=True)
                guard[first] = guard[first] if guard[first] is not None else guard[other]
            a = uf.root(x)
            for free, fixed in lists:
                if all(uf.root(y) != a for y in (fixed if rooted[a] else free)) and not (rooted[a] and any(uf.root(y) == a for y in free)):
                    (fixed if rooted[a] else free).append(x)
        return pd.DataFrame({"entity_id": list(uf.parent), "cls": [uf.root(n) for n in uf.parent]})

    return whole.unionByName(hard.groupBy("comp").cogroup(held.groupBy("within")).applyInPandas(lambda x, y: solve(x, y), f"entity_id {kind}, cls {kind}"))


def class_root(classes: DataFrame, entities: DataFrame) -> DataFrame:
    """(cls, root, rank): of each class its root entity (is_root first, then the least id) and its size."""
    w = Window.partitionBy("cls").orderBy(F.desc("is_root"), "entity_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("cls"))
    j = classes.join(entities.select("entity_id", "is_root"), "entity_id")
    return j.withColumns({"_r": F.row_number().over(w), "rank": n}).filter("_r = 1").select("cls", F.col("entity_id").alias("root"), "rank")


def singletons_merged(alone: DataFrame, inc: DataFrame, classes: DataFrame) -> DataFrame:
    """(entity_id, target): for entities alone, the class that all mapped holders of their values of some key agree on.

    An entity whose holders disagree for one of its keys joins nothing; of several keys that propose, the least
    class counts.  Per value the least and greatest class are enough, so holders are never paired.
    """
    per_value = inc.join(classes.select("entity_id", "cls"), "entity_id").groupBy("key", "value").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    mine = inc.join(alone.select("entity_id"), "entity_id", "left_semi").join(per_value, ["key", "value"]).groupBy("entity_id", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return mine.groupBy("entity_id").agg(F.min("lo").alias("target"), F.max((F.col("lo") != F.col("hi")).cast("int")).alias("clash")).filter("clash = 0").select("entity_id", "target")


def sgroups(classes: DataFrame, entities: DataFrame, version: int) -> DataFrame:
    """(version, sgroup_id, root, rank): resolved entities; the id depends on the members only."""
    ids = F.array_join(F.array_sort(F.collect_list(F.col("entity_id").cast("string"))), ",")
    named = classes.groupBy("cls").agg(F.substring(F.md5(ids), 1, 9).alias("sgroup_id"))
    return class_root(classes, entities).join(named, "cls").select(F.lit(version).alias("version"), "sgroup_id", "root", "rank").dropDuplicates(["sgroup_id"])


def value_groups(inc: DataFrame, percent: int = 40) -> DataFrame:
    """(a, b, similarity): values whose entity sets (rows of ``inc``, each once) have a Jaccard index above ``percent`` percent.

    Entities are ordered, rare ones first.  Two sets that link share at least ``need`` entities, so the
    first of these stands where as many are left in both; pairs meet only there.  Parity signatures differ
    in at most as many bits as the sets in entities, so most other pairs end within the join, before they
    are rows; what is left is counted exactly.
    """
    own, bit = Window.partitionBy("value"), F.pmod(F.xxhash64("entity_id"), F.lit(64 * SIGNATURE)).cast("int")
    rare = inc.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_f"))
    words = {f"s{i}": F.bit_xor(F.when(F.floor(bit / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), bit % 64)).otherwise(F.lit(0).cast("long"))).over(own) for i in range(SIGNATURE)}
    placed = inc.join(rare, "entity_id", "left").withColumns(words | {"n": F.count(F.lit(1)).over(own), "pos": F.row_number().over(own.orderBy("_f", "entity_id"))})
    front = written(placed.filter(F.expr(f"pos <= n - {percent} * n div 100")).drop("_f"), "front")
    x, y = (front.select("entity_id", *[F.col(c).alias(c + side) for c in ("value", "n", "pos", *words)]) for side in "xy")
    sums = F.col("nx") + F.col("ny")
    need = F.expr(f"{percent} * (nx + ny) div {100 + percent}") + 1
    bits = sum((F.bit_count(F.col(f"{w}x").bitwiseXOR(F.col(f"{w}y"))) for w in words), F.lit(0))
    meet = (F.col("valuex") < F.col("valuey")) & (F.col("posx") <= F.col("nx") - need + 1) & (F.col("posy") <= F.col("ny") - need + 1) & (bits <= sums - 2 * need)
    found = written(x.join(y, "entity_id").filter(meet).select(F.col("valuex").alias("a"), F.col("valuey").alias("b"), sums.alias("_sum")).distinct(), "found")
    left, right = inc.select("entity_id", F.col("value").alias("a")), inc.select("entity_id", F.col("value").alias("b"))
    both = found.join(left, "a").join(right, ["b", "entity_id"]).groupBy("a", "b", "_sum").agg(F.count(F.lit(1)).alias("ov"))
    s = F.col("ov") / (F.col("_sum") - F.col("ov"))
    return both.filter(s > percent / 100).select("a", "b", F.round(s, 6).alias("similarity"))


def value_classes(inc: DataFrame, percent: int = 40) -> DataFrame:
    """(entity_id, cls): values whose entity sets are similar form a class, named by its least value; an entity of
    several classes goes to the one whose values its own are most like (Jaccard index), then to the least."""
    pairs = value_groups(inc, percent).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comp = connected_components(pairs)
    named = written(inc.join(comp, F.col("value") == F.col("node"), "left").select("entity_id", "value", F.coalesce("comp", "value").alias("cls")), "value_classes")
    size = named.select("cls", "value").distinct().groupBy("cls").agg(F.count(F.lit(1)).alias("m"))
    own = named.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    both = named.groupBy("entity_id", "cls").agg(F.count(F.lit(1)).alias("ov")).join(size, "cls").join(own, "entity_id")
    w = Window.partitionBy("entity_id").orderBy(F.desc(F.col("ov") / (F.col("n") + F.col("m") - F.col("ov"))), "cls")
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("entity_id", "cls")


def plsa(inc: DataFrame, comp: DataFrame, topics: int = 2, seed: int = 11) -> DataFrame:
    """(comp, entity_id, topic): per component, topics of the entity x value matrix by expectation maximisation (seeded)."""
    kind = comp.schema["entity_id"].dataType.simpleString()

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        entities, e = np.unique(rows.entity_id.to_numpy(), return_inverse=True)
        values, v = np.unique((rows.key + "\x00" + rows.value).to_numpy(str), return_inverse=True)
        k = min(topics, len(entities))
        rng = np.random.default_rng(seed)
        pz_e, pv_z = rng.dirichlet(np.ones(k), len(entities)), rng.dirichlet(np.ones(len(values)), k)
        for _ in range(10 * k):
            r = pz_e[e] * pv_z[:, v].T
            r /= r.sum(axis=1, keepdims=True) + 1e-300
            pz_e, pv_z = np.zeros_like(pz_e), np.zeros_like(pv_z)
            np.add.at(pz_e, e, r)
            np.add.at(pv_z.T, v, r)
            pz_e /= pz_e.sum(axis=1, keepdims=True) + 1e-300
            pv_z /= pv_z.sum(axis=1, keepdims=True) + 1e-300
        return pd.DataFrame({"comp": rows.comp.iloc[0], "entity_id": entities, "topic": pz_e.argmax(axis=1).astype(np.int32)})

    return inc.join(comp, "entity_id").groupBy("comp").applyInPandas(solve, f"comp {kind}, entity_id {kind}, topic int")
