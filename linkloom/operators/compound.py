"""Resolution of compounds into classes, phase by phase.

A phase proposes pairs of entities; ``guarded`` merges them.  ``classes`` (entity_id, cls) holds the entities
that are mapped so far, and a class is named by its root if it has one.  Pairs are contracted first: a group
of classes that proposed pairs connect merges at once if nothing in it can refuse (at most one root, one set
of active moieties), in whatever order; only groups with a conflict are walked pair by pair, each in a task.
So what a task sees is a conflict, not a component.  Holders of a value are proposed as a star around the
least of them, never as all pairs.

``info`` has a row per entity: entity_id, unii (array or null), active (array of its stated active moieties
or null), l4 (array of structure hashes with suffix -M metal, -S salt or solvent, -N other).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.cliques import potential, propagate_keys, value_cliques
from linkloom.operators.components import connected_components
from linkloom.operators.resolve import UnionFind, singletons_merged, stars
from linkloom.storage import written

# Keys by which classes are merged over cliques, and by which unmapped entities look for one.
SPAN = ["N_Name", "I_CAS", "I_DB", "I_ChEMBL", "I_CID", "I_SID", "H_LyChI_L4"]
NEAR = ["N_Name", "I_CAS", "I_DB", "I_ChEMBL"]
STRUCTURE = ["H_LyChI_L3", "H_LyChI_L4", "H_LyChI_L5"]
#: A mapped neighbour is not joined over a value with so many edges.
MOST_EDGES = 1000
#: Members of groups with a conflict that a task walks at once, about; a larger group is not cut.
LOT = 20_000


def covered(unii: str = "unii", active: str = "active") -> Column:
    """Are all of an entity's own identifiers among its stated active moieties?"""
    return F.col(unii).isNotNull() & (F.size(F.array_except(unii, active)) == 0)


def active_roots(info: DataFrame, links: DataFrame) -> DataFrame:
    """(entity_id, is_root): what states its active moieties is a root if they cover itself; else what others
    point to (``links``: src, dst), what points nowhere, and what nothing points to the wrong way round."""
    flipped = info.select(F.col("entity_id").alias("src"), F.coalesce(F.col("active").isNotNull() & covered(), F.lit(False)).alias("flip"))
    into = links.join(flipped, "src").groupBy(F.col("dst").alias("entity_id")).agg(F.max("flip").alias("flip"))
    out = links.select(F.col("src").alias("entity_id"), F.lit(True).alias("out")).distinct()
    j = info.join(into, "entity_id", "left").join(out, "entity_id", "left")
    pointed = F.col("flip").isNotNull() & F.col("out").isNull() & ~F.coalesce("flip", F.lit(False))
    return j.select("entity_id", F.when(F.col("active").isNotNull(), F.coalesce(covered(), F.lit(False))).otherwise(pointed).alias("is_root"))


def moiety_counts(info: DataFrame, moieties: DataFrame) -> DataFrame:
    """(entity_id, n): active moieties an entity points to (``moieties``: entity_id, values); its own identifier
    is not counted among several, and a single value must have ten characters."""
    own = F.when(F.size("unii") == 1, F.col("unii")[0])
    several = F.size(F.filter("values", lambda v: ~v.eqNullSafe(F.col("own"))))
    j = moieties.join(info.select("entity_id", own.alias("own")), "entity_id", "left")
    return j.select("entity_id", F.when(F.size("values") > 1, several).otherwise((F.length(F.col("values")[0]) == 10).cast("int")).alias("n"))


def moiety_pairs(counts: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst): entities with one active moiety and what it leads to."""
    return links.join(counts.filter("n = 1").select(F.col("entity_id").alias("src")), "src").select("src", "dst").filter("src <> dst").distinct()


def guarded(classes: DataFrame, pairs: DataFrame, info: DataFrame, roots: DataFrame) -> DataFrame:
    """(entity_id, cls) after the pairs (src, dst) were merged as far as the guards allow.

    Two classes that both have a root stay apart.  A pair of which one side is not mapped yet stays apart if
    both state active moieties and they differ.  Order: pairs by ``rank`` if they have one, then (src, dst); a
    class without a root is named by the least name.
    """
    kind = info.schema["entity_id"].dataType.simpleString()
    side = lambda c: classes.select(F.col("entity_id").alias(c), F.col("cls").alias(f"{c}_cls"))
    state = info.join(roots, "entity_id", "left").select("entity_id", F.coalesce("is_root", F.lit(False)).alias("is_root"), F.array_join(F.array_sort("active"), ",").alias("active"))
    rank = F.min("rank") if "rank" in pairs.columns else F.min(F.lit(0.0))
    p = pairs.groupBy("src", "dst").agg(rank.cast("double").alias("rank")).join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    p = p.withColumns({"a": F.coalesce("src_cls", "src"), "b": F.coalesce("dst_cls", "dst"), "open": F.col("src_cls").isNull() | F.col("dst_cls").isNull()}).filter("a <> b")
    for c in ("src", "dst"):
        p = p.join(state.select(F.col("entity_id").alias(c), F.col("active").alias(f"{c}_active")), c, "left")
    p = written(p, "proposed")
    comp = connected_components(p.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    nodes = written(comp.join(state.select(F.col("entity_id").alias("node"), "is_root"), "node", "left").withColumn("is_root", F.coalesce("is_root", F.lit(False))), "nodes")
    stated = p.filter("open").select("a", F.explode(F.array("src_active", "dst_active")).alias("active")).dropna().join(comp, F.col("a") == F.col("node")).groupBy("comp").agg(F.countDistinct("active").alias("kinds"))
    sizes = nodes.groupBy("comp").agg(F.count_if("is_root").alias("rooted"), F.min(F.when(F.col("is_root"), F.col("node"))).alias("root"))
    groups = sizes.join(stated, "comp", "left").select("comp", F.coalesce("root", "comp").alias("name"), ((F.col("rooted") > 1) | (F.coalesce("kinds", F.lit(0)) > 1)).alias("conflict"))
    groups = written(groups, "groups")
    free = nodes.join(groups.filter("not conflict"), "comp").select("node", "name")

    def walk(links: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        rooted = dict(zip(members.node, members.is_root))
        mapped = {n for c, n in ((c, n) for s in ("src", "dst") for c, n in zip(links[f"{s}_cls"], links["a" if s == "src" else "b"])) if pd.notna(c)}
        uf, moved = UnionFind(sorted(rooted)), set()
        for r in links.sort_values(["rank", "src", "dst"]).itertuples():
            a, b = uf.root(r.a), uf.root(r.b)
            unmapped = [x for x in (r.a, r.b) if x not in mapped and x not in moved]
            if a == b or (not unmapped and rooted[a] and rooted[b]):
                continue
            if unmapped and isinstance(r.src_active, str) and isinstance(r.dst_active, str) and r.src_active != r.dst_active:
                continue
            first = a if rooted[a] or (not rooted[b] and a < b) else b
            uf.union(first, b if first == a else a, keep_first=True)
            moved |= {r.a, r.b}
        keep = sorted(moved | mapped)
        return pd.DataFrame({"node": pd.Series(keep, dtype=members.node.dtype), "name": pd.Series([uf.root(n) for n in keep], dtype=members.node.dtype)})

    # groups touch nothing of each other, so a task walks many small ones at once
    hard = nodes.join(groups.filter("conflict").select("comp"), "comp")
    lot = F.pmod(F.xxhash64("comp"), F.lit(1 + hard.count() // LOT))
    links = p.join(comp, F.col("a") == F.col("node")).join(groups.filter("conflict").select("comp"), "comp").select(lot.alias("within"), "rank", "src", "dst", "src_cls", "dst_cls", "a", "b", "src_active", "dst_active")
    walked = links.groupBy("within").cogroup(hard.select("node", "is_root", lot.alias("within")).groupBy("within")).applyInPandas(lambda x, y: walk(x, y), f"node {kind}, name {kind}")
    names = written(free.unionByName(walked), "names")
    old = classes.join(names, F.col("cls") == F.col("node"), "left").select("entity_id", F.coalesce("name", "cls").alias("cls"))
    new = names.join(classes.select(F.col("cls").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("entity_id"), F.col("name").alias("cls"))
    return written(old.unionByName(new), "classes")


def equal_structures(classes: DataFrame, info: DataFrame) -> DataFrame:
    """(src, dst) among mapped entities whose whole sets of structure hashes are equal."""
    same = info.filter(F.size("l4") > 0).join(classes.select("entity_id"), "entity_id").select("entity_id", F.concat_ws(":", F.array_sort("l4")).alias("l4"))
    return stars(same, "l4")


def spanning_cliques(inc: DataFrame, comp: DataFrame) -> DataFrame:
    """Cliques (members, keys) of three or more that two or more keys span; a structure key is left out of
    components where any of its values is a metal."""
    rows = inc.filter(F.col("key").isin(SPAN)).join(comp, "entity_id")
    metal = rows.filter(F.col("key").isin(STRUCTURE) & F.col("value").endswith("-M")).select("comp", "key").distinct()
    return propagate_keys(value_cliques(rows.join(metal, ["comp", "key"], "left_anti").select("entity_id", "key", "value"), 3)).filter(F.size("keys") > 1)


def clique_pairs(cliques: DataFrame) -> DataFrame:
    """(src, dst): each member and the first."""
    return cliques.select(F.explode("members").alias("src"), F.col("members")[0].alias("dst")).filter("src <> dst").distinct()


def only_ends(values: str, shared: str, end: str) -> Column:
    """Do all values besides the shared ones end so?"""
    return F.forall(F.array_except(values, shared), lambda v: v.endswith(end))


def moiety_holders(info: DataFrame, links: DataFrame) -> DataFrame:
    """(l4, targets): the entities that an active-moiety link leads to, by their own hashes and those of what leads there."""
    name = F.concat_ws(":", F.array_sort("l4")).alias("l4")
    ends = links.select("src", "dst").union(links.select("dst", "dst")).distinct()
    return info.filter(F.size("l4") > 0).select(F.col("entity_id").alias("src"), name).join(ends, "src").groupBy("l4").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def rarest_structure(open_: DataFrame, inc: DataFrame, info: DataFrame, holders: DataFrame) -> DataFrame:
    """(src, dst, edges): for each of ``open_`` (entity_id) the neighbour over its rarest compatible structure hash.

    Compatible: besides the shared hashes both sides hold salts or solvents only, and where the neighbour's
    hashes are those of an active moiety, so are the shared ones.  Metals come first, then values with fewer
    edges, then the least neighbour.

    Entities with the same hashes form a class, and classes are paired: of each the two least members stand for
    all, as an entity leaves out itself only.  A class with a hash other than salts meets only what has it too.
    """
    l4 = inc.filter("key = 'H_LyChI_L4'").select("entity_id", "value").distinct()
    counts = l4.groupBy("value").agg(F.expr("count(1) * (count(1) - 1) div 2").alias("edges"))
    own = l4.join(counts, "value").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("value", "edges"))).alias("have")).join(info.select("entity_id", "l4").filter("l4 is not null"), "entity_id")
    own = written(own.select("entity_id", "have", F.array_sort("l4").alias("l4")), "own")
    classes = written(own.groupBy("have", "l4").agg(F.min("entity_id").alias("cls")), "equal")
    members = written(own.join(classes, ["have", "l4"]).select("entity_id", "cls"), "members")
    ends = members.groupBy("cls").agg(F.min("entity_id").alias("first"), F.min(F.when(F.col("entity_id") != F.col("cls"), F.col("entity_id"))).alias("second"))
    mine = members.join(open_.select("entity_id"), "entity_id", "left_semi").withColumnRenamed("cls", "s")
    values = F.transform("have", lambda x: x["value"])
    fixed = F.filter("l4", lambda v: ~v.endswith("-S"))
    asks = classes.join(mine.select(F.col("s").alias("cls")).distinct(), "cls").withColumns({"values": values, "_fixed": F.size(fixed) > 0, "probes": F.when(F.size(fixed) > 0, F.slice(fixed, 1, 1)).otherwise(values)})
    asks = asks.select(F.col("cls").alias("s"), F.col("have").alias("src_have"), F.col("values").alias("src_values"), F.col("l4").alias("src_l4"), "_fixed", F.explode("probes").alias("v"))
    holds = classes.select(F.col("cls").alias("d"), values.alias("dst_values"), F.col("l4").alias("dst_l4"), F.concat_ws(":", "l4").alias("dst_key")).withColumn("v", F.explode("dst_values"))
    met = asks.join(holds, "v").withColumn("shared", F.array_intersect("src_values", "dst_values"))
    met = met.filter((F.col("_fixed") | (F.col("v") == F.col("shared")[0])) & F.array_contains("shared", F.col("v")) & only_ends("src_l4", "shared", "-S") & only_ends("dst_l4", "shared", "-S"))
    edges = F.array_min(F.transform(F.filter("src_have", lambda x: F.array_contains("shared", x["value"])), lambda x: x["edges"]))
    j = written(met.select("s", "d", "shared", "dst_key", F.concat_ws(":", "shared").alias("shared_key"), edges.alias("edges")), "compatible")
    known = lambda c, name: holders.select(F.col("l4").alias(c), F.col("targets").alias(name))
    j = j.join(known("dst_key", "su"), "dst_key", "left").join(known("shared_key", "sv"), "shared_key", "left")
    parts = j.filter(F.size("shared") > 1).select("s", "d", "su", F.explode("shared").alias("one_key")).join(known("one_key", "s1"), "one_key").filter(F.size(F.array_except("s1", "su")) == 0).select("s", "d", F.lit(True).alias("part")).distinct()
    j = j.join(parts, ["s", "d"], "left").filter(F.col("su").isNull() | F.coalesce(F.arrays_overlap("su", "sv"), F.lit(False)) | F.coalesce("part", F.lit(False)))
    metal = F.exists("shared", lambda v: v.endswith("-M"))
    near = j.select("s", "edges", metal.alias("metal"), F.col("d").alias("cls")).join(ends, "cls").select("s", "edges", "metal", F.explode(F.array("first", "second")).alias("dst")).dropna(subset=["dst"])
    w = Window.partitionBy("s").orderBy(F.desc("metal"), "edges", "dst")
    best = near.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    each = mine.select(F.col("entity_id").alias("src"), "s").join(best, "s").filter("src <> dst").groupBy("src").agg(F.min(F.struct("_r", "dst", "edges")).alias("o"))
    return each.select("src", "o.dst", "o.edges")


def rarest_pairs(best: DataFrame, classes: DataFrame) -> DataFrame:
    """(src, dst) of those whose neighbour is unmapped or shares a value of few edges."""
    mapped = classes.select(F.col("entity_id").alias("dst"), F.lit(True).alias("mapped"))
    return best.join(mapped, "dst", "left").filter(F.col("mapped").isNull() | (F.col("edges") < MOST_EDGES)).select("src", "dst")


def clique_choice(open_: DataFrame, inc: DataFrame, classes: DataFrame) -> DataFrame:
    """(entity_id, members): for each of ``open_`` the cliques that it is merged with.

    Of its cliques that touch no class, the one with the highest potential (ties: the least members); if there
    is none, all that touch several classes and that several keys span.  Cliques that touch one class do nothing.
    """
    cliques = potential(value_cliques(inc.filter(F.col("key").isin(NEAR)))).withColumn("id", F.md5(F.concat_ws(",", "members")))
    each = cliques.select("id", F.explode("members").alias("entity_id"))
    touched = each.join(classes, "entity_id").groupBy("id").agg(F.countDistinct("cls").alias("touched"))
    cliques = cliques.join(touched, "id", "left").withColumn("touched", F.coalesce("touched", F.lit(0)))
    several = propagate_keys(cliques.filter("touched > 1").select("members", "keys", "n_values", "size")).filter(F.size("keys") > 1).select(F.md5(F.concat_ws(",", "members")).alias("id"))
    mine = each.join(open_.select("entity_id"), "entity_id", "left_semi")
    w = Window.partitionBy("entity_id").orderBy(F.desc("potential"), "members")
    best = mine.join(cliques.filter("touched = 0"), "id").withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("entity_id", "members")
    rest = mine.join(several, "id").join(cliques.select("id", "members"), "id").join(best, "entity_id", "left_anti").select("entity_id", "members")
    return best.unionByName(rest)


def choice_pairs(choice: DataFrame) -> DataFrame:
    return choice.select("entity_id", F.explode("members").alias("src")).select("src", F.col("entity_id").alias("dst")).filter("src <> dst").distinct()


def unsure_votes(unsure: DataFrame, links: DataFrame, info: DataFrame) -> DataFrame:
    """(entity_id, target): of the entities that several active moieties lead from, the one moiety with metal
    or other hashes; null if none or several have such."""
    voted = info.filter(F.exists("l4", lambda v: v.endswith("-M") | v.endswith("-N"))).select(F.col("entity_id").alias("dst"), F.lit(1).alias("vote"))
    j = links.join(unsure.select(F.col("entity_id").alias("src")), "src", "left_semi").distinct().join(voted, "dst", "left")
    n = j.groupBy(F.col("src").alias("entity_id")).agg(F.count(F.lit(1)).alias("out"), F.count("vote").alias("votes"), F.min(F.when(F.col("vote") == 1, F.col("dst"))).alias("target"))
    return n.filter("out > 1").select("entity_id", F.when(F.col("votes") == 1, F.col("target")).alias("target"))


def resolve_compounds(inc: DataFrame, comp: DataFrame, info: DataFrame, moieties: DataFrame, links: DataFrame) -> DataFrame:
    """(entity_id, cls) of all entities of ``info``, each phase on what the ones before it left.

    ``inc``: incidence rows; ``comp``: components; ``moieties``: entity_id, values; ``links``: src, dst of active
    moieties.  Phases: active moieties, equal identifiers, equal structures of different classes, cliques that
    several keys span, rarest structures, cliques of what is still open, singletons, votes.
    """
    info, links = written(info, "info"), written(links.distinct(), "links")
    roots = written(active_roots(info, links), "roots")
    counts = written(moiety_counts(info, moieties), "moieties")
    unsure = counts.filter("n > 1").select("entity_id")
    kind = info.schema["entity_id"].dataType.simpleString()
    classes = info.select("entity_id", F.lit(None).cast(kind).alias("cls")).filter("false")
    first = connected_components(moiety_pairs(counts, links))
    named = first.join(roots.select(F.col("entity_id").alias("node"), "is_root"), "node", "left").groupBy("comp").agg(F.min(F.when(F.col("is_root"), F.col("node"))).alias("root"))
    classes = written(first.join(named, "comp").select(F.col("node").alias("entity_id"), F.coalesce("root", "comp").alias("cls")), "classes")
    classes = guarded(classes, stars(inc.filter("key = 'I_UNII'"), "value"), info, roots)
    classes = guarded(classes, equal_structures(classes, info), info, roots)
    classes = guarded(classes, clique_pairs(spanning_cliques(inc, comp)), info, roots)

    def open_() -> DataFrame:
        return info.select("entity_id").join(classes, "entity_id", "left_anti").join(unsure, "entity_id", "left_anti")

    best = rarest_structure(open_(), inc, info, moiety_holders(info, links))
    classes = guarded(classes, rarest_pairs(best, classes), info, roots)
    classes = guarded(classes, choice_pairs(clique_choice(open_(), inc, classes)), info, roots)
    # singletons join the class that their keys agree on
    joined = singletons_merged(open_(), inc.filter(F.col("key").isin(NEAR)), classes)
    classes = written(classes.unionByName(joined.withColumnRenamed("target", "cls")), "classes")
    votes = unsure_votes(unsure.join(classes, "entity_id", "left_anti"), links, info).dropna()
    voted = votes.join(classes.withColumnRenamed("entity_id", "target"), "target", "left").select("entity_id", F.coalesce("cls", "target").alias("cls"))
    classes = written(classes.unionByName(voted), "classes")
    rest = info.select("entity_id").join(classes, "entity_id", "left_anti").select("entity_id", F.col("entity_id").alias("cls"))
    return classes.unionByName(rest)


def stitch_verdicts(pairs: DataFrame, threshold: Column) -> DataFrame:
    """(src, dst, score, accepted) of scored pairs (src, dst, score, keys, l4, src_l4, dst_l4).

    An equal layer-5 hash accepts.  An equal layer-4 hash accepts unless either side is left with a hash other
    than salt or solvent.  With only layer 3 in common the score counts a third.  Else more keys than the least
    number and a score of the threshold are needed.
    """
    score, accepted = verdict(threshold)
    return pairs.select("src", "dst", score.alias("score"), accepted.alias("accepted"))


def verdict(threshold: Column) -> tuple[Column, Column]:
    """(score, accepted) of a row as ``stitch_verdicts`` takes them."""
    has = lambda k: F.array_contains("keys", k)
    left = F.concat(F.array_except("src_l4", "l4"), F.array_except("dst_l4", "l4"))
    fits = ~F.exists(left, fixed)
    override = has("H_LyChI_L5") | (has("H_LyChI_L4") & fits)
    least = F.when(has("H_LyChI_L5") | (has("H_LyChI_L4") & fits), 1).otherwise(2)
    score = F.when(~has("H_LyChI_L5") & ~has("H_LyChI_L4") & has("H_LyChI_L3"), F.col("score") / 3.0).otherwise(F.col("score"))
    return score, override | ((F.size("keys") > least) & (score >= threshold))


def fixed(v: Column) -> Column:
    """Whether a layer-4 hash is neither salt nor solvent."""
    return v.endswith("-N") | v.endswith("-M")


def resolve_by_scores(verdicts: DataFrame, info: DataFrame, roots: DataFrame) -> DataFrame:
    """(entity_id, cls): accepted pairs of ``stitch_verdicts`` merge by falling score as far as the guards allow;
    the ends of the others are classes of their own if nothing else takes them."""
    kind = info.schema["entity_id"].dataType.simpleString()
    none = info.select("entity_id", F.lit(None).cast(kind).alias("cls")).filter("false")
    classes = guarded(none, verdicts.filter("accepted").select("src", "dst", (-F.col("score")).alias("rank")), info, roots)
    ends = verdicts.select(F.col("src").alias("entity_id")).union(verdicts.select("dst")).distinct()
    return classes.unionByName(ends.join(classes, "entity_id", "left_anti").select("entity_id", F.col("entity_id").alias("cls")))


def moiety_class_roots(classes: DataFrame, links: DataFrame, moieties: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """(cls, root): of each class what others point to and what points nowhere, else the fewest moieties
    (``moieties``: entity_id, n; none known comes last), else the least id; ``preferred`` (entity_id) go before all."""
    into = links.select(F.col("dst").alias("entity_id"), F.lit(1).alias("into")).distinct()
    out = links.select(F.col("src").alias("entity_id"), F.lit(1).alias("out")).distinct()
    j = classes.join(into, "entity_id", "left").join(out, "entity_id", "left").join(moieties.select("entity_id", "n"), "entity_id", "left")
    first = F.lit(0) if preferred is None else F.coalesce("first", F.lit(0))
    j = j if preferred is None else j.join(preferred.select("entity_id", F.lit(1).alias("first")).distinct(), "entity_id", "left")
    order = F.struct((-first).alias("a"), (~(F.col("into").isNotNull() & F.col("out").isNull())).cast("int").alias("b"), F.coalesce("n", F.lit(1 << 30)).alias("c"), F.col("entity_id").alias("d"))
    return j.groupBy("cls").agg(F.min(order).alias("o")).select("cls", F.col("o.d").alias("root"))
