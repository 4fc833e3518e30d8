"""Connected components by contraction, over pairs or over an incidence table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.storage import discard, written

#: A contracted graph of so many edges is finished in one task (some ten megabytes).
FEW_EDGES = 1 << 18


def finished(edges: DataFrame) -> DataFrame:
    """(old, new): each node of a graph of few edges and the least node that it reaches, in one task."""
    return forest(edges.select("src", "dst").coalesce(1)).toDF("old", "new")


def forest(edges: DataFrame) -> DataFrame:
    """(src, dst): fewer edges that connect the same; in each partition every node is tied to the least it reaches there."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        types = None
        for batch in batches:
            types = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if parent:
            yield pa.RecordBatch.from_arrays([pa.array(parent, types), pa.array([root(x) for x in parent], types)], names=["src", "dst"])

    return edges.select("src", "dst").mapInArrow(run, f"src {kind}, dst {kind}")


def renamed(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """Columns that hold an ``old`` name get the ``new`` one."""
    for c in columns:
        rows = rows.join(names.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return rows


def connected_components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, comp) of every node of ``edges(src, dst)``; comp is the smallest node it reaches.

    Each round, every node takes its least neighbour's name and then that one's, and the edges are renamed,
    so the graph shrinks from round to round; when few edges are left, one task finishes.  The smallest node
    of a component never changes its name.  Rounds end in written tables, so lineage and lost executors do
    not add up.  A self loop makes a component of one; nulls are left out.
    """
    least, most = F.least("src", "dst"), F.greatest("src", "dst")
    e = written(edges.select(least.alias("src"), most.alias("dst"), F.col("src").isNull() | F.col("dst").isNull()).toDF("src", "dst", "gap").filter("not gap").select("src", "dst").distinct(), "edges")
    labels = written(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("comp", F.col("node")), "labels")
    while True:
        small = e.count() <= few
        if small:
            names = finished(e)
        else:
            both = e.union(e.select("dst", "src").toDF("src", "dst"))
            names = written(both.groupBy(F.col("src").alias("old")).agg(F.least("old", F.min("dst")).alias("new")), "names")
            names = written(renamed(names, names, "new"), "names")
        fresh = written(renamed(labels, names, "comp").select("node", "comp"), "labels")
        discard(labels)
        labels = fresh
        if small:
            discard(e)
            return labels
        left = written(renamed(e, names, "src", "dst").filter("src <> dst").select(least.alias("src"), most.alias("dst")).distinct(), "edges")
        discard(e)
        e = left


def incidence_components(inc: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(entity_id, comp) over an incidence table (entity_id, key, value): sharing a value links.

    Values are never expanded into pairs: a value's entities make a star around the least of them.
    """
    inc = written(inc.select("entity_id", "key", "value").distinct(), "incidence")
    hubs = inc.groupBy("key", "value").agg(F.min("entity_id").alias("hub"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    star = inc.join(hubs, ["key", "value"]).select(F.col("entity_id").alias("src"), F.col("hub").alias("dst")).filter("src <> dst")
    comp = connected_components(star, few)
    out = written(inc.select("entity_id").distinct().join(comp, F.col("entity_id") == F.col("node"), "left").select("entity_id", F.coalesce("comp", "entity_id").alias("comp")), "components")
    discard(inc)
    discard(comp)
    return out


def component_sizes(comp: DataFrame) -> DataFrame:
    return comp.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))


def component_key(comp: DataFrame) -> DataFrame:
    """(comp, component_id): first nine hex digits of SHA-1 over the sorted entity ids, eight bytes each.

    A component's ids are gathered in one row; integer ids only.
    """
    ids = F.array_sort(F.collect_list("entity_id"))
    raw = F.unhex(F.array_join(F.transform(ids, lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    return comp.groupBy("comp").agg(F.substring(F.sha1(raw), 1, 9).alias("component_id"), F.count(F.lit(1)).alias("size"))


def component_stats(inc: DataFrame, comp: DataFrame, key: str) -> DataFrame:
    """(comp, value, edges) of the values of a key that link entities of a component; edges are counted, not made."""
    n = inc.filter(F.col("key") == key).join(comp, "entity_id").groupBy("comp", "value").agg(F.countDistinct("entity_id").alias("n"))
    return n.filter("n > 1").select("comp", "value", F.expr("n * (n - 1) div 2").alias("edges"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def only_one(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy(*a.columns).count().filter("count = 1").drop("count")


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: shared, union and Jaccard index of two node sets."""
    c = a.distinct().withColumn("_a", F.lit(1)).join(b.distinct().withColumn("_b", F.lit(1)), a.columns, "full")
    shared, union = F.count(F.col("_a") + F.col("_b")), F.count(F.lit(1))
    return c.agg(shared.alias("shared"), union.alias("n_union"), F.round(shared / union, 6).alias("jaccard"))
