"""Reports on resolved groups: strict clusters, clashes, approvals, one page per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.model import keys_between
from linkloom.operators.components import connected_components
from linkloom.operators.events import APPROVED, any_date
from linkloom.operators.resolve import stars
from linkloom.operators.search import resolve
from linkloom.storage import written

# The keys by which left-over entities look for each other, strongest first.
LEFT_KEYS = ["H_LyChI_L4", "I_UNII", "I_CAS", "N_Name", "H_LyChI_L3"]


def strict_clusters(inc: DataFrame) -> DataFrame:
    """(cls, entity_id, how): clusters over shared values of the strongest keys.

    ``core``: entities with one such value per key, by equal values.  ``near``: what shares a value of any key
    that counts with a core, in the least cluster.  ``several``: entities with several values of such a key, in
    every cluster that one of them leads to.  ``left``: what is left, by equal values of ``LEFT_KEYS``, where
    nobody in a value's group has a cluster yet.
    """
    strong = keys_between(5, 5)
    shared = inc.groupBy("key", "value").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key", "value")
    rows = written(inc.join(shared, ["key", "value"]), "shared")
    top = rows.filter(F.col("key").isin(strong))
    several = top.groupBy("entity_id", "key").agg(F.countDistinct("value").alias("n")).filter("n > 1").select("entity_id").distinct()
    single = top.join(several, "entity_id", "left_anti")
    comp = connected_components(stars(single, "key", "value"))
    core = single.select("entity_id").distinct().join(comp, F.col("entity_id") == F.col("node"), "left").select(F.coalesce("comp", "entity_id").alias("cls"), "entity_id", F.lit("core").alias("how"))
    core = written(core, "core")
    counted = rows.filter(F.col("key").isin(keys_between(1, 0)))
    led = counted.join(core.select("entity_id", "cls"), "entity_id").groupBy("key", "value").agg(F.min("cls").alias("cls"))
    near = counted.join(led, ["key", "value"]).join(core.select("entity_id"), "entity_id", "left_anti").join(several, "entity_id", "left_anti")
    near = near.groupBy("entity_id").agg(F.min("cls").alias("cls")).select("cls", "entity_id", F.lit("near").alias("how"))
    placed = written(core.unionByName(near), "placed")
    values = top.join(placed.select("entity_id", "cls"), "entity_id").select("key", "value", "cls").distinct()
    many = top.join(several, "entity_id").join(values, ["key", "value"]).select("cls", "entity_id", F.lit("several").alias("how")).distinct()
    placed = written(placed.unionByName(many), "placed")
    for key in LEFT_KEYS:
        of = inc.filter(F.col("key") == key).join(placed.select("entity_id").distinct().withColumn("old", F.lit(1)), "entity_id", "left")
        free = of.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count("old").alias("old"), F.min("entity_id").alias("hub")).filter("n > 1 and old = 0").select("value", "hub")
        fresh = connected_components(stars(of.join(free, "value").select("entity_id", "value"), "value"))
        placed = written(placed.unionByName(fresh.select(F.col("comp").alias("cls"), F.col("node").alias("entity_id"), F.lit("left").alias("how"))), "placed")
    return placed


def candidates(inc: DataFrame, placed: DataFrame) -> DataFrame:
    """(entity_id, cls): for entities in no cluster, the clusters of those they share a value of ``LEFT_KEYS`` with."""
    rows = inc.filter(F.col("key").isin(LEFT_KEYS))
    led = rows.join(placed.select("entity_id", "cls"), "entity_id").select("key", "value", "cls").distinct()
    return rows.join(placed.select("entity_id").distinct(), "entity_id", "left_anti").join(led, ["key", "value"]).select("entity_id", "cls").distinct()


def value_clashes(classes: DataFrame, inc: DataFrame, key: str) -> DataFrame:
    """(cls, n): groups whose members have more than one value of a key."""
    return inc.filter(F.col("key") == key).join(classes, "entity_id").groupBy("cls").agg(F.countDistinct("value").alias("n")).filter("n > 1")


def value_splits(classes: DataFrame, inc: DataFrame, key: str) -> DataFrame:
    """(value, n): values of a key whose holders lie in more than one group."""
    return inc.filter(F.col("key") == key).join(classes, "entity_id").groupBy("value").agg(F.countDistinct("cls").alias("n")).filter("n > 1")


def source_clashes(classes: DataFrame, entities: DataFrame) -> DataFrame:
    """(cls, source, n): groups with more than one entity of a source (entities: entity_id, source)."""
    return classes.join(entities.select("entity_id", "source"), "entity_id").groupBy("cls", "source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def root_clashes(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(cls, n): groups with more than one active-moiety root."""
    return classes.join(roots.filter("is_root"), "entity_id").groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphaned(classes: DataFrame, entities: DataFrame, source: str) -> DataFrame:
    """(entity_id): entities of a source that are alone in their group."""
    alone = classes.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("entity_id")).filter("n = 1")
    return entities.filter(F.col("source") == source).join(alone, "entity_id", "left_semi").select("entity_id")


def approved_groups(classes: DataFrame, events: DataFrame) -> DataFrame:
    """(cls, first, n): groups with an approval, the first date, and how many approvals."""
    return events.filter(F.col("kind").isin(APPROVED)).join(classes, "entity_id").groupBy("cls").agg(F.min("start").alias("first"), F.count(F.lit(1)).alias("n"))


def status_counts(highest: DataFrame) -> DataFrame:
    """(kind, n) of the groups' highest events."""
    return highest.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def shortest(value: Column) -> Column:
    """The shortest of a group's values, the least of equals."""
    return F.min(F.when(value.isNotNull(), F.struct(F.length(value).alias("n"), value.alias("v"))))["v"]


def group_pages(classes: DataFrame, inc: DataFrame, highest: DataFrame, approved: DataFrame) -> DataFrame:
    """One row per group: shortest name, highest event, first approval, identifiers and structures, and whether
    several structures stand in it.  ``highest``: entity_id, kind; ``approved``: cls, first."""
    v = inc.join(classes, "entity_id")
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("key") == k, F.col("value"))))
    values = v.filter(F.col("key").isin("N_Name", "I_UNII", "H_LyChI_L4")).groupBy("cls").agg(shortest(F.when(F.col("key") == "N_Name", F.col("value"))).alias("name"), of("I_UNII").alias("uniis"), of("H_LyChI_L4").alias("structures"))
    best = highest.join(classes, "entity_id").groupBy("cls").agg(F.min("kind").alias("kind"))
    groups = classes.groupBy("cls").agg(F.count(F.lit(1)).alias("size"))
    out = groups.join(values, "cls", "left").join(best, "cls", "left").join(approved.select("cls", "first"), "cls", "left")
    return out.withColumn("several_structures", F.coalesce(F.size("structures") > 1, F.lit(False)))


def generics(products: DataFrame) -> DataFrame:
    """(ingredient, makers): distinct sponsors of each ingredient, most first when ordered so."""
    return products.groupBy("ingredient").agg(F.countDistinct("sponsor").alias("makers"))


def designation_map(designations: DataFrame, diseases: DataFrame) -> DataFrame:
    """(id, disease_id, granted): rare-disease designations and the diseases that their text names, the longest name first."""
    hits = resolve(designations, "id", "text", diseases.select("name"))
    words = F.array_join(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), 0), " ")
    named = hits.join(diseases.select(words.alias("name"), "disease_id"), "name").withColumn("_r", F.rank().over(Window.partitionBy("entity_id").orderBy(F.desc(F.length("name")))))
    return named.filter("_r = 1").join(designations.select(F.col("id").alias("entity_id"), any_date(F.col("date")).alias("granted")), "entity_id").select(F.col("entity_id").alias("id"), "disease_id", "granted").distinct()


