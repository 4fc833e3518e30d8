"""Queries on parts of the graph, kept results, service routes, loader rules and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.api import Graph
from linkloom.operators import algebra as A
from linkloom.operators import cliques as Q
from linkloom.operators import components as C
from linkloom.operators import compound as K
from linkloom.operators import jobs as J
from linkloom.operators import parsers as X
from linkloom.operators import reports as R
from linkloom.operators import resolve as V
from linkloom.operators.linking import manual_values as manual_values_of
from linkloom.operators.linking import shared_value_edges
from linkloom.operators.neighborhood import both_ways
from linkloom.operators.twins import classes_by_scores
from linkloom.plans.compounds import CP_SQL, compounds
from linkloom.plans.derived import EVENTS_SQL, order_events
from linkloom.plans.links import EDGES_SQL
from linkloom.plans.registry import query
from linkloom.sources import loaders as L
from linkloom.sources.views import PARTS_SQL, parts, table, with_components
from linkloom.storage import scratch

one = "*"


def small_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("entity_id"))


TOP_SQL = "(SELECT p_brand || '|' || p_type || '|' || p_size FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f"SELECT p_partkey AS entity_id FROM part WHERE p_brand || '|' || p_type || '|' || p_size = {TOP_SQL} AND p_partkey % 2 = 0")
def component_filter(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    top = inc.filter("key = 'I_CODE'").groupBy("value").count().orderBy(F.desc("count"), "value").first()
    return A.with_value(inc, table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("entity_id")), "I_CODE", top["value"] if top else "")


@query(f"WITH inc AS ({PARTS_SQL}), n AS (SELECT p_partkey AS e FROM part WHERE p_partkey % 10 = 0), c AS (SELECT p_partkey AS e FROM part WHERE p_size < 20) SELECT e AS entity_id FROM n UNION SELECT a.entity_id FROM inc a JOIN inc b USING (key, value) WHERE a.entity_id <> b.entity_id AND a.entity_id IN (SELECT e FROM c) AND b.entity_id IN (SELECT e FROM n) AND key = 'N_Name' AND value < 'M'")
def component_extend(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("entity_id"))
    return A.extended(nodes, small_parts(spark, d), shared_value_edges(parts(spark, d)), ["N_Name"], F.col("value") < "M")


@query(with_components(PARTS_SQL) + ", x AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part) SELECT x.a, x.b, coalesce(p.comp = q.comp, false) AS connected FROM x LEFT JOIN comp p ON p.entity_id = x.a LEFT JOIN comp q ON q.entity_id = x.b")
def connected_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return A.connected(pairs, C.incidence_components(parts(spark, d)))


@query(f"WITH inc AS ({PARTS_SQL}), s AS (SELECT p_partkey AS e FROM part WHERE p_size < 20 AND p_partkey % 3 <> 0), h AS (SELECT key, value, list_sort(list(entity_id)) AS m, count(*) FILTER (WHERE entity_id IN (SELECT e FROM s)) AS k FROM inc GROUP BY key, value HAVING count(*) > 1) SELECT DISTINCT array_to_string(m, ',') AS members FROM h WHERE k >= 2")
def cliques_by_inclusion(spark: SparkSession, d: str) -> DataFrame:
    nodes = small_parts(spark, d).filter("entity_id % 3 <> 0")
    return A.cliques_among(parts(spark, d), nodes, inclusion=2).select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"WITH inc AS (SELECT * FROM ({PARTS_SQL}) WHERE key = 'N_Name' AND entity_id IN (SELECT p_partkey FROM part WHERE p_size < 20)) SELECT array_to_string(list_sort(list(entity_id)), ',') AS members FROM inc GROUP BY value HAVING count(*) > 1")
def cliques_by_label(spark: SparkSession, d: str) -> DataFrame:
    return A.cliques_among(parts(spark, d), small_parts(spark, d), "N_Name").select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(with_components(f"SELECT * FROM ({PARTS_SQL}) WHERE entity_id IN (SELECT p_partkey FROM part WHERE p_size < 20)") + ", z AS (SELECT count(*) AS n FROM comp GROUP BY comp) SELECT sum(n)::BIGINT AS entities, count(*) AS components, count(*) FILTER (WHERE n = 1) AS singletons, (SELECT sum(n * (n - 1) // 2)::BIGINT FROM (SELECT count(*) AS n FROM inc GROUP BY key, value)) AS edges FROM z")
def label_metrics(spark: SparkSession, d: str) -> DataFrame:
    return A.part_metrics(parts(spark, d), small_parts(spark, d))


@query("SELECT count(*) AS n FROM part WHERE p_brand = 'Brand#11' AND p_type = 'ECONOMY'")
def count_labels(spark: SparkSession, d: str) -> DataFrame:
    return A.count_labelled(table(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type").alias("labels")), ["Brand#11", "ECONOMY"])


@query("SELECT p_name || '|' || p_size AS g, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS items FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) < 3")
def small_collections(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.concat_ws("|", "p_name", "p_size").alias("g"), "p_brand")
    return A.small_groups(p, "g", "p_brand", 3).withColumn("items", F.array_join("items", ","))


@query("SELECT 'R1' AS start, 'R1>N' || n_nationkey || coalesce('>S' || s_suppkey, '') AS path FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def depth_first_paths(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("dst"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("src"), F.concat(F.lit("N"), "s_nationkey").alias("dst"))
    edges = n.unionByName(s).withColumn("key", F.lit("R_subClassOf"))
    comp = C.connected_components(edges).withColumnRenamed("node", "entity_id")
    return A.depth_first(edges, comp, spark.createDataFrame([("R1",)], "entity_id string")).withColumn("path", F.array_join("path", ">"))


@query("SELECT p_partkey * 2 AS twice FROM part WHERE p_brand = 'Brand#11'")
def mapped_entities(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.array("p_brand").alias("labels"))

    def double(batches):
        for b in batches:
            yield b[["p_partkey"]].rename(columns={"p_partkey": "twice"}) * 2

    return A.mapped_entities(p, double, "twice long", ["Brand#11"])


@query(f"WITH inc AS ({PARTS_SQL}) SELECT key, sum(n * (n - 1) // 2)::BIGINT AS edges FROM (SELECT key, count(*) AS n FROM inc GROUP BY key, value) GROUP BY key")
def kept_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Made for one version, then read back for the same."""
    path = f"{scratch(spark)}/linkloom/{uuid.uuid4().hex}/metrics"
    make = lambda: A.edge_counts(parts(spark, d)).groupBy("key").agg(F.sum("edges").alias("edges"))
    J.kept(spark, path, "v1", make)
    return J.kept(spark, path, "v1", make)


@query(f"WITH {EVENTS_SQL} SELECT c_custkey AS entity_id, min(start) FILTER (WHERE kind IN ('USApprovalOTC', 'USApprovalRx', 'Marketed') AND jurisdiction = 'US')::VARCHAR AS initially_marketed_first_us, array_to_string(coalesce(list_sort(list_distinct(list_concat(list(kind) FILTER (WHERE kind IS NOT NULL), list(source) FILTER (WHERE kind IS NOT NULL)))), []), ',') AS labels_labels FROM customer LEFT JOIN ev ON entity_id = c_custkey GROUP BY c_custkey")
def calculated_events(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"))
    out = J.calculated(order_events(spark, d), entities, ["initially_marketed", "labels"])
    return out.select("entity_id", F.col("initially_marketed_first_us").cast("string").alias("initially_marketed_first_us"), F.array_join(F.coalesce("labels_labels", F.expr("cast(array() as array<string>)")), ",").alias("labels_labels"))


# --- service routes ------------------------------------------------------------------------------------


def graph(spark: SparkSession, d: str) -> Graph:
    p = table(spark, d, "part")
    entities = p.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("source"), F.array("p_brand", "p_type").alias("labels"), F.when(F.col("p_size") % 10 == 0, "add:NEW").alias("curation"))
    inc = parts(spark, d)
    payloads = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), "l_orderkey", "l_linenumber")
    stitches = p.select((F.col("p_size") % 3).alias("version"), F.concat(F.lit("G"), F.floor(F.col("p_partkey") / 3).cast("string")).alias("sgroup_id"), F.col("p_partkey").alias("root"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), "text")
    return Graph(entities, inc, shared_value_edges(inc), C.incidence_components(inc), payloads, stitches, docs)


@query("SELECT p_partkey AS entity_id FROM part WHERE p_brand = 'Brand#11' ORDER BY p_partkey LIMIT 10 OFFSET 3")
def route_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).entities("Brand#11", 3).select("entity_id")


@query("SELECT p_brand AS source, count(*) AS entities FROM part GROUP BY p_brand")
def route_datasources(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).datasources()


@query(with_components(PARTS_SQL) + " SELECT l_partkey AS entity_id, l_orderkey, l_linenumber FROM lineitem JOIN comp ON entity_id = l_partkey WHERE comp = (SELECT comp FROM comp WHERE entity_id = 7)")
def route_component_payloads(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).component_payloads(7)


@query("SELECT p_size % 3 AS version, 'G' || p_partkey // 3 AS sgroup_id, p_partkey AS root FROM part WHERE p_size % 3 = 2 ORDER BY sgroup_id LIMIT 0")
def route_no_rows(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).latest(0, 0)


@query("SELECT p_size % 3 AS version, 'G' || p_partkey // 3 AS sgroup_id, p_partkey AS root FROM part WHERE 'G' || p_partkey // 3 = 'G5' QUALIFY p_size % 3 = max(p_size % 3) OVER ()")
def route_stitch(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).stitch("G5")


@query("SELECT p_partkey AS entity_id, 'add:NEW' AS curation FROM part WHERE p_size % 10 = 0 ORDER BY p_partkey LIMIT 5")
def route_curations(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).curated().select("entity_id", "curation")


@query(r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), h AS (SELECT doc_id FROM t WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' rights reserved ') AND NOT list_contains(w, 'mit')), c AS (SELECT doc_id, x, count(*) AS f FROM (SELECT doc_id, unnest(w) AS x FROM t) WHERE x IN ('rights', 'reserved') GROUP BY ALL) SELECT doc_id AS entity_id, round(sum(1 + ln(f)), 6) AS score, (SELECT count(*) FROM h) AS total FROM c JOIN h USING (doc_id) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20")
def route_search(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).search('"rights reserved" NOT mit')


@query("SELECT 'R2' AS node, 0 AS depth UNION ALL SELECT 'N' || n_nationkey, 1 FROM nation WHERE n_regionkey = 2")
def route_tree(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    return graph(spark, d).tree(links, "R2")


@query("SELECT 'N3' AS start, 'N3>R' || n_regionkey AS path FROM nation WHERE n_nationkey = 3")
def route_parents(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    return graph(spark, d).parents(links, "N3").withColumn("path", F.array_join("path", ">"))


# --- loader rules --------------------------------------------------------------------------------------


def ontology_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.col("p_name").alias("label"), F.array("p_brand").alias("exact"), F.lower("p_type").alias("types"))


@query("SELECT p_partkey AS entity_id, 'N_Name' AS key, upper(p_name) AS value FROM part UNION SELECT p_partkey, 'R_exactMatch', p_brand FROM part")
def verbatim_keys(spark: SparkSession, d: str) -> DataFrame:
    return L.keyed(ontology_rows(spark, d), "p_partkey", "ontology")


@query("SELECT p_partkey AS entity_id, array_to_string(list_sort([p_brand, lower(p_type)]), ',') AS labels FROM part")
def keyword_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = ontology_rows(spark, d)
    labels = rows.select(F.col("p_partkey").alias("entity_id"), F.col("exact").alias("labels"))
    return L.keyword_labels(rows, "p_partkey", "ontology", labels).withColumn("labels", F.array_join("labels", ","))


@query(f"WITH inc AS ({PARTS_SQL}), c AS (SELECT entity_id AS e, upper(value) AS v FROM inc WHERE key = 'I_CODE') SELECT a.e AS src, b.e AS dst, 'R_hasPhenotype' AS key, CASE WHEN x.p_size % 2 = 0 THEN 'Frequent' END AS frequency FROM part x JOIN c a ON a.v = upper(x.p_brand || '|' || x.p_type || '|' || x.p_size) JOIN part y ON y.p_partkey = x.p_partkey + 1 JOIN c b ON b.v = upper(y.p_brand || '|' || y.p_type || '|' || y.p_size)")
def phenotype_links(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type", "p_size").alias("code"), "p_size")
    rows = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("code").alias("phenotype")), "p_partkey").select(F.col("code").alias("disorder"), "phenotype", F.when(F.col("p_size") % 2 == 0, " Frequent ").otherwise("n/a").alias("frequency"))
    inc = parts(spark, d).withColumn("value", F.upper("value"))
    return L.phenotypes(rows, inc).select("src", "dst", "key", F.col("attrs")["frequency"].alias("frequency"))


@query("SELECT p_partkey AS sample, array_to_string(list_sort(list_distinct([p_name, p_brand])), ';') AS names FROM part WHERE p_size < 20")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("sample"), F.col("p_name").alias("name"), F.col("p_brand").alias("preferred"))
    return L.samples(rows, p.filter("p_size < 20").select(F.col("p_partkey").alias("sample"))).select("sample", F.array_join(F.array_sort("names"), ";").alias("names"))


@query("SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size % 2 = 0 THEN 'Not Available' ELSE p_name END AS name, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS brand FROM part")
def line_cells(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, "NA").otherwise(F.col("p_name"))
    line = F.when(F.col("p_size") % 5 == 0, F.concat_ws("\t", "p_partkey", name)).otherwise(F.concat_ws("\t", F.col("p_partkey").cast("string"), name, "p_brand", F.lit("more")))
    return L.line_records(table(spark, d, "part").select(line.alias("value")), ["id", "name", "brand"])


@query("SELECT p_partkey, p_size % 4 IN (0, 2) AS metal FROM part")
def alkali_metals(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_size") % 4
    smiles = F.when(m == 0, "[Na+]").when(m == 1, "[Ca+2]").when(m == 2, "[K]").otherwise("CC(=O)[O-].[Na+]")
    return table(spark, d, "part").select("p_partkey", L.group_1_metal(smiles).alias("metal"))


@query("""WITH s AS (SELECT p_partkey AS e, 'U' || p_partkey AS u, p_size % 6 AS m, p_size FROM part WHERE p_size % 7 <> 0),
  t AS (SELECT e, u, 'CFR' AS t, CASE m WHEN 0 THEN '21 CFR 520' WHEN 1 THEN '21 CFR 310' ELSE '40 CFR 1' END AS x FROM s UNION ALL SELECT e, u, 'WHO-ATC', 'A' || m FROM s WHERE m = 2 UNION ALL SELECT e, u, 'INN', 'x [INN]' FROM s WHERE m = 3 UNION ALL SELECT e, u, 'USAN', 'rec' FROM s WHERE m = 4)
  SELECT e AS entity_id, t AS comment, x AS product, CASE t WHEN 'CFR' THEN CASE m WHEN 0 THEN 'USAnimalDrug' WHEN 1 THEN 'Marketed' ELSE 'Other' END WHEN 'WHO-ATC' THEN 'Marketed' ELSE 'Clinical' END AS kind, CASE t WHEN 'CFR' THEN 'US' WHEN 'USAN' THEN 'US' END AS jurisdiction FROM (SELECT t.*, s.m FROM t JOIN s USING (e))""")
def substance_events(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_size") % 6
    entries = F.map_from_arrays(F.array(F.lit("CFR"), F.lit("odd type"), F.when(m == 2, "WHO-ATC").when(m == 4, "USAN").when(m == 3, "INN").otherwise("none")), F.array(F.when(m == 0, "21 CFR 520").when(m == 1, "21 CFR 310").otherwise("40 CFR 1"), F.lit("z"), F.when(m == 4, "rec").otherwise(F.concat(F.lit("A"), m.cast("string")))))
    names = F.when(m == 3, F.array(F.lit("a [INN]"), F.lit("plain"), F.lit("x [INN]"))).otherwise(F.array(F.lit("y [CFR]"), F.lit("z [INCI]")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("U"), F.col("p_partkey").cast("string"))).alias("unii"), entries.alias("entries"), names.alias("names"))
    return X.substance_events(rows).select("entity_id", "comment", "product", "kind", "jurisdiction")


# --- reports -------------------------------------------------------------------------------------------


def brand_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of parts by brand and size."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.concat_ws("|", "p_brand", "p_size").alias("cls"))


GROUPS_SQL = "gr AS (SELECT p_partkey AS e, p_brand || '|' || p_size AS cls FROM part)"


@query(f"WITH {GROUPS_SQL}, inc AS ({PARTS_SQL}) SELECT cls, count(DISTINCT value) AS n FROM inc JOIN gr ON e = entity_id WHERE key = 'N_Name' GROUP BY cls HAVING count(DISTINCT value) > 1")
def value_clashes(spark: SparkSession, d: str) -> DataFrame:
    return R.value_clashes(brand_groups(spark, d), parts(spark, d), "N_Name")


@query(f"WITH {GROUPS_SQL}, inc AS ({PARTS_SQL}) SELECT value, count(DISTINCT cls) AS n FROM inc JOIN gr ON e = entity_id WHERE key = 'N_Name' GROUP BY value HAVING count(DISTINCT cls) > 1")
def value_splits(spark: SparkSession, d: str) -> DataFrame:
    return R.value_splits(brand_groups(spark, d), parts(spark, d), "N_Name")


@query(f"WITH {GROUPS_SQL} SELECT cls, p_type AS source, count(*) AS n FROM gr JOIN part ON p_partkey = e GROUP BY ALL HAVING count(*) > 1")
def source_clashes(spark: SparkSession, d: str) -> DataFrame:
    return R.source_clashes(brand_groups(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("source")))


@query(f"WITH {GROUPS_SQL} SELECT min(e) AS entity_id FROM gr JOIN part ON p_partkey = e GROUP BY cls HAVING count(*) = 1 AND min(p_type) = 'SMALL'")
def source_orphans(spark: SparkSession, d: str) -> DataFrame:
    return R.orphaned(brand_groups(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("source")), "SMALL")


@query(f"WITH {EVENTS_SQL}, r AS (SELECT c_custkey AS e, c_nationkey AS cls FROM customer) SELECT cls, min(start)::VARCHAR AS first, count(*) AS n FROM ev JOIN r ON e = entity_id WHERE kind IN ('USApprovalOTC', 'USApprovalRx') GROUP BY cls")
def approved_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").alias("cls"))
    return R.approved_groups(groups, order_events(spark, d)).withColumn("first", F.col("first").cast("string"))


@query(f"WITH {CP_SQL}, {GROUPS_SQL}, v AS (SELECT cls, key, value FROM inc JOIN gr ON e = entity_id) SELECT cls, count(*) AS size, (SELECT value FROM v WHERE v.cls = gr.cls AND key = 'N_Name' ORDER BY length(value), value LIMIT 1) AS name, (SELECT count(DISTINCT value) > 1 FROM v WHERE v.cls = gr.cls AND key = 'H_LyChI_L4') AS several_structures FROM gr GROUP BY cls")
def group_pages(spark: SparkSession, d: str) -> DataFrame:
    _, _, _, inc = compounds(spark, d)
    nothing = spark.createDataFrame([], "entity_id long, kind string")
    pages = R.group_pages(brand_groups(spark, d), inc, nothing, spark.createDataFrame([], "cls string, first date"))
    return pages.select("cls", "size", "name", "several_structures")


@query("SELECT p_name AS ingredient, count(DISTINCT p_brand) AS makers FROM part GROUP BY p_name")
def generic_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.generics(table(spark, d, "part").select(F.col("p_name").alias("ingredient"), F.col("p_brand").alias("sponsor")))


@query()
def strict_clusters(spark: SparkSession, d: str) -> DataFrame:
    _, _, _, inc = compounds(spark, d)
    return R.strict_clusters(inc.withColumn("key", F.when(F.col("key") == "I_UNII", "R_activeMoiety").otherwise(F.col("key"))))


# --- further operators on groups -----------------------------------------------------------------------


@query(with_components(PARTS_SQL) + " SELECT comp, value, n * (n - 1) // 2 AS edges FROM (SELECT comp, value, count(*) AS n FROM inc JOIN comp USING (entity_id) WHERE key = 'N_Name' GROUP BY ALL) WHERE n > 1")
def component_stats(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    return C.component_stats(inc, C.incidence_components(inc), "N_Name")


@query(f"WITH inc AS ({PARTS_SQL}) SELECT array_to_string(m, ',') AS members, key, array_to_string(list_sort(list(value)), ';') AS merged FROM (SELECT key, value, list_sort(list(entity_id)) AS m FROM inc GROUP BY key, value HAVING count(*) > 1) GROUP BY m, key")
def values_of_cliques(spark: SparkSession, d: str) -> DataFrame:
    v = Q.clique_values(parts(spark, d))
    return v.select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "key", F.array_join("merged", ";").alias("merged"))


@query(f"WITH inc AS ({PARTS_SQL}), e AS ({EDGES_SQL}) SELECT src AS entity_id, dst AS neighbor, key, false AS reverse FROM e WHERE key = 'I_CODE' UNION ALL SELECT dst, src, key, true FROM e WHERE key = 'I_CODE'")
def neighbor_visits(spark: SparkSession, d: str) -> DataFrame:
    return both_ways(shared_value_edges(parts(spark, d).filter("key = 'I_CODE'"))).select(F.col("src").alias("entity_id"), F.col("dst").alias("neighbor"), "key", "reverse")


@query(f"WITH inc AS ({PARTS_SQL}) SELECT * FROM inc UNION SELECT unnest([p_partkey, p_partkey - 1]), 'I_CODE', 'M' || p_partkey FROM part WHERE p_partkey % 50 = 1")
def manual_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    manual = table(spark, d, "part").filter("p_partkey % 50 = 1").select(k.alias("src"), (k - 1).alias("dst"), F.lit("I_CODE").alias("key"), F.concat(F.lit("M"), k.cast("string")).alias("value"))
    return manual_values_of(parts(spark, d), manual)


@query(f"WITH {CP_SQL}, {GROUPS_SQL} SELECT cls, arg_min(e, (CASE WHEN EXISTS (SELECT 1 FROM ln WHERE dst = e) AND NOT EXISTS (SELECT 1 FROM ln WHERE src = e) THEN 0 ELSE 1 END, e % 3, e)) AS root FROM gr GROUP BY cls")
def moiety_class_roots(spark: SparkSession, d: str) -> DataFrame:
    info, _, links, _ = compounds(spark, d)
    return K.moiety_class_roots(brand_groups(spark, d), links, info.select("entity_id", (F.col("entity_id") % 3).alias("n")))


@query()
def greedy_cliques(spark: SparkSession, d: str) -> DataFrame:
    return Q.greedy_disjoint(Q.value_cliques(parts(spark, d)))


@query()
def value_classes(spark: SparkSession, d: str) -> DataFrame:
    return V.value_classes(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_partkey").alias("value")).distinct())


@query()
def scored_classes(spark: SparkSession, d: str) -> DataFrame:
    info, _, links, inc = compounds(spark, d)
    return classes_by_scores(inc, info, K.active_roots(info, links), F.lit(3.0))
