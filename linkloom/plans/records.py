"""Queries on the rules of record loaders and event parsers, over the tables' rows in the records' shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import parsers as X
from linkloom.operators import search as S
from linkloom.plans.registry import query
from linkloom.sources import formats
from linkloom.sources import loaders as L
from linkloom.sources import sinks
from linkloom.sources.views import table

text = lambda c: F.col(c).cast("string")


def coded(spark: SparkSession, d: str) -> DataFrame:
    """Nations as entities with a code by region."""
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("entity_id"), F.lit("I_CODE").alias("key"), F.concat(F.lit("UMLS:C"), text("n_regionkey")).alias("value"))


@query("WITH r AS (SELECT 'C' || (n_nationkey % 5) AS a, 'C' || n_regionkey AS b, CASE WHEN n_nationkey % 2 = 0 THEN 'isa' WHEN n_nationkey % 3 = 0 THEN 'part of' END AS rela FROM nation) SELECT x.n_nationkey AS src, y.n_nationkey AS dst, CASE WHEN rela = 'isa' THEN 'R_subClassOf' ELSE 'R_rel' END AS key, rela AS name FROM r JOIN nation x ON 'C' || x.n_regionkey = a JOIN nation y ON 'C' || y.n_regionkey = b WHERE a <> b AND rela IS NOT NULL")
def concept_relations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.concat(F.lit("C"), (k % 5).cast("string")).alias("cui1"), F.concat(F.lit("C"), text("n_regionkey")).alias("cui2"), F.when(k % 2 == 0, "isa").when(k % 3 == 0, "part of").alias("rela"))
    return L.relations(rows, coded(spark, d))


@query("WITH r AS (SELECT p_brand AS omim, CASE WHEN p_size % 4 = 0 THEN '-' ELSE p_name END AS gene, CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'C' || p_size END AS concept FROM part), ok AS (SELECT * FROM r WHERE gene <> '-' AND concept LIKE 'C%') SELECT omim AS src, gene AS dst, 'I_GENE' AS key FROM ok UNION SELECT concept, gene, 'I_GENE' FROM ok UNION SELECT omim, concept, 'I_GENE' FROM ok")
def gene_concept_links(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return L.gene_links(table(spark, d, "part").select(F.col("p_brand").alias("omim"), F.when(s % 4 == 0, "-").otherwise(F.col("p_name")).alias("gene"), F.when(s % 3 == 0, F.col("p_type")).otherwise(F.concat(F.lit("C"), s.cast("string"))).alias("concept")))


@query("SELECT list_sort(list_distinct(['g' || l_suppkey, 'u' || l_suppkey]))[1] AS a, 'g' || l_partkey AS b, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey END AS pmid FROM lineitem WHERE l_returnflag = 'N'")
def protein_interactions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    ref = lambda p, c: F.concat(F.lit(p), text(c))
    human = F.when(F.col("l_returnflag") == "N", "taxid:9606(human)").otherwise("taxid:10090(mouse)")
    rows = li.select(human.alias("taxid_a"), F.lit("taxid:9606").alias("taxid_b"), ref("entrez gene/locuslink:g", "l_suppkey").alias("id_a"), ref("uniprotkb:u", "l_suppkey").alias("alt_a"), F.lit("-").alias("alias_a"),
                     ref("entrez gene/locuslink:g", "l_partkey").alias("id_b"), F.lit("-").alias("alt_b"), F.lit(None).cast("string").alias("alias_b"), F.when(F.col("l_linenumber") % 2 == 0, ref("pubmed:", "l_orderkey")).otherwise("-").alias("publications"))
    return L.interactions(rows).select(F.array_sort("genes_a")[0].alias("a"), F.array_join("genes_b", ",").alias("b"), F.get("pmids", F.lit(0)).alias("pmid"))


@query("SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 'R_subClassOf' AS key FROM nation UNION SELECT 'N' || n_nationkey, 'R' || (n_regionkey + 1) % 5, 'R_subClassOf' FROM nation WHERE n_nationkey % 2 = 0")
def parent_links(spark: SparkSession, d: str) -> DataFrame:
    one, two = F.concat(F.lit("R"), text("n_regionkey")), F.concat(F.lit("R"), ((F.col("n_regionkey") + 1) % 5).cast("string"))
    rows = table(spark, d, "nation").select(F.concat(F.lit("N"), text("n_nationkey")).alias("child"), F.when(F.col("n_nationkey") % 2 == 0, F.array(one, two, one)).otherwise(F.array(one)).alias("parents"))
    return L.child_parent(rows, "child", "parents")


@query("SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst FROM nation UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier")
def nested_classification(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.concat(F.lit("S"), text("s_suppkey")).alias("code"))).alias("children"))
    n = table(spark, d, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.concat(F.lit("N"), text("n_nationkey")).alias("code"), "children")).alias("children"))
    return L.nested_tree(n.select(F.struct(F.concat(F.lit("R"), text("n_regionkey")).alias("code"), "children").alias("node")), 2)


@query("WITH r AS (SELECT CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_brand END AS src, upper(p_type) AS c, p_size FROM part) SELECT src, c AS dst, 'indication_of' AS name FROM r UNION SELECT src, 'RARE ' || p_size % 4, 'offlabel_for' FROM r WHERE p_size % 2 = 0 UNION SELECT src, 'OTHER', 'offlabel_for' FROM r WHERE p_size % 2 = 0")
def indications(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    rows = table(spark, d, "part").select(F.when(s % 3 == 0, " n/a ").otherwise(F.col("p_brand")).alias("unii"), F.col("p_name").alias("drug"), F.lower("p_type").alias("condition"), F.when(s % 2 == 0, F.concat(F.lit("rare "), (s % 4).cast("string"), F.lit("| other|"))).alias("offlabel"))
    return L.conditions(rows)


@query("SELECT ingredient, string_agg(p_partkey::VARCHAR || '=' || strength, ';' ORDER BY lpad(p_partkey::VARCHAR, 9, '0')) AS products FROM (SELECT p_partkey, p_name AS ingredient, p_size || 'mg' AS strength FROM part UNION ALL SELECT p_partkey, p_type, CASE WHEN p_size % 2 = 0 THEN '1g' ELSE 'Not given' END FROM part) GROUP BY ingredient")
def ingredient_products(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    rows = table(spark, d, "part").select(F.lpad(text("p_partkey"), 9, "0").alias("application"), F.col("p_name").alias("product"), F.concat("p_name", F.lit("; "), "p_type").alias("ingredients"), F.when(s % 2 == 0, F.concat(s.cast("string"), F.lit("mg;1g"))).otherwise(F.concat(s.cast("string"), F.lit("mg"))).alias("strength"), F.lit(None).cast("string").alias("date"))
    out = L.by_ingredient(rows)
    return out.select("ingredient", F.array_join(F.zip_with("application", "strength", lambda a, x: F.concat(F.regexp_replace(a, "^0+(?=.)", ""), F.lit("="), x)), ";").alias("products"))


@query("SELECT p_brand AS submitter, count(*) AS n FROM part GROUP BY p_brand")
def submitters(spark: SparkSession, d: str) -> DataFrame:
    return L.submitter_counts(table(spark, d, "part").select(F.col("p_brand").alias("submitter"), F.array("p_name").alias("genes")))[0]


@query("WITH r AS (SELECT CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'A' || p_partkey // 2 END AS unii, 'A' || (p_partkey + 1) // 2 AS m, p_partkey AS k FROM part WHERE p_partkey % 2 = 1) SELECT DISTINCT unii AS src, m AS dst FROM r WHERE unii <> m AND m IN (SELECT unii FROM r WHERE unii IS NOT NULL)")
def moiety_references(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    a = lambda shift: F.concat(F.lit("A"), F.floor((k + shift) / 2).cast("string"))
    rows = table(spark, d, "part").filter(k % 2 == 1).select(F.when(F.col("p_size") % 3 != 0, a(0)).alias("unii"), F.array(a(1)).alias("moieties"))
    return formats.moiety_edges(rows)


# --- events ---------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS entity_id, 'Withdrawn' AS kind, c_mktsegment AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'N' || c_nationkey END AS jurisdiction FROM customer")
def withdrawal_events(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("name"), F.when(n % 2 == 0, F.concat(F.lit("N"), n.cast("string"))).otherwise("NA").alias("country"), F.lit("2001-02-03").alias("date"), F.lit("NA").alias("reason"))
    return X.withdrawals(rows).select("entity_id", "kind", "id", "jurisdiction")


@query("SELECT c_custkey AS entity_id, CASE WHEN c_nationkey % 2 = 0 THEN 'b' ELSE 'a' END AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'US' END AS jurisdiction, '2001-02-03' AS start FROM customer WHERE c_nationkey % 3 <> 0 OR c_nationkey % 2 = 0")
def condition_events(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    first = F.struct(F.lit("a").alias("name"), F.when(n % 3 != 0, "Approved").otherwise("Phase II").alias("highestPhase"), F.lit("http://x").alias("url"), F.lit("2001-02-03").alias("date"))
    second = F.struct(F.lit("b").alias("name"), F.when(n % 2 == 0, "Phase IV").otherwise("Phase I").alias("highestPhase"), F.lit("http://www.fda.gov/x").alias("url"), F.lit("02/03/2001").alias("date"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.base64(F.to_json(F.array(first, second)).cast("binary")).alias("conditions"))
    return X.conditions(rows).select("entity_id", "id", "jurisdiction", text("start").alias("start"))


@query("SELECT c_custkey AS entity_id, 'i' || c_nationkey AS id, c_mktsegment AS product, CASE WHEN c_nationkey % 2 = 0 THEN 'Marketed' ELSE 'Other' END AS kind FROM customer")
def reference_events(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    line = F.concat_ws("|", F.concat(F.lit("i"), n.cast("string")), "c_mktsegment", F.when(n % 2 == 0, "FDA Approved").otherwise("trial"))
    return X.references(table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.concat(line, F.lit("\nno|line")).alias("refs"))).select("entity_id", "id", "product", "kind")


@query("SELECT c_custkey AS entity_id, 'Excipient' AS kind, NULL::VARCHAR AS app_id, c_mktsegment AS route FROM customer UNION ALL SELECT c_custkey, 'USAnimalDrug', CASE WHEN c_custkey % 2 = 0 THEN 'ANADA200-' ELSE 'NADA1-' END || c_custkey, NULL FROM customer WHERE c_nationkey < 10")
def excipient_and_animal_events(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    number = F.concat(F.when(F.col("c_custkey") % 2 == 0, "200-").otherwise("1-"), text("c_custkey"))
    e = X.excipients(c.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("route")))
    a = X.animal_drugs(c.select(F.col("c_custkey").alias("entity_id"), number.alias("application"), F.when(F.col("c_nationkey") < 10, "Approved").otherwise("Voided").alias("status")))
    keep = ["entity_id", "kind", "app_id", "route"]
    return e.select(*keep).unionByName(a.select(*keep))


@query("SELECT c_custkey AS entity_id, c_mktsegment AS product, 'N' || c_nationkey AS jurisdiction, CASE WHEN c_nationkey % 2 = 0 THEN (1990 + c_nationkey) || '-12-31' END AS start FROM customer")
def manufactured_events(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    p = F.struct(F.col("c_mktsegment").alias("name"), F.concat(F.lit("N"), n.cast("string")).alias("country"), F.lit("x").alias("company"), F.when(n % 2 == 0, (n + 1990).cast("string")).otherwise("unknown").alias("year"))
    nameless = F.base64(F.lit('{"country":"N1"}').cast("binary"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.concat_ws("\n", L.encoded(p), nameless).alias("products"))
    return X.manufactured(rows).select("entity_id", "product", "jurisdiction", text("start").alias("start"))


# --- exports, tokens --------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS entity_id, '{\"entity_id\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"payload\":[' || string_agg('{\"s\":' || s_suppkey || '}', ',' ORDER BY s_suppkey) || ']}' AS json FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def entity_json(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("entity_id"), F.col("n_name").alias("name"))
    p = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("entity_id"), F.col("s_suppkey").alias("s"))
    return sinks.entity_documents(n.join(p.select("entity_id").distinct(), "entity_id"), p, spark.createDataFrame([], "src long, dst long, key string"))


@query("SELECT count(*) AS nodes, (SELECT count(*) FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey > b.s_suppkey) AS edges FROM supplier")
def gexf_counts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("label"), "s_nationkey")
    e = s.alias("a").join(s.alias("b"), F.expr("a.s_nationkey = b.s_nationkey and a.entity_id > b.entity_id")).select(F.col("a.entity_id").alias("src"), F.col("b.entity_id").alias("dst"), F.lit("I_CODE").alias("key"), F.col("a.s_nationkey").cast("string").alias("value"))
    nodes, edges = sinks.gexf_elements(s, e)
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each


@query("SELECT conv_id, count(*) AS hits FROM conversations WHERE regexp_matches(lower(text), '(^|[^a-z0-9])you can([^a-z0-9]|$)') GROUP BY conv_id")
def phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "conv_id", "text")
    return S.search_text(turns, "id", "text", '"you can"').join(turns.select(F.col("id").alias("entity_id"), "conv_id"), "entity_id").groupBy("conv_id").agg(F.count(F.lit(1)).alias("hits"))
