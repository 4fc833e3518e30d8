"""Queries on components, metrics, neighbourhoods, cliques and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.model import KEYS, key_table
from linkloom.operators import cliques as Q
from linkloom.operators import components as C
from linkloom.operators import neighborhood as N
from linkloom.operators import paths as P
from linkloom.operators import twins as T
from linkloom.operators.linking import edge_counts, latest, shared_value_edges
from linkloom.plans.links import EDGES_SQL
from linkloom.plans.registry import query
from linkloom.sources.views import DOCS_SQL, PARTIES_SQL, PARTS_SQL, docs, parties, parts, table, with_components

one = "*"


@query(with_components(PARTS_SQL) + " SELECT comp_size, count(*) AS n_components FROM (SELECT count(*) AS comp_size FROM comp GROUP BY comp) GROUP BY comp_size")
def component_histogram(spark: SparkSession, d: str) -> DataFrame:
    sizes = C.component_sizes(C.incidence_components(parts(spark, d)))
    return sizes.groupBy(F.col("size").alias("comp_size")).agg(F.count(one).alias("n_components"))


@query(with_components(PARTIES_SQL) + " SELECT * FROM comp")
def components(spark: SparkSession, d: str) -> DataFrame:
    return C.incidence_components(parties(spark, d))


@query(with_components(DOCS_SQL) + " SELECT * FROM comp")
def document_components(spark: SparkSession, d: str) -> DataFrame:
    return C.incidence_components(docs(spark, d))


@query(with_components(PARTS_SQL) + " SELECT comp, substr(sha1(unhex(string_agg(lpad(printf('%X', entity_id), 16, '0'), '' ORDER BY entity_id))), 1, 9) AS component_id, count(*) AS size FROM comp GROUP BY comp")
def component_id(spark: SparkSession, d: str) -> DataFrame:
    return C.component_key(C.incidence_components(parts(spark, d)))


@query(with_components(PARTS_SQL) + " SELECT comp, size FROM (SELECT comp, count(*) AS size FROM comp GROUP BY comp) ORDER BY size DESC, comp LIMIT 15")
def top_components(spark: SparkSession, d: str) -> DataFrame:
    return C.component_sizes(C.incidence_components(parts(spark, d))).orderBy(F.desc("size"), "comp").limit(15)


@query("SELECT p_partkey AS node FROM part WHERE p_size < 20 AND p_retailprice > 1000")
def component_and(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return C.both(p.filter("p_size < 20").select(F.col("p_partkey").alias("node")), p.filter("p_retailprice > 1000").select(F.col("p_partkey").alias("node")))


@query("SELECT p_partkey AS node FROM part WHERE p_size < 20 OR p_retailprice > 1000")
def component_or(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return C.either(p.filter("p_size < 20").select(F.col("p_partkey").alias("node")), p.filter("p_retailprice > 1000").select(F.col("p_partkey").alias("node")))


@query("SELECT p_partkey AS node FROM part WHERE (p_size < 20) <> (p_retailprice > 1000)")
def component_xor(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return C.only_one(p.filter("p_size < 20").select(F.col("p_partkey").alias("node")), p.filter("p_retailprice > 1000").select(F.col("p_partkey").alias("node")))


@query("SELECT count(*) FILTER (WHERE p_size < 20 AND p_retailprice > 1000) AS shared, count(*) AS n_union, round(count(*) FILTER (WHERE p_size < 20 AND p_retailprice > 1000) / count(*), 6) AS jaccard FROM part WHERE p_size < 20 OR p_retailprice > 1000")
def component_jaccard(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return C.jaccard(p.filter("p_size < 20").select(F.col("p_partkey").alias("node")), p.filter("p_retailprice > 1000").select(F.col("p_partkey").alias("node")))


JACCARD_SQL = "sz AS (SELECT entity_id, count(*) AS n FROM inc GROUP BY entity_id), j AS (SELECT src, dst, ov / (a.n + b.n - ov) AS s FROM (SELECT src, dst, count(*) AS ov FROM e2 GROUP BY src, dst) JOIN sz a ON a.entity_id = src JOIN sz b ON b.entity_id = dst)"


@query(with_components(PARTS_SQL) + f", e2 AS ({EDGES_SQL}), {JACCARD_SQL}, n AS (SELECT comp, count(*) AS size FROM comp GROUP BY comp) SELECT n.comp, size, round(coalesce(sum(s) / (size * (size - 1)), 0), 6) AS potential FROM n LEFT JOIN (SELECT comp, s FROM j JOIN comp ON src = entity_id) p ON p.comp = n.comp GROUP BY n.comp, size")
def component_potential(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    comp = C.incidence_components(inc)
    edges = shared_value_edges(inc)
    size = inc.groupBy("entity_id").agg(F.count(one).alias("n"))
    ov = edges.groupBy("src", "dst").agg(F.count(one).alias("ov"))
    s = ov.join(size.select(F.col("entity_id").alias("src"), F.col("n").alias("a")), "src").join(size.select(F.col("entity_id").alias("dst"), F.col("n").alias("b")), "dst")
    sums = s.join(comp.withColumnRenamed("entity_id", "src"), "src").groupBy("comp").agg(F.sum(F.col("ov") / (F.col("a") + F.col("b") - F.col("ov"))).alias("t"))
    n = F.col("size")
    return C.component_sizes(comp).join(sums, "comp", "left").select("comp", "size", F.round(F.when(n > 1, F.coalesce("t", F.lit(0.0)) / (n * (n - 1))).otherwise(0.0), 6).alias("potential"))


@query(with_components(PARTIES_SQL) + ", x AS (SELECT comp, substr(entity_id, 1, 1) AS s, count(*) AS n FROM comp GROUP BY ALL) SELECT comp, coalesce(sum(n) FILTER (WHERE s = 'C'), 0)::BIGINT AS customers, coalesce(sum(n) FILTER (WHERE s = 'S'), 0)::BIGINT AS suppliers FROM x GROUP BY comp")
def component_labels(spark: SparkSession, d: str) -> DataFrame:
    comp = C.incidence_components(parties(spark, d))
    return comp.groupBy("comp").agg(F.count_if(F.col("entity_id").startswith("C")).alias("customers"), F.count_if(F.col("entity_id").startswith("S")).alias("suppliers"))


@query(f"WITH inc AS ({PARTS_SQL}), e AS ({EDGES_SQL}), deg AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT coalesce(k, 0) AS degree, count(*) AS n_entities FROM (SELECT DISTINCT entity_id FROM inc) LEFT JOIN deg ON id = entity_id GROUP BY 1")
def entity_size_distribution(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    # a value of n entities gives each of them n - 1 edges: no pairs are made
    degree = inc.join(edge_counts(inc), ["key", "value"]).groupBy("entity_id").agg(F.sum(F.col("entities") - 1).alias("degree"))
    return degree.groupBy("degree").agg(F.count(one).alias("n_entities"))


@query(f"WITH inc AS ({PARTS_SQL}), e AS ({EDGES_SQL}) SELECT key, count(*) AS n_edges, count(DISTINCT value) AS n_values FROM e GROUP BY key")
def stitch_histogram(spark: SparkSession, d: str) -> DataFrame:
    return edge_counts(parts(spark, d)).filter("edges > 0").groupBy("key").agg(F.sum("edges").alias("n_edges"), F.count(one).alias("n_values"))


@query(with_components(PARTS_SQL) + f", e2 AS ({EDGES_SQL}), n AS (SELECT count(*) AS size FROM comp GROUP BY comp) SELECT (SELECT count(DISTINCT entity_id) FROM inc) AS entities, (SELECT count(*) FROM e2) AS stitches, (SELECT count(*) FROM n) AS n_components, (SELECT count(*) FROM n WHERE size = 1) AS singletons, (SELECT max(size) FROM n) AS largest")
def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    sizes = C.component_sizes(C.incidence_components(inc))
    edges = edge_counts(inc).agg(F.sum("edges").alias("stitches"))
    return sizes.agg(F.sum("size").alias("entities"), F.count(one).alias("n_components"), F.count_if(F.col("size") == 1).alias("singletons"), F.max("size").alias("largest")).crossJoin(edges)


@query(f"WITH inc AS ({DOCS_SQL}) SELECT key, value, n * (n - 1) // 2 AS n_edges FROM (SELECT key, value, count(*) AS n FROM inc GROUP BY ALL) WHERE n > 1")
def value_distribution(spark: SparkSession, d: str) -> DataFrame:
    return edge_counts(docs(spark, d)).filter("edges > 0").select("key", "value", F.col("edges").alias("n_edges"))


@query(f"WITH inc AS ({PARTS_SQL}) SELECT key, value, n_edges FROM (SELECT key, value, count(*) * (count(*) - 1) // 2 AS n_edges FROM inc GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY n_edges DESC, value) <= 5")
def topk_values(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("n_edges"), "value")
    counts = edge_counts(parts(spark, d)).select("key", "value", F.col("edges").alias("n_edges"))
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r <= 5").drop("_r")


@query(f"WITH inc AS ({PARTIES_SQL}), e AS ({EDGES_SQL}) SELECT key, count(*) AS n FROM e WHERE src LIKE 'S%' OR dst LIKE 'S%' GROUP BY key")
def stitch_count_labels(spark: SparkSession, d: str) -> DataFrame:
    label = F.count_if(F.col("entity_id").startswith("S"))
    per = parties(spark, d).groupBy("key", "value").agg(label.alias("s"), F.count(one).alias("n"))
    # pairs with a labelled end: all pairs less the pairs without
    return per.groupBy("key").agg(F.sum(F.expr("(n * (n - 1) - (n - s) * (n - s - 1)) div 2")).cast("long").alias("n")).filter("n > 0")


@query(with_components(PARTS_SQL) + " SELECT comp, key, value, count(*) AS n FROM inc JOIN comp USING (entity_id) GROUP BY ALL HAVING count(*) > 1")
def component_values(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    return inc.join(C.incidence_components(inc), "entity_id").groupBy("comp", "key", "value").agg(F.count(one).alias("n")).filter("n > 1")


PRIORITY_SQL = "pr AS (SELECT unnest(['I_CODE', 'N_Name']) AS key, unnest([1, 2]) AS priority)"


@query(f"WITH inc AS ({PARTS_SQL}), {PRIORITY_SQL}, e AS ({EDGES_SQL}) SELECT score, count(*) AS n_pairs FROM (SELECT src, dst, sum(priority)::BIGINT AS score FROM e JOIN pr USING (key) GROUP BY src, dst) GROUP BY score")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    edges = shared_value_edges(parts(spark, d)).join(F.broadcast(key_table(spark).select("key", "priority")), "key")
    return edges.groupBy("src", "dst").agg(F.sum("priority").alias("score")).groupBy("score").agg(F.count(one).alias("n_pairs"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 25")
def last_updated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(25).select("event_id", "ts", "event_type")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100")
def page_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").orderBy("p_partkey").offset(100).limit(50).select("p_partkey", "p_name")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def labels_in_use(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(one).alias("n"))


@query(f"WITH inc AS ({PARTS_SQL}), e AS ({EDGES_SQL}) SELECT entity_id, count(DISTINCT o) AS n_neighbors, min(o) AS least, max(o) AS most FROM (SELECT src AS entity_id, dst AS o FROM e UNION ALL SELECT dst, src FROM e) GROUP BY entity_id")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    n = N.neighbors(shared_value_edges(parts(spark, d)))
    return n.groupBy("entity_id").agg(F.count(one).alias("n_neighbors"), F.min("neighbor").alias("least"), F.max("neighbor").alias("most"))


@query(f"WITH inc AS ({PARTS_SQL}), e AS ({EDGES_SQL}) SELECT entity_id, key, array_to_string(list_sort(list(DISTINCT value)), ';') AS merged FROM (SELECT src AS entity_id, key, value FROM e UNION ALL SELECT dst, key, value FROM e) GROUP BY ALL")
def edge_keys(spark: SparkSession, d: str) -> DataFrame:
    return N.edge_keys(parts(spark, d)).withColumn("merged", F.array_join("merged", ";"))


@query(f"WITH inc AS ({PARTS_SQL}), e AS ({EDGES_SQL}) SELECT src, dst, count(DISTINCT key) AS n_keys, count(*) AS n_values, array_to_string(list_sort(list(DISTINCT key)), ',') AS key_list FROM e GROUP BY src, dst")
def triples(spark: SparkSession, d: str) -> DataFrame:
    return N.triples(shared_value_edges(parts(spark, d)))


@query(f"WITH inc AS ({PARTS_SQL}), e2 AS ({EDGES_SQL}), {JACCARD_SQL} SELECT src, dst, round(s, 6) AS similarity FROM j")
def value_jaccard(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    return N.value_jaccard(inc, shared_value_edges(inc))


NEAR_SQL = f"WITH inc AS ({PARTS_SQL}), e AS ({EDGES_SQL}), n AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e), k AS (SELECT a, count(*) AS c FROM n GROUP BY a), s AS (SELECT src, dst, round(count(*) / sqrt(any_value(x.c) * any_value(y.c)), 6) AS similarity FROM (SELECT DISTINCT src, dst FROM e) p JOIN n u ON u.a = src JOIN n v ON v.a = dst AND v.b = u.b JOIN k x ON x.a = src JOIN k y ON y.a = dst GROUP BY src, dst)"


@query(NEAR_SQL + " SELECT * FROM s")
def struct_similarity(spark: SparkSession, d: str) -> DataFrame:
    return T.structural_similarity(parts(spark, d))


@query(NEAR_SQL + " SELECT * FROM s WHERE similarity >= 0.7")
def struct_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return T.structural_similarity(parts(spark, d), 0.7)


SCORE_SQL = f"WITH inc AS ({PARTS_SQL}), {PRIORITY_SQL}, e AS ({EDGES_SQL}), c AS (SELECT key, value, count(*) AS c FROM e GROUP BY ALL), t AS (SELECT key, count(*) AS t FROM e GROUP BY key), z AS (SELECT entity_id, key, count(*) AS n FROM inc GROUP BY ALL), q AS (SELECT src, dst, key, count(*) AS ov, sum(ln(c / t)) AS l FROM e JOIN c USING (key, value) JOIN t USING (key) GROUP BY ALL), sc AS (SELECT src, dst, round(-sum(ov / (a.n + b.n - ov) * priority * l), 6) AS score FROM q JOIN pr USING (key) JOIN z a ON a.entity_id = src AND a.key = q.key JOIN z b ON b.entity_id = dst AND b.key = q.key GROUP BY src, dst)"


@query(SCORE_SQL + " SELECT * FROM sc")
def triple_score(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    return N.triple_scores(inc, shared_value_edges(inc), key_table(spark))


@query(SCORE_SQL + " SELECT count(*) AS n, round(greatest(median(score) - min(score), avg(score) - median(score)), 5) AS threshold FROM sc")
def triples_threshold(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    s = N.triple_scores(inc, shared_value_edges(inc), key_table(spark))
    return s.agg(F.count(one).alias("n"), F.round(F.greatest(F.median("score") - F.min("score"), F.avg("score") - F.median("score")), 5).alias("threshold"))


CLIQUES_SQL = f"WITH inc AS ({PARTS_SQL}), h AS (SELECT key, value, list_sort(list(entity_id)) AS m FROM inc GROUP BY ALL HAVING count(*) > 1), q AS (SELECT m, list_sort(list(DISTINCT key)) AS k, count(*) AS n_values, len(m) AS size FROM h GROUP BY m)"


@query(CLIQUES_SQL + " SELECT array_to_string(m, ',') AS members, array_to_string(k, ',') AS keys, n_values, size FROM q")
def value_cliques(spark: SparkSession, d: str) -> DataFrame:
    return Q.value_cliques(parts(spark, d)).select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.array_join("keys", ",").alias("keys"), "n_values", F.col("size").cast("long").alias("size"))


@query(CLIQUES_SQL + " SELECT array_to_string(a.m, ',') AS members FROM q a WHERE NOT EXISTS (SELECT 1 FROM q b WHERE b.size > a.size AND list_has_all(b.m, a.m))")
def maximal_cliques(spark: SparkSession, d: str) -> DataFrame:
    return Q.maximal(Q.value_cliques(parts(spark, d))).select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(CLIQUES_SQL + " SELECT array_to_string(m, ',') AS members, round((CASE WHEN list_contains(k, 'N_Name') THEN 2 ELSE 1 END) * power(size, 0.3) * power(len(k), 0.7), 6) AS potential FROM q")
def clique_potential(spark: SparkSession, d: str) -> DataFrame:
    return Q.potential(Q.value_cliques(parts(spark, d))).select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "potential")


@query(CLIQUES_SQL + f" SELECT array_to_string(m, ',') AS members, list_sum(list_transform(k, lambda x: CASE WHEN x = 'N_Name' THEN {1 << list(KEYS).index('N_Name')} ELSE {1 << list(KEYS).index('I_CODE')} END))::BIGINT AS rank, size FROM q")
def clique_rank(spark: SparkSession, d: str) -> DataFrame:
    return Q.value_cliques(parts(spark, d)).select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), Q.key_rank().alias("rank"), F.col("size").cast("long").alias("size"))


@query(CLIQUES_SQL + ", x AS (SELECT unnest(m) AS e, m FROM q), y AS (SELECT e FROM x GROUP BY e HAVING count(*) > 1) SELECT array_to_string(m, ',') AS members FROM q WHERE NOT EXISTS (SELECT 1 FROM y WHERE list_contains(q.m, y.e))")
def high_confidence_cliques(spark: SparkSession, d: str) -> DataFrame:
    return Q.high_confidence(Q.value_cliques(parts(spark, d))).select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(CLIQUES_SQL + " SELECT array_to_string(a.m, ',') AS members, array_to_string(list_sort(list_distinct(list_concat(a.k, coalesce(flatten((SELECT list(b.k) FROM q b WHERE b.m <> a.m AND (list_has_all(b.m, a.m) OR list_has_all(a.m, b.m)))), [])))), ',') AS keys FROM q a")
def clique_key_propagation(spark: SparkSession, d: str) -> DataFrame:
    return Q.propagate_keys(Q.value_cliques(parts(spark, d))).select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.array_join("keys", ",").alias("keys"))


@query(f"WITH inc AS ({PARTS_SQL}), h AS (SELECT key, value, count(*) AS n FROM inc GROUP BY ALL HAVING count(*) > 1) SELECT key, value, n, n * (n - 1) // 2 AS n_edges FROM h")
def clique_values(spark: SparkSession, d: str) -> DataFrame:
    return edge_counts(parts(spark, d)).filter("entities > 1").select("key", "value", F.col("entities").alias("n"), F.col("edges").alias("n_edges"))


@query(f"WITH inc AS ({PARTS_SQL}) SELECT inc.key, array_to_string(list_sort(list(entity_id)), ',') AS members FROM inc GROUP BY inc.key, value HAVING count(*) > 1")
def component_cliques(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    found = Q.key_cliques(inc, C.incidence_components(inc))
    return found.select("key", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent): supplier -> nation -> region."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("child"), F.concat(F.lit("N"), "s_nationkey").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    return s.unionByName(n)


@query("SELECT 'S' || s_suppkey AS start, 'S' || s_suppkey || '>N' || s_nationkey || '>R' || n_regionkey AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'N' || n_nationkey, 'N' || n_nationkey || '>R' || n_regionkey FROM nation")
def parent_paths(spark: SparkSession, d: str) -> DataFrame:
    return P.ancestor_paths(tree(spark, d)).select("start", F.array_join("path", ">").alias("path"))


@query("SELECT 'R1' AS node, 0 AS depth UNION ALL SELECT 'N' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'S' || s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1")
def tree_depth(spark: SparkSession, d: str) -> DataFrame:
    return P.depths(tree(spark, d), spark.sql("select 'R1' as node"))


@query("SELECT 'S' || s_suppkey AS node FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey = 2 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def leaf_descendants(spark: SparkSession, d: str) -> DataFrame:
    return P.leaves(tree(spark, d), spark.sql("select 'R2' as node"))


@query("SELECT 'S1>N' || s_nationkey || '>R' || n_regionkey AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 1")
def bfs_path(spark: SparkSession, d: str) -> DataFrame:
    edges = tree(spark, d).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    region = table(spark, d, "supplier").filter("s_suppkey = 1").join(table(spark, d, "nation"), F.expr("n_nationkey = s_nationkey")).first()["n_regionkey"]
    return P.bfs_path(edges, "S1", f"R{region}").select(F.array_join("path", ">").alias("path"))


@query("WITH e AS (SELECT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b FROM nation UNION SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation) SELECT 'N0' AS start, b AS node, 1 AS hops FROM e WHERE a = 'N0' UNION SELECT 'N0', y.b, 2 FROM e x JOIN e y ON y.a = x.b WHERE x.a = 'N0' AND y.b <> 'N0'")
def khop_match(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("dst"))
    return P.within_hops(e, spark.sql("select 'N0' as node"), 2)


@query(f"WITH inc AS ({PARTS_SQL}) SELECT DISTINCT b.entity_id FROM inc a JOIN inc b USING (key, value) WHERE a.entity_id = 7")
def expand_entity(spark: SparkSession, d: str) -> DataFrame:
    return P.expand(parts(spark, d), 7)


@query(f"WITH inc AS ({PARTS_SQL}), {PRIORITY_SQL}, e AS ({EDGES_SQL}), s AS (SELECT src, dst, sum(priority) AS w FROM e JOIN pr USING (key) GROUP BY ALL), b AS (SELECT src AS a, dst AS b, w FROM s UNION ALL SELECT dst, src, w FROM s) SELECT a AS entity_id, b AS best, w::BIGINT AS score FROM b QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) = 1")
def closest_neighbor(spark: SparkSession, d: str) -> DataFrame:
    e = shared_value_edges(parts(spark, d)).join(F.broadcast(key_table(spark).select("key", "priority")), "key").groupBy("src", "dst").agg(F.sum("priority").alias("score"))
    return latest(N.both_ways(e), "src", F.desc("score"), F.asc("dst")).select(F.col("src").alias("entity_id"), F.col("dst").alias("best"), "score")


@query("""WITH RECURSIVE inc AS (""" + PARTS_SQL + """), pr AS (SELECT unnest(['I_CODE', 'N_Name']) AS key, unnest([1, 2]) AS priority), e AS (""" + EDGES_SQL + """), s AS (SELECT src, dst, sum(priority) AS w FROM e JOIN pr USING (key) GROUP BY ALL), b AS (SELECT src AS a, dst AS b, w FROM s UNION ALL SELECT dst, src, w FROM s), k AS (SELECT a, b FROM b WHERE w >= 2 QUALIFY rank() OVER (PARTITION BY a ORDER BY w DESC) = 1), u AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT entity_id, least(entity_id, coalesce(min(b), entity_id)) AS comp FROM (SELECT DISTINCT entity_id FROM inc) LEFT JOIN r ON a = entity_id GROUP BY entity_id""")
def scored_components(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    e = shared_value_edges(inc).join(F.broadcast(key_table(spark).select("key", "priority")), "key").groupBy("src", "dst").agg(F.sum("priority").alias("score")).filter("score >= 2")
    best = N.both_ways(e).withColumn("_r", F.rank().over(Window.partitionBy("src").orderBy(F.desc("score")))).filter("_r = 1")
    comp = C.connected_components(best.select("src", "dst"))
    return inc.select("entity_id").distinct().join(comp, F.col("entity_id") == F.col("node"), "left").select("entity_id", F.coalesce("comp", "entity_id").alias("comp"))
