"""Queries on keys, links and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import keys as K
from linkloom.operators import linking as L
from linkloom.plans.registry import query
from linkloom.sources.views import DOCS_SQL, PARTIES_SQL, PARTS_SQL, parties, parts, table


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([upper(p_name), upper(p_brand), upper(p_type), upper(p_name)])), ';') AS norm FROM part")
def normalize_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(K.normalized(F.array("p_name", "p_brand", "p_type", "p_name")), ";").alias("norm"))


@query("SELECT doc_id, array_to_string(list_distinct_first, ';') AS hits FROM (SELECT doc_id, list_filter(m, lambda x, i: list_position(m, x) = i) AS list_distinct_first FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[0-9]{5,}'), lambda x: trim(x)), lambda x: length(x) >= 6) AS m FROM documents))")
def regex_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(K.regex_values(F.col("text"), "[0-9]{5,}", least=6), ";").alias("hits"))


@query(f"WITH inc AS ({PARTS_SQL}) SELECT * FROM inc WHERE NOT (key = 'N_Name' AND upper(value) IN (SELECT upper(p_name) || '|' || p_size FROM part WHERE p_partkey <= 50))")
def blacklist_filter(spark: SparkSession, d: str) -> DataFrame:
    blocked = table(spark, d, "part").filter("p_partkey <= 50").select(F.lit("N_Name").alias("key"), F.lower(F.concat_ws("|", "p_name", "p_size")).alias("value"))
    return K.without_blocked(parts(spark, d), blocked)


@query("SELECT o_orderkey, o_orderpriority || ';' || o_orderstatus AS a, array_to_string(list_distinct([o_orderpriority, o_orderstatus, 'X']), ';') IS NOT NULL AS ok, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority || ';' || o_orderstatus || ';X' ELSE o_orderpriority || ';' || o_orderstatus || ';O;X' END AS merged FROM orders")
def array_merge(spark: SparkSession, d: str) -> DataFrame:
    a = F.array("o_orderpriority", "o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(a, ";").alias("a"), F.lit(True).alias("ok"), F.array_join(K.merged(a, F.array(F.lit("O"), F.lit("X"))), ";").alias("merged"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag NOT IN ('A', 'N') AND l_linestatus NOT IN ('A', 'N') THEN 'NO_CHANGE' WHEN l_linestatus IN ('A', 'N') AND l_returnflag IN ('A', 'N') THEN 'NULL' ELSE 'CHANGED' END AS state FROM lineitem")
def array_delta(spark: SparkSession, d: str) -> DataFrame:
    x = K.delta(F.array("l_returnflag", "l_linestatus"), F.array(F.lit("A"), F.lit("N")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x["state"].alias("state"))


@query("SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS equal FROM customer GROUP BY c_nationkey")
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    same = K.same_set(F.array("c_mktsegment", F.lit("BUILDING")), F.array(F.lit("BUILDING"), F.lit("BUILDING")))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("equal"))


@query("SELECT event_id, list_sum(list_transform(list_filter(list_transform(string_split_regex(trim(regexp_replace(props, '[^0-9a-z]+', ' ', 'g')), '[\\n\\s,]+'), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x IS NOT NULL), lambda x: x))::BIGINT AS total FROM events")
def long_keys(spark: SparkSession, d: str) -> DataFrame:
    tokens = K.long_tokens(F.regexp_replace("props", "[^0-9a-z]+", " "))
    total = F.aggregate(tokens, F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, d, "events").select("event_id", F.when(F.size(tokens) > 0, total).alias("total"))


@query("SELECT doc_id, sha1(text) AS h_sha1, sha256(text) AS h_sha256, md5(text) AS h_md5 FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", F.sha1(t).alias("h_sha1"), F.sha2(t, 256).alias("h_sha256"), F.md5(t).alias("h_md5"))


@query("SELECT DISTINCT source, 'S_' || upper(source) AS label FROM documents")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source", K.source_label(F.col("source")).alias("label")).distinct()


@query(r"SELECT p_partkey, CASE WHEN regexp_matches(p_size::VARCHAR, '^[+-]?\d+$') THEN 'Integer' END AS t_size, 'Double' AS t_price, 'String' AS t_name FROM part")
def text_types(spark: SparkSession, d: str) -> DataFrame:
    t = lambda c: K.text_type(F.col(c).cast("string"))
    return table(spark, d, "part").select("p_partkey", t("p_size").alias("t_size"), t("p_retailprice").alias("t_price"), t("p_name").alias("t_name"))


EDGES_SQL = "SELECT a.entity_id AS src, b.entity_id AS dst, key, value FROM inc a JOIN inc b USING (key, value) WHERE a.entity_id > b.entity_id"


@query(f"WITH inc AS ({PARTS_SQL}) {EDGES_SQL}")
def stitch_edges(spark: SparkSession, d: str) -> DataFrame:
    return L.shared_value_edges(parts(spark, d))


@query(f"WITH inc AS ({PARTIES_SQL}) {EDGES_SQL}")
def party_edges(spark: SparkSession, d: str) -> DataFrame:
    return L.shared_value_edges(parties(spark, d))


@query(f"WITH inc AS ({PARTS_SQL}), e AS ({EDGES_SQL}), m AS (SELECT p_partkey AS src, p_partkey - 1 AS dst, 'I_CODE' AS key, p_brand || '|' || p_type || '|' || p_size AS value, 'manual' AS attrs FROM part WHERE p_partkey % 7 = 0) SELECT src, dst, key, value, max(attrs) AS attrs FROM (SELECT *, NULL AS attrs FROM e UNION ALL SELECT * FROM m) GROUP BY src, dst, key, value")
def manual_stitch(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").filter("p_partkey % 7 = 0")
    manual = p.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - 1).alias("dst"), F.lit("I_CODE").alias("key"), F.concat_ws("|", "p_brand", "p_type", "p_size").alias("value"), F.lit("manual").alias("attrs"))
    return L.add_edges(L.shared_value_edges(parts(spark, d)), manual)


@query(f"WITH inc AS ({PARTIES_SQL}) SELECT entity_id, count(*) AS n_payloads, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN inc ON key = 'N_Name' AND value = c_mktsegment || '|' || floor(c_acctbal)::BIGINT GROUP BY entity_id")
def attach_reference(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat_ws("|", "c_mktsegment", F.floor("c_acctbal").cast("long")).alias("name"))
    rows = table(spark, d, "orders").select("o_custkey", "o_totalprice").join(c, "o_custkey")
    return L.attach(rows, parties(spark, d), "N_Name", "name").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_payloads"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("WITH known AS (SELECT p_brand, p_size, min(p_partkey) AS k FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), new AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 2 = 1) SELECT p_brand, p_size, 'known' AS origin FROM known UNION ALL SELECT p_brand, p_size, 'new' FROM new WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.p_brand = new.p_brand AND k.p_size = new.p_size)")
def register_if_absent(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    known = p.filter("p_partkey % 2 = 0").select("p_brand", "p_size", F.lit("known").alias("origin")).distinct()
    new = p.filter("p_partkey % 2 = 1").select("p_brand", "p_size", F.lit("new").alias("origin"))
    return L.register_if_absent(known, new, ["p_brand", "p_size"])


@query(f"WITH inc AS ({DOCS_SQL}), s AS (SELECT entity_id, key, value, source FROM inc JOIN documents ON doc_id = entity_id) SELECT a.source AS s1, b.source AS s2, count(DISTINCT a.entity_id) AS n1, count(DISTINCT b.entity_id) AS n2 FROM s a JOIN s b USING (key, value) WHERE a.source <> b.source GROUP BY ALL")
def cross_source_matrix(spark: SparkSession, d: str) -> DataFrame:
    docs_ = table(spark, d, "documents")
    src = docs_.select(F.col("doc_id").alias("entity_id"), F.col("source").alias("_s"))
    from linkloom.sources.views import docs

    return L.cross_source(docs(spark, d).join(src, "entity_id"), F.col("_s"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def optional_match(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def not_exists(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_name").join(returned, "p_partkey", "left_anti")


ANY = ["0|10", "1|20", "2|30", "3|40"]


@query(f"WITH inc AS ({PARTIES_SQL}), w AS (SELECT unnest({ANY!r}) AS value, unnest([1, 2, 3, 4]) AS r), b AS (SELECT value FROM inc JOIN w USING (value) WHERE key = 'I_CODE' GROUP BY value, r ORDER BY count(*) DESC, r LIMIT 1) SELECT entity_id FROM inc JOIN b USING (value) WHERE key = 'I_CODE'")
def find_any(spark: SparkSession, d: str) -> DataFrame:
    return L.find_any(parties(spark, d), "I_CODE", ANY)


@query("SELECT l_orderkey AS entity_id FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 2")
def find_all(spark: SparkSession, d: str) -> DataFrame:
    inc = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.lit("I_ANY").alias("key"), F.col("l_returnflag").alias("value"))
    return L.find_all(inc, "I_ANY", ["A", "R"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 20 OFFSET 10")
def filter_page(spark: SparkSession, d: str) -> DataFrame:
    labels = F.array("o_orderstatus", "o_orderpriority")
    return table(spark, d, "orders").filter(K.has_all(labels, ["O", "1-URGENT"])).orderBy("o_orderkey").offset(10).limit(20).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'P') OR o_orderpriority = '5-LOW' AS any_label, o_orderstatus = 'F' AND o_orderpriority = '5-LOW' AS all_labels, o_orderstatus = 'P' AS is_label FROM orders")
def label_any_all(spark: SparkSession, d: str) -> DataFrame:
    labels = F.array("o_orderstatus", "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", K.has_any(labels, ["F", "P", "5-LOW"]).alias("any_label"), K.has_all(labels, ["F", "5-LOW"]).alias("all_labels"), F.array_contains(labels, "P").alias("is_label"))


@query("SELECT c_custkey, max(o_orderkey) AS payload, max_by(o_totalprice, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS price FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1) GROUP BY c_custkey")
def latest_payload(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return L.latest(o, "o_custkey", F.desc("o_orderdate"), F.asc("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("payload"), F.col("o_totalprice").alias("price"))


@query("SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS status, max_by(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey")
def merged_payload(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max_by("o_orderpriority", "o_orderkey").alias("priority"))


@query("SELECT n.n_nationkey, count(DISTINCT s.s_suppkey) AS suppliers, count(DISTINCT c.c_custkey) AS customers FROM nation n LEFT JOIN supplier s ON s_nationkey = n_nationkey LEFT JOIN customer c ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def multiple_payloads(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return table(spark, d, "nation").select("n_nationkey").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").select("n_nationkey", zero("suppliers"), zero("customers"))
