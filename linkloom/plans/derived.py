"""Queries on resolution, events, search, curation, parsing and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.operators import components as C
from linkloom.operators import curate as U
from linkloom.operators import events as E
from linkloom.operators import resolve as R
from linkloom.operators import search as S
from linkloom.operators.linking import shared_value_edges
from linkloom.plans.links import EDGES_SQL
from linkloom.plans.registry import query
from linkloom.sources import formats
from linkloom.sources import sinks
from linkloom.sources.views import PARTIES_SQL, PARTS_SQL, parties, parts, table, with_components

one = "*"

# --- resolution -------------------------------------------------------------------------------------

CODE_SQL = f"WITH RECURSIVE inc AS ({PARTS_SQL}), e AS ({EDGES_SQL}), k AS (SELECT src AS a, dst AS b FROM e WHERE key = '{{}}'), u AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)"


@query(CODE_SQL.format("I_CODE") + " SELECT a AS node, least(a, min(b)) AS comp FROM r GROUP BY a")
def mergers_by_key(spark: SparkSession, d: str) -> DataFrame:
    return R.merge_free(parts(spark, d), ["I_CODE"])


@query("WITH RECURSIVE k AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND floor(a.s_acctbal / 1000) = floor(b.s_acctbal / 1000) AND a.s_suppkey > b.s_suppkey), u AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS node, least(a, min(b)) AS comp FROM r GROUP BY a")
def exact_match_merge(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.lit("R_exactMatch").alias("key"), F.concat_ws("|", "s_nationkey", F.floor(F.col("s_acctbal") / 1000)).alias("value"))
    return R.merge_free(s, ["R_exactMatch", "R_equivalentClass"])


def _entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts with a guard (brand) and roots (the dearest of a brand and size), and their incidence rows."""
    w = Window.partitionBy("p_brand", "p_size").orderBy(F.desc("p_retailprice"), "p_partkey")
    p = table(spark, d, "part").withColumn("is_root", F.row_number().over(w) == 1).select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("guard"), "is_root")
    return p, parts(spark, d)


@query()
def untangle(spark: SparkSession, d: str) -> DataFrame:
    return R.guarded_values(*_entities(spark, d))


@query()
def sgroups(spark: SparkSession, d: str) -> DataFrame:
    entities, inc = _entities(spark, d)
    return R.sgroups(R.guarded_values(entities, inc), entities, 1)


@query("SELECT p_brand || '|' || p_size AS cls, arg_max(p_partkey, (p_retailprice > 1000, -p_partkey)) AS root, count(*) AS rank FROM part GROUP BY 1")
def class_root(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    classes = p.select(F.col("p_partkey").alias("entity_id"), F.concat_ws("|", "p_brand", "p_size").alias("cls"))
    return R.class_root(classes, p.select(F.col("p_partkey").alias("entity_id"), (F.col("p_retailprice") > 1000).alias("is_root")))


@query(CODE_SQL.format("N_Name") + """, cl AS (SELECT entity_id, least(entity_id, coalesce(min(b), entity_id)) AS cls FROM (SELECT DISTINCT entity_id FROM inc) LEFT JOIN r ON a = entity_id GROUP BY entity_id),
  sz AS (SELECT cls, count(*) AS n FROM cl GROUP BY cls), al AS (SELECT entity_id FROM cl JOIN sz USING (cls) WHERE n = 1), mp AS (SELECT entity_id, cls FROM cl JOIN sz USING (cls) WHERE n > 1),
  nb AS (SELECT src AS entity_id, dst AS o, key FROM e UNION ALL SELECT dst, src, key FROM e), per AS (SELECT nb.entity_id, key, count(DISTINCT cls) AS n, min(cls) AS cls FROM nb JOIN al USING (entity_id) JOIN mp ON mp.entity_id = o GROUP BY ALL)
  SELECT entity_id, min(cls) AS target FROM per GROUP BY entity_id HAVING max(n) = 1""")
def singleton_merge(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    classes = R.merge_free(inc, ["N_Name"]).select(F.col("node").alias("entity_id"), F.col("comp").alias("cls"))
    return R.singletons_merged(inc.select("entity_id").distinct().join(classes, "entity_id", "left_anti"), inc, classes)


@query("WITH i AS (SELECT DISTINCT l_suppkey AS e, l_partkey AS v FROM lineitem), s AS (SELECT v, count(*) AS n FROM i GROUP BY v), p AS (SELECT x.v AS a, y.v AS b, count(*) AS ov FROM i x JOIN i y ON x.e = y.e AND x.v < y.v GROUP BY ALL) SELECT a, b, round(ov / (m.n + n.n - ov), 6) AS similarity FROM p JOIN s m ON m.v = a JOIN s n ON n.v = b WHERE ov / (m.n + n.n - ov) > 0.4")
def value_similarity(spark: SparkSession, d: str) -> DataFrame:
    return R.value_groups(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_partkey").alias("value")).distinct())


@query()
def plsa(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    return R.plsa(inc, C.incidence_components(inc))


# --- events -----------------------------------------------------------------------------------------

KIND_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'USApprovalRx' WHEN '2-HIGH' THEN 'USApprovalOTC' WHEN '3-MEDIUM' THEN 'Marketed' WHEN '4-NOT SPECIFIED' THEN 'Clinical' ELSE 'Withdrawn' END"
PHASE_SQL = "CASE o_orderstatus WHEN 'F' THEN 'Phase 3' WHEN 'O' THEN 'Phase 1' ELSE 'Phase 2' END"
EVENTS_SQL = f"ev AS (SELECT o_custkey AS entity_id, {KIND_SQL} AS kind, o_orderstatus AS source, 'E' || (o_orderkey % 50) AS id, o_orderdate::DATE AS start, CASE WHEN c_nationkey < 12 THEN 'US' ELSE 'XX' END AS jurisdiction, {PHASE_SQL} AS comment, o_orderkey AS k FROM orders JOIN customer ON c_custkey = o_custkey)"


def order_events(spark: SparkSession, d: str) -> DataFrame:
    """An order is an event of its customer: priority as kind, status as source and phase."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "USApprovalRx").when(p == "2-HIGH", "USApprovalOTC").when(p == "3-MEDIUM", "Marketed").when(p == "4-NOT SPECIFIED", "Clinical").otherwise("Withdrawn")
    s = F.col("o_orderstatus")
    return E.event(o, F.col("o_custkey"), kind=kind, source=s, id=F.concat(F.lit("E"), F.col("o_orderkey") % 50), start=F.col("o_orderdate"), jurisdiction=F.when(F.col("c_nationkey") < 12, "US").otherwise("XX"),
                   comment=F.when(s == "F", "Phase 3").when(s == "O", "Phase 1").otherwise("Phase 2"), product=F.col("o_orderkey").cast("string"))


@query(f"WITH {EVENTS_SQL} SELECT entity_id, kind, source, count(*) AS n, min(start)::VARCHAR AS first FROM ev GROUP BY ALL")
def event_union(spark: SparkSession, d: str) -> DataFrame:
    return order_events(spark, d).groupBy("entity_id", "kind", "source").agg(F.count(one).alias("n"), F.min("start").cast("string").alias("first"))


@query(f"WITH {EVENTS_SQL} SELECT entity_id, CASE WHEN r > 1 THEN id || ':' || r ELSE id END AS id FROM (SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id, id) AS r FROM ev)")
def event_id_dedup(spark: SparkSession, d: str) -> DataFrame:
    return E.numbered_ids(order_events(spark, d)).select("entity_id", "id")


@query(f"WITH {EVENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE kind WHEN 'USApprovalOTC' THEN 0 WHEN 'USApprovalRx' THEN 1 WHEN 'Marketed' THEN 6 WHEN 'Withdrawn' THEN 8 ELSE 9 END, CASE WHEN kind = 'Clinical' THEN CASE comment WHEN 'Phase 3' THEN -6 WHEN 'Phase 2' THEN -4 ELSE -2 END ELSE 0 END, id) AS r FROM ev) SELECT entity_id, kind, id, CASE WHEN kind = 'Clinical' THEN comment END AS phase FROM r WHERE r = 1")
def highest_status(spark: SparkSession, d: str) -> DataFrame:
    return E.highest(order_events(spark, d))


@query(f"WITH {EVENTS_SQL} SELECT entity_id, min(start) FILTER (WHERE kind IN ('USApprovalOTC', 'USApprovalRx', 'Marketed'))::VARCHAR AS first_any, min(start) FILTER (WHERE kind IN ('USApprovalOTC', 'USApprovalRx', 'Marketed') AND jurisdiction = 'US')::VARCHAR AS first_us FROM ev GROUP BY entity_id")
def initially_marketed(spark: SparkSession, d: str) -> DataFrame:
    return E.initially_marketed(order_events(spark, d)).withColumns({c: F.col(c).cast("string") for c in ("first_any", "first_us")})


@query(f"WITH {EVENTS_SQL} SELECT entity_id, id FROM ev WHERE kind IN ('USApprovalOTC', 'USApprovalRx') AND jurisdiction = 'US' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY start DESC, id DESC) = 1")
def us_approved(spark: SparkSession, d: str) -> DataFrame:
    return E.us_approved(order_events(spark, d))


@query(f"WITH {EVENTS_SQL} SELECT entity_id, array_to_string(list_sort(list_distinct(list_concat(list(kind), list(source)))), ',') AS labels FROM ev GROUP BY entity_id")
def event_labels(spark: SparkSession, d: str) -> DataFrame:
    return E.labels(order_events(spark, d)).withColumn("labels", F.array_join("labels", ","))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'returned' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'accepted' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'open' END, 'other') AS status FROM lineitem")
def status_lookup(spark: SparkSession, d: str) -> DataFrame:
    logic = spark.createDataFrame([("R", "F", "returned"), ("A", "F", "accepted"), ("N", "O", "open")], "l_returnflag string, l_linestatus string, status string")
    return E.with_status(table(spark, d, "lineitem"), F.broadcast(logic), ["l_returnflag", "l_linestatus"], "other").select("l_orderkey", "l_linenumber", "status")


INTERVALS_SQL = "i AS (SELECT l_suppkey AS g, l_returnflag AS f, l_orderkey * 10 + l_linenumber AS k, l_shipdate AS s, CASE WHEN l_quantity < 45 THEN l_shipdate + to_days((l_quantity * 3)::INT) END AS t FROM lineitem)"


@query(f"WITH {INTERVALS_SQL} SELECT g, f, k FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE b.g = a.g AND b.f = a.f AND b.k <> a.k AND b.s <= a.s AND coalesce(b.t, TIMESTAMP '9999-12-31') >= coalesce(a.t, TIMESTAMP '9999-12-31') AND (b.s < a.s OR coalesce(b.t, TIMESTAMP '9999-12-31') > coalesce(a.t, TIMESTAMP '9999-12-31') OR b.k < a.k))")
def interval_dedupe(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("f"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_shipdate").alias("s"),
                                            F.when(F.col("l_quantity") < 45, F.expr("timestampadd(DAY, cast(l_quantity * 3 as int), l_shipdate)")).alias("t"))
    return E.undominated(li, ["g", "f"], "s", "t", "k").select("g", "f", "k")


@query(f"WITH {EVENTS_SQL} SELECT entity_id, comment, id, start::VARCHAR AS start FROM ev QUALIFY row_number() OVER (PARTITION BY entity_id, comment ORDER BY start, id) = 1")
def clinical_latest(spark: SparkSession, d: str) -> DataFrame:
    return E.clinical_latest(order_events(spark, d)).select("entity_id", "comment", "id", F.col("start").cast("string").alias("start"))


@query("SELECT user_id, event_type, sum(coalesce(json_extract(props, '$.k')::BIGINT, 0))::BIGINT AS total, count(*) AS n FROM events GROUP BY ALL")
def json_events(spark: SparkSession, d: str) -> DataFrame:
    # payloads arrive as base64 of JSON
    e = table(spark, d, "events").withColumn("payload", F.base64(F.col("props").cast("binary")))
    k = E.base64_json(F.col("payload"), "k bigint")["k"]
    return e.groupBy("user_id", "event_type").agg(F.sum(F.coalesce(k, F.lit(0))).alias("total"), F.count(one).alias("n"))


@query(r"SELECT p_partkey, array_to_string(regexp_extract_all(upper(p_name) || ' [' || p_brand || '] [' || p_type || ']', ' \[([^\]]*)\]', 1), ';') AS suffixes FROM part")
def synonym_suffix(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.upper("p_name"), F.lit(" ["), F.col("p_brand"), F.lit("] ["), F.col("p_type"), F.lit("]"))
    return table(spark, d, "part").select("p_partkey", F.array_join(E.suffixes(name), ";").alias("suffixes"))


@query("WITH s AS (SELECT l_partkey, min(l_shipdate)::DATE AS d FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_partkey), b AS (SELECT l_partkey, min(l_shipdate)::DATE AS b FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey), x AS (SELECT p_brand || p_size AS ingredient, p_partkey AS application, coalesce(least(d, b), d, b) AS date FROM part LEFT JOIN s ON s.l_partkey = p_partkey LEFT JOIN b ON b.l_partkey = p_partkey) SELECT ingredient, application, date::VARCHAR AS date FROM x WHERE date > DATE '1938-08-01' AND date <= current_date QUALIFY row_number() OVER (PARTITION BY ingredient ORDER BY date, application) = 1")
def approval_years(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("application"), F.col("l_shipdate").cast("date").alias("date"), "l_linestatus", "l_returnflag")
    products = table(spark, d, "part").select(F.concat("p_brand", "p_size").alias("ingredient"), F.col("p_partkey").alias("application"))
    return E.approval_years(products, li.filter("l_linestatus = 'F'"), li.filter("l_returnflag = 'N'")).withColumn("date", F.col("date").cast("string"))


# --- text -------------------------------------------------------------------------------------------

TOKENS_SQL = "tk AS (SELECT doc_id AS entity_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)"


@query(f"WITH {TOKENS_SQL} SELECT token, count(*) AS n, count(DISTINCT entity_id) AS docs FROM tk GROUP BY token")
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    idx = S.index(table(spark, d, "documents"), "doc_id", "text")
    return idx.groupBy("token").agg(F.sum("freq").alias("n"), F.count(one).alias("docs"))


@query(f"WITH {TOKENS_SQL}, c AS (SELECT entity_id, token, count(*) AS f FROM tk WHERE token IN ('the', 'license', 'der', 'under') GROUP BY ALL) SELECT entity_id, round(sum(CASE WHEN token <> 'der' THEN 1 + ln(f) ELSE 0 END), 6) AS score FROM c GROUP BY entity_id HAVING count(*) FILTER (WHERE token IN ('license', 'under')) = 2 AND count(*) FILTER (WHERE token = 'der') = 0")
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    return S.search(S.index(table(spark, d, "documents"), "doc_id", "text"), "+license under ~the -der")


@query(r"WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains(['a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with'], x)) AS w FROM documents), g AS (SELECT w[i] AS gram FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w) UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w) UNION ALL SELECT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w)) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(S.ngrams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count(one).alias("n"))


@query("WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), nm AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(x), '[a-z0-9]+'), ' ') AS name FROM (SELECT unnest(['Apache License', 'MIT License', 'rights reserved', 'General Public License', 'cc', 'idiot']) AS x) WHERE length(x) > 3), g AS (SELECT doc_id, w[i] AS name FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w) UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)) SELECT doc_id AS entity_id, name, count(*) AS hits FROM g JOIN nm USING (name) GROUP BY ALL")
def text_resolve(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in ("Apache License", "MIT License", "rights reserved", "General Public License", "cc", "idiot")], "name string")
    return S.resolve(table(spark, d, "documents"), "doc_id", "text", names)


# --- curation and reports -----------------------------------------------------------------------------


@query("SELECT c_custkey, array_to_string(CASE WHEN c_custkey % 5 = 0 THEN ['FIXED'] WHEN c_custkey % 5 = 1 THEN ['N' || c_nationkey] WHEN c_custkey % 5 = 2 THEN [c_mktsegment, 'N' || c_nationkey, 'NEW'] ELSE [c_mktsegment, 'N' || c_nationkey] END, ',') AS labels, CASE c_custkey % 5 WHEN 0 THEN 'replace:FIXED' WHEN 1 THEN 'remove:' || c_mktsegment WHEN 2 THEN 'add:NEW' END AS curation FROM customer")
def curation_edit(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    m = F.col("c_custkey") % 5
    edits = c.filter(m < 3).select("c_custkey", F.when(m == 0, "replace").when(m == 1, "remove").otherwise("add").alias("action"), F.when(m == 0, "FIXED").when(m == 1, F.col("c_mktsegment")).otherwise("NEW").alias("value"))
    rows = c.select("c_custkey", F.array("c_mktsegment", F.concat(F.lit("N"), "c_nationkey")).alias("labels"))
    return U.curate(rows, edits, "c_custkey", "labels").withColumn("labels", F.array_join("labels", ","))


TOP_SQL = "(SELECT p_brand || '|' || p_type || '|' || p_size FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(with_components(f"SELECT * FROM ({PARTS_SQL}) WHERE NOT (key = 'I_CODE' AND value = {TOP_SQL})") + " SELECT comp_size, count(*) AS n_components FROM (SELECT count(*) AS comp_size FROM comp GROUP BY comp) GROUP BY comp_size")
def delete_value(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    top = inc.filter("key = 'I_CODE'").groupBy("value").count().orderBy(F.desc("count"), "value").first()
    left = U.delete_value(inc, "I_CODE", top["value"] if top else "")
    return C.component_sizes(C.incidence_components(left)).groupBy(F.col("size").alias("comp_size")).agg(F.count(one).alias("n_components"))


@query(f"WITH inc AS ({PARTIES_SQL}) SELECT key, count(*) AS n FROM inc WHERE entity_id NOT LIKE 'S%' GROUP BY key")
def delete_source(spark: SparkSession, d: str) -> DataFrame:
    inc = parties(spark, d)
    return U.delete_entities(inc, inc.filter(F.col("entity_id").startswith("S")).select("entity_id").distinct()).groupBy("key").agg(F.count(one).alias("n"))


@query("SELECT p_partkey, array_to_string(list_filter([p_brand, p_type], lambda x: x <> 'Brand#11'), ',') AS labels, CASE WHEN p_brand = 'Brand#11' THEN 'Brand#11' ELSE '' END AS labels_deprecated FROM part")
def deprecate_value(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type").alias("labels"))
    return U.deprecate(rows, "labels", F.lit("Brand#11")).select("p_partkey", F.array_join("labels", ",").alias("labels"), F.array_join("labels_deprecated", ",").alias("labels_deprecated"))


@query("SELECT old_cluster, new_cluster, count(*) AS moved FROM (SELECT c_custkey AS m, c_nationkey AS old_cluster FROM customer WHERE c_custkey % 11 <> 0) FULL JOIN (SELECT c_custkey AS m, CASE WHEN c_acctbal < 0 THEN 99 ELSE c_nationkey END AS new_cluster FROM customer WHERE c_custkey % 13 <> 0) USING (m) GROUP BY ALL")
def clustering_diff(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    old = c.filter("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("cluster"))
    new = c.filter("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("member"), F.when(F.col("c_acctbal") < 0, 99).otherwise(F.col("c_nationkey")).alias("cluster"))
    return U.clustering_diff(old, new)


@query("SELECT p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def id_clashes(spark: SparkSession, d: str) -> DataFrame:
    return U.clashes(table(spark, d, "part"), "p_name", "p_brand")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").filter("lang = 'en'"), "doc_id", "left_anti")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS a, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS z FROM lineitem) WHERE a <= 2 OR z = 1")
def per_group_sample(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_partkey")
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    first = F.row_number().over(w.orderBy("l_shipdate", "l_orderkey", "l_linenumber"))
    return li.withColumns({"_a": first, "_n": F.count(one).over(w)}).filter("_a <= 2 or _a = _n").select("l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3 OR o_totalprice > 200000")
def first_n_or_high(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("_r", F.row_number().over(w)).filter("_r <= 3 or o_totalprice > 200000").select("o_custkey", "o_orderkey")


@query(f"WITH {EVENTS_SQL}, a AS (SELECT entity_id, min(start)::VARCHAR AS first, count(*) AS n FROM ev WHERE kind IN ('USApprovalOTC', 'USApprovalRx') GROUP BY entity_id) SELECT entity_id, c_name AS name, first, n FROM a JOIN customer ON c_custkey = entity_id")
def approved_report(spark: SparkSession, d: str) -> DataFrame:
    a = order_events(spark, d).filter(F.col("kind").isin(E.APPROVED)).groupBy("entity_id").agg(F.min("start").cast("string").alias("first"), F.count(one).alias("n"))
    return a.join(table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name")), "entity_id").select("entity_id", "name", "first", "n")


# --- parsing and export -------------------------------------------------------------------------------


@query("SELECT 'p_brand' AS column_name, count(p_brand) AS filled, 'String' AS kind FROM part UNION ALL SELECT 'p_partkey', count(p_partkey), 'Integer' FROM part UNION ALL SELECT 'p_retailprice', count(p_retailprice), 'Double' FROM part UNION ALL SELECT 'p_name', count(p_name), 'String' FROM part UNION ALL SELECT 'p_size', count(p_size), 'Integer' FROM part UNION ALL SELECT 'p_type', count(p_type), 'String' FROM part")
def property_profile(spark: SparkSession, d: str) -> DataFrame:
    return formats.profile(table(spark, d, "part"), None)


@query("SELECT p_partkey::VARCHAR AS f0, p_name AS f1, p_brand || '|' || p_type AS f2, p_brand AS first FROM part")
def delimited_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit('\t"'), "p_name", F.lit('"\t'), "p_brand", F.lit("|"), "p_type").alias("value"))
    rows = formats.split_line(lines, "\t", 3)
    return rows.withColumn("first", F.split("f2", r"\|")[0])


@query(f"WITH inc AS ({PARTS_SQL}), e AS ({EDGES_SQL}) SELECT least(src, dst) || ' ' || greatest(src, dst) || ' ' || array_to_string(list_sort(list(DISTINCT key || '=' || value)), ' ') AS line FROM e GROUP BY least(src, dst), greatest(src, dst)")
def export_edges(spark: SparkSession, d: str) -> DataFrame:
    return sinks.edge_lines(shared_value_edges(parts(spark, d)))


@query(with_components(PARTS_SQL) + ", s AS (SELECT comp, key, value, count(*) AS n FROM inc JOIN comp USING (entity_id) GROUP BY ALL HAVING count(*) > 1) SELECT c.comp, count(*) AS size, string_agg(entity_id, ',' ORDER BY entity_id) AS nodes, coalesce(any_value(st), '') AS stitches FROM comp c LEFT JOIN (SELECT comp, string_agg(key || '=' || value || ':' || n, ';' ORDER BY key || '=' || value || ':' || n) AS st FROM s GROUP BY comp) x ON x.comp = c.comp GROUP BY c.comp")
def component_json(spark: SparkSession, d: str) -> DataFrame:
    inc = parts(spark, d)
    j = sinks.component_documents(inc, C.incidence_components(inc))
    return j.select("comp", "size", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), F.array_join(F.transform("stitches", lambda s: F.concat(s["key"], F.lit("="), s["value"], F.lit(":"), s["count"])), ";").alias("stitches"))


@query("SELECT p_size AS comp, coalesce(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) FILTER (WHERE p_brand = 'Brand#11'), '') AS \"Brand#11\", coalesce(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) FILTER (WHERE p_brand = 'Brand#12'), '') AS \"Brand#12\" FROM part GROUP BY p_size")
def cross_id_table(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_size").alias("comp"), F.col("p_brand").alias("source"), F.col("p_partkey").alias("id"))
    return sinks.cross_ids(p, ["Brand#11", "Brand#12"])


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def html_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p>"), 0)).cast("long").alias("paragraphs"))
