"""Queries on the phases that resolve compounds, over parts that stand in for compounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import compound as R
from linkloom.operators import twins as T
from linkloom.operators.components import incidence_components
from linkloom.plans.registry import query
from linkloom.sources.views import table

# A part as a compound: an identifier shared by three neighbours, a structure hash by name and size (a salt
# with every fifth), one or two active moieties with some, and what it states about itself with others.
CP_SQL = """cp AS (SELECT p_partkey AS e, CASE WHEN p_partkey % 4 <> 0 THEN ['UNII' || lpad((p_partkey // 3)::VARCHAR, 6, '0')] END AS unii,
    list_concat([p_name || '|' || p_size || CASE p_size % 7 WHEN 0 THEN '-M' WHEN 1 THEN '-S' ELSE '-N' END], CASE WHEN p_partkey % 5 = 0 THEN [p_brand || '-S'] ELSE [] END) AS l4,
    CASE p_partkey % 12 WHEN 1 THEN ['UNII' || lpad(((p_partkey + 7) // 3)::VARCHAR, 6, '0')] WHEN 5 THEN ['UNII' || lpad((p_partkey // 3)::VARCHAR, 6, '0'), 'UNII' || lpad(((p_partkey + 20) // 3)::VARCHAR, 6, '0'), 'UNII' || lpad(((p_partkey + 40) // 3)::VARCHAR, 6, '0')] END AS mo,
    CASE p_partkey % 12 WHEN 7 THEN unii WHEN 1 THEN mo END AS active, p_brand || '|' || p_size AS cas, p_name || '|' || p_size AS nm FROM part),
  ln AS (SELECT DISTINCT a.e AS src, b.e AS dst FROM (SELECT e, unnest(mo) AS u FROM cp) a JOIN (SELECT e, unnest(unii) AS u FROM cp) b ON a.u = b.u WHERE a.e <> b.e),
  inc AS (SELECT e AS entity_id, 'I_UNII' AS key, unnest(unii) AS value FROM cp UNION SELECT e, 'H_LyChI_L4', unnest(l4) FROM cp UNION SELECT e, 'I_CAS', cas FROM cp UNION SELECT e, 'N_Name', nm FROM cp)"""


def compounds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(info, moieties, links, inc) of the parts."""
    k = F.col("p_partkey")
    unii = lambda shift: F.concat(F.lit("UNII"), F.lpad(F.floor((k + shift) / 3).cast("string"), 6, "0"))
    suffix = F.when(F.col("p_size") % 7 == 0, "-M").when(F.col("p_size") % 7 == 1, "-S").otherwise("-N")
    name = F.concat_ws("|", "p_name", "p_size")
    salt = F.when(k % 5 == 0, F.array(F.concat("p_brand", F.lit("-S")))).otherwise(F.array().cast("array<string>"))
    p = table(spark, d, "part").select(
        k.alias("entity_id"), F.when(k % 4 != 0, F.array(unii(0))).alias("unii"), F.concat(F.array(F.concat(name, suffix)), salt).alias("l4"),
        F.when(k % 12 == 1, F.array(unii(7))).when(k % 12 == 5, F.array(unii(0), unii(20), unii(40))).alias("values"), F.concat_ws("|", "p_brand", "p_size").alias("cas"), name.alias("name"),
    )
    p = p.withColumn("active", F.when(F.col("entity_id") % 12 == 7, F.col("unii")).when(F.col("entity_id") % 12 == 1, F.col("values")))
    moieties = p.select("entity_id", "values").dropna()
    holders = p.select(F.col("entity_id").alias("dst"), F.explode("unii").alias("u"))
    links = moieties.select(F.col("entity_id").alias("src"), F.explode("values").alias("u")).join(holders, "u").filter("src <> dst").select("src", "dst").distinct()
    pair = lambda key, values: p.select("entity_id", F.lit(key).alias("key"), F.explode(values).alias("value"))
    inc = pair("I_UNII", "unii").unionByName(pair("H_LyChI_L4", "l4")).unionByName(pair("I_CAS", F.array("cas"))).unionByName(pair("N_Name", F.array("name"))).distinct()
    return p.select("entity_id", "unii", "active", "l4"), moieties, links, inc


@query(f"""WITH {CP_SQL}, f AS (SELECT e, coalesce(len(list_filter(unii, lambda x: NOT list_contains(active, x))) = 0, false) AS own, active IS NOT NULL AS st FROM cp)
  SELECT e AS entity_id, CASE WHEN st THEN own ELSE EXISTS (SELECT 1 FROM ln WHERE dst = e) AND NOT EXISTS (SELECT 1 FROM ln WHERE src = e) AND NOT EXISTS (SELECT 1 FROM ln JOIN f g ON g.e = ln.src WHERE ln.dst = f.e AND g.st AND g.own) END AS is_root FROM f""")
def active_roots(spark: SparkSession, d: str) -> DataFrame:
    info, _, links, _ = compounds(spark, d)
    return R.active_roots(info, links)


@query(f"""WITH {CP_SQL}, n AS (SELECT e, CASE WHEN len(mo) > 1 THEN len(list_filter(mo, lambda x: x IS DISTINCT FROM unii[1])) ELSE (length(mo[1]) = 10)::INT END AS n FROM cp WHERE mo IS NOT NULL)
  SELECT n.e AS entity_id, n.n, min(dst) FILTER (WHERE n.n = 1) AS least FROM n LEFT JOIN ln ON src = n.e GROUP BY n.e, n.n""")
def moiety_merges(spark: SparkSession, d: str) -> DataFrame:
    info, moieties, links, _ = compounds(spark, d)
    counts = R.moiety_counts(info, moieties)
    pairs = R.moiety_pairs(counts, links).groupBy(F.col("src").alias("entity_id")).agg(F.min("dst").alias("least"))
    return counts.join(pairs, "entity_id", "left").select("entity_id", "n", "least")


@query(f"""WITH {CP_SQL}, g AS (SELECT e, array_to_string(list_sort(l4), ':') AS l FROM cp WHERE e % 2 = 0) SELECT e AS src, h AS dst FROM (SELECT e, min(e) OVER (PARTITION BY l) AS h FROM g) WHERE e <> h""")
def equal_structures(spark: SparkSession, d: str) -> DataFrame:
    """Entities with even ids count as mapped."""
    info, *_ = compounds(spark, d)
    return R.equal_structures(info.filter("entity_id % 2 = 0").select("entity_id", F.col("entity_id").alias("cls")), info)


@query(f"""WITH {CP_SQL}, i5 AS (SELECT * FROM inc WHERE key IN ('N_Name', 'I_CAS')), q AS (SELECT m, list_sort(list(DISTINCT key)) AS k FROM (SELECT key, value, list_sort(list(entity_id)) AS m FROM i5 GROUP BY key, value HAVING count(*) > 2) GROUP BY m),
  x AS (SELECT m, unnest(m) AS v FROM q), o AS (SELECT a.m AS a, b.m AS b FROM x a JOIN x b ON a.v = b.v WHERE a.m <> b.m AND len(a.m) <= len(b.m) GROUP BY a.m, b.m HAVING count(*) = len(a.m)), t AS (SELECT a AS m, b AS o FROM o UNION SELECT b, a FROM o)
  SELECT array_to_string(m, ',') AS members, array_to_string(ks, ',') AS keys FROM (SELECT q.m, list_sort(list_distinct(list_concat(any_value(q.k), flatten(coalesce(list(r.k) FILTER (WHERE r.k IS NOT NULL), []))))) AS ks FROM q LEFT JOIN t ON t.m = q.m LEFT JOIN q r ON r.m = t.o GROUP BY q.m) WHERE len(ks) > 1""")
def spanning_cliques(spark: SparkSession, d: str) -> DataFrame:
    """Structure keys are left out: the whole table counts as one component, which holds metals."""
    info, _, _, inc = compounds(spark, d)
    cliques = R.spanning_cliques(inc, info.select("entity_id", F.lit(0).alias("comp")))
    return cliques.select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.array_join("keys", ",").alias("keys"))


@query(f"""WITH {CP_SQL}, l AS (SELECT entity_id AS e, value AS v FROM inc WHERE key = 'H_LyChI_L4'), c AS (SELECT v, count(*) * (count(*) - 1) // 2 AS n FROM l GROUP BY v),
  s AS (SELECT a.e AS src, b.e AS dst, list_sort(list(a.v)) AS sh, min(n) AS n FROM l a JOIN l b ON a.v = b.v AND a.e <> b.e JOIN c ON c.v = a.v WHERE a.e % 4 = 0 GROUP BY a.e, b.e),
  k AS (SELECT e, l4, array_to_string(list_sort(l4), ':') AS lk FROM cp), en AS (SELECT src, dst FROM ln UNION SELECT dst, dst FROM ln), h AS (SELECT lk, list(DISTINCT en.dst) AS t FROM en JOIN k ON k.e = en.src GROUP BY lk),
  j AS (SELECT s.*, hu.t AS su, hv.t AS sv FROM s JOIN k x ON x.e = s.src JOIN k y ON y.e = s.dst LEFT JOIN h hu ON hu.lk = y.lk LEFT JOIN h hv ON hv.lk = array_to_string(s.sh, ':')
    WHERE len(list_filter(x.l4, lambda z: NOT list_contains(s.sh, z) AND NOT ends_with(z, '-S'))) = 0 AND len(list_filter(y.l4, lambda z: NOT list_contains(s.sh, z) AND NOT ends_with(z, '-S'))) = 0),
  p AS (SELECT DISTINCT j.src, j.dst FROM (SELECT src, dst, su, unnest(sh) AS o FROM j WHERE len(sh) > 1) j JOIN h ON h.lk = j.o WHERE len(list_filter(h.t, lambda z: NOT list_contains(j.su, z))) = 0)
  SELECT src, dst, n AS edges FROM j WHERE su IS NULL OR coalesce(list_has_any(su, sv), false) OR EXISTS (SELECT 1 FROM p WHERE p.src = j.src AND p.dst = j.dst)
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY len(list_filter(sh, lambda z: ends_with(z, '-M'))) > 0 DESC, n, dst) = 1""")
def rarest_structure(spark: SparkSession, d: str) -> DataFrame:
    """For the entities without an identifier."""
    info, _, links, inc = compounds(spark, d)
    return R.rarest_structure(info.filter("unii is null"), inc, info, R.moiety_holders(info, links))


@query(f"""WITH {CP_SQL}, q AS (SELECT m, list_sort(list(DISTINCT key)) AS k FROM (SELECT key, value, list_sort(list(entity_id)) AS m FROM inc WHERE key IN ('N_Name', 'I_CAS') GROUP BY key, value HAVING count(*) > 1) GROUP BY m),
  p AS (SELECT m, k, round(2 * pow(len(m), 0.3) * pow(len(k), 0.7), 6) AS pot FROM q), x AS (SELECT m, unnest(m) AS e FROM p), t AS (SELECT m, count(DISTINCT e % 7) FILTER (WHERE e % 4 <> 0) AS n FROM x GROUP BY m),
  w AS (SELECT p.*, coalesce(n, 0) AS n FROM p LEFT JOIN t USING (m)), b AS (SELECT x.e, w.m FROM x JOIN w USING (m) WHERE x.e % 4 = 0 AND n = 0 QUALIFY row_number() OVER (PARTITION BY x.e ORDER BY pot DESC, w.m) = 1),
  sv AS (SELECT m, k FROM w WHERE n > 1), y AS (SELECT m, unnest(m) AS v FROM sv), o AS (SELECT a.m AS a, c.m AS b FROM y a JOIN y c ON a.v = c.v WHERE a.m <> c.m AND len(a.m) <= len(c.m) GROUP BY a.m, c.m HAVING count(*) = len(a.m)), u AS (SELECT a AS m, b AS o FROM o UNION SELECT b, a FROM o),
  z AS (SELECT sv.m, list_distinct(list_concat(any_value(sv.k), flatten(coalesce(list(r.k) FILTER (WHERE r.k IS NOT NULL), [])))) AS ks FROM sv LEFT JOIN u ON u.m = sv.m LEFT JOIN sv r ON r.m = u.o GROUP BY sv.m)
  SELECT e AS entity_id, array_to_string(m, ',') AS members FROM b UNION ALL SELECT x.e, array_to_string(x.m, ',') FROM x JOIN z ON z.m = x.m WHERE len(ks) > 1 AND x.e % 4 = 0 AND x.e NOT IN (SELECT e FROM b)""")
def clique_choice(spark: SparkSession, d: str) -> DataFrame:
    """Entities with an identifier count as mapped, to seven classes."""
    info, _, _, inc = compounds(spark, d)
    classes = info.filter("unii is not null").select("entity_id", (F.col("entity_id") % 7).alias("cls"))
    return R.clique_choice(info.filter("unii is null"), inc, classes).select("entity_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"""WITH {CP_SQL}, v AS (SELECT e FROM cp WHERE len(list_filter(l4, lambda x: ends_with(x, '-M') OR ends_with(x, '-N'))) > 0)
  SELECT src AS entity_id, CASE WHEN count(v.e) = 1 THEN min(v.e) END AS target FROM ln JOIN cp ON cp.e = src AND src % 12 = 5 LEFT JOIN v ON v.e = dst GROUP BY src HAVING count(*) > 1""")
def unsure_votes(spark: SparkSession, d: str) -> DataFrame:
    info, moieties, links, _ = compounds(spark, d)
    return R.unsure_votes(R.moiety_counts(info, moieties).filter("n > 1"), links, info)


@query(f"""WITH {CP_SQL}, pr AS (SELECT a.entity_id AS src, b.entity_id AS dst, list(DISTINCT a.key) AS k, list(a.value) FILTER (WHERE a.key = 'H_LyChI_L4') AS sh, count(*) AS s FROM inc a JOIN inc b USING (key, value) WHERE a.entity_id > b.entity_id GROUP BY ALL),
  j AS (SELECT pr.*, list_concat(list_filter(x.l4, lambda z: NOT list_contains(coalesce(sh, []), z)), list_filter(y.l4, lambda z: NOT list_contains(coalesce(sh, []), z))) AS rest FROM pr JOIN cp x ON x.e = src JOIN cp y ON y.e = dst),
  f AS (SELECT *, list_contains(k, 'H_LyChI_L4') AND len(list_filter(rest, lambda z: ends_with(z, '-N') OR ends_with(z, '-M'))) = 0 AS ov FROM j)
  SELECT src, dst, s::DOUBLE AS score, ov OR (len(k) > CASE WHEN ov THEN 1 ELSE 2 END AND s >= 3) AS accepted FROM f""")
def stitch_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs scored by the number of values they share, with a threshold of three."""
    info, _, _, inc = compounds(spark, d)
    return T.value_verdicts(inc, info, F.lit(3.0))


@query()
def compound_classes(spark: SparkSession, d: str) -> DataFrame:
    info, moieties, links, inc = compounds(spark, d)
    return R.resolve_compounds(inc, incidence_components(inc), info, moieties, links)
