"""Tables as entities: incidence rows (entity_id, key, value) of the views the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidence(df: DataFrame, entity: str, keys: dict) -> DataFrame:
    """Unpivots key columns; an array gives a row per value; nulls and repeats go (incidence is a set)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in keys.items()])
    return df.select(F.col(entity).alias("entity_id"), F.explode(pairs).alias("p")).select("entity_id", "p.*").filter("value is not null").distinct()


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return incidence(p, "p_partkey", {"I_CODE": F.concat_ws("|", "p_brand", "p_type", "p_size"), "N_Name": F.concat_ws("|", F.upper("p_name"), "p_size")})


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id C<customer> or S<supplier>, with the source."""
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("id"),
        F.concat_ws("|", "c_nationkey", F.floor(F.col("c_acctbal") / 100).cast("long")).alias("code"),
        F.concat_ws("|", "c_mktsegment", F.floor("c_acctbal").cast("long")).alias("name"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("id"),
        F.concat_ws("|", "s_nationkey", F.floor(F.col("s_acctbal") / 100).cast("long")).alias("code"),
        F.lit(None).cast("string").alias("name"),
    )
    return incidence(c.unionByName(s), "id", {"I_CODE": F.col("code"), "N_Name": F.col("name")})


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return incidence(d, "doc_id", {"H_SHA1": F.sha1(F.col("text").cast("binary")), "N_Name": F.trim(F.split("text", "\n")[0])})


#: The same incidence as SQL.
PARTS_SQL = """SELECT p_partkey AS entity_id, 'I_CODE' AS key, p_brand || '|' || p_type || '|' || p_size AS value FROM part
  UNION SELECT p_partkey, 'N_Name', upper(p_name) || '|' || p_size FROM part"""
PARTIES_SQL = """SELECT 'C' || c_custkey AS entity_id, 'I_CODE' AS key, c_nationkey || '|' || floor(c_acctbal / 100)::BIGINT AS value FROM customer
  UNION SELECT 'C' || c_custkey, 'N_Name', c_mktsegment || '|' || floor(c_acctbal)::BIGINT FROM customer
  UNION SELECT 'S' || s_suppkey, 'I_CODE', s_nationkey || '|' || floor(s_acctbal / 100)::BIGINT FROM supplier"""
DOCS_SQL = r"""SELECT doc_id AS entity_id, 'H_SHA1' AS key, sha1(text) AS value FROM documents
  UNION SELECT doc_id, 'N_Name', trim(string_split(text, chr(10))[1]) FROM documents"""


def with_components(inc_sql: str) -> str:
    """CTEs inc and comp(entity_id, comp): the least entity that each reaches."""
    return f"""WITH RECURSIVE inc AS ({inc_sql}),
  hub AS (SELECT key, value, min(entity_id) AS h FROM inc GROUP BY key, value),
  e AS (SELECT DISTINCT entity_id AS a, h AS b FROM inc JOIN hub USING (key, value)),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a),
  comp AS (SELECT a AS entity_id, min(b) AS comp FROM reach GROUP BY a)"""
