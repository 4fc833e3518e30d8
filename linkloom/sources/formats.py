"""Readers of record files: delimited text, structure files, JSON and XML records, triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.keys import text_type


def delimited(spark: SparkSession, path: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """Quoted fields may hold the separator and line ends; empty cells are null; gzip by the file's name."""
    return spark.read.csv(path, sep=sep, header=header, multiLine=True, quote='"', escape="\x00", nullValue="", emptyValue="")


def table_records(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Rows of a file with a header line; rows of another width are skipped; cells split on | into arrays."""
    lines = spark.read.text(path)
    names = lines.first()["value"].split(sep)
    rows = split_line(lines.filter(F.col("value") != sep.join(names)), sep, len(names)).toDF(*names)
    return rows.select(*[F.split(c, r"\|").alias(c) for c in names])


def split_line(lines: DataFrame, sep: str, width: int, value: str = "value") -> DataFrame:
    """f0.. of lines with exactly ``width`` cells: quotes toggle and go, empty cells are null."""
    # cells: quoted stretches and other characters, up to a separator outside quotes
    s = "\\t" if sep == "\t" else "\\" + sep
    cells = F.regexp_extract_all(F.concat(F.col(value), F.lit(sep)), F.lit(f'((?:"[^"]*"|[^{s}"])*){s}'), 1)
    clean = F.transform(cells, lambda c: F.nullif(F.replace(c, F.lit('"'), F.lit("")), F.lit("")))
    return lines.withColumn("_c", clean).filter(F.size("_c") == width).select(*[F.col("_c")[i].alias(f"f{i}") for i in range(width)])


def structure_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, props): records of an SD file; each property's lines become an array."""
    raw = spark.read.option("lineSep", "$$$$").text(path).filter(F.length(F.trim(F.regexp_replace("value", r"\s", ""))) > 0)
    blocks = F.regexp_extract_all("value", F.lit(r"(?s)> +<[^>]+>[^\n]*\n.*?(?=\n\s*\n|\z)"), 0)
    entries = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"<([^>]+)>", 1).alias("key"), F.split(F.regexp_replace(b, r"^> +<[^>]+>[^\n]*\n", ""), r"\r?\n").alias("value")))
    return raw.select(F.trim(F.regexp_extract("value", r"^\s*([^\n]*)", 1)).alias("id"), F.map_from_entries(entries).alias("props"), F.regexp_extract("value", r"(?s)^(.*?M  END)", 1).alias("structure"))


def indexed_values(values: Column, most: int = 100) -> Column:
    """The values, if the longest is short enough to be looked up; else none."""
    return F.when(F.coalesce(F.array_max(F.transform(values, F.length)), F.lit(0)) < most, values)


def json_column_records(spark: SparkSession, path: str, schema: str, column: int = 2) -> DataFrame:
    """Tab-separated lines whose cell ``column`` is a JSON record."""
    cells = F.split("value", "\t")
    return spark.read.text(path).select(cells[0].alias("id"), cells[1].alias("name"), F.from_json(cells[column], schema).alias("record"))


SUBSTANCE = "uuid string, approvalID string, substanceClass string, names array<struct<name:string,displayName:boolean>>, codes array<struct<codeSystem:string,code:string,type:string>>, relationships array<struct<type:string,relatedSubstance:struct<approvalID:string,refuuid:string>>>"


def substances(records: DataFrame) -> DataFrame:
    """Names longer than three characters, the display name, and primary codes by system, of JSON substances."""
    r = F.col("record")
    names = F.filter(r["names"], lambda n: F.length(n["name"]) > 3)
    primary = F.filter(r["codes"], lambda c: c["type"] == "PRIMARY")
    systems = F.array_sort(F.array_distinct(F.transform(primary, lambda c: c["codeSystem"])))
    codes = F.map_from_arrays(systems, F.transform(systems, lambda s: F.transform(F.filter(primary, lambda c: c["codeSystem"] == s), lambda c: c["code"])))
    return records.select(
        r["uuid"].alias("uuid"), r["approvalID"].alias("unii"), r["substanceClass"].alias("kind"), F.transform(names, lambda n: n["name"]).alias("names"),
        F.element_at(F.transform(F.filter(names, lambda n: n["displayName"]), lambda n: n["name"]), 1).alias("preferred"), codes.alias("codes"),
        F.transform(F.filter(r["relationships"], lambda x: x["type"] == "ACTIVE MOIETY"), lambda x: x["relatedSubstance"]["approvalID"]).alias("moieties"),
    )


def moiety_edges(subs: DataFrame) -> DataFrame:
    """(src, dst): a substance and its active moiety, once both are loaded; references to itself are left out."""
    refs = subs.select(F.col("unii").alias("src"), F.explode("moieties").alias("dst")).filter("src <> dst")
    return refs.join(subs.select(F.col("unii").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct()


def xml_records(spark: SparkSession, path: str, tag: str, schema: str | None = None) -> DataFrame:
    """One row per element ``tag``, however large the file."""
    reader = spark.read.format("xml").option("rowTag", tag)
    return (reader.schema(schema) if schema else reader).load(path)


def json_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, literal) of N-Triples lines; comments and broken lines are left out."""
    line = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"\S*)\s*\.\s*$'
    get = lambda i: F.regexp_extract("value", line, i)
    return spark.read.text(path).filter(F.col("value").rlike(line)).select(F.regexp_replace(get(1), "[<>]", "").alias("s"), get(2).alias("p"), F.concat(get(3), get(4), get(5)).alias("o"), (F.length(get(3)) + F.length(get(4)) == 0).alias("literal"))


# Predicates that link classes.
LINKS = {"subClassOf": "R_subClassOf", "equivalentClass": "R_equivalentClass", "exactMatch": "R_exactMatch", "closeMatch": "R_closeMatch"}


def ontology(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resources, edges): literals of each resource as a map, links by the predicate's last word, restrictions through blank nodes."""
    local = F.regexp_extract("p", r"([^#/]+)$", 1)
    t = triples.withColumn("name", local)
    props = t.filter("literal").groupBy("s", "name").agg(F.array_sort(F.collect_set("o")).alias("v")).groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("props"))
    subjects = t.select("s").distinct()
    resources = subjects.join(props, "s", "left").select(F.col("s").alias("uri"), "props", F.col("props").isNull().alias("transient"), F.coalesce(F.array_contains(F.col("props")["deprecated"], "true"), F.lit(False)).alias("deprecated"))
    table = F.create_map(*[x for k, v in LINKS.items() for x in (F.lit(k), F.lit(v))])
    links = t.filter(~F.col("literal"))
    direct = links.filter(~F.col("o").startswith("_:") & ~F.col("s").startswith("_:") & (F.col("name") != "type"))
    direct = direct.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.coalesce(table[F.col("name")], F.lit("R_rel")).alias("key"), F.col("name").alias("value"))
    blank = links.filter(F.col("s").startswith("_:"))
    on = blank.filter("name = 'onProperty'").select(F.col("s").alias("b"), F.regexp_extract("o", r"([^#/]+)$", 1).alias("property"))
    some = blank.filter(F.col("name").isin("someValuesFrom", "allValuesFrom", "onDataRange")).select(F.col("s").alias("b"), F.col("o").alias("dst"))
    via = links.filter(F.col("o").startswith("_:")).select(F.col("s").alias("src"), F.col("o").alias("b"))
    restricted = via.join(some, "b").join(on, "b", "left").select("src", "dst", F.when(F.col("property") == "subClassOf", "R_subClassOf").otherwise("R_rel").alias("key"), F.col("property").alias("value"))
    return resources, direct.unionByName(restricted)


def spl_products(labels: DataFrame) -> DataFrame:
    """One row per product and ingredient of label records (set_id, effective, products array of structs)."""
    p = labels.select("set_id", "effective", F.explode("products").alias("p"))
    return p.select("set_id", "effective", F.col("p.code").alias("code"), F.col("p.name").alias("name"), F.col("p.route").alias("route"), F.explode("p.ingredients").alias("i")).select("set_id", "effective", "code", "name", "route", F.col("i.unii").alias("unii"), F.col("i.active").alias("active"))


def initial_approval(text: Column) -> Column:
    """The year behind ``Initial U.S. Approval``."""
    return F.regexp_extract(text, r"(?i)initial\s+U\.?S\.?\s+approval\s*:?\s*(\d{4})", 1).try_cast("int")


def profile(df: DataFrame, most: int = 1000) -> DataFrame:
    """(column_name, filled, kind): non-null cells and the narrowest type of each column's text, over at most ``most`` rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in df.columns]))
    rows = df if most is None else df.limit(most)
    kinds = rows.select(cells.alias("x")).select("x.*").withColumn("k", text_type(F.col("v")))
    kind = F.when(F.count_if(F.col("k") == "String") > 0, "String").when(F.count_if(F.col("k") == "Double") > 0, "Double").otherwise("Integer")
    return kinds.filter("v is not null").groupBy("column_name").agg(F.count(F.lit(1)).alias("filled"), kind.alias("kind"))


def content_key(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha1, key, size): the key is the first nine digits of a file's SHA-1."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.sha1("content").alias("sha1"), F.substring(F.sha1("content"), 1, 9).alias("key"), F.col("length").alias("size"))


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(source, name, file) of a JSON object of sources."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<name:string,file:string>>").alias("m"))
    return raw.select(F.explode("m").alias("source", "v")).select("source", "v.name", "v.file")
