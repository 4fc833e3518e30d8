"""Rules of the record loaders: how each kind of source becomes entities, keys and links.

``MAPPINGS`` states which property of a source feeds which key; the functions hold what goes beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.storage import written

#: Holders of a code that stand in one row, and pairs that a task makes, about.
BLOCK, PAIRS = 1000, 4_000_000

# Key <- properties, by kind of source.
MAPPINGS = {
    "gsrs": {"N_Name": ["names"], "I_UNII": ["unii"], "I_CAS": ["CAS"]},
    "drugbank": {"N_Name": ["name", "synonyms"], "I_DB": ["drugbank-id"], "I_CAS": ["cas-number"], "I_UNII": ["unii"]},
    "npc": {"N_Name": ["Synonyms"], "I_CAS": ["CAS"], "I_UNII": ["CompoundUNII"], "I_CID": ["CompoundCID"]},
    "medgen": {"N_Name": ["NAME", "SYNONYMS"], "I_CODE": ["SOURCE_IDS"], "T_Keyword": ["SEMANTIC_TYPES"]},
    "clinvar": {"N_Name": ["names"], "I_CODE": ["xrefs"], "I_GENE": ["genes"]},
    "disgenet": {"I_CODE": ["diseaseId"], "I_GENE": ["geneSymbol"], "I_PMID": ["pmid"]},
    "hpo": {"I_CODE": ["hpo_id"], "N_Name": ["label"]},
    "ppi": {"I_GENE": ["genes"], "I_PMID": ["pmids"]},
    "orphanet": {"N_Name": ["name", "synonyms"], "I_CODE": ["orpha_code", "xrefs"]},
    "orphan_designation": {"N_Name": ["generic_name", "trade_name"], "I_CODE": ["gard"]},
    "integrity": {"N_Name": ["Drug_Name"], "I_CAS": ["CAS"]},
    "hmdb": {"N_Name": ["name", "synonyms"], "I_CAS": ["cas"], "I_CODE": ["accession", "secondary"], "H_InChIKey": ["inchikey"]},
    "frdb": {"N_Name": ["name", "synonyms", "iupac"], "I_UNII": ["unii"], "I_CAS": ["cas"], "I_CID": ["cid"]},
    "ncgc": {"N_Name": ["names"], "I_CAS": ["cas"], "I_CODE": ["sample"]},
    "genereviews": {"N_Name": ["DiseaseName", "Synonyms"], "I_GENE": ["GeneSymbol"], "I_UniProt": ["ProteinName"], "T_Keyword": ["Include"]},
    "target": {"N_Name": ["name", "synonyms"], "I_UniProt": ["accessions"], "I_GENE": ["gene"], "I_ChEMBL": ["chembl_id"]},
    "ontology": {"N_Name": ["label", "synonyms"], "I_CODE": ["notation", "xrefs"], "R_subClassOf": ["parents"], "R_exactMatch": ["exact"], "R_equivalentClass": ["equivalent"], "T_Keyword": ["types"]},
}


# Keys whose values are kept as they are.
VERBATIM = ["R_exactMatch", "R_equivalentClass", "R_subClassOf"]


def cells(df: DataFrame, entity: str, source: str) -> DataFrame:
    """(entity_id, key, value) as the mapping of a source reads them; arrays give a row per value."""
    out = None
    for key, columns in MAPPINGS[source].items():
        for c in columns:
            if c in df.columns:
                cell = F.col(f"`{c}`")
                values = cell if df.schema[c].dataType.simpleString().startswith("array") else F.array(cell)
                rows = df.select(F.col(entity).alias("entity_id"), F.explode(values).alias("v")).select("entity_id", F.lit(key).alias("key"), F.col("v").cast("string").alias("value"))
                out = rows if out is None else out.unionByName(rows)
    return out.filter(F.trim("value") != "")


def keyed(df: DataFrame, entity: str, source: str) -> DataFrame:
    """Incidence rows of a source's records: values in upper case but those of relations; keywords link nothing."""
    value = F.when(F.col("key").isin(VERBATIM), F.col("value")).otherwise(F.upper(F.trim("value")))
    return cells(df, entity, source).filter("key <> 'T_Keyword'").withColumn("value", value).distinct()


def keyword_labels(df: DataFrame, entity: str, source: str, labels: DataFrame | None = None) -> DataFrame:
    """(entity_id, labels): keywords as labels, verbatim, added to those there are (entity_id, labels)."""
    found = cells(df, entity, source).filter("key = 'T_Keyword'").groupBy("entity_id").agg(F.array_sort(F.collect_set("value")).alias("labels"))
    if labels is None:
        return found
    both = labels.join(found.withColumnRenamed("labels", "_new"), "entity_id", "full")
    none = F.expr("cast(array() as array<string>)")
    return both.select("entity_id", F.array_sort(F.array_union(F.coalesce("labels", none), F.coalesce("_new", none))).alias("labels"))


# Prefixes of cross references that differ between sources.
PREFIXES = {"ORPHANET": "ORPHA", "SNOMED_CT": "SNOMEDCT_US", "ICD-10-CM": "ICD10CM", "GTR": "UMLS", "MSH": "MESH", "MeSH": "MESH", "UMLS_CUI": "UMLS", "NCIT": "NCI", "MIM": "OMIM"}


def prefixed(db: Column, value: Column) -> Column:
    """db:value with the usual name of the database; GARD numbers have seven digits."""
    table = F.create_map(*[x for k, v in PREFIXES.items() for x in (F.lit(k), F.lit(v))])
    name = F.coalesce(table[db], F.upper(F.replace(db, F.lit(" "), F.lit("_"))))
    return F.when(name == "GARD", F.concat(F.lit("GARD:"), F.lpad(value, 7, "0"))).otherwise(F.concat(name, F.lit(":"), F.regexp_replace(value, r"^[A-Za-z_]+:", "")))


def concepts(names: DataFrame, types: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row per concept id: names, types, definition; the first name where there is no preferred one."""
    n = names.groupBy("cui").agg(F.array_sort(F.collect_set("name")).alias("synonyms"), F.min(F.when(F.col("preferred"), F.col("name"))).alias("_p"))
    t = types.groupBy("cui").agg(F.array_sort(F.collect_set("type")).alias("types"))
    d = definitions.groupBy("cui").agg(F.min("definition").alias("definition"))
    return n.join(t, "cui", "left").join(d, "cui", "left").withColumn("name", F.coalesce("_p", F.col("synonyms")[0])).drop("_p")


def relations(rows: DataFrame, inc: DataFrame) -> DataFrame:
    """(src, dst, key, name): relations of concepts between all entities that carry the concepts; not to itself, not without a name."""
    codes = inc.filter("key = 'I_CODE'")
    r = rows.filter("cui1 <> cui2 and rela is not null")
    a = codes.select(F.col("entity_id").alias("src"), F.regexp_extract("value", r"^UMLS:(.+)$", 1).alias("cui1")).filter("cui1 <> ''")
    b = codes.select(F.col("entity_id").alias("dst"), F.regexp_extract("value", r"^UMLS:(.+)$", 1).alias("cui2")).filter("cui2 <> ''")
    return r.join(a, "cui1").join(b, "cui2").select("src", "dst", F.when(F.col("rela") == "isa", "R_subClassOf").otherwise("R_rel").alias("key"), F.col("rela").alias("name"))


def gene_links(rows: DataFrame) -> DataFrame:
    """(src, dst, key): OMIM-gene, concept-gene and OMIM-concept edges of (omim, gene, concept) rows."""
    ok = rows.filter("gene <> '-' and concept like 'C%'")
    pairs = F.array(F.struct(F.col("omim").alias("src"), F.col("gene").alias("dst")), F.struct(F.col("concept").alias("src"), F.col("gene").alias("dst")), F.struct(F.col("omim").alias("src"), F.col("concept").alias("dst")))
    return ok.select(F.explode(pairs).alias("e")).select("e.src", "e.dst", F.lit("I_GENE").alias("key")).filter("src <> dst").distinct()


def interactions(rows: DataFrame) -> DataFrame:
    """Human-human interactions: gene ids of three column groups merged, PubMed ids as numbers, ``-`` as null."""
    human = rows.filter(F.col("taxid_a").startswith("taxid:9606") & F.col("taxid_b").startswith("taxid:9606"))
    genes = lambda s: F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.col(f"{c}_{s}"), F.lit(r"(?:entrez gene/locuslink|uniprotkb|ensembl):([^|(\"]+)"), 1) for c in ("id", "alt", "alias")])))
    filled = human.na.fill("", [f"{c}_{s}" for c in ("id", "alt", "alias") for s in "ab"])
    return filled.select(genes("a").alias("genes_a"), genes("b").alias("genes_b"), F.transform(F.regexp_extract_all("publications", F.lit(r"pubmed:(\d+)"), 1), lambda x: x.try_cast("bigint")).alias("pmids"))


def associations(rows: DataFrame, inc: DataFrame, left: Column, right: Column, right_key: str, key: str, name: str) -> DataFrame:
    """(src, dst, key, name, attrs): entities found by code on the left and by another key on the right; the row as attributes."""
    a = inc.filter("key = 'I_CODE'").select(F.col("entity_id").alias("src"), F.col("value").alias("_l"))
    b = inc.filter(F.col("key") == right_key).select(F.col("entity_id").alias("dst"), F.col("value").alias("_r"))
    attrs = F.to_json(F.struct(*rows.columns))
    return rows.select(left.alias("_l"), right.alias("_r"), attrs.alias("attrs")).join(a, "_l").join(b, "_r").select("src", "dst", F.lit(key).alias("key"), F.lit(name).alias("name"), "attrs")


def child_parent(rows: DataFrame, child: str, parents: str) -> DataFrame:
    """(src, dst, key): each child and each of its parents."""
    return rows.select(F.col(child).alias("src"), F.explode(parents).alias("dst")).select("src", "dst", F.lit("R_subClassOf").alias("key")).distinct()


def nested_tree(rows: DataFrame, depth: int, node: str = "node", children: str = "children") -> DataFrame:
    """(src, dst): child and parent of a nested classification, level by level."""
    level, out = rows.select(F.col(node).alias("n")), None
    for _ in range(depth):
        below = level.select(F.col("n.code").alias("dst"), F.explode(f"n.{children}").alias("n"))
        edges = below.select(F.col("n.code").alias("src"), "dst")
        out = edges if out is None else out.unionByName(edges)
        level = below.select("n")
        if children not in level.schema["n"].dataType.names:
            break
    return out.distinct()


def attributes_as_links(rows: DataFrame, entity: str, columns: dict[str, str]) -> DataFrame:
    """(src, dst, key, name): terms in array columns become entities of their own, linked by a named relation."""
    stack = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("terms")) for c, name in columns.items()]))
    return rows.select(F.col(entity).alias("src"), stack.alias("x")).select("src", F.explode("x.terms").alias("dst"), F.lit("R_rel").alias("key"), "x.name")


def long_enough(values: Column, least: int = 4) -> Column:
    return F.filter(values, lambda v: (F.length(v) >= least) & ~F.upper(v).isin("NOT FOUND", "MIXTURE"))


def cas_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b(\d{2,7}-\d{2}-\d)\b"), 1)


def no_value(text: Column) -> Column:
    """Empty, n/a and NA count as null."""
    return F.when(~F.lower(F.trim(text)).isin("", "n/a", "na"), F.trim(text))


def conditions(rows: DataFrame) -> DataFrame:
    """(src, dst, name): drug (by UNII, else by name) and condition of indication rows; off-label uses split on |."""
    drug = F.coalesce(no_value(F.col("unii")), F.upper("drug"))
    on = rows.select(drug.alias("src"), F.upper("condition").alias("dst"), F.lit("indication_of").alias("name")).filter("dst is not null")
    off = rows.select(drug.alias("src"), F.explode(F.split("offlabel", r"\|")).alias("dst"), F.lit("offlabel_for").alias("name")).withColumn("dst", F.upper(F.trim("dst"))).filter("dst <> ''")
    return on.unionByName(off).distinct()


def by_ingredient(products: DataFrame) -> DataFrame:
    """Per ingredient the applications, strengths and dates in parallel; a strength belongs to the ingredient at its place."""
    p = products.withColumn("_s", F.split("strength", ";"))
    e = p.select("application", "product", "date", F.posexplode(F.split("ingredients", ";")).alias("i", "ingredient"), "_s")
    e = e.withColumn("strength", F.coalesce(F.get("_s", F.col("i")), F.lit("Not given")))
    rows = F.array_sort(F.collect_list(F.struct("application", "product", "strength", F.coalesce("date", F.lit("Not found")).alias("date"))))
    return e.groupBy(F.trim("ingredient").alias("ingredient")).agg(rows.alias("r")).select("ingredient", *[F.col(f"r.{c}").alias(c) for c in ("application", "product", "strength", "date")])


def submitter_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows per submitter, and how many records have how many genes."""
    return rows.groupBy("submitter").agg(F.count(F.lit(1)).alias("n")), rows.groupBy(F.size("genes").alias("n_genes")).agg(F.count(F.lit(1)).alias("n"))


def phenotypes(rows: DataFrame, inc: DataFrame) -> DataFrame:
    """(src, dst, key, attrs): disorder and phenotype, both by code; the frequency is an attribute only where given.

    Rows meet the holders of both codes as arrays, and pairs are made last, where nothing is shuffled any more; what a
    phenotype's code makes is dealt over as many tasks as it needs.
    """
    codes = inc.filter("key = 'I_CODE'").select("entity_id", "value")
    sizes = written(codes.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "sizes")
    block = F.pmod(F.xxhash64("entity_id"), F.ceil(F.col("n") / BLOCK)).alias("block")
    none = F.array_repeat(F.lit(None).cast(inc.schema["entity_id"].dataType), F.count_if(F.col("entity_id").isNull()).cast("int"))
    held = written(codes.join(sizes, "value").groupBy("value", block).agg(F.concat(F.collect_list("entity_id"), none).alias("ids")), "holders")
    attrs = F.when(no_value(F.col("frequency")).isNotNull(), F.create_map(F.lit("frequency"), F.trim("frequency")))
    r = rows.select(F.upper("disorder").alias("_l"), F.upper("phenotype").alias("_r"), attrs.alias("attrs"))
    size = lambda c, n: sizes.select(F.col("value").alias(c), F.col("n").alias(n))
    r = r.join(size("_l", "_a"), "_l").join(size("_r", "_b"), "_r")
    r = written(r.select("_l", "_r", "attrs", (F.col("_a") * F.col("_b")).alias("_n"), F.monotonically_increasing_id().alias("_id")), "rows")
    deal = written(r.groupBy("_r").agg(F.sum("_n").alias("n")).select("_r", "n", F.least(F.lit(5000), 1 + F.floor(F.col("n") / PAIRS)).alias("parts")), "deal")
    tasks = max(1, min(5000, (deal.agg(F.sum("n")).first()[0] or 0) // PAIRS))
    a, b = held.select(F.col("value").alias("_l"), F.col("ids").alias("srcs")), held.select(F.col("value").alias("_r"), F.col("ids").alias("dsts"))
    left = r.join(deal, "_r").join(a, "_l").select("_r", F.pmod(F.xxhash64("_id", F.col("srcs")[0]), "parts").alias("_part"), "attrs", "srcs")
    right = b.join(deal, "_r").select("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("_part"), "dsts")
    met = left.repartition(tasks, "_r", "_part").join(right.repartition(tasks, "_r", "_part"), ["_r", "_part"])
    pairs = met.select("attrs", F.explode("srcs").alias("src"), "dsts").select("attrs", "src", F.explode("dsts").alias("dst"))
    return pairs.select("src", "dst", F.lit("R_hasPhenotype").alias("key"), "attrs")


def prevalence(rows: DataFrame, inc: DataFrame) -> DataFrame:
    """(src, source, id, key, attrs, pmids): a data row per disorder, source and id, once; PubMed ids from the text."""
    codes = inc.filter("key = 'I_CODE'").select(F.col("entity_id").alias("src"), F.col("value").alias("_l"))
    attrs = F.to_json(F.struct(*[c for c in rows.columns if c not in ("disorder", "source", "id")]))
    pmids = F.transform(F.regexp_extract_all(F.coalesce("reference", F.lit("")), F.lit(r"(\d+)\[PMID\]"), 1), lambda x: x.try_cast("bigint"))
    found = rows.select(F.upper("disorder").alias("_l"), "source", "id", F.lit("PREVALENCE").alias("key"), attrs.alias("attrs"), pmids.alias("pmids")).join(codes, "_l").drop("_l")
    return found.groupBy("src", "source", "id", "key").agg(F.min(F.struct("attrs", "pmids")).alias("x")).select("src", "source", "id", "key", "x.*")


def encoded(value: Column) -> Column:
    """Base64 of a value's JSON, in one line."""
    return F.regexp_replace(F.base64(F.to_json(value).cast("binary")), r"\s", "")


def drug_records(rows: DataFrame) -> DataFrame:
    """Drug records of XML (``drugbank-id``: array of struct<_primary, _VALUE>): the primary id and the others,
    the record's own name, synonyms and groups merged, and the whole record as base64 JSON."""
    ids = F.col("`drugbank-id`")
    primary = F.filter(ids, lambda x: F.coalesce(x["_primary"], F.lit(False)))
    merged = F.array_sort(F.array_distinct(F.filter(F.concat(*[F.coalesce(F.col(c), F.expr("cast(array() as array<string>)")) for c in ("synonyms", "groups")]), lambda x: F.trim(x) != "")))
    return rows.select(primary[0]["_VALUE"].alias("id"), F.transform(F.filter(ids, lambda x: ~F.coalesce(x["_primary"], F.lit(False))), lambda x: x["_VALUE"]).alias("others"), "name", merged.alias("terms"), encoded(F.struct("*")).alias("record"))


# What stands for an unknown value in these records.
UNKNOWN = ["Unknown"]


def json_records(rows: DataFrame, structure: str) -> DataFrame:
    """Records of JSON with nested objects as base64 JSON and unknown values as null; those without a structure go."""
    out = []
    for f in rows.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind.startswith("struct") or kind.startswith("array<struct"):
            c = F.when(c.isNotNull(), encoded(c))
        elif kind == "string":
            c = F.when(~F.trim(c).isin(*UNKNOWN), c)
        elif kind == "array<string>":
            c = F.filter(c, lambda x: ~F.trim(x).isin(*UNKNOWN))
        out.append(c.alias(f.name))
    return rows.select(*out).filter(F.trim(F.coalesce(F.col(structure), F.lit(""))) != "")


def metabolites(rows: DataFrame) -> DataFrame:
    """Metabolite records: accession and secondary accessions, the metabolite's own synonyms, and patients of
    abnormal concentrations only."""
    patients = F.transform(F.coalesce("abnormal_concentrations", F.expr("cast(array() as array<struct<patient_information:string>>)")), lambda x: x["patient_information"])
    return rows.select("accession", F.array_except("secondary", F.array("accession")).alias("secondary"), "name", F.array_distinct("synonyms").alias("synonyms"), F.array_sort(F.array_distinct(F.filter(patients, lambda x: x.isNotNull()))).alias("patients"))


def samples(rows: DataFrame, wanted: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Sample rows with both names in one array; only listed samples (column sample), or the first ``most`` by id."""
    names = F.array_distinct(F.filter(F.array("name", "preferred"), lambda x: x.isNotNull() & (F.trim(x) != "")))
    out = rows.withColumn("names", names).drop("name", "preferred")
    out = out if wanted is None else out.join(wanted.select("sample").distinct(), "sample", "left_semi")
    return out if most is None else out.orderBy("sample").limit(most)


def chapters(rows: DataFrame) -> DataFrame:
    """Book chapters (xml: JATS text): keywords by the group's type, authors with their affiliations, history dates."""
    groups = ["Synonyms", "GeneSymbol", "DiseaseName", "ProteinName", "Include"]
    words = lambda g: F.transform(F.xpath("xml", F.lit(f"//kwd-group[@kwd-group-type='{g}']/kwd/text()")), lambda x: F.trim(x))
    authors = F.zip_with(F.xpath("xml", F.lit("//contrib/name/surname/text()")), F.xpath("xml", F.lit("//contrib/xref/@rid")), lambda a, r: F.struct(a.alias("name"), r.alias("rid")))
    places = F.map_from_arrays(F.xpath("xml", F.lit("//aff/@id")), F.xpath("xml", F.lit("//aff/text()")))
    part = lambda e: F.xpath("xml", F.lit(f"//history/date/{e}/text()"))
    dates = F.transform(F.arrays_zip(part("month").alias("m"), part("day").alias("d"), part("year").alias("y")), lambda x: F.concat_ws("/", F.lpad(x["m"], 2, "0"), F.lpad(x["d"], 2, "0"), x["y"]))
    out = rows.select("id", F.xpath_string("xml", F.lit("//title")).alias("title"), *[words(g).alias(g) for g in groups], authors.alias("_a"), places.alias("_p"), dates.alias("dates"))
    return out.withColumn("authors", F.transform("_a", lambda a: F.struct(a["name"].alias("name"), F.get(F.map_values(F.map_filter("_p", lambda k, v: k == a["rid"])), F.lit(0)).alias("affiliation")))).drop("_a", "_p")


def line_records(lines: DataFrame, names: list[str], sep: str = "\t", value: str = "value") -> DataFrame:
    """Delimited rows by the names: ``NA`` reads Not Available, short rows keep the cells they have, long ones lose the rest."""
    cell = F.split(F.col(value), sep)
    return lines.select(*[F.when(F.trim(F.get(cell, F.lit(i))) == "NA", "Not Available").otherwise(F.get(cell, F.lit(i))).alias(n) for i, n in enumerate(names)])


def structure_column(rows: DataFrame, sample: int = 100) -> str | None:
    """The column whose first ``sample`` non-empty values look most like structure lines (SMILES), if most do."""
    looks = r"^(?=.*[CNOcno])[A-Za-z0-9@+\-\[\]()=#$%/\\.*:]{3,}$"
    head = rows.limit(sample)
    shares = head.agg(*[F.avg(F.col(f"`{c}`").rlike(looks).cast("int")).alias(c) for c in rows.columns]).first().asDict()
    best = max(shares, key=lambda c: (shares[c] or 0, -rows.columns.index(c)))
    return best if (shares[best] or 0) > 0.5 else None


# Alkali metals.
GROUP_1 = ["Li", "Na", "K", "Rb", "Cs", "Fr"]


def group_1_metal(structure: Column) -> Column:
    """Is a structure line one atom, and an alkali metal?"""
    return F.regexp_extract(F.trim(structure), r"^\[\d*([A-Z][a-z]?)(?:H\d*)?[+-]?\d*\]$", 1).isin(*GROUP_1)
