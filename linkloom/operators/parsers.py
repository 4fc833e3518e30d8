"""Event parsers: payload columns of each kind of source to events (``events.event``).

Every parser takes a DataFrame with ``entity_id`` and the columns it names, and returns events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.events import any_date, application_kind, base64_json, event, monograph_kind, suffixes, undominated


def applications(df: DataFrame) -> DataFrame:
    """app_type, app_no, product, sponsor, date, active: no date, no event."""
    d = any_date(F.col("date"))
    return event(df.filter(d.isNotNull()), F.col("entity_id"), kind=application_kind(F.col("app_type"), F.lower("active") == "true"), source=F.lit("Drugs@FDA"), id=F.concat("app_type", "app_no"), app_id=F.concat("app_type", "app_no"), start=d, jurisdiction=F.lit("US"), product=F.col("product"), sponsor=F.col("sponsor"), active=F.lower("active") == "true")


CONDITIONS = "array<struct<name:string,highestPhase:string,url:string,date:string,route:string,sponsor:string>>"


def conditions(df: DataFrame) -> DataFrame:
    """``conditions``: base64 JSON.  Approved or phase IV is marketed, in the US if the url says so; the last that qualifies wins."""
    c = df.select("entity_id", F.posexplode(base64_json(F.col("conditions"), CONDITIONS)).alias("pos", "c")).select("entity_id", "pos", "c.*")
    good = c.filter(F.lower("highestPhase").isin("approved", "phase iv"))
    last = good.groupBy("entity_id").agg(F.max_by(F.struct("name", "url", "date", "route", "sponsor"), "pos").alias("c")).select("entity_id", "c.*")
    us = F.col("url").rlike("fda\\.gov|dailymed")
    return event(last, F.col("entity_id"), kind=F.lit("Marketed"), source=F.lit("conditions"), id=F.col("name"), start=any_date(F.col("date")), jurisdiction=F.when(us, "US"), route=F.col("route"), sponsor=F.col("sponsor"), url=F.col("url"))


def withdrawals(df: DataFrame) -> DataFrame:
    """name, country, date, reason: NA is null, the country is the jurisdiction."""
    na = lambda c: F.nullif(F.trim(c), F.lit("NA"))
    return event(df, F.col("entity_id"), kind=F.lit("Withdrawn"), source=F.lit("Withdrawn"), id=na("name"), start=any_date(na("date")), jurisdiction=na("country"), comment=na("reason"))


def trials(df: DataFrame, earliest_per: str | None = "phase") -> DataFrame:
    """nct, phase, status, date: phase 4 is marketed; the earliest per phase stays, or the last per status (earliest_per None)."""
    w = Window.partitionBy("entity_id", earliest_per or "status").orderBy(F.asc(any_date(F.col("date"))) if earliest_per else F.desc(any_date(F.col("date"))), "nct")
    kept = df.withColumn("r_", F.row_number().over(w)).filter("r_ = 1")
    url = F.when(F.col("nct").startswith("NCT"), F.concat(F.lit("https://clinicaltrials.gov/study/"), "nct")).otherwise(F.concat(F.lit("https://trialsearch.who.int/"), "nct"))
    return event(kept, F.col("entity_id"), kind=F.when(F.col("phase") == "Phase 4", "Marketed").otherwise("Clinical"), source=F.lit("ClinicalTrials"), id=F.col("nct"), start=any_date(F.col("date")), comment=F.col("phase"), url=url)


# Record type or name suffix -> (jurisdiction, kind).
RECORD_KINDS = {
    "HEALTH -CANADA NHP INGREDIENT MONOGRAPH": ("Canada", "Marketed"),
    "Canada": ("Canada", "Marketed"),
    "UK NHS": ("UK", "Marketed"),
    "Japan": ("Japan", "Marketed"),
    "ORANGE BOOK": ("US", "Marketed"),
    "WHO-ATC": (None, "Marketed"),
    "WHO-ESSENTIAL MEDICINES LIST": (None, "Marketed"),
    "CFR": ("US", "Marketed"),
    "FDA ORPHAN DRUG": ("US", "Designation"),
    "DEA NO.": ("US", "Other"),
    "EU-Orphan Drug": ("EU", "Designation"),
    "INN": (None, "Clinical"),
    "USAN": ("US", "Clinical"),
    "JAN": ("Japan", "Clinical"),
    "BAN": ("UK", "Clinical"),
    "GREEN BOOK": ("US", "USAnimalDrug"),
}


def regulation_kind(entry: Column) -> Column:
    """What a citation of the federal regulations tells: animal drugs in 21 CFR 5, marketed ones in 2, 3 and 6."""
    return F.when(entry.startswith("21 CFR 5"), "USAnimalDrug").when(entry.rlike("^21 CFR [236]"), "Marketed").otherwise("Other")


def _record_events(df: DataFrame, entry: Column, type_: Column, pages: str | None) -> DataFrame:
    kind = F.create_map(*[x for k, (_, v) in RECORD_KINDS.items() for x in (F.lit(k), F.lit(v))])
    place = F.create_map(*[x for k, (v, _) in RECORD_KINDS.items() if v for x in (F.lit(k), F.lit(v))])
    url = F.concat(F.lit(pages), "unii")  # null without an address
    return event(df, F.col("entity_id"), kind=F.when(type_ == "CFR", regulation_kind(entry)).otherwise(kind[type_]), source=F.lit("G-SRS"), id=F.col("unii"), comment=type_, product=entry, jurisdiction=place[type_], url=url)


def substance_events(df: DataFrame, pages: str | None = None) -> DataFrame:
    """``unii``, ``entries`` (map of record type to its first entry) and ``names``: one event per listed type; one
    that a name's bracketed suffix tells of takes the place of the record's.  Without an identifier, none.
    ``pages``: address before the identifier in an event's url."""
    known = df.filter("unii is not null")
    direct = known.select("entity_id", "unii", F.explode("entries").alias("type", "entry")).filter(F.col("type").isin(*RECORD_KINDS))
    # the text between the last opening and the last closing bracket
    suffix = F.regexp_extract("entry", r"^.* \[(.*)\][^\]]*$", 1)
    named = known.select("entity_id", "unii", F.posexplode("names").alias("pos", "entry")).withColumn("type", suffix).filter(F.col("type").isin(*RECORD_KINDS) & (F.col("type") != "CFR"))
    named = named.groupBy("entity_id", "unii", "type").agg(F.max_by("entry", "pos").alias("entry"))
    first = direct.join(named.select("entity_id", "type"), ["entity_id", "type"], "left_anti").select("entity_id", "unii", "type", "entry")
    return _record_events(first.unionByName(named.select("entity_id", "unii", "type", "entry")), F.col("entry"), F.col("type"), pages)


def named_suffixes(df: DataFrame) -> DataFrame:
    """``names`` (array): an event for each bracketed suffix that is listed."""
    kind = F.create_map(*[x for k, (_, v) in RECORD_KINDS.items() for x in (F.lit(k), F.lit(v))])
    s = df.select("entity_id", F.explode("names").alias("name")).select("entity_id", "name", F.explode(suffixes(F.col("name"))).alias("suffix"))
    return event(s.filter(kind[F.col("suffix")].isNotNull()), F.col("entity_id"), kind=kind[F.col("suffix")], source=F.lit("names"), id=F.col("name"), comment=F.col("suffix"))


def references(df: DataFrame) -> DataFrame:
    """``refs``: lines ``ingredient|product|type``."""
    p = df.select("entity_id", F.explode(F.split("refs", "\n")).alias("l")).withColumn("p", F.split("l", r"\|")).filter(F.size("p") == 3)
    return event(p, F.col("entity_id"), kind=F.when(F.lower(F.col("p")[2]).contains("approved"), "Marketed").otherwise("Other"), source=F.lit("references"), id=F.col("p")[0], product=F.col("p")[1], comment=F.col("p")[2])


def monographs(df: DataFrame) -> DataFrame:
    return event(df, F.col("entity_id"), kind=monograph_kind(F.col("status")), source=F.lit("monograph"), id=F.col("monograph"), jurisdiction=F.lit("US"), comment=F.col("status"))


def excipients(df: DataFrame) -> DataFrame:
    return event(df, F.col("entity_id"), kind=F.lit("Excipient"), source=F.lit("excipients"), id=F.col("name"), jurisdiction=F.lit("US"), route=F.col("route"))


def animal_drugs(df: DataFrame) -> DataFrame:
    """application, status: approved ones; numbers that begin with 200 are abbreviated applications."""
    kind = F.when(F.col("application").startswith("200"), "ANADA").otherwise("NADA")
    return event(df.filter("status = 'Approved'"), F.col("entity_id"), kind=F.lit("USAnimalDrug"), source=F.lit("animal drugs"), id=F.col("application"), app_id=F.concat(kind, F.col("application")), jurisdiction=F.lit("US"))


PRODUCT = "struct<name:string,country:string,company:string,year:string>"


def manufactured(df: DataFrame) -> DataFrame:
    """``products``: lines of base64 JSON."""
    p = df.select("entity_id", F.explode(F.split("products", "\n")).alias("l")).select("entity_id", base64_json(F.col("l"), PRODUCT).alias("p")).filter("p.name is not null")
    return event(p, F.col("entity_id"), kind=F.lit("Marketed"), source=F.lit("products"), id=F.col("p.name"), product=F.col("p.name"), sponsor=F.col("p.company"), jurisdiction=F.col("p.country"), start=F.make_date(F.col("p.year").try_cast("int"), F.lit(12), F.lit(31)))


def label_kind(status: Column, application: Column, product_type: Column) -> Column:
    """Looked-up status, then the application's number: NDA and BLA are prescription, a monograph (CFR) is over the counter."""
    return F.when(product_type.rlike("(?i)animal|veterinary"), None).when(application.rlike("^(N?ANDA|NDA|BLA)"), "USApprovalRx").when(application.rlike("(?i)^(part|CFR)"), "USApprovalOTC").otherwise(F.coalesce(status, F.lit("Marketed")))


def product_labels(df: DataFrame, logic: DataFrame) -> DataFrame:
    """Product labels: market_status, product_type, comment, application, initial_year, market_date, end_date, route, set_id.

    The start is the earlier of the end of the initial year and the marketing date; veterinary products
    are skipped; within a jurisdiction and route dominated intervals go.
    """
    keys = ["market_status", "product_type", "comment"]
    start = F.least(F.make_date(F.col("initial_year").try_cast("int"), F.lit(12), F.lit(31)), any_date(F.col("market_date")))
    joined = df.join(logic, keys, "left")
    e = event(joined, F.col("entity_id"), kind=label_kind(F.col("status"), F.col("application"), F.col("product_type")), source=F.lit("labels"), id=F.col("set_id"), app_id=F.col("application"), start=F.coalesce(start, any_date(F.col("market_date"))), end=any_date(F.col("end_date")), jurisdiction=F.lit("US"), route=F.col("route"), comment=F.col("comment")).filter("kind is not null")
    return undominated(e, ["entity_id", "jurisdiction", "route"], "start", "end", "id")


def product_records(df: DataFrame) -> DataFrame:
    """name, country, approved, started, ended, generic: ended ones are discontinued, unapproved ones marketed; what is left in the US goes."""
    kind = F.when(F.col("ended").isNotNull() & (F.col("ended") != ""), "Discontinued").when(F.lower("approved") == "false", "Marketed").when(F.col("country") == "US", None).otherwise("Marketed")
    e = event(df, F.col("entity_id"), kind=kind, source=F.lit("product records"), id=F.col("name"), start=any_date(F.col("started")), end=any_date(F.col("ended")), jurisdiction=F.col("country"), product=F.col("name")).filter("kind is not null")
    return undominated(e, ["entity_id", "jurisdiction", "route"], "start", "end", "id")
