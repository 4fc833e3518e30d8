"""Events of resolved entities and the variables derived from them.

An event has the columns kind, source, id, start, end, active, jurisdiction, comment, route, app_id,
product, sponsor, url; ``event`` fills those that a parser does not set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.model import APPROVED, EVENT_KINDS, MARKETED, PHASES

FIELDS = {"kind": "string", "source": "string", "id": "string", "start": "date", "end": "date", "active": "boolean", "jurisdiction": "string", "comment": "string", "route": "string", "app_id": "string", "product": "string", "sponsor": "string", "url": "string"}


def event(df: DataFrame, entity: Column, **fields: Column) -> DataFrame:
    return df.select(entity.alias("entity_id"), *[fields.get(f, F.lit(None)).cast(t).alias(f) for f, t in FIELDS.items()])


def rank_of(value: Column, order: list[str]) -> Column:
    """Place in a fixed order, from 0; null if it is not listed."""
    table = F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))])
    return table[value]


def any_date(text: Column) -> Column:
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "MM/dd/yyyy"))


def numbered_ids(events: DataFrame) -> DataFrame:
    """The n-th repeat of an id within an entity gets :n behind it (n from 2)."""
    w = Window.partitionBy("entity_id", "id").orderBy("start", "kind", "source", "product", "comment")
    n = F.row_number().over(w)
    return events.withColumn("_n", n).withColumn("id", F.when(F.col("_n") > 1, F.concat_ws(":", "id", "_n")).otherwise(F.col("id"))).drop("_n")


def highest(events: DataFrame) -> DataFrame:
    """(entity_id, kind, id, phase): the best kind; among clinical events the latest phase; then the least id."""
    order = F.struct(rank_of(F.col("kind"), EVENT_KINDS).alias("r"), F.when(F.col("kind") == "Clinical", -F.coalesce(rank_of(F.col("comment"), PHASES), F.lit(-1))).otherwise(0).alias("p"), F.col("id"))
    best = events.filter(F.col("kind").isin(EVENT_KINDS)).groupBy("entity_id").agg(F.min_by(F.struct("kind", "id", "comment"), order).alias("b"))
    return best.select("entity_id", "b.kind", "b.id", F.when(F.col("b.kind") == "Clinical", F.col("b.comment")).alias("phase"))


def initially_marketed(events: DataFrame) -> DataFrame:
    """(entity_id, first_any, first_us): earliest starts of marketed kinds."""
    marketed = F.col("kind").isin(MARKETED)
    return events.groupBy("entity_id").agg(F.min(F.when(marketed, F.col("start"))).alias("first_any"), F.min(F.when(marketed & (F.col("jurisdiction") == "US"), F.col("start"))).alias("first_us"))


def us_approved(events: DataFrame) -> DataFrame:
    """(entity_id, id): the last approved US event, by start then id."""
    e = events.filter(F.col("kind").isin(APPROVED) & (F.col("jurisdiction") == "US"))
    return e.groupBy("entity_id").agg(F.max_by("id", F.struct("start", "id")).alias("id"))


def labels(events: DataFrame) -> DataFrame:
    """(entity_id, labels): sorted kinds and sources."""
    return events.groupBy("entity_id").agg(F.array_sort(F.array_union(F.collect_set("kind"), F.collect_set("source"))).alias("labels"))


def undominated(events: DataFrame, group: list[str], start: str, end: str, key: str) -> DataFrame:
    """Drops an event whose interval lies within another's of its group (null end: open); of equal ones the least key stays.

    By a sort, not by pairs: ordered by start, and by end downwards among equals, an event is dominated
    exactly if an earlier one ends no sooner.
    """
    until = F.coalesce(F.col(end).cast("timestamp"), F.lit("9999-12-31").cast("timestamp"))
    w = Window.partitionBy(*group).orderBy(F.col(start), until.desc(), F.col(key)).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(until).over(w)
    return events.withColumn("_m", latest).filter(F.col("_m").isNull() | (F.col("_m") < until)).drop("_m")


def with_status(rows: DataFrame, logic: DataFrame, on: list[str], otherwise: str) -> DataFrame:
    """Looks a status up by several columns in a small table of rules."""
    return rows.join(logic, on, "left").withColumn("status", F.coalesce("status", F.lit(otherwise)))


def base64_json(column: Column, schema: str) -> Column:
    return F.from_json(F.unbase64(column).cast("string"), schema)


def suffixes(text: Column) -> Column:
    """What stands in brackets after a space: ``NAME [ORANGE BOOK]`` gives ORANGE BOOK."""
    return F.regexp_extract_all(text, F.lit(r" \[([^\]]*)\]"), 1)


def application_kind(app_type: Column, active: Column) -> Column:
    return F.when(active, F.when(app_type.isin("NDA", "ANDA", "BLA"), "USApprovalRx").otherwise("USApprovalOTC")).otherwise("USPreviouslyMarketed")


def monograph_kind(status: Column) -> Column:
    return F.when(status == "Approved", "USApprovalOTC").when(status == "Marketed", "Marketed").when(status == "Animal Drug", "USAnimalDrug").otherwise("USPreviouslyMarketed")


def clinical_latest(events: DataFrame) -> DataFrame:
    """Of each entity and phase the earliest clinical event; phase 4 counts as marketed."""
    e = events.filter(F.col("comment").isin(PHASES)).withColumn("kind", F.when(F.col("comment") == "Phase 4", "Marketed").otherwise("Clinical"))
    w = Window.partitionBy("entity_id", "comment").orderBy("start", "id")
    return e.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def approval_years(products: DataFrame, submissions: DataFrame, book: DataFrame) -> DataFrame:
    """(ingredient, application, date): earliest submission, overridden by an earlier book date, within 1938-08-01 and now; then the earliest application of an ingredient."""
    first = submissions.groupBy("application").agg(F.min("date").alias("d"))
    other = book.groupBy("application").agg(F.min("date").alias("b"))
    dated = products.join(first, "application", "left").join(other, "application", "left").withColumn("date", F.least("d", "b")).filter("date > date'1938-08-01' and date <= current_date()")
    w = Window.partitionBy("ingredient").orderBy("date", "application")
    return dated.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("ingredient", "application", "date")
