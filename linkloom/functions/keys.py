"""Column functions on key values: normal form, extraction, merging, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized(values: Column) -> Column:
    """Upper case, distinct, sorted; nulls go."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(values, lambda x: x.isNotNull()), F.upper)))


def regex_values(text: Column, pattern: str, *, least: int = 1, upper: bool = False, block: list[str] | None = None) -> Column:
    """All whole matches: trimmed, without double quotes, of ``least`` characters, not blocked, first seen first."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    if upper:
        found = F.transform(found, F.upper)
    found = F.filter(found, lambda x: F.length(x) >= least)
    if block:
        found = F.filter(found, lambda x: ~F.upper(x).isin([b.upper() for b in block]))
    return F.array_distinct(found)


def long_values(values: Column) -> Column:
    """The values that parse as BIGINT; others are dropped."""
    return F.filter(F.transform(values, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def long_tokens(text: Column) -> Column:
    return long_values(F.split(F.trim(text), r"[\n\s,]+"))


def merged(a: Column, b: Column) -> Column:
    """Union in order; a null side counts as empty."""
    empty = F.expr("cast(array() as array<string>)")
    return F.array_union(F.coalesce(a.cast("array<string>"), empty), F.coalesce(b.cast("array<string>"), empty))


def delta(value: Column, old: Column) -> Column:
    """(state, values): CHANGED with value minus old, NULL if nothing is left, NO_CHANGE if they are disjoint."""
    left = F.array_except(value, old)
    state = F.when(~F.arrays_overlap(value, old), "NO_CHANGE").when(F.size(left) == 0, "NULL").otherwise("CHANGED")
    return F.struct(state.alias("state"), F.when(state == "CHANGED", left).alias("values"))


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets; an empty array equals nothing."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)))


def has_any(labels: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(labels, F.array(*map(F.lit, wanted)))


def has_all(labels: Column, wanted: list[str]) -> Column:
    return F.size(F.array_intersect(labels, F.array(*map(F.lit, wanted)))) == len(set(wanted))


def source_label(name: Column) -> Column:
    """S_ and the upper-cased name; .digit becomes _digit, and what follows another dot is cut."""
    digits = F.regexp_replace(name, r"\.(\d)", "_$1")
    return F.concat(F.lit("S_"), F.upper(F.regexp_replace(digits, r"\..*$", "")))


def text_type(value: Column) -> Column:
    """Type of a text cell: Integer, Double or String."""
    return F.when(value.rlike(r"^[+-]?\d+$"), "Integer").when(value.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "Double").otherwise("String")


def structure_suffix(value: Column) -> Column:
    """M (metal), S (salt or solvent) or N (other) of a layered structure hash, else null."""
    return F.when(F.substring(value, -2, 1) == "-", F.substring(value, -1, 1))


def without_blocked(inc: DataFrame, blocked: DataFrame) -> DataFrame:
    """Incidence rows whose value, upper-cased, is not blocked for the key (a null key blocks for all keys)."""
    b = blocked.select(F.col("key").alias("_k"), F.upper("value").alias("_v"))
    return inc.join(b.filter(b["_k"].isNotNull()), (F.col("key") == F.col("_k")) & (F.upper("value") == F.col("_v")), "left_anti").join(b.filter(b["_k"].isNull()).select("_v"), F.upper("value") == F.col("_v"), "left_anti")
