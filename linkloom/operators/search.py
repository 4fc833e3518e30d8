"""Token index, boolean search, n-grams and text resolution."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English stop words of the index.
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def index(docs: DataFrame, entity: str, text: str) -> DataFrame:
    """(entity_id, token, freq)."""
    return docs.select(F.col(entity).alias("entity_id"), F.explode(tokens(F.col(text))).alias("token")).groupBy("entity_id", "token").agg(F.count(F.lit(1)).alias("freq"))


@dataclass(frozen=True)
class Clause:
    """``need``: + required, ~ optional, - forbidden.  ``phrases``: any of these token runs; in one, a token may
    stand up to ``slop`` places from where it belongs."""

    need: str
    phrases: tuple[tuple[str, ...], ...]
    slop: int = 0

    def words(self) -> set[str]:
        return {t for p in self.phrases for t in p}


def rewritten(query: str) -> list[Clause]:
    """Clauses of a query: plain words and quotes are required, ~ makes one optional, - and NOT forbid it; quotes
    may end in ~n; x's stands for any of x's, x and xs; AND and OR between required words change nothing."""
    out, negate = [], False
    for mark, quoted, slop, word in re.findall(r'([+\-~]?)"([^"]+)"(?:~(\d+))?|(\S+)', query):
        if word in ("AND", "OR", "NOT"):
            negate = word == "NOT"
            continue
        if word and word[0] in "+-~":
            mark, word = word[0], word[1:]
        possessive = re.fullmatch(r"(.+)'s", word.lower())
        variants = [f"{possessive[1]} s", possessive[1], possessive[1] + "s"] if possessive else [quoted or word]
        phrases = tuple(p for v in variants if (p := tuple(re.findall("[a-z0-9]+", v.lower()))))
        if phrases:
            out.append(Clause("-" if negate else mark or "+", phrases, int(slop or 0)))
        negate = False
    return out


def search(idx: DataFrame, query: str, top: int | None = None) -> DataFrame:
    """(entity_id, score) from an index: as ``search_text``, but a phrase is met by its words in any places."""
    return _scored(idx, rewritten(query), top)


def _scored(idx: DataFrame, clauses: list[Clause], top: int | None = None) -> DataFrame:
    """Entities that meet all required and no forbidden clause, by summed 1 + ln(freq); ties by id."""
    words = sorted({w for c in clauses for w in c.words()})
    counted = sorted({w for c in clauses if c.need != "-" for w in c.words()})
    hit = idx.filter(F.col("token").isin(words or [""])).groupBy("entity_id").agg(F.collect_set("token").alias("_t"), F.sum(F.when(F.col("token").isin(counted or [""]), 1 + F.log("freq")).otherwise(0.0)).alias("score"))
    for c in clauses:
        if c.need != "~":
            met = reduce(or_, [F.size(F.array_intersect("_t", F.array(*map(F.lit, sorted(set(p)))))) == len(set(p)) for p in c.phrases])
            hit = hit.filter(met if c.need == "+" else ~met)
    out = hit.select("entity_id", F.round("score", 6).alias("score"))
    out = out if any(c.need == "+" for c in clauses) else out.filter("score > 0")
    return out if top is None else out.orderBy(F.desc("score"), "entity_id").limit(top)


def _stands(places: Column, phrase: tuple[str, ...], slop: int) -> Column:
    """Does the phrase stand in an array of (pos, token)?"""

    def follows(first: Column, i: int, token: str) -> Column:
        return F.exists(places, lambda y: (y["token"] == token) & (F.abs(y["pos"] - first["pos"] - i) <= slop))

    def after(first: Column) -> Column:
        return reduce(and_, [first["token"] == phrase[0], *[follows(first, i, t) for i, t in enumerate(phrase) if i]])

    return F.exists(places, after)


def search_text(docs: DataFrame, entity: str, text: str, query: str, top: int | None = None) -> DataFrame:
    """(entity_id, score): entities whose text meets all required and no forbidden clause, phrases in place."""
    clauses = rewritten(query)
    out = _scored(index(docs, entity, text), [c if c.need != "-" or all(len(p) == 1 for p in c.phrases) else Clause("~", ()) for c in clauses])
    placed = [c for c in clauses if c.need != "~" and any(len(p) > 1 for p in c.phrases)]
    if placed:
        words = F.array(*map(F.lit, sorted({w for c in placed for w in c.words()})))
        places = F.filter(F.transform(tokens(F.col(text)), lambda t, i: F.struct(i.alias("pos"), t.alias("token"))), lambda x: F.array_contains(words, x["token"]))
        rows = docs.select(F.col(entity).alias("entity_id"), places.alias("_p")).join(out.select("entity_id").distinct(), "entity_id")
        for c in placed:
            met = reduce(or_, [_stands(F.col("_p"), p, c.slop) for p in c.phrases])
            rows = rows.filter(met if c.need == "+" else ~met)
        out = out.join(rows.select("entity_id"), "entity_id", "left_semi")
    return out if top is None else out.orderBy(F.desc("score"), "entity_id").limit(top)


def ngrams(text: Column, least: int = 1, most: int = 3, stop: list[str] = STOP) -> Column:
    """Shingles of least..most words without stop words, smaller sizes first."""
    words = F.filter(tokens(text), lambda w: ~w.isin(stop)) if stop else tokens(text)

    def grams(w: Column, n: int) -> Column:
        first = F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))
        return F.transform(first, lambda x, i: F.concat(x, *[y for j in range(1, n) for y in (F.lit(" "), F.get(w, i + j))])) if n > 1 else w

    # a variable of a function, so the words of a text are found once
    return F.flatten(F.transform(F.array(words), lambda w: F.concat(*[grams(w, n) for n in range(least, most + 1)])))


def resolve(texts: DataFrame, entity: str, text: str, names: DataFrame) -> DataFrame:
    """(entity_id, name, hits): dictionary names (longer than three characters, of any number of words) that
    stand in a text, and in how many places.

    Texts give one row per word, which meets the names' words; a name stands where all of its words meet at
    their distances.  Only words of some name outlive the join, and nothing grows with the names' lengths.
    """
    known = names.filter(F.length("name") > 3).select(tokens(F.col("name")).alias("w")).filter(F.size("w") > 0).select(F.array_join("w", " ").alias("name"), "w").distinct()
    words = known.select("name", F.size("w").alias("n"), F.posexplode("w").alias("at", "token"))
    placed = texts.select(F.col(entity).alias("entity_id"), F.posexplode(tokens(F.col(text))).alias("pos", "token"))
    met = placed.join(words, "token").withColumn("start", F.col("pos") - F.col("at"))
    single = met.filter("n = 1").select("entity_id", "name", "start")
    longer = met.filter("n > 1").groupBy("entity_id", "name", "n", "start").agg(F.count(F.lit(1)).alias("_c")).filter("_c = n").select("entity_id", "name", "start")
    return single.unionByName(longer).groupBy("entity_id", "name").agg(F.count(F.lit(1)).alias("hits"))
