"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and calls one
operator of ``linkloom.llm``.  All stages but the last return the columns of ``documents``.

In every stage a null text counts as empty, very long texts are worked on whole, columns besides doc_id and
text pass through whatever their names, and a table without rows gives one without rows.  What a stage does
with null ids, repeated rows and ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import decontaminate, jaccard, packing, quality, repeats
from linkloom.llm.common import table
from linkloom.storage import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a rule of the cascade rejects go: empty ones do; repeated rows and rows
    without an id are judged each by its text."""
    return quality.keep(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, 0.8 or more) the smallest doc_id stays; of rows that repeat
    doc_id and text one does; rows without an id stay, and keep no copy of theirs from staying."""
    return jaccard.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that start elsewhere too are cut out of the texts, in all places; halves of a character
    that was cut go too; rows stay, empty ones as well."""
    return repeats.strip_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their doc_id; null and one-word items are in none."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as pieces of sequences, one row a piece; an empty text is its end id."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The order in which rules, trees and suffixes decide is not for SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
