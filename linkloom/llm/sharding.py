"""Sharding by proportional stratified interleaving (law ``rows``).

Rows are shuffled within their source by a seeded hash, row r of n gets the fractional rank
(r + 1/2) / n, and all rows, sorted by it, are cut into shards of equal counts: each shard then
holds every source in its share of the whole, to within one row or two.

Both ranks are found without one task that sees a whole source or the whole table: a row's hash
(then its fraction) falls into one of B buckets, the buckets' counts are summed into offsets, and
``row_number`` runs within a bucket only.  Hashes and fractions are uniform, so buckets are even
however large one source is.  The texts are read once and never shuffled.

Groups of equal texts are dealt out like other rows: law ``rows`` cannot hold beside a rule that keeps a
group together which has more rows than a shard.

Edge cases: a null source is a stratum of its own; a null doc_id hashes as null; a null text has
size 1 and the crc of no bytes; repeated rows are kept, and each gets a slot; rows that tie
in source, hash, id, size and crc are the same to the result, whichever comes first; texts are only measured, however long; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SEED = 16, 20_011
#: Rows wanted in a bucket, and the most buckets (the largest table one window sorts).
BUCKET_ROWS, MOST_BUCKETS = 250, 1 << 16


def _offsets(df: DataFrame, strata: list[str], bucket: str) -> DataFrame:
    """Rows before each bucket of a stratum, and the stratum's rows; partial counts come first."""
    counts = df.groupBy(*strata, bucket).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    before = F.sum("_n").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    return counts.select(*strata, bucket, before.alias("_before"), F.sum("_n").over(w).alias("_all"))


def _ranked(df: DataFrame, buckets: int, source: str, doc_id: str, seed: int) -> DataFrame:
    """Adds _rank (from 0, in the source's shuffled order) and _all (rows of the source)."""
    key = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"))
    df = df.withColumn("_stratum", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))).withColumn("_key", key)
    df = df.withColumn("_bucket", F.pmod(F.shiftrightunsigned("_key", 20), F.lit(buckets)))
    offsets = _offsets(df, ["_stratum"], "_bucket")
    order = Window.partitionBy("_stratum", "_bucket").orderBy("_key", doc_id, *[c for c in ("_size", "_crc") if c in df.columns])
    return df.join(offsets, ["_stratum", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(order) - 1).drop("_before")


def interleave(df: DataFrame, shards: int = SHARDS, seed: int = SEED, *, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard of every row of ``df``."""
    n = df.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    body = F.coalesce(F.col(text), F.lit(""))
    base = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), (F.octet_length(body) + F.lit(1)).cast("long").alias("_size"), F.crc32(body.cast("binary")).alias("_crc"))

    def placed(x: DataFrame) -> DataFrame:
        fraction = (F.col("_rank") * 2 + 1) / (F.col("_all") * 2)
        return _ranked(x, buckets, "source", "doc_id", seed).withColumn("_frac", fraction).withColumn("_slice", F.least(F.floor(F.col("_frac") * buckets), F.lit(buckets - 1)))

    # the offsets need ids and sources only, so their plan never reads the texts
    offsets = _offsets(placed(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"))), [], "_slice").select("_slice", "_before")
    order = Window.partitionBy("_slice").orderBy("_frac", "_stratum", "_key", "doc_id", "_size", "_crc")
    place: Column = F.col("_before") + F.row_number().over(order) - 1
    return (
        placed(base).join(offsets, "_slice").withColumn("_place", place)
        .withColumn("_shard", F.expr(f"cast((_place * {shards}) div {max(n, 1)} as int)"))
        .select("doc_id", "source", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("_shard").alias("shard"),
                F.expr(f"_place - (_shard * {n}L + {shards - 1}) div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
