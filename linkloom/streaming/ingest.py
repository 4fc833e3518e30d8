"""Incremental ingest: each micro-batch of incidence rows updates the components.

State is three append-only tables, a part per batch: ``entities`` (entity_id, comp) and ``values`` (key,
value, comp) with the component that each had when it came, and ``renames`` (src, dst), old components that
a later batch joined.  A batch writes its own rows only; what an entity's component is now follows from the
renames (``labels``).  Reading is a semi-join of the batch with the tables; nothing is written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.operators.components import connected_components

TABLES = ("entities", "values", "renames")


def current(rows: DataFrame, renames: DataFrame | None) -> DataFrame:
    """Rows with the component that theirs has become."""
    if renames is None:
        return rows
    now = connected_components(renames).select(F.col("node").alias("comp"), F.col("comp").alias("_now"))
    return rows.join(now, "comp", "left").withColumn("comp", F.coalesce("_now", "comp")).drop("_now")


def merge_batch(state: dict[str, DataFrame] | None, batch: DataFrame) -> dict[str, DataFrame]:
    """What a batch (entity_id, key, value) adds to each table; ``state``: the tables so far, if any.

    Null ids and values are left out; an entity or a value that came before keeps its row.
    """
    batch = batch.select("entity_id", "key", "value").dropna().distinct()
    ids = batch.select("entity_id").distinct()
    old = None if state is None else state["renames"]
    known = ids.withColumn("comp", F.col("entity_id")).filter("false") if state is None else current(state["entities"].join(ids, "entity_id", "left_semi"), old)
    placed = ids.join(known, "entity_id", "left").select("entity_id", F.coalesce("comp", "entity_id").alias("comp"))
    rows = batch.join(placed, "entity_id")
    hubs = rows.groupBy("key", "value").agg(F.min("comp").alias("hub"))
    links = rows.join(hubs, ["key", "value"]).select(F.col("comp").alias("src"), F.col("hub").alias("dst"))
    held = None if state is None else current(state["values"].join(hubs.select("key", "value"), ["key", "value"], "left_semi"), old)
    if held is not None:
        links = links.unionByName(held.join(hubs, ["key", "value"]).select(F.col("hub").alias("src"), F.col("comp").alias("dst")))
    moved = connected_components(links)
    fresh = hubs if held is None else hubs.join(held, ["key", "value"], "left_anti")
    now = moved.select(F.col("node").alias("hub"), "comp")
    return {
        "entities": ids.join(known.select("entity_id"), "entity_id", "left_anti").withColumn("comp", F.col("entity_id")),
        "values": fresh.join(now, "hub").select("key", "value", "comp"),
        "renames": moved.filter("node <> comp").select(F.col("node").alias("src"), F.col("comp").alias("dst")),
    }


def read_state(spark: SparkSession, path: str, before: int | None = None) -> dict[str, DataFrame] | None:
    """The tables, of batches before a number if one is given; none before the first batch."""
    if before == 0:
        return None
    out = {}
    for name in TABLES:
        t = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
        out[name] = (t if before is None else t.filter(F.col("v") < before)).drop("v")
    return out


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, comp) as of the last batch; comp is the smallest entity of the component."""
    state = read_state(spark, path)
    return current(state["entities"], state["renames"]).select("entity_id", "comp")


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs ``merge_batch`` for each micro-batch; a part v=<number> of each table under ``path``.

    A batch reads the parts before its own, so a batch that is run again after a failure gives the same parts.
    """

    def handle(batch: DataFrame, number: int) -> None:
        for name, rows in merge_batch(read_state(batch.sparkSession, path, number), batch).items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/v={number}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
