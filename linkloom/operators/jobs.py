"""Results that are kept until the graph changes or time has passed, and the calculators of resolved entities."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import events as E


def kept(spark: SparkSession, path: str, version: str, make: Callable[[], DataFrame], seconds: float | None = None, now: float | None = None) -> DataFrame:
    """The table at ``path`` if it was made for this version (and within ``seconds``), else made anew.

    The marker beside the table is written last, so a job that dies leaves a table that counts as stale.
    """
    now = time.time() if now is None else now
    marker, files = f"{path}/marker", spark._jvm.org.apache.hadoop.fs
    there = files.Path(marker).getFileSystem(spark._jsc.hadoopConfiguration()).exists(files.Path(f"{marker}/_SUCCESS"))
    if there:
        row = spark.read.json(marker, schema="version string, made double, name string").first()
        if row and row["version"] == version and (seconds is None or now - row["made"] <= seconds):
            return spark.read.parquet(f"{path}/{row['name']}")
    name = f"table-{int(now * 1000)}"
    make().write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(version, float(now), name)], "version string, made double, name string").coalesce(1).write.mode("overwrite").json(marker)
    return spark.read.parquet(f"{path}/{name}")


#: name -> events (entity_id, ...) to one row per entity.
CALCULATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "highest": E.highest,
    "initially_marketed": E.initially_marketed,
    "us_approved": lambda ev: E.us_approved(ev).withColumnRenamed("id", "approval"),
    "labels": E.labels,
}


def calculated(events: DataFrame, entities: DataFrame, names: list[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """The entities with the columns of the calculators (all, or those named), for all or for ``nodes`` only.

    Entities without events keep a row of nulls.
    """
    wanted = entities if nodes is None else entities.join(nodes.select("entity_id"), "entity_id", "left_semi")
    ev = events if nodes is None else events.join(nodes.select("entity_id"), "entity_id", "left_semi")
    out = wanted
    for name in names or list(CALCULATORS):
        columns = CALCULATORS[name](ev)
        out = out.join(columns.select("entity_id", *[F.col(c).alias(f"{name}_{c}") for c in columns.columns if c != "entity_id"]), "entity_id", "left")
    return out
