"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and all runs on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame, path: str, **options: str) -> DataFrame:
    """``df`` written to ``path`` as Parquet and read from there; the shuffle files of the write go with it."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.mode("overwrite").options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder.

    Lineage ends there, so a lost executor costs at most the stage that runs, and the shuffle files
    of the write, which nothing reads any more, are deleted with it.
    """
    return saved(df, f"{scratch(df.sparkSession)}/linkloom/{uuid.uuid4().hex}/{name}")


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
