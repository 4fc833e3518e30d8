"""Command line: ``python -m linkloom metrics TABLES`` and ``python -m linkloom values TABLES KEY [TOP]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkloom.operators.algebra import part_metrics
from linkloom.operators.linking import edge_counts


def main(argv: list[str] | None = None) -> list:
    """Reads an incidence table (entity_id, key, value) and prints rows; returns them too."""
    p = argparse.ArgumentParser(prog="linkloom")
    p.add_argument("command", choices=["metrics", "values"])
    p.add_argument("incidence", help="Parquet table of entity_id, key, value")
    p.add_argument("key", nargs="?", help="values: the key")
    p.add_argument("top", nargs="?", type=int, default=20, help="values: how many")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("linkloom").getOrCreate()
    inc = spark.read.parquet(a.incidence)
    if a.command == "metrics":
        out = part_metrics(inc, inc)
    else:
        out = edge_counts(inc.filter(F.col("key") == a.key)).orderBy(F.desc("edges"), "value").limit(a.top)
    rows = out.collect()
    for r in rows:
        print(*r, sep="\t")
    return rows


if __name__ == "__main__":
    main()
