"""The pipeline stage by stage against brute force."""

import re

import corpus_pipeline as P
from linkloom.llm import decontaminate, quality
from linkloom.llm.common import WordHash
from tests.llm import helpers as H
from tests.llm.test_operators import leak_brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}

    docs = P.STAGES[0][1](spark, docs, sf)
    hashes = WordHash()
    measured = {i: quality.Doc(t.encode(), hashes) for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if not measured[i].base_failed and not any(r(measured[i]) for r in quality.RULES.values())}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == rows

    docs = P.STAGES[1][1](spark, docs, sf)
    comp = H.jaccard_components(list(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if comp[i][1] == i}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == rows

    docs = P.STAGES[2][1](spark, docs, sf)
    left = H.without_repeats(list(rows.values()))
    rows = {i: bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore") for i, (raw, gone) in zip(rows, left)}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == rows

    docs = P.STAGES[3][1](spark, docs, sf)
    long = [(i, t) for i, t in items if len(decontaminate.words_of(t.encode())) >= 8]
    rows = {i: t for i, t in rows.items() if not any(leak_brute(t, x) for _, x in long)}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == rows

    packed = P.STAGES[4][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(rows)


def test_registered(spark, sf):
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))


def test_odd_and_empty_documents(spark, sf, tmp_path):
    """All stages over nulls, odd and long texts, repeated rows and clashing columns, and over no rows."""
    odd = H.edge_documents(spark)
    for name, docs in (("odd", odd), ("empty", H.empty(odd))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path / name))
            assert docs.columns == odd.columns and docs.dtypes == odd.dtypes
        packed = P.run(spark, str(tmp_path / name)).collect()
        # only the long text has fifty words, and it is one word again and again
        assert packed == []
