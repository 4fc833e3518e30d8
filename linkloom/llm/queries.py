"""The operators as queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import decontaminate, htmltree, jaccard, licenses, packing, quality, repeats, sharding, toxicity, warc
from linkloom.llm.common import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltree.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents")).drop("rejected_by")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("payload", "stated_digest", "url")


QUERIES = {f.__name__: f for f in (op1_html, op2_toxicity, op3_jaccard, op4_quality, op5_sharding, op6_packing, op7_decontaminate, op8_licenses, op9_repeats, op10_warc)}

ORACLES = {
    "op3_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
        u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
        r(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = d.doc_id), doc_id)) AS component_id
        FROM d LEFT JOIN n USING (doc_id)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT page_id, strlen(html) AS n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
        FROM g""",
    "op4_quality": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        m AS (SELECT doc_id, t, w, len(w) AS n,
                     list_sum(list_transform(w, lambda x: length(x))) AS chars,
                     length(t) - length(translate(t, '#*$%&|<>', '')) AS sym,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
              FROM d),
        e AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
        r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM e),
        k AS (SELECT doc_id, count(DISTINCT i + j) AS rep FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE c > 1 GROUP BY doc_id),
        b AS (SELECT m.*, coalesce(rep, 0) AS rep, len(lines) - len(list_distinct(lines)) AS dup,
                     n < 50 OR 100 * coalesce(rep, 0) > 50 * n AS failed,
                     CASE WHEN n = 0 THEN 0 ELSE list_max(map_values(list_histogram(w))) END AS top
              FROM m LEFT JOIN k USING (doc_id)),
        v AS (SELECT *, CASE WHEN failed THEN 'base' END AS base_by,
                     [x FOR x IN [CASE WHEN 100 * sym > 30 * n THEN 'symbols' END, CASE WHEN 100 * dup > 50 * len(lines) THEN 'repeated_lines' END,
                       CASE WHEN chars < 2 * n OR chars > 20 * n THEN 'word_length' END,
                       CASE WHEN 100 * len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) > 50 * n THEN 'shouting' END,
                       CASE WHEN 100 * (length(t) - length(replace(t, '!', ''))) > 50 * n THEN 'exclamations' END,
                       CASE WHEN 100 * top > 30 * n THEN 'one_word' END] IF x IS NOT NULL] AS rules
              FROM b)
        SELECT doc_id, n::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, sym::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
               rep::BIGINT AS n_repeat_words, failed AS base_failed, NOT failed AND len(rules) = 0 AS kept
        FROM v""",
}
