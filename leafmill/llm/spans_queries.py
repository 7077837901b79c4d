"""Queries of problem 8."""

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import spans
from leafmill.session import text_table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share a run of 300 characters."""
    return spans.shared_pairs(text_table(spark, d, "documents"))


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document also occurs in another one."""
    return spans.shared_spans(text_table(spark, d, "documents"))


QUERIES = {"p8_found": p8_found, "p8_shared": p8_shared}

#: Every window of 300 characters with its hash, and the windows that two documents hold.
_WINDOWS = """
texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
places AS (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 298, 1))) AS s FROM texts),
windows AS (SELECT doc_id, s, md5(substring(text, s, 300)) AS h FROM places),
shared AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, s, h FROM windows WHERE h IN (SELECT h FROM shared))
"""
SQL = {
    "p8_found": f"""WITH {_WINDOWS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM hits a JOIN hits b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p8_shared": f"""WITH {_WINDOWS},
      steps AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM hits),
      cover AS (SELECT doc_id, CAST(sum(CASE WHEN gap IS NULL OR gap > 300 THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(sum(least(coalesce(gap, 300), 300)) AS BIGINT) AS c FROM steps GROUP BY doc_id)
      SELECT t.doc_id, CAST(length(t.text) AS BIGINT) AS n_chars, coalesce(c.n, 0) AS span_count, coalesce(c.c, 0) AS shared_chars,
        CASE WHEN length(t.text) > 0 THEN coalesce(c.c, 0)::DOUBLE / length(t.text) ELSE 0::DOUBLE END AS shared_share
      FROM texts t LEFT JOIN cover c ON t.doc_id = c.doc_id""",
}
