"""Queries of problem 7."""

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import leakage
from leafmill.session import table, text_table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least 12 words of an item in a row."""
    return leakage.leaks(text_table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Number of documents that leak each item."""
    return leakage.leak_report(p7_found(spark, d), table(spark, d, "eval_items"))


_GRAMS = r"""
WITH w AS (SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
           UNION ALL SELECT 1, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM eval_items WHERE text IS NOT NULL),
g AS (SELECT kind, id, unnest(list_transform(range(1, len(w) - 10), lambda i: hash(array_to_string(w[i:i+11], ' ')))) AS gram
      FROM w WHERE len(w) >= 12),
found AS (SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM g a JOIN g b ON a.gram = b.gram AND a.kind = 0 AND b.kind = 1)
"""
QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
SQL = {
    "p7_found": _GRAMS + "SELECT doc_id, item_id FROM found",
    "p7_items": _GRAMS + """SELECT i.item_id, CAST(count(f.doc_id) AS BIGINT) AS documents
                            FROM (SELECT DISTINCT item_id FROM eval_items) i LEFT JOIN found f USING (item_id) GROUP BY i.item_id""",
}
