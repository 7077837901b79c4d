"""Queries of problem 5."""

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import lookalike
from leafmill.session import text_table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pages with different texts that look the same."""
    return lookalike.same_looks(text_table(spark, d, "extracted_pages"))


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page in one consistent form."""
    return lookalike.normalized_pages(text_table(spark, d, "extracted_pages"))


QUERIES = {"p5_found": p5_found, "p5_pages": p5_pages}


def _found_sql() -> str:
    """The mapping as rows, and the normal form of the database for order and composition."""
    rows = ", ".join(f"(chr({ord(c)}), {' || '.join(f'chr({ord(x)})' for x in to) or repr('')})" for c, to in lookalike.char_map().items() if not 0xAC00 <= ord(c) < 0xD7A4)
    return f"""WITH m(c, s) AS (VALUES {rows}),
      p AS (SELECT DISTINCT page_id, page_text AS t FROM extracted_pages WHERE page_id IS NOT NULL AND page_text <> ''),
      x AS (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM (SELECT DISTINCT t FROM p)),
      f AS (SELECT x.t, nfc_normalize(string_agg(coalesce(m.s, substring(x.t, i, 1)), '' ORDER BY i)) AS f FROM x LEFT JOIN m ON m.c = substring(x.t, i, 1) GROUP BY x.t),
      q AS (SELECT page_id, p.t, f FROM p JOIN f ON p.t = f.t)
      SELECT DISTINCT a.page_id AS page_id_a, b.page_id AS page_id_b FROM q a JOIN q b ON a.f = b.f AND a.page_id < b.page_id AND a.t <> b.t"""


def __getattr__(name: str):
    if name == "SQL":  # made from the mapping only when it is asked for
        return {"p5_found": _found_sql()}
    raise AttributeError(name)
