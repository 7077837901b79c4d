"""Queries of problem 2."""

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import encoding
from leafmill.session import text_table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines garbled by a wrong decoding."""
    return encoding.garbled_lines(text_table(spark, d, "extracted_pages")).select("page_id", "line_no").distinct()


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    """Garbled lines with what could be restored and by which round trips."""
    return encoding.garbled_lines(text_table(spark, d, "extracted_pages"))


def p2_pages(spark: SparkSession, d: str) -> DataFrame:
    """All pages with their restored text."""
    return encoding.restored_pages(text_table(spark, d, "extracted_pages"))


QUERIES = {"p2_found": p2_found, "p2_lines": p2_lines, "p2_pages": p2_pages}
SQL: dict[str, str] = {}
