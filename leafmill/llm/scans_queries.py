"""Queries of problem 1."""

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import scans
from leafmill.session import text_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of page frames, lines that end inside a word and lines with misread words."""
    return scans.damaged_lines(text_table(spark, d, "extracted_pages"))


def p1_pages(spark: SparkSession, d: str) -> DataFrame:
    """Scanned pages as continuous paragraphs."""
    return scans.readable_pages(text_table(spark, d, "extracted_pages"))


QUERIES = {"p1_found": p1_found, "p1_pages": p1_pages}
SQL: dict[str, str] = {}
