"""Queries of problem 3."""

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import quality
from leafmill.session import text_table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    return quality.document_quality(text_table(spark, d, "documents")).where("text_class <> 'prose'").select("doc_id", "text_class").distinct()


def p3_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Figures of every non-empty document."""
    return quality.document_quality(text_table(spark, d, "documents"))


QUERIES = {"p3_found": p3_found, "p3_metrics": p3_metrics}
SQL: dict[str, str] = {}
