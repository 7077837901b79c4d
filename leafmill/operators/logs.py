"""Health of a service from its log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators.order import by_ranges

DATE = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_id, line)`` of text files: ids rise in the order of files and lines, with gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))


def dated(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``ts``, the time a line starts with, or null."""
    text = F.regexp_extract(line, DATE, 1)
    return lines.withColumn("ts", F.when(text != "", F.try_to_timestamp(F.regexp_replace(text, "T", " "))))


def carried(lines: DataFrame, order: str) -> DataFrame:
    """Adds ``last_ts``, the time of the last dated line up to each line.

    Lines are looked up within ranges of the order; the last time of the ranges before, one row for each, is carried in.
    """
    ranged = by_ranges(lines, order)
    ends = ranged.groupBy("_range").agg(F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col(order))).alias("_end"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # rows are ranges
    base = ends.select("_range", F.last("_end", ignorenulls=True).over(before).alias("_base"))
    inner = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumn("_in", F.last("ts", ignorenulls=True).over(inner)).join(base, "_range")
    return out.withColumn("last_ts", F.coalesce("_in", "_base")).drop("_range", "_in", "_base")


def tracebacks(lines: DataFrame, order: str, cutoff: Column, line: str = "line") -> DataFrame:
    """Number of traceback lines whose carried time is at or after the cutoff."""
    marked = carried(lines, order)
    return marked.agg(F.count_if(F.col(line).startswith("Traceback") & (F.col("last_ts") >= cutoff)).alias("tracebacks"))


def freshness(lines: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Time of the last dated line, its age in whole hours, and whether that is a warning; no dated line is one."""
    last = lines.agg(F.max("ts").alias("last_ts"))
    age = F.timestamp_diff("HOUR", F.col("last_ts"), now)
    return last.select("last_ts", age.alias("age_hours"), F.coalesce(age > hours, F.lit(True)).alias("warn"))
