"""Places of rows in a global order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import stage

#: Rows of a block of a sliding window.
BLOCK = 10_000


def with_ordinal(rows: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """Adds the place of each row, from 1, in the order of columns that together are unique.

    Rows are split into ranges of about equal size; ranges are numbered within, and the sizes of the
    ranges before, of which there are as many as partitions, are added.
    """
    ranged = stage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ordinal")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_inner", inner).join(F.broadcast(offsets), "_range").withColumn(
        name, (F.col("_offset") + F.col("_inner")).cast("long")
    ).drop("_range", "_offset", "_inner")


def with_running_sum(rows: DataFrame, key: str, value: Column, name: str, *order: str) -> DataFrame:
    """Adds the sum of a value over the rows of the same key up to each row in the order of columns.

    A key of many rows lies in several ranges, each summed by itself. Only the first key of a range can have begun in
    ranges before, so there are at most as many offsets as ranges.
    """
    ranged = stage(rows.withColumn("_value", value).repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "running")
    inner = Window.partitionBy("_range", key).orderBy(*order, "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(key).orderBy("_range")
    sums = ranged.groupBy("_range", key).agg(F.sum("_value").alias("_sum"))
    offsets = sums.select(
        F.col("_range").alias("_at"), F.col(key).alias("_key"), F.row_number().over(across).alias("_nth"),
        F.sum("_sum").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_offset"),
    ).where("_nth > 1")
    summed = ranged.withColumn("_inner", F.sum("_value").over(inner))
    joined = summed.join(F.broadcast(offsets), (F.col("_range") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(name, F.col("_inner") + F.coalesce("_offset", F.lit(0))).drop("_value", "_range", "_at", "_key", "_nth", "_offset", "_inner")


def by_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """Rows staged in ranges of an order, as many as partitions; ``_range`` is the place of a row's range."""
    return stage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def with_range_sum(ranged: DataFrame, value: Column, name: str, keys: list[str], *order: str) -> DataFrame:
    """Adds the sum of a value over the rows of the same keys up to each row of ``by_ranges``.

    Ranges are summed by themselves; the sums of the ranges before, a row for each range and key, are added.
    """
    names = [f"_{k}_{n}" for n, k in enumerate(keys)]
    sums = ranged.groupBy("_range", *keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # rows are ranges
    offsets = sums.select(F.col("_range").alias("_at"), *[F.col(k).alias(n) for k, n in zip(keys, names)], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    same = F.col("_range") == F.col("_at")
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    inner = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return summed.join(offsets, same).withColumn(name, (F.col("_inner") + F.col("_offset")).cast("long")).drop("_at", *names, "_offset", "_inner")


def with_blocks(rows: DataFrame, ordinal: str, before: int) -> DataFrame:
    """Rows in blocks, each with the ``before`` rows that precede it marked ``_own`` = false.

    A frame of at most ``before`` preceding rows is then complete within a block.
    """
    if before >= BLOCK:
        raise ValueError("a frame must be smaller than a block")
    block = F.floor((F.col(ordinal) - 1) / BLOCK)
    last = (F.col(ordinal) - 1) % BLOCK >= BLOCK - before
    own = rows.withColumn("_block", block).withColumn("_own", F.lit(True))
    borrowed = rows.where(last).withColumn("_block", block + 1).withColumn("_own", F.lit(False))
    return own.unionByName(borrowed)
