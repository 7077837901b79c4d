"""Queries of problem 6."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import packing
from leafmill.session import stage, table, text_table


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of each kind."""
    lengths = packing.token_counts(text_table(spark, d, "documents"))
    return packing.pack(lengths, packing.container_kinds(table(spark, d, "container_specs")))


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    """Containers used and the share of their room that is filled, by kind."""
    specs = table(spark, d, "container_specs").select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).distinct()
    fills = p6_packed(spark, d).groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("tokens"))
    used = fills.groupBy("container_kind").agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest")
    )
    return used.join(specs, "container_kind").withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """By kind: documents placed, and how many containers are too full, texts cut without need, and texts not placed once in full."""
    specs = table(spark, d, "container_specs").select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    lengths = stage(packing.token_counts(text_table(spark, d, "documents")), "counted")
    rows = stage(packing.pack(lengths, packing.container_kinds(specs.withColumnRenamed("capacity", "capacity_tokens"))), "packed")
    full = rows.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t")).join(specs, "container_kind")
    overfull = full.groupBy("container_kind").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    texts = rows.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("parts"), F.count_distinct("part").alias("kinds"))
    texts = texts.join(specs, "container_kind").join(lengths, "doc_id")
    least = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")))
    judged = texts.groupBy("container_kind").agg(
        F.count("*").alias("documents"), F.count_if(F.col("parts") != least).alias("cut"),
        F.count_if((F.col("t") != F.col("tokens")) | (F.col("parts") != F.col("kinds"))).alias("wrong"),
    )
    return judged.join(overfull, "container_kind")


QUERIES = {"p6_packed": p6_packed, "p6_usage": p6_usage, "p6_invariants": p6_invariants}
SQL = {
    "p6_invariants": """SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS cut, 0 AS wrong, 0 AS overfull
      FROM (SELECT DISTINCT container_kind FROM container_specs WHERE container_kind IS NOT NULL AND capacity_tokens > 0)""",
}
