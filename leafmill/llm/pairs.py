"""All pairs within groups, a large group cut into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block; two blocks meet in one join key, so a key makes at most ``BLOCK`` squared pairs.
BLOCK = 2_000


def pairs_within(members: DataFrame, *keys: str) -> DataFrame:
    """``(a, b)``, a < b, of all members ``(keys, id, ...)`` of each group; other columns come out as ``x_a`` and ``x_b``.

    The result has all pairs, so its size is quadratic in a group; the work on it is spread: every pair of blocks is a key of its own.
    """
    rest = [c for c in members.columns if c not in (*keys, "id")]
    sizes = members.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.ceil(F.col("_n") / F.lit(BLOCK)).cast("int").alias("_blocks"))
    blocked = (
        members.join(sizes, list(keys)).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumns({"_lo": F.least("_own", "_other"), "_hi": F.greatest("_own", "_other")})
    )

    def side(name: str) -> DataFrame:
        return blocked.select(*keys, "_lo", "_hi", F.col("_own").alias(f"_own_{name}"), F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in rest])

    met = side("a").join(side("b"), [*keys, "_lo", "_hi"]).where("a < b AND (_lo = _hi OR _own_a <> _own_b)")
    return met.select("a", "b", *[f"{c}_{n}" for c in rest for n in "ab"])
