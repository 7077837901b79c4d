"""Queries of the incremental operator over the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import incremental as inc
from leafmill.session import new_path, table


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return inc.watch_changes(
        spark,
        table(spark, d, "file_listing"),
        table(spark, d, "processed"),
        table(spark, d, "watch_runs"),
        new_path(spark, "watch-state"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Paths that are new or changed against the records of successful runs."""
    return _changes(spark, d).select(F.col("key").alias("path"))


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    """New and changed paths with what is taken up."""
    return _changes(spark, d).select(
        F.col("key").alias("path"), "size", "mtime_us", F.col("content_hash").alias("file_hash"), "change"
    )


def p4_second_run(spark: SparkSession, d: str) -> DataFrame:
    """Paths left for a third run: the first run broke off after taking up everything, in the second all files of odd size failed."""
    root = new_path(spark, "watch-state")
    store = inc.StateStore(spark, root)
    store.commit(inc.state_rows(inc.successful_rows(table(spark, d, "processed"), table(spark, d, "watch_runs"))))
    current = inc.current_rows(table(spark, d, "file_listing"))

    def breaks(todo: DataFrame) -> None:
        todo.write.parquet(new_path(spark, "taken"))
        raise RuntimeError("lost")

    try:
        inc.run_once(store, current, breaks)
    except RuntimeError:
        pass
    inc.run_once(store, current, lambda todo: todo.where("size % 2 = 0"))
    return inc.changed(current, store.load()).select(F.col("key").alias("path"), "change")


_NEWEST = """
newest AS (
  SELECT path, max({'a': listed_at, 'b': modificationtime, 'c': length, 'd': file_hash}) AS n
  FROM file_listing WHERE path IS NOT NULL GROUP BY path),
good AS (
  SELECT p.path, max({'a': p.processed_at, 'b': p.mtime, 'c': p.size, 'd': p.file_hash}) AS n
  FROM processed p JOIN watch_runs r
    ON r.status = 'success' AND r.finished_at IS NOT NULL
   AND p.processed_at >= epoch_us(r.started_at) / 1e6 AND p.processed_at <= epoch_us(r.finished_at) / 1e6
  GROUP BY p.path),
j AS (
  SELECT l.path, l.n.c AS size, epoch_us(l.n.b) AS mtime_us, l.n.d AS file_hash, g.path IS NULL AS is_new,
         g.n.c AS s_size, CAST(round(g.n.b * 1e6) AS BIGINT) AS s_mtime, g.n.d AS s_hash
  FROM newest l LEFT JOIN good g ON l.path = g.path),
found AS (
  SELECT path, size, mtime_us, file_hash, CASE WHEN is_new THEN 'new' ELSE 'changed' END AS change
  FROM j WHERE is_new OR size IS DISTINCT FROM s_size
    OR CASE WHEN file_hash IS NULL OR s_hash IS NULL THEN mtime_us IS DISTINCT FROM s_mtime
            ELSE file_hash <> s_hash END)
"""

QUERIES = {"p4_found": p4_found, "p4_changes": p4_changes, "p4_second_run": p4_second_run}
SQL = {
    "p4_found": f"WITH {_NEWEST} SELECT path FROM found",
    "p4_changes": f"WITH {_NEWEST} SELECT path, size, mtime_us, file_hash, change FROM found",
    "p4_second_run": f"WITH {_NEWEST} SELECT path, change FROM found WHERE size % 2 <> 0 OR size IS NULL",
}
