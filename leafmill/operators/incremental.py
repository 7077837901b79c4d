"""Processing only new or changed records.

State is a table of one row per key with the metadata and content hash last taken up
successfully.  A run hashes the current rows, joins them with the state, hands the new and
changed ones to the consumer and swaps to a new state version only after the consumer ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import stage

STATE_SCHEMA = "key string, size bigint, mtime_us bigint, content_hash string, row_hash bigint"
#: Width of the time buckets on which records meet the runs that wrote them.
BUCKET_S = 6 * 3600


def row_hash(size: Column, mtime_us: Column, content_hash: Column) -> Column:
    """64-bit hash of what identifies a record's content."""
    return F.xxhash64(size, mtime_us, content_hash)


def current_rows(listing: DataFrame) -> DataFrame:
    """Newest listing row of each path, in the layout of the state.

    Input columns: path, length, modificationtime, file_hash, listed_at; others are ignored.
    Rows without a path are no records. Among rows with the same ``listed_at`` the greatest
    (modificationtime, length, file_hash) counts, so repeated and tied rows give one result.
    The aggregate combines map-side: a path with many listings moves one row per task.
    """
    newest = F.max(F.struct("listed_at", "modificationtime", "length", "file_hash"))
    return (
        listing.where(F.col("path").isNotNull())
        .groupBy(F.col("path").alias("key"))
        .agg(newest.alias("n"))
        .select(
            "key",
            F.col("n.length").alias("size"),
            F.unix_micros("n.modificationtime").alias("mtime_us"),
            F.col("n.file_hash").alias("content_hash"),
        )
        .withColumn("row_hash", row_hash(F.col("size"), F.col("mtime_us"), F.col("content_hash")))
    )


def successful_rows(processed: DataFrame, runs: DataFrame) -> DataFrame:
    """Records written within a successful run.

    Runs and records meet on equal time buckets; a run is exploded into the buckets it covers,
    so this is a hash join for any number of runs. Runs without an end or with status other
    than ``success`` hold nothing; records without ``processed_at`` belong to no run.
    """
    def bucket(seconds: Column) -> Column:
        return F.floor(seconds / BUCKET_S).cast("long")

    start, end = F.unix_micros("started_at") / 1e6, F.unix_micros("finished_at") / 1e6
    spans = (
        runs.where((F.col("status") == "success") & F.col("finished_at").isNotNull() & F.col("started_at").isNotNull())
        .select(start.alias("run_from"), end.alias("run_to"))
        .where("run_from <= run_to")
        .withColumn("run_bucket", F.explode(F.sequence(bucket(F.col("run_from")), bucket(F.col("run_to")))))
    )
    rows = processed.select("path", "mtime", "size", "file_hash", "processed_at").withColumn(
        "run_bucket", bucket(F.col("processed_at"))
    )
    inside = (
        (rows["run_bucket"] == spans["run_bucket"])
        & (rows["processed_at"] >= spans["run_from"])
        & (rows["processed_at"] <= spans["run_to"])
    )
    return rows.join(spans, inside, "left_semi").drop("run_bucket")


def state_rows(records: DataFrame) -> DataFrame:
    """Newest record of each path in the layout of the state; ties go to the greatest row."""
    newest = F.max(F.struct("processed_at", "mtime", "size", "file_hash"))
    return (
        records.where(F.col("path").isNotNull())
        .groupBy(F.col("path").alias("key"))
        .agg(newest.alias("n"))
        .select(
            "key",
            F.col("n.size").alias("size"),
            F.round(F.col("n.mtime") * 1e6).cast("long").alias("mtime_us"),
            F.col("n.file_hash").alias("content_hash"),
        )
        .withColumn("row_hash", row_hash(F.col("size"), F.col("mtime_us"), F.col("content_hash")))
    )


def changed(current: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of ``current`` that are new or changed, with ``change`` = ``new`` or ``changed``.

    Equal row hashes of rows with known content hashes mean an unchanged record. Otherwise a
    record changed if the sizes differ, if both content hashes are known and differ, or if one
    is missing and the modification times differ. An unknown size counts as a value of its own.
    """
    s = state.select(
        F.col("key"), *[F.col(c).alias(f"s_{c}") for c in ("size", "mtime_us", "content_hash", "row_hash")]
    ).withColumn("known", F.lit(True))
    j = current.join(s, "key", "left")
    size_differs = ~F.col("size").eqNullSafe(F.col("s_size"))
    unhashed = F.col("content_hash").isNull() | F.col("s_content_hash").isNull()
    differs = size_differs | F.when(unhashed, ~F.col("mtime_us").eqNullSafe(F.col("s_mtime_us"))).otherwise(
        F.col("content_hash") != F.col("s_content_hash")
    )
    same = (F.col("row_hash") == F.col("s_row_hash")) & ~unhashed & ~size_differs
    is_new = F.col("known").isNull()
    return j.where(is_new | (~same & differs)).select(
        "key", "size", "mtime_us", "content_hash", "row_hash", F.when(is_new, "new").otherwise("changed").alias("change")
    )


class StateStore:
    """Versioned state tables below one folder.

    Each version is a complete parquet table in a folder of its own. ``commit`` writes the next
    version beside the current one and then renames a finished pointer file to ``_versions/<n>``.
    The rename is atomic and does not replace an existing pointer on HDFS-like file systems, so a
    reader sees the old state or the new one, a failed run leaves no trace in the state, and of
    two runs at once only one can commit. (Object stores without such a rename need a lock.)
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the current version, 0 before the first commit."""
        folder = self._path(f"{self.root}/_versions")
        if not self._fs.exists(folder):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return max((int(n.split("-")[0]) for n in names if n[0].isdigit()), default=0)

    def load(self) -> DataFrame:
        """The state of the current version; empty before the first commit."""
        n = self.version()
        if not n:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        target = self._target(n)
        return self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.root}/{target}")

    def _target(self, n: int) -> str:
        stream = self._fs.open(self._path(f"{self.root}/_versions/{n}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commit(self, rows: DataFrame, expected: int | None = None) -> int:
        """Writes ``rows`` as the next version and swaps to it; returns its number.

        ``expected`` is the version the run started from: if another run committed since, this
        one raises ``FileExistsError`` and changes nothing.
        """
        base = self.version() if expected is None else expected
        name = f"state-{base + 1}-{uuid.uuid4().hex}"
        fields = STATE_SCHEMA.split(", ")
        rows.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in fields]).write.option(
            "compression", "zstd"
        ).parquet(f"{self.root}/{name}")
        self._fs.mkdirs(self._path(f"{self.root}/_versions"))
        draft, final = self._path(f"{self.root}/{name}/_pointer"), self._path(f"{self.root}/_versions/{base + 1}")
        out = self._fs.create(draft, True)
        out.write(bytearray(name.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise FileExistsError(f"version {base + 1} of {self.root} was committed by another run")
        return base + 1

    def vacuum(self, keep: int = 2) -> None:
        """Deletes versions older than the newest ``keep`` ones."""
        for n in range(1, self.version() - keep + 1):
            pointer = self._path(f"{self.root}/_versions/{n}")
            if self._fs.exists(pointer):
                self._fs.delete(self._path(f"{self.root}/{self._target(n)}"), True)
                self._fs.delete(pointer, False)


def merge_state(state: DataFrame, taken: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """State after a run took up ``taken``: its rows replace the state's; gone keys may be dropped."""
    kept = state.join(taken.select("key"), "key", "left_anti")
    merged = kept.unionByName(taken.select(*kept.columns))
    return merged if current is None else merged.join(current.select("key"), "key", "left_semi")


def run_once(store: StateStore, current: DataFrame, consume: Callable[[DataFrame], DataFrame | None]) -> int:
    """One incremental run: select, consume, commit. Returns the committed version.

    What is to be done is written once, so a source that changes meanwhile cannot commit records that were not
    consumed. ``consume`` may return ``(key, ...)`` of the records it took up; the others stay to be done. If it fails
    nothing is committed, so the next run sees the same records again; a consumer keyed by ``key`` and ``row_hash`` makes the
    repetition harmless.
    """
    base = store.version()
    state = store.load()
    todo = stage(changed(current, state), "todo")
    return store.commit(merge_state(state, succeeded(todo, consume(todo))), expected=base)


def succeeded(todo: DataFrame, done: DataFrame | None) -> DataFrame:
    """Rows that a consumer took up: all, if it does not say which."""
    return todo if done is None else todo.join(done.select("key").distinct(), "key", "left_semi")


def watch_changes(spark: SparkSession, listing: DataFrame, processed: DataFrame, runs: DataFrame, root: str) -> DataFrame:
    """Paths a watch run over ``listing`` must take up, against the records of successful runs.

    The state is built from the log, committed as a version below ``root`` and read back, as it
    would be by the next run.
    """
    store = StateStore(spark, root)
    store.commit(state_rows(successful_rows(processed, runs)))
    return changed(current_rows(listing), store.load())
