"""Watching folders: every micro-batch lists them, takes up new and changed ready files and commits the state."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from leafmill.operators import incremental as inc
from leafmill.operators.listing import COOLDOWN_MINUTES, FORMATS, editor_locks, readiness
from leafmill.session import stage
from leafmill.sources.documents import inspect_files

LISTING = "path string, length long, mtime double, listed_at double, cycle long"


def list_folder(folder: str, recursive: bool) -> Iterator[tuple[str, int, float]]:
    """Files of a folder with size and time; what cannot be read is passed over."""
    folders = [folder]
    while folders:
        here = folders.pop()
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    if recursive:
                        folders.append(e.path)
                elif e.is_file():
                    s = e.stat()
                    yield e.path, s.st_size, s.st_mtime
            except OSError:
                continue


class _Folder(InputPartition):
    def __init__(self, folder: str, recursive: bool, cycle: int):
        self.folder, self.recursive, self.cycle = folder, recursive, cycle


class _Reader(DataSourceStreamReader):
    """A cycle is named after its time, so a restarted stream goes on. Executors list the folders, the driver only what lies directly in the watched ones."""

    def __init__(self, options: dict):
        self.folders = [x for x in options.get("folders", "").split(os.pathsep) if x]
        self.recursive = options.get("recursive", "false") == "true"

    def initialOffset(self) -> dict:
        return {"cycle": 0}

    def latestOffset(self) -> dict:
        return {"cycle": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = [_Folder(f, False, end["cycle"]) for f in self.folders]
        if self.recursive:
            parts += [_Folder(sub, True, end["cycle"]) for f in self.folders for sub in subfolders(f)]
        return parts

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        # A repeated batch lists again: the state tells what is still to be done.
        now = time.time()
        for p, n, m in list_folder(partition.folder, partition.recursive):
            yield p, n, m, now, partition.cycle

    def commit(self, end: dict) -> None:
        pass


def subfolders(folder: str) -> list[str]:
    try:
        return sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False))
    except OSError:
        return []


class FolderListing(DataSource):
    """Stream of complete listings, one for each micro-batch.

    Spark's own file source remembers paths and does not return to a file that changed under the same
    path; a listing compared with the state does. Options: folders (separated as in PATH), recursive.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def cycle(
    listing: DataFrame, store: inc.StateStore, consume: Callable[[DataFrame], DataFrame | None], now: float, formats: tuple[str, ...] = FORMATS,
    inspect: Callable[[DataFrame], DataFrame] | None = None, cooldown: float = COOLDOWN_MINUTES,
) -> DataFrame:
    """One cycle over a listing: ready files that are new or changed are consumed, then the state is committed.

    Returns ``(path, ready, reason)`` of all candidates. Files that are not ready stay candidates. ``consume`` may return
    ``(key, ...)`` of the files it took up; the others, whose conversion failed, stay candidates too. If it raises, nothing is
    committed. ``inspect`` gives ``(path, content_hash, problem)`` of ready files: a problem makes them unready, and a
    file whose content is the one taken up before is noted without being consumed again.
    """
    base = store.version()
    rows = listing.groupBy("path").agg(F.max(F.struct("mtime", "length")).alias("n")).select("path", "n.length", "n.mtime")
    rows = rows.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(list(formats)))
    current = _hashed(
        rows.select(F.col("path").alias("key"), F.col("length").alias("size"), F.round(F.col("mtime") * 1e6).cast("long").alias("mtime_us"), F.lit(None).cast("string").alias("content_hash"))
    )
    state = store.load()
    # Size and time tell what may have changed; contents are read of such files only.
    todo = inc.changed(current, state.withColumn("content_hash", F.lit(None).cast("string")))
    candidates = rows.join(todo.select(F.col("key").alias("path")), "path", "left_semi")
    judged = stage(readiness(candidates, F.lit(now), editor_locks(candidates, listing.select("path")), cooldown), "judged")
    ready = judged.where("ready").select("path")
    taken = todo.join(ready.select(F.col("path").alias("key")), "key", "left_semi")
    if inspect is not None:
        found = stage(inspect(ready), "inspected")
        problems = found.where("problem IS NOT NULL").select("path", "problem")
        judged = judged.join(problems, "path", "left").select("path", F.coalesce("problem", "reason").alias("reason"), (F.col("ready") & F.col("problem").isNull()).alias("ready"))
        hashes = found.where("problem IS NULL").select(F.col("path").alias("key"), F.col("content_hash").alias("_h"))
        taken = _hashed(taken.join(hashes, "key").withColumn("content_hash", F.col("_h")).drop("_h"))
    taken = stage(taken, "taken")
    if not taken.isEmpty():
        known = state.select("key", F.col("content_hash").alias("_known"), F.col("size").alias("_size"))
        same = taken.join(known, "key").where("content_hash = _known AND size = _size").select(*taken.columns)
        fresh = taken.join(same.select("key"), "key", "left_anti")
        done = same.unionByName(inc.succeeded(fresh, consume(fresh)))
        store.commit(inc.merge_state(state, done), expected=base)
    return judged


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row_hash", inc.row_hash(F.col("size"), F.col("mtime_us"), F.col("content_hash")))


def watch(
    spark: SparkSession, folders: list[str], store: inc.StateStore, checkpoint: str, consume: Callable[[DataFrame], DataFrame | None], recursive: bool = False,
    minutes: int | None = 30, clock: Callable[[], float] = time.time, report: Callable[[DataFrame], None] | None = None,
    formats: tuple[str, ...] = FORMATS, inspect: Callable[[DataFrame], DataFrame] | None = inspect_files, cooldown: float = COOLDOWN_MINUTES,
):
    """Starts the watch as a streaming query: every ``minutes``, or a single cycle for None. Stop it with ``query.stop()``."""
    spark.dataSource.register(FolderListing)

    def batch(listing: DataFrame, _: int) -> None:
        judged = cycle(listing, store, consume, clock(), formats, inspect, cooldown)
        if report:
            report(judged)

    stream = spark.readStream.format("folder_listing").option("folders", os.pathsep.join(folders)).option("recursive", str(recursive).lower()).load()
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if minutes is None else writer.trigger(processingTime=f"{minutes} minutes")).start()
