"""Session helpers: shared working folder and staged tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "extracted_pages quality_metrics text_class_labels processed_files ocr_outcomes "
    "file_listing processed watch_runs eval_items container_specs"
).split()


_SHIPPED: set[str] = set()
_OWN: set[str] = set()
#: Bytes up to which an input in few partitions is spread over all cores.
SPREAD_BYTES = 1 << 30


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that none needs it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="leafmill_code_")  # read by the driver only, which serves it to executors
    archive = os.path.join(folder, "leafmill.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for here, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(here, name)
                    z.write(full, os.path.join("leafmill", os.path.relpath(full, root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one parquet table of an input directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_names() -> list[str]:
    return list(_TABLES)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A folder of our own is set only where the session names none (local tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        known = jsc.getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        else:
            master = spark.sparkContext.master
            if not master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            folder = "file://" + tempfile.mkdtemp(prefix="leafmill_")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run uses, below the folder of this application."""
    return f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    folder = f"{shared_dir(spark)}/leafmill/{spark.sparkContext.applicationId}"
    if folder not in _OWN:
        _OWN.add(folder)
        atexit.register(_delete, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)
    return folder


def _delete(jvm, configuration, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(configuration).delete(path, True)
    except Exception:  # the Java side is gone; what is left stays in the shared folder
        pass


def cleanup(spark: SparkSession) -> None:
    """Deletes what this application staged. Results that were not read yet become unreadable; it also happens when the application ends."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _own_dir(spark))


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and several
    consumers share one computation.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, path: str) -> DataFrame:
    """``df`` over all cores if its input at ``path`` is small and in few partitions, as a single file is; else as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    return df.repartition(cores) if size <= SPREAD_BYTES and 2 * df.rdd.getNumPartitions() <= cores else df


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are costly to work on."""
    return spread(table(spark, sf_dir, name), f"{sf_dir}/{name}.parquet")
