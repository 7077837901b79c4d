"""Command line: convert folders of documents to markdown, watch folders, report on what was learnt."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import markdown as md
from leafmill.functions import text_quality as tq
from leafmill.functions.strings import convert_windows_path
from leafmill.operators import incremental as inc
from leafmill.operators import learner as le
from leafmill.operators import listing as ls
from leafmill.operators import status as su
from leafmill.operators.hybrid import Recognition
from leafmill.session import ship, stage
from leafmill.sources import documents as src

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafmill", description=__doc__)
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="convert the documents of a folder")
    c.add_argument("directory")
    c.add_argument("-r", "--recursive", action="store_true")
    c.add_argument("-n", "--dry-run", action="store_true")
    c.add_argument("-f", "--force", "--overwrite", dest="overwrite", action="store_true")
    c.add_argument("--improve", action="store_true")
    c.add_argument("--formats", default="")
    _recognition_options(c)
    w = sub.add_parser("watch", help="convert new and changed documents as they come")
    w.add_argument("-d", "--directories", nargs="+", required=True)
    w.add_argument("-r", "--recursive", action="store_true")
    w.add_argument("--state", required=True, help="folder of the state and the stream's checkpoint")
    w.add_argument("--once", action="store_true")
    w.add_argument("--poll-interval", type=int, default=30, help="minutes")
    w.add_argument("--cooldown", type=float, default=ls.COOLDOWN_MINUTES, help="minutes that a file must have been left alone")
    w.add_argument("--formats", default="")
    _recognition_options(w)
    n = sub.add_parser("learn", help="train the model on all outcomes, or forget both")
    n.add_argument("action", choices=("retrain", "reset"))
    n.add_argument("root", help="folder of outcomes and model")
    n.add_argument("--key", required=True, help="file of the key that signs the model")
    s = sub.add_parser("stats", help="report on outcomes and processed files")
    s.add_argument("outcomes")
    s.add_argument("files")
    return p


def _recognition_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--recogniser", default="", help="module:function that makes a recognition engine in each worker")
    p.add_argument("--ocr-engine", choices=("surya", "paddle", "tesseract"), default="paddle", help="its name")
    p.add_argument("--no-ocr", action="store_true", help="take the text layer of PDF files only")
    p.add_argument("--force-ocr", action="store_true", help="recognise every page as a whole")


def recognition(recogniser: str, engine: str, no_ocr: bool, force: bool) -> Recognition | None:
    """What the options ask for; None for the text layer alone. Raises ``ValueError`` for a recogniser that cannot be loaded."""
    if no_ocr or not recogniser:
        if force:
            raise ValueError("--force-ocr needs a recogniser")
        return None
    module, _, name = recogniser.partition(":")
    try:
        make = getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as error:
        raise ValueError(f"cannot load {recogniser}: {error}") from error
    return Recognition(make, engine, force)


def formats(text: str) -> tuple[str, ...]:
    """Extensions of a comma-separated list; raises ``ValueError`` for unsupported ones, none means all."""
    asked = tuple("." + x.strip().lower().lstrip(".") for x in text.split(",") if x.strip())
    if unknown := sorted(set(asked) - set(ls.FORMATS)):
        raise ValueError(f"unsupported formats: {', '.join(unknown)}")
    return asked or ls.FORMATS


def _scored(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return tq.with_quality(df, column, prefix)


def convert(
    spark: SparkSession, directory: str, recursive: bool = False, wanted: tuple[str, ...] = ls.FORMATS, improve: bool = False, overwrite: bool = False, dry_run: bool = False,
    how: Recognition | None = None,
) -> DataFrame:
    """Converts a folder and returns ``(path, status, detail, error, size, md_bytes, pages, ocr_pages, ocr_chars)`` per document.

    Contents are read only of documents whose status depends on them.
    """
    listed = src.list_files(spark, [directory], recursive)
    found = listed.join(ls.find_documents(listed, wanted), "path", "left_semi").withColumn("output_path", md.markdown_path(F.col("path")))
    outputs = listed.select(F.col("path").alias("output_path")).withColumn("_e", F.lit(True))
    known = found.join(outputs, "output_path", "left").withColumn("exists", F.coalesce("_e", F.lit(False))).drop("_e")
    open_ = known.withColumns({"error": F.lit(None).cast("string"), "old_score": F.lit(None).cast("double"), "new_score": F.lit(None).cast("double")})
    first = su.with_status(open_, improve, overwrite, dry_run)
    waiting = first.where("status IN ('created', 'kept', 'improved', 'failed')").select("path", "output_path", "length", "exists")
    done = first.where("status NOT IN ('created', 'kept', 'improved', 'failed')")
    files = src.read_files(waiting.select("path"))
    rendered = waiting.join(src.documents(files, recognition=how).drop("output_path"), "path")
    rendered = _scored(rendered.withColumn("new_text", F.array_join("pages", "\n")), "new_text", "new_")
    if improve:
        old = src.existing_markdown(spark, directory).select(F.regexp_replace("path", "^file:/+", "file:/").alias("output_path"), md.strip_metadata(F.col("markdown")).alias("old_text"))
        rendered = _scored(rendered.join(old, "output_path", "left"), "old_text", "old_")
    else:
        rendered = rendered.withColumn("old_total_score", F.lit(None).cast("double"))
    judged = su.with_status(rendered.withColumnRenamed("new_total_score", "new_score").withColumnRenamed("old_total_score", "old_score"), improve, overwrite, dry_run)
    judged = stage(judged, "converted")
    src.write_markdown(judged.where("status IN ('created', 'improved')"))
    columns = [
        "path", "status", su.detail(F.col("old_score"), F.col("new_score"), F.col("status")).alias("detail"), "error", F.col("length").alias("size"),
    ]
    written = F.when(F.col("status").isin("created", "improved"), F.octet_length("markdown")).otherwise(0).cast("long").alias("md_bytes")
    a = judged.select(*columns, written, F.size("pages").alias("pages"), "ocr_pages", "ocr_chars")
    b = done.select(*columns, *[F.lit(0).cast(kind).alias(n) for n, kind in (("md_bytes", "long"), ("pages", "int"), ("ocr_pages", "long"), ("ocr_chars", "long"))])
    return a.unionByName(b)


def take_up(todo: DataFrame, how: Recognition | None = None) -> DataFrame:
    """Converts files ``(key, ...)`` and returns the keys of those that could be converted; the others are tried again."""
    rendered = stage(src.documents(src.read_files(todo.select(F.col("key").alias("path"))), recognition=how), "rendered")
    src.write_markdown(rendered)
    for row in rendered.where("error IS NOT NULL").select("path", "error").toLocalIterator():
        print(f"Failed: {row.path} -> {row.error}", file=sys.stderr)
    return rendered.where("error IS NULL").select(F.col("path").alias("key"))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("leafmill").getOrCreate()
    ship(spark)
    if args.command == "learn":
        from leafmill.streaming.online import OnlineLearner

        learner = OnlineLearner(spark, args.root, args.key)
        learner.reset() if args.action == "reset" else learner.retrain()
        return 0
    try:
        wanted = formats(getattr(args, "formats", ""))
        how = recognition(args.recogniser, args.ocr_engine, args.no_ocr, args.force_ocr) if args.command in ("convert", "watch") else None
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    if args.command == "convert":
        directory = spark.range(1).select(convert_windows_path(F.lit(args.directory)).alias("d")).first().d
        results = convert(spark, directory, args.recursive, wanted, args.improve, args.overwrite, args.dry_run, how)
        totals = su.roll_up(stage(results, "results"))
        totals.show(truncate=False, vertical=True)
        return su.failed_run(totals).first().exit_code
    if args.command == "watch":
        from leafmill.streaming.watch import watch

        def take(todo: DataFrame) -> DataFrame:
            return take_up(todo, how)

        query = watch(spark, args.directories, inc.StateStore(spark, f"{args.state}/state"), f"{args.state}/checkpoint", take, args.recursive, None if args.once else args.poll_interval, formats=wanted, cooldown=args.cooldown)
        query.awaitTermination()
        return 0
    outcomes, files = spark.read.parquet(args.outcomes), spark.read.parquet(args.files)
    le.outcome_counts(outcomes).show(vertical=True)
    le.file_stats(files).show(vertical=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
