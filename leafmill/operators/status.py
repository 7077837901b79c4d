"""Outcome of each document and the roll-ups of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("failed", "skipped", "improved", "kept", "created", "would_compare", "would_create", "would_overwrite")


def with_status(files: DataFrame, improve: bool = False, overwrite: bool = False, dry_run: bool = False) -> DataFrame:
    """Adds ``status`` to rows ``(exists, error, old_score, new_score)``.

    Improve mode compares existing outputs and overwrites only strictly better ones; otherwise existing
    outputs are skipped unless overwritten. A row with an error failed, if its document was read at all.
    """
    exists = F.coalesce("exists", F.lit(False))
    failed = F.col("error").isNotNull()
    better = F.col("new_score") > F.col("old_score")
    if improve:
        status = F.when(exists & F.lit(dry_run), "would_compare").when(exists & failed, "failed").when(exists & better, "improved").when(exists, "kept")
    else:
        status = F.when(exists & F.lit(not overwrite), "skipped").when(exists & F.lit(dry_run), "would_overwrite")
    return files.withColumn("status", status.when(F.lit(dry_run), "would_create").when(failed, "failed").otherwise("created"))


def detail(old_score: Column, new_score: Column, status: Column) -> Column:
    """What improve mode decided, with both scores."""
    return F.when(status == "improved", F.format_string("Improved: %.2f → %.2f", old_score, new_score)).when(
        status == "kept", F.format_string("Kept existing: %.2f > %.2f", old_score, new_score)
    )


def roll_up(results: DataFrame, *keys: str) -> DataFrame:
    """Counters of a run from rows ``(status, size, md_bytes, pages, ocr_pages, ocr_chars)``.

    Failed and skipped documents add no processed bytes. Sums commute, so partial ones combine map-side.
    """
    s = F.col("status")
    done = s.isin("improved", "kept", "created")

    def total(column: str, condition: Column | None = None) -> Column:
        value = F.col(column) if condition is None else F.when(condition, F.col(column))
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    return results.groupBy(*keys).agg(
        F.count("*").alias("total_files"),
        total("size").alias("total_bytes"),
        F.count_if(s == "failed").alias("failed_files"),
        F.count_if(s == "skipped").alias("skipped_files"),
        F.count_if(s == "improved").alias("improved_files"),
        F.count_if(s == "kept").alias("kept_existing"),
        F.count_if(done).alias("processed_files"),
        total("size", done).alias("processed_bytes"),
        total("md_bytes").alias("md_bytes"),
        total("pages").alias("processed_pages"),
        total("ocr_pages").alias("ocr_pages"),
        total("ocr_chars").alias("ocr_chars"),
    )


def throughput(totals: DataFrame, seconds: Column) -> DataFrame:
    """Files and megabytes a minute, and output size in percent of the input; 0 where nothing was done."""
    minutes = seconds / 60
    mb = F.col("processed_bytes") / (1024 * 1024)
    return totals.withColumns(
        {
            "files_per_min": F.when(minutes > 0, F.col("processed_files") / minutes).otherwise(0.0),
            "mb_per_min": F.when(minutes > 0, mb / minutes).otherwise(0.0),
            "output_percent": F.when(F.col("processed_bytes") > 0, F.col("md_bytes") * 100.0 / F.col("processed_bytes")).otherwise(0.0),
        }
    )


def failed_run(totals: DataFrame) -> DataFrame:
    """Exit code of a run: 1 if a document failed."""
    return totals.select(F.when(F.col("failed_files") > 0, 1).otherwise(0).alias("exit_code"))


def cycle_stats(scan: DataFrame, outcome: DataFrame) -> DataFrame:
    """One watch cycle: ready and pending files of the scan, processed, failed and skipped ones of the outcome."""
    a = scan.agg(F.count_if("ready").alias("ready"), F.count_if(~F.col("ready")).alias("pending"))
    s = F.col("status")
    b = outcome.agg(
        F.count_if(s.isin("created", "improved")).alias("processed"), F.count_if(s == "failed").alias("failed"), F.count_if(s.isin("skipped", "kept")).alias("skipped")
    )
    return one_row(a, b)


def one_row(*frames: DataFrame) -> DataFrame:
    """One row of frames of one row each, without a join."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def first_regressions(regressions: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first regressions in order of insertion, each with the number of further ones."""
    more = regressions.agg(F.greatest(F.count("*") - n, F.lit(0)).cast("long")).scalar()
    return regressions.orderBy(order).limit(n).withColumn("more", more)


def last_messages(log: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The last ``n`` messages with their place from the end."""
    last = log.orderBy(F.col(order).desc()).limit(n)
    return last.withColumn("from_end", F.row_number().over(Window.orderBy(F.col(order).desc())))


def worker_count(ocr: Column, engine: Column, has_pdf: Column, cpus: Column, asked: Column) -> Column:
    """Parallel workers: 1 for surya on PDF files, at most 2 for other engines, else all cores but one."""
    own = F.when(ocr & has_pdf, F.when(engine == "surya", F.lit(1)).otherwise(F.least(F.lit(2), cpus - 1))).otherwise(F.greatest(cpus - 1, F.lit(1)))
    return F.greatest(F.coalesce(asked, own), F.lit(1))


def batch_sizes(free_mb: Column) -> Column:
    """Recognition and detection batch sizes that fit the free memory of a device."""
    available = F.greatest(F.lit(0), free_mb - 4000)

    def fit(each: int, most: int, least: int) -> Column:
        return F.least(F.lit(most), F.greatest(F.lit(least), F.floor(available / each))).cast("int")

    return F.struct(fit(50, 64, 4).alias("recognition"), fit(280, 8, 1).alias("detection"))


def resolve_engine(requested: Column, enabled: Column, surya: Column, paddle: Column, tesseract: Column) -> Column:
    """First available engine of the fallback chain of the requested one; null if none or disabled."""
    t = F.when(tesseract, "tesseract")
    p = F.when(paddle, "paddle")
    chain = F.when(requested == "surya", F.coalesce(F.when(surya, "surya"), p, t)).when(requested == "paddle", F.coalesce(p, t)).otherwise(t)
    return F.when(enabled, chain)


def page_strategy(force: Column, images: Column, engine: Column) -> Column:
    """text, full or hybrid recognition of a page; force asks for full recognition whatever the engine."""
    return F.when(force, "full").when(engine.isNull() | (engine == "none"), "text").when(images > 0, "hybrid").otherwise("text")


def extraction_mode(force: Column, ocr: Column) -> Column:
    return F.when(force, "force_ocr").when(ocr, "ocr").otherwise("text")


def device_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows of a device listing in CSV with eight fields; lines with other counts are left out."""
    fields = F.transform(F.split(line, ","), lambda x: F.trim(x))
    names = ("name", "memory_total", "memory_used", "memory_free", "utilization", "temperature", "driver", "capability")
    kept = lines.where(F.size(fields) == 8).select(fields.alias("f"))
    numeric = {"memory_total", "memory_used", "memory_free", "utilization", "temperature"}
    return kept.select(*[(F.get("f", i).try_cast("int") if n in numeric else F.get("f", i)).alias(n) for i, n in enumerate(names)])
