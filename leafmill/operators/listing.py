"""Finding documents, judging whether they are ready, and keeping what is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.strings import temp_pattern

# Supported formats, least size in bytes and rest in minutes of a ready file.
FORMATS = (".pdf", ".docx", ".doc", ".rtf", ".odt")
LEAST_SIZE, COOLDOWN_MINUTES = 100, 10


def case_variants(extension: str) -> list[str]:
    """Lower, upper and capitalised form of an extension."""
    bare = extension.lstrip(".")
    return [f".{x}" for x in (bare.lower(), bare.upper(), bare.capitalize())]


def find_documents(listing: DataFrame, formats: tuple[str, ...] | None = None, path: str = "path") -> DataFrame:
    """Distinct listed files whose extension is one of three case variants of a format.

    No or empty formats mean all supported ones. ``x.pDf`` is not found.
    """
    wanted = [v for f in (formats or FORMATS) for v in case_variants(f)]
    extension = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    return listing.where(extension.isin(wanted)).select(path).distinct()


def find_pdfs(listing: DataFrame, path: str = "path") -> DataFrame:
    return find_documents(listing, (".pdf",), path)


def find_by_globs(listing: DataFrame, formats: tuple[str, ...], path: str = "path") -> DataFrame:
    """The same as a union of one filter per pattern, made distinct."""
    parts = [listing.where(F.col(path).endswith(v)).select(path) for f in formats for v in case_variants(f)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def scan_formats(listing: DataFrame, formats: tuple[str, ...] = FORMATS, path: str = "path") -> DataFrame:
    """Listed files whose extension is a format in any case."""
    return listing.where(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(list(formats)))


def unsupported_formats(requested: Column) -> Column:
    """Requested extensions that no reader supports, trimmed, in lower case and with a dot."""
    cleaned = F.transform(requested, lambda x: F.lower(F.trim(x)))
    dotted = F.transform(cleaned, lambda x: F.when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x)))
    return F.array_except(dotted, F.array(*[F.lit(f) for f in FORMATS]))


def needs_processing(listing: DataFrame, tracker: DataFrame) -> DataFrame:
    """Rows ``(path, mtime, size)`` of a listing that no tracker row matches in path, time and size."""
    known = tracker.select("path", "mtime", "size").distinct()
    return listing.join(known, ["path", "mtime", "size"], "left_anti")


def lock_paths(path: Column) -> Column:
    """Lock files an editor may have put beside a file, with the order in which they count."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1)
    suffix = F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1)

    def at(order: int, lock: Column) -> Column:
        return F.struct(F.lit(order).alias("order"), F.concat(folder, lock).alias("lock"))

    every = F.array(
        at(1, F.concat(F.lit(".~lock."), name, F.lit("#"))),
        at(2, F.concat(F.lit("~$"), name)),
        F.when(F.length(stem) > 6, at(3, F.concat(F.lit("~$"), F.substring(stem, 1, 6), suffix))),
        at(4, F.concat(F.lit("."), name, F.lit(".swp"))),
    )
    return F.filter(every, lambda x: x.isNotNull())


def editor_locks(candidates: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """``(path, lock)``: first lock file that lies beside a candidate; unlocked candidates give no row."""
    keys = candidates.select(F.col(path), F.explode(lock_paths(F.col(path))).alias("k")).select(path, "k.order", "k.lock")
    present = listing.select(F.col(path).alias("lock")).distinct()
    first = F.min_by(F.col("lock"), F.col("order"))
    return keys.join(present, "lock").groupBy(path).agg(first.alias("lock"))


def readiness(listing: DataFrame, now: Column, locks: DataFrame | None = None, cooldown: float = COOLDOWN_MINUTES) -> DataFrame:
    """``(path, ready, reason)`` of ``(path, length, mtime)`` rows; the first reason that holds counts.

    ``now`` and ``mtime`` are epoch seconds. Reasons carry no figures, so that they can be counted.
    """
    df = listing if locks is None else listing.join(locks, "path", "left")
    locked = F.lit(False) if locks is None else F.col("lock").isNotNull()
    pattern = temp_pattern(F.regexp_extract("path", r"([^/]*)$", 1))
    reason = (
        F.when(F.col("length").isNull() | F.col("mtime").isNull(), "file does not exist")
        .when(pattern.isNotNull(), F.concat(F.lit("matches temp pattern: "), pattern))
        .when(F.col("length") < LEAST_SIZE, "too small")
        .when(now - F.col("mtime") < cooldown * 60, "cooldown")
        .when(locked, "editor lock")
        .otherwise("ready")
    )
    return df.select("path", reason.alias("reason")).withColumn("ready", F.col("reason") == "ready")


def unseen_content(files: DataFrame, processed: DataFrame, key: str = "file_hash") -> DataFrame:
    """Files whose content hash was not processed yet; a missing hash counts as unseen."""
    known = processed.select(key).where(F.col(key).isNotNull()).distinct()
    return files.join(known, key, "left_anti")


def seen_content(files: DataFrame, processed: DataFrame, key: str = "file_hash") -> DataFrame:
    known = processed.select(key).where(F.col(key).isNotNull()).distinct()
    return files.join(known, key, "left_semi")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last by ``order``, among equals the greatest in all columns.

    The aggregate combines map-side, so a key with a third of all rows is no hot spot.
    """
    rest = [c for c in rows.columns if c not in (key, order)]
    newest = F.max(F.struct(F.col(order), *[F.col(c) for c in rest]))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(newest.alias("_r")).select(
        *[F.col(key) if c == key else F.col(f"_r.{c}") for c in rows.columns]
    )


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Table after changes: for each key the last row by ``order``, the changes winning ties."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    ranked = F.max(F.struct(F.col(order), F.col("_new"), *[F.col(c) for c in table.columns if c not in (key, order)]))
    return both.groupBy(key).agg(ranked.alias("_r")).select(*[F.col(key) if c == key else F.col(f"_r.{c}") for c in table.columns])


def touch(processed: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Processed files with time and path of those seen again by hash; others stay."""
    s = seen.groupBy("file_hash").agg(F.max("path").alias("_path"))
    j = processed.join(s, "file_hash", "left")
    again = F.col("_path").isNotNull()
    return j.select(
        *[
            F.when(again, now).otherwise(F.col(c)).alias(c) if c == "last_seen_at" else F.coalesce("_path", c).alias(c) if c == "pdf_path" else F.col(c)
            for c in processed.columns
        ]
    )


def file_records(files: DataFrame, now: Column) -> DataFrame:
    """Records of processed files from ``(path, file_hash, file_size, page_count, image_count, score, word_count, old_score, mode)``.

    The change in quality is null without both scores. A content seen under several paths has one record, the greatest.
    """
    rows = files.select(
        "file_hash", now.cast("double").alias("processed_at"), F.col("path").alias("pdf_path"), "file_size", "page_count", "image_count", now.cast("double").alias("last_seen_at"),
        F.col("score").alias("quality_score"), F.col("word_count").alias("quality_word_count"), F.col("old_score").alias("previous_quality_score"),
        (F.col("score") - F.col("old_score")).alias("quality_delta"), F.col("mode").alias("extraction_mode"),
    )
    return latest(rows, "file_hash", "processed_at")


def regressed(records: DataFrame, below: float = -0.02) -> DataFrame:
    """``(path, old_score, new_score, delta)`` of records whose quality fell by more than the bound."""
    return records.where(F.col("quality_delta") < below).select(
        F.col("pdf_path").alias("path"), F.col("previous_quality_score").alias("old_score"), F.col("quality_score").alias("new_score"), F.col("quality_delta").alias("delta")
    )
