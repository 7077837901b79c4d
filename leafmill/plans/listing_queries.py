"""Listing, readiness and run queries over the driver's tables, with their DuckDB SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import strings as st
from leafmill.functions import text_quality as tq
from leafmill.operators import listing as ls
from leafmill.operators import status as su
from leafmill.plans.text_queries import quality_ctes
from leafmill.session import table, text_table

#: Fixed time at which listings are judged, epoch seconds.
NOW = 1767657600


def find_documents(spark: SparkSession, d: str) -> DataFrame:
    """Listed documents by case variants of all formats."""
    return ls.find_documents(table(spark, d, "file_listing"))


def find_union(spark: SparkSession, d: str) -> DataFrame:
    """The same as a union of patterns made distinct."""
    return ls.find_by_globs(table(spark, d, "file_listing"), ls.FORMATS)


def find_pdfs(spark: SparkSession, d: str) -> DataFrame:
    """PDF files only."""
    return ls.find_pdfs(table(spark, d, "file_listing"))


def scan(spark: SparkSession, d: str) -> DataFrame:
    """Listed files of a format in any case, of two tables, in order of path."""
    both = table(spark, d, "file_listing").select("path").unionByName(table(spark, d, "processed").select("path"))
    return ls.scan_formats(both).distinct().orderBy("path")


def formats(spark: SparkSession, d: str) -> DataFrame:
    """Requested extensions of each source that no reader supports."""
    asked = F.array(F.lit(" PDF"), F.concat(F.lit("."), F.coalesce("source", F.lit("x"))), F.lit("docx "))
    return table(spark, d, "documents").select("doc_id", F.array_join(ls.unsupported_formats(asked), ",").alias("unsupported"))


def _listing(spark: SparkSession, d: str) -> DataFrame:
    newest = ls.latest(table(spark, d, "file_listing").select("path", "listed_at", "modificationtime", "length"), "path", "listed_at")
    return newest.select("path", F.col("length").alias("size"), F.unix_micros("modificationtime").alias("mtime"))


def _tracker(spark: SparkSession, d: str) -> DataFrame:
    p = ls.latest(table(spark, d, "processed").select("path", "processed_at", "mtime", "size"), "path", "processed_at")
    return p.select("path", F.round(F.col("mtime") * 1e6).cast("long").alias("mtime"), "size")


def needs_processing(spark: SparkSession, d: str) -> DataFrame:
    """Newest listing rows that the tracker's newest row does not match in time and size."""
    return ls.needs_processing(_listing(spark, d), _tracker(spark, d))


def readiness(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of all listed files, counted."""
    files = _listing(spark, d).select("path", F.col("size").alias("length"), (F.col("mtime") / 1e6).alias("mtime"))
    folder, name = F.regexp_extract("path", r"^(.*/)", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    kind = F.col("length") % 17
    made = files.withColumn(
        "path", F.when(kind == 1, F.concat("path", F.lit(".tmp"))).when(kind == 2, F.concat(folder, F.lit("Thumbs.db"))).otherwise(F.col("path"))
    )
    locks = files.where(kind == 3).select(F.concat(folder, F.lit("~$"), name).alias("path"))
    found = ls.editor_locks(made, made.select("path").unionByName(locks))
    return ls.readiness(made, F.lit(NOW), found).groupBy("reason", "ready").agg(F.count("*").alias("files"))


def lock_keys(spark: SparkSession, d: str) -> DataFrame:
    """Lock file that lies beside each listed file."""
    paths = table(spark, d, "file_listing").select("path").distinct()
    keys = paths.select("path", F.explode(ls.lock_paths(F.col("path"))).alias("k"))
    present = keys.where(F.length("path") % 4 == F.col("k.order") - 1).select(F.col("k.lock").alias("path"))
    return ls.editor_locks(paths, paths.unionByName(present))


def unseen(spark: SparkSession, d: str) -> DataFrame:
    """Listed content not among the processed content, and that seen before."""
    files = table(spark, d, "file_listing").select("path", "file_hash").distinct()
    known = table(spark, d, "processed")
    new, old = ls.unseen_content(files, known), ls.seen_content(files, known)
    return new.withColumn("seen", F.lit(False)).unionByName(old.withColumn("seen", F.lit(True))).select("path", "file_hash", "seen")


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """K4: processed files by hash after the rows of one table are put in by time."""
    rows = table(spark, d, "processed_files").select("file_hash", "pdf_path", "page_count", "processed_at", "last_seen_at").distinct()
    early, late = rows.where("page_count % 2 = 0"), rows.where("page_count % 2 = 1")
    return ls.upsert(ls.latest(early, "file_hash", "processed_at"), late, "file_hash", "processed_at")


def tracker_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The tracker's last row of each path."""
    return ls.latest(table(spark, d, "processed").select("path", "processed_at", "mtime", "size", "file_hash"), "path", "processed_at")


def tracked(spark: SparkSession, d: str) -> DataFrame:
    """How many paths the tracker knows, and how many of them have an output."""
    rows = ls.latest(table(spark, d, "processed").select("path", "processed_at", "output_path"), "path", "processed_at")
    return rows.agg(F.count("*").alias("total"), F.count("output_path").alias("with_output"))


def touched(spark: SparkSession, d: str) -> DataFrame:
    """K7: processed files touched where their content was seen under a second path."""
    rows = table(spark, d, "processed_files").select("file_hash", "pdf_path", "last_seen_at").distinct()
    paths = rows.groupBy("file_hash").agg(F.min("pdf_path").alias("first"), F.max("pdf_path").alias("path"))
    seen = paths.where("first <> path").select("file_hash", F.concat("path", F.lit(".again")).alias("path"))
    return ls.touch(rows, seen, F.lit(float(NOW)))


def _results(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "processed_files").distinct()
    existing = F.col("previous_quality_score").isNotNull()
    error = F.when(F.col("file_size") % 23 == 0, "broken")
    return f.select(
        "pdf_path", existing.alias("exists"), error.alias("error"), F.col("previous_quality_score").alias("old_score"), F.col("quality_score").alias("new_score"),
        F.col("file_size").alias("size"), (F.col("quality_word_count") * 6).alias("md_bytes"), F.col("page_count").alias("pages"),
        F.col("image_count").alias("ocr_pages"), (F.col("image_count") * 100).alias("ocr_chars"), "extraction_mode",
    )


def statuses(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of each file in every mode, counted."""
    r = _results(spark, d)
    modes = {"standard": {}, "overwrite": {"overwrite": True}, "improve": {"improve": True}, "dry": {"dry_run": True}, "dry_improve": {"dry_run": True, "improve": True}}
    out = None
    for name, options in modes.items():
        one = su.with_status(r, **options).groupBy("status").agg(F.count("*").alias("files")).withColumn("mode", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Counters of an improve run by extraction mode, with throughput over one hour."""
    r = su.with_status(_results(spark, d), improve=True)
    totals = su.throughput(su.roll_up(r, "extraction_mode"), F.lit(3600.0))
    return totals.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in totals.dtypes])


def cycle(spark: SparkSession, d: str) -> DataFrame:
    """Ready and pending files of a scan and the outcomes of a cycle."""
    files = _listing(spark, d).select("path", F.col("size").alias("length"), (F.col("mtime") / 1e6).alias("mtime"))
    return su.cycle_stats(ls.readiness(files, F.lit(NOW)), su.with_status(_results(spark, d)))


def regressions(spark: SparkSession, d: str) -> DataFrame:
    """O3: the first five regressions in order of recording and how many follow."""
    f = table(spark, d, "processed_files").where("quality_delta < -0.02").select("file_hash", "processed_at", "quality_delta").distinct()
    keyed = f.withColumn("seq", F.struct("processed_at", "file_hash"))
    return su.first_regressions(keyed, "seq").select("file_hash", F.round("quality_delta", 6).alias("quality_delta"), "more")


def last_messages(spark: SparkSession, d: str) -> DataFrame:
    """The last hundred events."""
    return su.last_messages(table(spark, d, "events").select("event_id", "event_type"), "event_id").select("event_id", "event_type", F.col("from_end").cast("long").alias("from_end"))


def exit_code(spark: SparkSession, d: str) -> DataFrame:
    """K9: exit code of the run."""
    return su.failed_run(su.roll_up(su.with_status(_results(spark, d))))


def settings(spark: SparkSession, d: str) -> DataFrame:
    """Engines, page strategies, workers and batch sizes over all nations' numbers."""
    n = F.col("c_custkey")
    df = table(spark, d, "customer").select(
        n.alias("id"), F.element_at(F.array(*map(F.lit, ("surya", "paddle", "tesseract", "auto"))), (n % 4 + 1).cast("int")).alias("asked"),
        *[(F.floor(n / k) % 2 == 0).alias(c) for k, c in ((4, "enabled"), (8, "surya"), (16, "paddle"), (32, "tesseract"), (64, "force"))],
        (n % 5).cast("int").alias("images"), (n % 9 + 1).cast("int").alias("cpus"), (n % 30000).cast("int").alias("free_mb"),
    )
    df = df.withColumn("engine", su.resolve_engine(F.col("asked"), F.col("enabled"), F.col("surya"), F.col("paddle"), F.col("tesseract")))
    sizes = su.batch_sizes(F.col("free_mb"))
    ocr = F.col("engine").isNotNull()
    return df.select(
        "id", "engine", su.page_strategy(F.col("force"), F.col("images"), F.col("engine")).alias("strategy"),
        su.extraction_mode(F.col("force"), ocr).alias("mode"),
        su.worker_count(ocr, F.col("engine"), F.lit(True), F.col("cpus"), F.lit(None).cast("int")).alias("workers"),
        sizes["recognition"].alias("recognition"), sizes["detection"].alias("detection"),
    )


def records(spark: SparkSession, d: str) -> DataFrame:
    """Records of documents by the hash of their content, with the newest stored score as the earlier one."""
    old = ls.latest(table(spark, d, "quality_metrics").select("doc_id", "scored_at", "total_score"), "doc_id", "scored_at").select("doc_id", F.col("total_score").alias("old_score"))
    docs = text_table(spark, d, "documents").where("text IS NOT NULL").select(
        "doc_id", F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("file_hash"), F.octet_length("text").cast("long").alias("file_size"),
        F.size(F.split("text", "\n\n", -1)).alias("page_count"), F.lit(0).alias("image_count"), F.lit("text").alias("mode"), "text",
    )
    scored = tq.with_quality(docs, "text", "now_").withColumns({"score": F.round("now_total_score", 6), "word_count": F.col("now_word_count")})
    rows = ls.file_records(scored.join(old, "doc_id", "left").withColumn("old_score", F.round("old_score", 6)), F.lit(float(NOW)))
    worse = ls.regressed(rows).select(F.col("path").alias("pdf_path"), F.lit(True).alias("regressed"))
    found = rows.join(worse, "pdf_path", "left")
    return found.select("file_hash", "pdf_path", "file_size", "page_count", "quality_score", "quality_word_count", "previous_quality_score", F.round("quality_delta", 6).alias("quality_delta"), F.coalesce("regressed", F.lit(False)).alias("regressed"))


def formatted(spark: SparkSession, d: str) -> DataFrame:
    """Figures of processed files as they are shown."""
    f = table(spark, d, "processed_files").select("file_hash", "pdf_path", "file_size", "page_count").distinct()
    return f.select("file_hash", "pdf_path", st.grouped(F.col("file_size")).alias("bytes"), st.megabytes(F.col("file_size")).alias("mb"), st.progress_bar((F.col("page_count") % 11) / 10.0, 40, "Pages").alias("bar"))


_EXT = ", ".join(f"'{v}'" for f in ls.FORMATS for v in ls.case_variants(f))
_NEW = "(SELECT path, max({'a': listed_at, 'b': modificationtime, 'c': length}) AS n FROM file_listing WHERE path IS NOT NULL GROUP BY path)"
_LIST = f"(SELECT path, n.c AS size, epoch_us(n.b) AS mtime FROM {_NEW})"
_LOCKS = """SELECT path, unnest([{{'o': 1, 'l': f || '.~lock.' || n || '#'}}, {{'o': 2, 'l': f || '~$' || n}}, CASE WHEN length(s) > 6 THEN {{'o': 3, 'l': f || '~$' || substring(s, 1, 6) || x}} END, {{'o': 4, 'l': f || '.' || n || '.swp'}}]) AS k
  FROM (SELECT path, f, n, regexp_extract(n, '^(.+?)(\\.[^.]*)?$', 1) AS s, regexp_extract(n, '^.+?(\\.[^.]*)$', 1) AS x
        FROM (SELECT path, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS f, regexp_extract(path, '([^/]*)$', 1) AS n FROM {src}))"""
_RES = """SELECT *, previous_quality_score IS NOT NULL AS e, file_size % 23 = 0 AS bad FROM (SELECT DISTINCT * FROM processed_files)"""
_STATUS = {
    "standard": "CASE WHEN e THEN 'skipped' WHEN bad THEN 'failed' ELSE 'created' END",
    "overwrite": "CASE WHEN bad THEN 'failed' ELSE 'created' END",
    "improve": "CASE WHEN e AND bad THEN 'failed' WHEN e AND quality_score > previous_quality_score THEN 'improved' WHEN e THEN 'kept' WHEN bad THEN 'failed' ELSE 'created' END",
    "dry": "CASE WHEN e THEN 'skipped' ELSE 'would_create' END",
    "dry_improve": "CASE WHEN e THEN 'would_compare' ELSE 'would_create' END",
}

QUERIES = {
    "ref_s1_find_documents": find_documents, "ref_s1_u1_union": find_union, "ref_s2_find_pdfs": find_pdfs, "ref_s3_o1_scan": scan, "ref_u2_formats": formats,
    "ref_j1_needs_processing": needs_processing, "ref_r3_readiness": readiness, "ref_j5_locks": lock_keys, "ref_j2_unseen": unseen, "ref_k4_upsert": upserted,
    "ref_k5_tracker": tracker_upsert, "ref_a16_tracked": tracked, "ref_k7_touch": touched, "ref_k2_statuses": statuses, "ref_a8_roll_up": roll_up, "ref_a12_cycle": cycle, "ref_o3_regressions": regressions,
    "ref_n9_last_messages": last_messages, "ref_k9_exit_code": exit_code, "ref_p11_p14_settings": settings, "ref_g10_h1_records": records, "ref_t11_formats": formatted,
}
SQL = {
    "ref_s1_find_documents": f"SELECT DISTINCT path FROM file_listing WHERE regexp_extract(path, '(\\.[^./]+)$', 1) IN ({_EXT})",
    "ref_s1_u1_union": f"SELECT DISTINCT path FROM file_listing WHERE regexp_extract(path, '(\\.[^./]+)$', 1) IN ({_EXT})",
    "ref_s2_find_pdfs": "SELECT DISTINCT path FROM file_listing WHERE regexp_extract(path, '(\\.[^./]+)$', 1) IN ('.pdf', '.PDF', '.Pdf')",
    "ref_s3_o1_scan": f"SELECT DISTINCT path FROM (SELECT path FROM file_listing UNION ALL SELECT path FROM processed) WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN {ls.FORMATS} ORDER BY path",
    "ref_u2_formats": f"SELECT doc_id, CASE WHEN lower(trim('.' || coalesce(source, 'x'))) IN {ls.FORMATS} THEN '' ELSE lower(trim('.' || coalesce(source, 'x'))) END AS unsupported FROM documents",
    "ref_j1_needs_processing": f"""SELECT l.path, l.size, l.mtime FROM {_LIST} l LEFT JOIN
      (SELECT path, CAST(round(n.b * 1e6) AS BIGINT) AS mtime, n.c AS size FROM (SELECT path, max({{'a': processed_at, 'b': mtime, 'c': size}}) AS n FROM processed GROUP BY path)) t
      ON l.path = t.path AND l.mtime = t.mtime AND l.size = t.size WHERE t.path IS NULL""",
    "ref_r3_readiness": f"""WITH f AS (SELECT path AS p0, size, mtime / 1e6 AS mtime, size % 17 AS kind FROM {_LIST}),
      m AS (SELECT *, CASE kind WHEN 1 THEN p0 || '.tmp' WHEN 2 THEN regexp_extract(p0, '^(.*/)', 1) || 'Thumbs.db' ELSE p0 END AS path FROM f),
      r AS (SELECT CASE WHEN ends_with(lower(path), '.tmp') THEN 'matches temp pattern: *.tmp' WHEN kind = 2 THEN 'matches temp pattern: thumbs.db' WHEN size < 100 THEN 'too small'
        WHEN {NOW} - mtime < 600 THEN 'cooldown' WHEN kind = 3 THEN 'editor lock' ELSE 'ready' END AS reason FROM m)
      SELECT reason, reason = 'ready' AS ready, count(*) AS files FROM r GROUP BY reason""",
    "ref_j5_locks": f"""WITH k AS ({_LOCKS.format(src='(SELECT DISTINCT path FROM file_listing)')}), u AS (SELECT path, k.o AS o, k.l AS l FROM k WHERE k IS NOT NULL)
      SELECT path, min_by(l, o) AS lock FROM u WHERE l IN (SELECT l FROM u WHERE length(path) % 4 = o - 1) GROUP BY path""",
    "ref_j2_unseen": """SELECT DISTINCT path, file_hash, file_hash IS NOT NULL AND file_hash IN (SELECT file_hash FROM processed WHERE file_hash IS NOT NULL) AS seen FROM file_listing""",
    "ref_k4_upsert": """SELECT file_hash, n.c AS pdf_path, n.d AS page_count, n.a AS processed_at, n.e AS last_seen_at FROM
      (SELECT file_hash, max({'a': processed_at, 'b': page_count % 2, 'c': pdf_path, 'd': page_count, 'e': last_seen_at}) AS n FROM processed_files GROUP BY file_hash)""",
    "ref_k5_tracker": """SELECT path, n.a AS processed_at, n.b AS mtime, n.c AS size, n.d AS file_hash FROM (SELECT path, max({'a': processed_at, 'b': mtime, 'c': size, 'd': file_hash}) AS n FROM processed GROUP BY path)""",
    "ref_a16_tracked": """SELECT count(*) AS total, count(*) FILTER (m.b <> '') AS with_output FROM (SELECT path, max({'a': processed_at, 'b': coalesce(output_path, '')}) AS m FROM processed WHERE path IS NOT NULL GROUP BY path)""",
    "ref_k7_touch": f"""WITH r AS (SELECT DISTINCT file_hash, pdf_path, last_seen_at FROM processed_files), m AS (SELECT file_hash, max(pdf_path) || '.again' AS p FROM r GROUP BY file_hash HAVING count(DISTINCT pdf_path) > 1)
      SELECT r.file_hash, coalesce(m.p, r.pdf_path) AS pdf_path, CASE WHEN m.p IS NULL THEN last_seen_at ELSE {NOW}::DOUBLE END AS last_seen_at FROM r LEFT JOIN m USING (file_hash)""",
    "ref_k2_statuses": " UNION ALL ".join(f"SELECT {s} AS status, count(*) AS files, '{m}' AS mode FROM ({_RES}) GROUP BY 1" for m, s in _STATUS.items()),
    "ref_a8_roll_up": f"""WITH r AS (SELECT *, {_STATUS['improve']} AS s FROM ({_RES})),
      t AS (SELECT extraction_mode, count(*) AS total_files, CAST(sum(file_size) AS BIGINT) AS total_bytes, count(*) FILTER (s = 'failed') AS failed_files, count(*) FILTER (s = 'skipped') AS skipped_files,
        count(*) FILTER (s = 'improved') AS improved_files, count(*) FILTER (s = 'kept') AS kept_existing, count(*) FILTER (s IN ('improved', 'kept', 'created')) AS processed_files,
        CAST(coalesce(sum(file_size) FILTER (s IN ('improved', 'kept', 'created')), 0) AS BIGINT) AS processed_bytes, CAST(coalesce(sum(quality_word_count * 6), 0) AS BIGINT) AS md_bytes,
        CAST(coalesce(sum(page_count), 0) AS BIGINT) AS processed_pages, CAST(coalesce(sum(image_count), 0) AS BIGINT) AS ocr_pages, CAST(coalesce(sum(image_count * 100), 0) AS BIGINT) AS ocr_chars FROM r GROUP BY extraction_mode)
      SELECT *, round(processed_files / 60::DOUBLE, 6) AS files_per_min, round(processed_bytes / 1048576::DOUBLE / 60::DOUBLE, 6) AS mb_per_min,
        round(CASE WHEN processed_bytes > 0 THEN md_bytes * 100::DOUBLE / processed_bytes ELSE 0::DOUBLE END, 6) AS output_percent FROM t""",
    "ref_a12_cycle": f"""SELECT a.*, b.* FROM (SELECT count(*) FILTER (size >= 100 AND {NOW} - mtime / 1e6 >= 600) AS ready, count(*) FILTER (NOT (size >= 100 AND {NOW} - mtime / 1e6 >= 600)) AS pending FROM {_LIST}) a,
      (SELECT count(*) FILTER (s IN ('created', 'improved')) AS processed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s IN ('skipped', 'kept')) AS skipped FROM (SELECT {_STATUS['standard']} AS s FROM ({_RES}))) b""",
    "ref_o3_regressions": """WITH f AS (SELECT DISTINCT file_hash, processed_at, quality_delta FROM processed_files WHERE quality_delta < -0.02::DOUBLE)
      SELECT file_hash, round(quality_delta, 6) AS quality_delta, (SELECT CAST(greatest(count(*) - 5, 0) AS BIGINT) FROM f) AS more FROM f ORDER BY processed_at, file_hash LIMIT 5""",
    "ref_n9_last_messages": "SELECT event_id, event_type, row_number() OVER (ORDER BY event_id DESC) AS from_end FROM events ORDER BY event_id DESC LIMIT 100",
    "ref_k9_exit_code": f"SELECT CASE WHEN count(*) FILTER ({_STATUS['standard']} = 'failed') > 0 THEN 1 ELSE 0 END AS exit_code FROM ({_RES})",
    "ref_g10_h1_records": f"""WITH {quality_ctes("(SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL)")}, o AS (SELECT doc_id, max({{'a': scored_at, 'b': total_score}}) AS m FROM quality_metrics GROUP BY doc_id),
      r AS (SELECT md5(q.t) AS file_hash, '/doc/' || q.id AS pdf_path, CAST(strlen(q.t) AS BIGINT) AS file_size, CAST(len(string_split(q.t, chr(10) || chr(10))) AS INTEGER) AS page_count,
        round(q.total, 6) AS s, q.word_count AS w, round(o.m.b, 6) AS p FROM q LEFT JOIN o ON q.id = o.doc_id),
      g AS (SELECT file_hash, max(pdf_path) AS pdf_path FROM r GROUP BY file_hash)
      SELECT r.file_hash, r.pdf_path, file_size, page_count, s AS quality_score, w AS quality_word_count, p AS previous_quality_score, round(s - p, 6) AS quality_delta, coalesce(s - p < -0.02::DOUBLE, FALSE) AS regressed
      FROM r JOIN g ON r.file_hash = g.file_hash AND r.pdf_path = g.pdf_path""",
    "ref_t11_formats": """SELECT DISTINCT file_hash, pdf_path, format('{:,}', file_size) AS bytes, printf('%.2f MB', file_size / 1048576::DOUBLE) AS mb,
      'Pages [' || repeat('█', CAST(floor((page_count % 11) / 10::DOUBLE * 25) AS INTEGER)) || repeat('░', 25 - CAST(floor((page_count % 11) / 10::DOUBLE * 25) AS INTEGER)) || ']' || printf(' %5.1f%%', (page_count % 11) / 10::DOUBLE * 100) AS bar FROM processed_files""",
    "ref_p11_p14_settings": """WITH b AS (SELECT c_custkey AS id, ['surya', 'paddle', 'tesseract', 'auto'][c_custkey % 4 + 1] AS a, (c_custkey // 4) % 2 = 0 AS en, (c_custkey // 8) % 2 = 0 AS su, (c_custkey // 16) % 2 = 0 AS pa, (c_custkey // 32) % 2 = 0 AS te,
        (c_custkey // 64) % 2 = 0 AS fo, c_custkey % 5 AS im, c_custkey % 9 + 1 AS cpu, c_custkey % 30000 AS mb FROM customer),
      e AS (SELECT *, CASE WHEN NOT en THEN NULL WHEN a = 'surya' AND su THEN 'surya' WHEN a IN ('surya', 'paddle') AND pa THEN 'paddle' WHEN te THEN 'tesseract' END AS engine FROM b)
      SELECT id, engine, CASE WHEN fo THEN 'full' WHEN engine IS NULL THEN 'text' WHEN im > 0 THEN 'hybrid' ELSE 'text' END AS strategy,
        CASE WHEN fo THEN 'force_ocr' WHEN engine IS NOT NULL THEN 'ocr' ELSE 'text' END AS mode,
        CAST(greatest(1, CASE WHEN engine IS NULL THEN greatest(cpu - 1, 1) WHEN engine = 'surya' THEN 1 ELSE least(2, cpu - 1) END) AS INTEGER) AS workers,
        CAST(least(64, greatest(4, greatest(0, mb - 4000) // 50)) AS INTEGER) AS recognition, CAST(least(8, greatest(1, greatest(0, mb - 4000) // 280)) AS INTEGER) AS detection FROM e""",
}
