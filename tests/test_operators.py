import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import features as fe
from leafmill.operators import learner as le
from leafmill.operators import listing as ls
from leafmill.operators import logs, sections
from leafmill.operators import status as su
from leafmill.operators.order import with_ordinal


def test_case_rules_of_both_scans(spark):
    names = ["a.pdf", "b.PDF", "c.Pdf", "d.pDf", "e.docx", "f.txt", "g", "h.pdf"]
    df = spark.createDataFrame([(n,) for n in names + ["a.pdf"]], "path string")
    assert {r.path for r in ls.find_documents(df).collect()} == {"a.pdf", "b.PDF", "c.Pdf", "e.docx", "h.pdf"}
    assert {r.path for r in ls.find_by_globs(df, ls.FORMATS).collect()} == {"a.pdf", "b.PDF", "c.Pdf", "e.docx", "h.pdf"}
    assert {r.path for r in ls.scan_formats(df).collect()} == {"a.pdf", "b.PDF", "c.Pdf", "d.pDf", "e.docx", "h.pdf"}
    assert {r.path for r in ls.find_documents(df, ()).collect()} == {r.path for r in ls.find_documents(df).collect()}


def test_readiness_order(spark):
    now = 10_000.0
    rows = [
        ("/d/a.docx", 200, 0.0), ("/d/small.pdf", 50, 0.0), ("/d/new.pdf", 200, now - 5), ("/d/x.tmp", 10, now), ("/d/report1.docx", 200, 0.0), ("/d/gone.pdf", None, None),
        ("/d/notes.md", 200, 0.0), ("/d/.notes.md.swp", 200, 0.0), ("/d/.~lock.a.docx#", 10, 0.0), ("/d/~$report.docx", 10, 0.0),
    ]
    df = spark.createDataFrame(rows, "path string, length long, mtime double")
    locks = ls.editor_locks(df, df)
    got = {r.path: r.reason for r in ls.readiness(df, F.lit(now), locks).collect()}
    assert got["/d/a.docx"] == got["/d/report1.docx"] == got["/d/notes.md"] == "editor lock"
    assert got["/d/small.pdf"] == "too small" and got["/d/new.pdf"] == "cooldown" and got["/d/gone.pdf"] == "file does not exist"
    assert got["/d/x.tmp"] == "matches temp pattern: *.tmp"


def test_upsert_and_touch(spark):
    t = spark.createDataFrame([("a", 1.0, "x"), ("b", 5.0, "y")], "k string, at double, v string")
    c = spark.createDataFrame([("a", 1.0, "new"), ("b", 4.0, "old"), ("c", 1.0, None)], "k string, at double, v string")
    assert {r.k: r.v for r in ls.upsert(t, c, "k", "at").collect()} == {"a": "new", "b": "y", "c": None}
    p = spark.createDataFrame([("h", "p", 1.0), ("i", "q", 1.0)], "file_hash string, pdf_path string, last_seen_at double")
    s = spark.createDataFrame([("h", "r")], "file_hash string, path string")
    assert sorted(map(tuple, ls.touch(p, s, F.lit(9.0)).collect())) == [("h", "r", 9.0), ("i", "q", 1.0)]


def test_status_and_roll_up(spark):
    rows = [(True, None, 0.5, 0.6), (True, None, 0.5, 0.5), (True, "bad", None, None), (False, None, None, 0.4), (False, "bad", None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "exists boolean, error string, old_score double, new_score double")

    def statuses(**options):
        return [r.status for r in su.with_status(df, **options).collect()]

    assert statuses(improve=True) == ["improved", "kept", "failed", "created", "failed", "created"]
    assert statuses() == ["skipped", "skipped", "skipped", "created", "failed", "created"]
    assert statuses(overwrite=True) == ["created", "created", "failed", "created", "failed", "created"]
    assert statuses(dry_run=True) == ["skipped"] * 3 + ["would_create"] * 3
    full = su.with_status(df, improve=True).select("status", *[F.lit(2).alias(c) for c in ("size", "md_bytes", "pages", "ocr_pages", "ocr_chars")])
    r = su.throughput(su.roll_up(full), F.lit(60.0)).first()
    assert (r.failed_files, r.improved_files, r.kept_existing, r.processed_files, r.processed_bytes, r.files_per_min) == (2, 1, 1, 4, 8, 4.0)
    empty = su.throughput(su.roll_up(full.where("false")), F.lit(0.0)).first()
    assert (empty.total_files, empty.processed_bytes, empty.output_percent) == (0, 0, 0.0)


def test_vector_and_pixels(spark):
    row = [(500, 300, 150000, 1.67, 0.5, "body", 50.0, True, 128.0, 40.0, False, True)]
    df = spark.createDataFrame(row, "width int, height int, area int, aspect_ratio double, page_y_center double, region string, surrounding_text_density double, has_nearby_caption boolean, brightness_mean double, brightness_std double, is_mostly_white boolean, has_contrast boolean")
    v = df.select(fe.vector().alias("v")).first().v
    assert len(v) == 14 and v[0] == 0.5 and v[7] == 0.5 and v[9] == 1.0
    assert df.withColumn("area", F.lit(None).cast("int")).select(fe.vector().alias("v")).first().v is None
    p = spark.createDataFrame([([255] * 20,), ([0, 255],), ([],)], "px array<int>").select(fe.pixel_stats(F.col("px")).alias("s")).collect()
    assert p[0].s.is_mostly_white and not p[0].s.has_contrast and p[1].s.brightness_std == 127.5 and p[2].s is None


def test_rects_fold_in_order(spark):
    rng = random.Random(4)
    pages = []
    for page in range(20):
        rects = []
        for i in range(12):
            x, y = rng.randint(0, 60), rng.randint(0, 60)
            rects.append((i, float(x), float(y), float(x + rng.randint(0, 40)), float(y + rng.randint(0, 40))))
        pages.append((page, rects))

    def area(r):
        return (r[3] - r[1]) * (r[4] - r[2])

    def brute(rects):
        kept = []
        for r in rects:
            if not any(r[1] < p[3] and r[3] > p[1] and r[2] < p[4] and r[4] > p[2] and area(r) > 0 and abs(area(r) - area(p)) / max(area(r), 1) < 0.5 for p in kept):
                kept.append(r)
        return [r[0] for r in kept]

    df = spark.createDataFrame(pages, "page int, r array<struct<seq:int,x0:double,y0:double,x1:double,y1:double>>")
    for row in df.select("page", fe.distinct_rects(F.col("r")).alias("k")).collect():
        assert [x.seq for x in row.k] == brute(pages[row.page][1])


def test_ordinals_and_windows_over_tasks(spark):
    n = 25_000
    df = spark.range(n).select(F.col("id"), (F.col("id") % 7).cast("double").alias("recorded_at"))
    ordered = with_ordinal(df, "recorded_at", "id")
    rows = ordered.orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(1, n + 1))
    assert all((a.recorded_at, a.id) < (b.recorded_at, b.id) for a, b in zip(rows, rows[1:]))
    p = df.withColumns({"pred_prob": (F.col("id") % 10) / 10.0, "is_useful": F.col("id") % 3 == 0})
    got = {r.id: (r.recent_count, r.recent_error) for r in le.recent_error(p).collect()}
    errors, want = [], {}
    for r in rows:
        errors.append(int(((r.id % 10) / 10.0 < 0.5) == (r.id % 3 == 0)))
        last = errors[-100:]
        want[r.id] = (len(last), sum(last) / len(last) if len(last) >= 20 else None)
    assert got == want


def test_rates(spark):
    def value(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert value(le.exploration_rate(F.lit(10))) == 0.5
    assert value(le.exploration_rate(F.lit(200))) == 0.25
    assert value(le.exploration_rate(F.lit(100000))) == 0.05
    assert value(le.adaptive_exploration(F.lit(200), F.lit(0.6), F.lit(50))) == pytest.approx(0.5)
    assert value(le.skip_validation(F.lit(5), F.lit(5))) == 0.10
    assert value(le.skip_validation(F.lit(20), F.lit(20))) == 0.5
    assert value(le.ucb_bonus(F.lit(10), F.lit(10))) == 0.15
    assert value(le.ucb_bonus(F.lit(100), F.lit(None).cast("int"))) == 0.30


def test_disabled_learner_recognises_all(spark):
    df = spark.createDataFrame([(1,)], "id int")
    r = le.decide(df, df, F.lit(0), F.lit(0.1), F.lit(0.0), F.lit(0), F.lit(0), F.lit(0), (F.lit(0.5), F.lit(0.5)), enabled=False).first()
    assert r.do_ocr and r.reason == "learning disabled" and not r.is_exploration


def test_training_needs_samples_and_classes(spark, sf, tmp_path):
    o = spark.read.parquet(f"{sf}/ocr_outcomes.parquet").distinct()
    assert le.train(o.limit(5)) is None
    assert le.train(o.where("is_useful")) is None
    model = le.train(o, f"file://{tmp_path}/m")
    scored = le.predict(model, o)
    assert scored.where("probability BETWEEN 0 AND 1").count() + scored.where("probability IS NULL").count() == o.count()
    assert le.load_or_train(f"file://{tmp_path}/none", o, b"key")[0].depth <= 10


def test_sections(spark):
    rows = [("a", 0, "x", True), ("a", 1, "", True), ("a", 2, "y", False), ("a", 3, "z", True), ("b", 0, "", False)]
    got = sections.split_sections(spark.createDataFrame(rows, "path string, pos int, text string, has_break boolean")).collect()
    assert sorted((r.path, r.section, r.text) for r in got) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "")]


def test_log_health(spark):
    lines = ["Traceback (none before)", "2025-01-01 00:00:00 a", "Traceback x", "  at", "2025-01-03 00:00:00 b", "Traceback y"]
    df = logs.dated(spark.createDataFrame(list(enumerate(lines)), "n int, line string"))
    assert logs.tracebacks(df, "n", F.lit("2025-01-02").cast("timestamp")).first()[0] == 1
    assert logs.tracebacks(df, "n", F.lit("2024-01-01").cast("timestamp")).first()[0] == 2
    r = logs.freshness(df, F.lit("2025-01-10").cast("timestamp")).first()
    assert r.warn and r.age_hours == 168
    assert logs.freshness(df.where("ts IS NULL"), F.lit("2025-01-10").cast("timestamp")).first().warn


def test_status_functions(spark):
    def value(c):
        return spark.range(1).select(c.alias("x")).first().x

    t, f = F.lit(True), F.lit(False)
    assert value(su.resolve_engine(F.lit("surya"), t, f, t, t)) == "paddle"
    assert value(su.resolve_engine(F.lit("auto"), t, t, t, t)) == "tesseract"
    assert value(su.resolve_engine(F.lit("surya"), f, t, t, t)) is None
    assert value(su.page_strategy(t, F.lit(3), F.lit("none"))) == "full"
    assert value(su.page_strategy(f, F.lit(3), F.lit("none"))) == value(su.page_strategy(f, F.lit(0), F.lit("paddle"))) == "text"
    assert value(su.page_strategy(f, F.lit(3), F.lit("paddle"))) == "hybrid"
    assert value(su.worker_count(t, F.lit("surya"), t, F.lit(8), F.lit(None).cast("int"))) == 1
    assert value(su.worker_count(f, F.lit("x"), t, F.lit(1), F.lit(None).cast("int"))) == 1
    assert value(su.batch_sizes(F.lit(6000))).recognition == 40
    gpu = spark.createDataFrame([("A, 100, 5, 95, 1, 40, 5.1, 8.0",), ("broken",)], "line string")
    assert su.device_rows(gpu).first().memory_free == 95 and su.device_rows(gpu).count() == 1
