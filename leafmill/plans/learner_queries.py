"""Feature, layout, learner and log queries over the driver's tables, with their DuckDB SQL."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import strings as st
from leafmill.operators import features as fe
from leafmill.operators import hybrid as hy
from leafmill.operators import learner as le
from leafmill.operators import logs
from leafmill.session import table


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes without repeated rows."""
    return table(spark, d, "ocr_outcomes").distinct()


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes on pages of 600 by 800 units, from the sizes and heights of recorded images."""
    o = _outcomes(spark, d).where("width IS NOT NULL AND height IS NOT NULL AND page_y_center IS NOT NULL")
    x0 = ((F.col("id") * 37) % 500).cast("double")
    y0 = F.col("page_y_center") * 800 - F.col("height") / 2
    return o.select("id", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("width") + 0.4).alias("x1"), (y0 + F.col("height")).alias("y1"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))


def geometry(spark: SparkSession, d: str) -> DataFrame:
    """Geometry, region and tiny images."""
    g = fe.geometry(_boxes(spark, d)).withColumn("tiny", fe.is_tiny(F.col("width"), F.col("height")))
    return _rounded(g.select("id", "width", "height", "area", "aspect_ratio", "page_y_center", "region", "tiny"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Grey value figures of small made-up images."""
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("p_partkey") * (i + 3) * 7) % 256).cast("int"))
    white = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lit(250))
    df = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, white).otherwise(values).alias("px"))
    return _rounded(df.select("p_partkey", fe.pixel_stats(F.col("px")).alias("s")).select("p_partkey", "s.*"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """P5: feature vectors of all outcomes."""
    v = _outcomes(spark, d).select("id", fe.vector().alias("v"))
    return v.select("id", *[F.round(F.get("v", i), 9).alias(f"v{i}") for i in range(14)])


def structs(spark: SparkSession, d: str) -> DataFrame:
    """Features to JSON and back."""
    o = _outcomes(spark, d)
    kind = o.select(fe.as_struct().alias("s")).schema["s"].dataType
    back = o.select("id", F.from_json(F.to_json(fe.as_struct()), kind).alias("s")).select("id", "s.*")
    return _rounded(back)


def context(spark: SparkSession, d: str) -> DataFrame:
    """Text near the image of every page, the lines of the page as its text blocks."""
    pages = table(spark, d, "extracted_pages").select("page_id", "path", "page_num", "page_text").distinct().where("page_text IS NOT NULL")
    blocks = pages.select("path", "page_num", F.posexplode(F.split("page_text", "\n", -1)).alias("n", "content")).select(
        "path", "page_num", F.lit(60.0).alias("x0"), (F.col("n") * 20.0).alias("y0"), F.lit(540.0).alias("x1"), (F.col("n") * 20.0 + 18).alias("y1"), "content"
    )
    images = pages.select(
        "path", "page_num", F.col("page_id").alias("image_no"), F.lit(100.0).alias("x0"), (F.col("page_id") % 600).cast("double").alias("y0"), F.lit(300.0).alias("x1"), (F.col("page_id") % 600 + 80).cast("double").alias("y1")
    )
    return _rounded(fe.text_context(images, blocks).select("path", "page_num", "image_no", "surrounding_text_density", "has_nearby_caption"))


def rects(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles of each page without those an accepted one covers."""
    o = _outcomes(spark, d).where("width IS NOT NULL AND height IS NOT NULL")
    r = F.struct(
        F.col("image_index").alias("seq"), F.col("id").alias("id"), ((F.col("id") * 13) % 200).cast("double").alias("x0"), ((F.col("id") * 29) % 200).cast("double").alias("y0"),
        ((F.col("id") * 13) % 200 + F.col("width") / 4).alias("x1"), ((F.col("id") * 29) % 200 + F.col("height") / 4).alias("y1"),
    )
    pages = o.groupBy("pdf_path", "page_num").agg(F.array_sort(F.collect_list(r)).alias("r"))
    kept = fe.distinct_rects(F.col("r"))
    return pages.select("pdf_path", "page_num", F.size("r").alias("images"), F.size(kept).alias("kept"))


def ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Images of each page numbered from 0."""
    o = _outcomes(spark, d).select("id", "pdf_path", "page_num", "image_index")
    w = Window.partitionBy("pdf_path", "page_num").orderBy("image_index", "id")
    return o.select("id", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


def merged(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each page and recognised images merged by height."""
    pages = table(spark, d, "extracted_pages").select("page_id", "page_text").distinct()
    lines = pages.select("page_id", F.posexplode(F.split("page_text", "\n", -1)).alias("seq", "text"))
    blocks = lines.select("page_id", ((F.col("seq") * 11) % 7).cast("double").alias("y0"), "seq", "text", (F.col("seq") % 4 == 3).alias("recognised"))
    return fe.merge_page(blocks, "page_id").select("page_id", F.md5("page_text").alias("text_md5"), "ocr_regions", "ocr_chars")


def recognised(spark: SparkSession, d: str) -> DataFrame:
    """Results of recognisers in three shapes."""
    c = table(spark, d, "nation").select("n_nationkey", "n_name")
    q = F.concat(F.lit('"'), F.col("n_name"), F.lit('"'))
    kind = F.col("n_nationkey") % 4
    made = (
        F.when(kind == 0, F.concat(F.lit('{"rec_texts": ['), q, F.lit(', "", "x"]}')))
        .when(kind == 1, F.concat(F.lit('{"data": {"rec_texts": ['), q, F.lit("]}}")))
        .when(kind == 2, F.concat(F.lit("[[[[1,2],["), q, F.lit(",0.9]],[[3,4],[\"y\",0.5]]]]")))
        .otherwise("{}")
    )
    return c.select("n_nationkey", st.recognised_text(made).alias("text"))


def _fake_engine():
    """Reads from a region where it lies; stands for a recogniser."""
    return lambda r: "" if r["x0"] == 100 and r["y0"] % 5 == 0 else f"image {r['image_no']} at {int(r['y0'])}"


def hybrid_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page with its lines as text blocks, an image block, and two listed images, one of them the block's."""
    pages = table(spark, d, "extracted_pages").select("page_id", "path", "page_num", "page_text").distinct().where("page_text IS NOT NULL")
    pages = pages.withColumn("path", F.concat_ws("/", "path", F.col("page_id").cast("string")))
    n = F.col("page_id")
    size = [F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height")]
    pixels = F.array(F.lit(0), (n % 256).cast("int"), F.lit(255)).alias("pixels")
    lines = pages.select("path", "page_num", F.posexplode(F.split("page_text", "\n", -1)).alias("seq", "content")).select(
        "path", "page_num", "seq", F.lit("text").alias("kind"), F.lit(60.0).alias("x0"), (F.col("seq") * 20.0).alias("y0"), F.lit(540.0).alias("x1"), (F.col("seq") * 20.0 + 18).alias("y1"),
        *size, "content", F.lit(None).cast("array<int>").alias("pixels"),
    )

    def image(seq: int, kind: str, x0: float, y0, width, height: float) -> DataFrame:
        top = y0.cast("double")
        return pages.select(
            "path", "page_num", F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), F.lit(x0).alias("x0"), top.alias("y0"), (F.lit(x0) + width).cast("double").alias("x1"), (top + height).alias("y1"),
            *size, F.lit("").alias("content"), pixels,
        )

    made = [image(1_000_000, "image", 100.0, n % 600, F.lit(200.0), 80.0), image(1_000_001, "listed", 101.0, n % 600, F.lit(200.0), 80.0), image(1_000_002, "listed", 350.0, n * 7 % 600, n % 40, 30.0)]
    layout = lines.unionByName(made[0]).unionByName(made[1]).unionByName(made[2])
    done, _ = hy.extract_pages(pages.select("path", "page_num", *size), layout, _fake_engine, "tesseract", dpi=72)
    return done.select("path", "page_num", "strategy", F.md5("page_text").alias("text_md5"), "used_ocr", "ocr_regions", "ocr_chars", "skipped", "message")


def bins(spark: SparkSession, d: str) -> DataFrame:
    """A2, A3: recognised samples by bin."""
    return le.region_counts(_outcomes(spark, d))


def heuristics(spark: SparkSession, d: str) -> DataFrame:
    """Reason of every image."""
    return _outcomes(spark, d).select("id", le.heuristic_reason().alias("reason"))


def rates(spark: SparkSession, d: str) -> DataFrame:
    """Exploration, validation and bonus over a range of states."""
    n = F.col("p_partkey")
    df = table(spark, d, "part").select(
        n.alias("id"), (n % 700).alias("samples"), ((n % 101) / 100.0).alias("error"), (n % 40).alias("recent"), (n % 60).alias("total"), (n % 7).alias("useful"), (n % 90).alias("region"),
        ((n * 31 % 100) / 100.0).alias("p"), ((n * 7919 % 1000) / 1000.0).alias("draw"),
    )
    rate = le.adaptive_exploration(F.col("samples"), F.col("error"), F.col("recent"))
    bonus = le.ucb_bonus(F.col("samples") + 1, F.col("region"))
    return _rounded(
        df.select(
            "id", le.exploration_rate(F.col("samples")).alias("explore"), rate.alias("adaptive"), le.skip_validation(F.col("total"), F.col("useful")).alias("validate"),
            bonus.alias("bonus"), le.explores(F.col("p"), rate, bonus, F.col("draw")).alias("explores"),
        )
    )


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decision on every image with a frozen model's probability and fixed draws."""
    o = _outcomes(spark, d)
    p = F.when(F.col("id") % 11 != 0, (F.col("id") * 31 % 100) / 100.0)
    draws = ((F.col("id") * 7919 % 1000) / 1000.0, (F.col("id") * 104729 % 1000) / 1000.0)
    done = le.decide(o, le.region_counts(o), F.lit(600), p, F.lit(0.2), F.lit(50), F.lit(40), F.lit(6), draws)
    return done.select("id", "do_ocr", "reason", "is_exploration", F.round(st.reason_probability(F.col("reason")), 6).alias("stated"))


def accounting(spark: SparkSession, d: str) -> DataFrame:
    """Session counters of the decisions."""
    o = _outcomes(spark, d).select("ocr_performed", "is_useful", (F.col("id") % 5 == 0).alias("is_exploration"), F.when(F.col("id") % 10 == 0, "skip-validation (p=4%, rate=10%)").otherwise("classifier: 60% useful").alias("reason"))
    return le.account(o)


def running(spark: SparkSession, d: str) -> DataFrame:
    """Samples so far, in all and by bin, and the model's version."""
    o = _outcomes(spark, d).where("recorded_at IS NOT NULL").select("id", "recorded_at", "area", "brightness_mean", "region", "ocr_performed")
    return le.running_samples(o).select("id", "total_samples", "region_samples", "model_version")


def recent(spark: SparkSession, d: str) -> DataFrame:
    """Error over the last hundred predictions."""
    o = _outcomes(spark, d).where("recorded_at IS NOT NULL AND ocr_performed AND is_useful IS NOT NULL")
    p = o.select("id", "recorded_at", ((F.col("id") * 31 % 100) / 100.0).alias("pred_prob"), "is_useful")
    return _rounded(le.recent_error(p).select("id", F.col("recent_count").cast("long").alias("recent_count"), "recent_error"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Records, recognised and useful ones."""
    return _rounded(le.outcome_counts(_outcomes(spark, d)))


def files(spark: SparkSession, d: str) -> DataFrame:
    """Processed files, pages, images and quality changes."""
    return _rounded(le.file_stats(table(spark, d, "processed_files").distinct()))


def report(spark: SparkSession, d: str) -> DataFrame:
    """The full report."""
    return _rounded(le.learning_report(_outcomes(spark, d), table(spark, d, "processed_files").distinct(), accounting(spark, d)))


def training(spark: SparkSession, d: str) -> DataFrame:
    """Training rows by label with their weight."""
    return _rounded(le.training_set(_outcomes(spark, d)).groupBy("label").agg(F.count("*").alias("rows"), F.max("weight").alias("weight")))


def trained(spark: SparkSession, d: str) -> DataFrame:
    """Probability of a decision tree on every image; not expressible in SQL."""
    o = _outcomes(spark, d)
    model = le.train(o)
    return le.predict(model, o).select("id", F.round("probability", 6).alias("probability"))


def drawn(spark: SparkSession, d: str) -> DataFrame:
    """Bernoulli draws from a hash-free number; O4 orders by the same number."""
    o = _outcomes(spark, d)
    draw = (F.col("id") * 7919 % 1000) / 1000.0
    return o.select("id", F.round(draw, 6).alias("draw"), (draw < 0.1).alias("taken")).orderBy("draw", "id")


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    text = F.when(F.col("event_type") == "error", "Traceback (most recent call last):").when(
        F.col("event_id") % 3 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO "), F.col("event_type"))
    ).otherwise(F.concat(F.lit("  at "), F.col("event_type")))
    return logs.dated(e.select("event_id", text.alias("line")))


def traceback_count(spark: SparkSession, d: str) -> DataFrame:
    """Traceback lines since the middle of the log."""
    lines = logs.carried(_log(spark, d), "event_id")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return lines.agg(F.count_if(F.col("line").startswith("Traceback")).alias("tracebacks"), F.count_if(F.col("line").startswith("Traceback") & (F.col("last_ts") >= cut)).alias("recent"))


def fresh(spark: SparkSession, d: str) -> DataFrame:
    """Age of the last dated line."""
    return logs.freshness(_log(spark, d), F.lit("2025-06-01 00:00:00").cast("timestamp")).select(F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"), "age_hours", "warn")


_O = "(SELECT DISTINCT * FROM ocr_outcomes)"
_SIZE = "CASE WHEN area < 10000 THEN 'small' WHEN area < 50000 THEN 'medium' ELSE 'large' END"
_LIGHT = "CASE WHEN brightness_mean < 100 THEN 'dark' WHEN brightness_mean < 200 THEN 'medium' ELSE 'bright' END"
_HEURISTIC = """CASE WHEN area < 400 THEN 'heuristic: tiny image' WHEN region IN ('header', 'footer') AND area < 10000 THEN 'heuristic: small header/footer'
  WHEN region IN ('header', 'footer') AND aspect_ratio > 2 THEN 'heuristic: wide decoration' WHEN region = 'body' AND area < 2500 THEN 'heuristic: small body image'
  WHEN area > 50000 AND brightness_mean < 150 THEN 'heuristic: dark large image' WHEN is_mostly_white AND NOT has_contrast THEN 'heuristic: blank/white'
  WHEN region = 'margin' AND (aspect_ratio > 5 OR aspect_ratio < 0.2::DOUBLE) THEN 'heuristic: margin decoration' ELSE 'heuristic: worth trying' END"""
_BOX = f"""SELECT id, CAST((id * 37) % 500 AS DOUBLE) AS x0, page_y_center * 800 - height / 2::DOUBLE AS y0, CAST((id * 37) % 500 AS DOUBLE) + width + 0.4::DOUBLE AS x1,
  page_y_center * 800 - height / 2::DOUBLE + height AS y1 FROM {_O} WHERE width IS NOT NULL AND height IS NOT NULL AND page_y_center IS NOT NULL"""
_VECTOR = [
    "width / 1000::DOUBLE", "height / 1000::DOUBLE", "area / 1000000::DOUBLE", "log10(greatest(area, 1)) / 6::DOUBLE", "CASE WHEN region = 'body' THEN log10(greatest(area, 1)) / 6::DOUBLE ELSE 0 END", "aspect_ratio", "page_y_center",
    "CASE region WHEN 'header' THEN 0::DOUBLE WHEN 'footer' THEN 1::DOUBLE WHEN 'margin' THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END", "surrounding_text_density / 100::DOUBLE", "CAST(has_nearby_caption AS INTEGER)::DOUBLE",
    "brightness_mean / 255::DOUBLE", "brightness_std / 128::DOUBLE", "CAST(is_mostly_white AS INTEGER)::DOUBLE", "CAST(has_contrast AS INTEGER)::DOUBLE",
]
_WHOLE = " AND ".join(f"({v}) IS NOT NULL" for v in _VECTOR)
_ACCOUNT = f"""SELECT count(*) FILTER (ocr_performed AND u) AS ocr_useful, count(*) FILTER (ocr_performed AND NOT u) AS ocr_empty, count(*) FILTER (ocr_performed AND id % 10 = 0) AS skip_validation_ocrs,
  count(*) FILTER (ocr_performed AND id % 10 = 0 AND u) AS skip_validation_useful, count(*) FILTER (ocr_performed AND id % 5 = 0 AND id % 10 <> 0 AND u) AS exploration_useful,
  count(*) FILTER (ocr_performed AND id % 5 = 0 AND id % 10 <> 0 AND NOT u) AS exploration_empty FROM (SELECT *, coalesce(is_useful, FALSE) AS u FROM {_O})"""
_COUNTS = f"""SELECT count(*) AS total_records, count(*) FILTER (ocr_performed) AS ocrd_records, count(*) FILTER (ocr_performed AND is_useful) AS useful_records,
  round(count(*) FILTER (ocr_performed AND is_useful) / greatest(count(*) FILTER (ocr_performed), 1)::DOUBLE, 6) AS useful_rate FROM {_O}"""
_FILES = """SELECT count(*) AS processed_files, CAST(coalesce(sum(page_count), 0) AS BIGINT) AS total_pages, CAST(coalesce(sum(image_count), 0) AS BIGINT) AS total_images,
  count(quality_score) AS files_with_quality, count(*) FILTER (quality_score IS NOT NULL AND previous_quality_score IS NOT NULL) AS files_with_comparison, round(coalesce(avg(quality_score), 0), 6) AS avg_quality_score,
  count(*) FILTER (d > 0.02::DOUBLE) AS quality_improved, count(*) FILTER (d BETWEEN -0.02::DOUBLE AND 0.02::DOUBLE) AS quality_unchanged, count(*) FILTER (d < -0.02::DOUBLE) AS quality_regressed,
  round(coalesce(avg(d) FILTER (d > 0.02::DOUBLE), 0), 6) AS avg_improvement, round(coalesce(avg(d) FILTER (d < -0.02::DOUBLE), 0), 6) AS avg_regression
  FROM (SELECT *, CASE WHEN quality_score IS NOT NULL THEN quality_delta END AS d FROM (SELECT DISTINCT * FROM processed_files))"""
_EXPLORE = "CASE WHEN {n} < 30 THEN 0.5::DOUBLE ELSE greatest(0.05::DOUBLE, 0.5::DOUBLE * pow(0.5::DOUBLE, {n} / 200::DOUBLE)) END"
_LINES = """SELECT event_id, CASE WHEN event_type = 'error' THEN 'Traceback (most recent call last):' WHEN event_id % 3 = 0 THEN 'dated' ELSE 'at' END AS line,
  CASE WHEN event_type <> 'error' AND event_id % 3 = 0 THEN date_trunc('second', ts) END AS t FROM events"""

QUERIES = {
    "ref_p2_p3_geometry": geometry, "ref_p4_pixels": pixels, "ref_p5_vectors": vectors, "ref_p6_structs": structs, "ref_j6_j7_context": context, "ref_j8_rects": rects, "ref_n2_ordinals": ordinals,
    "ref_o2_a13_merge": merged, "ref_s9_s10_hybrid": hybrid_pages, "ref_t13_recognised": recognised, "ref_a2_bins": bins, "ref_p8_heuristics": heuristics, "ref_g1_g5_rates": rates, "ref_g6_decisions": decisions,
    "ref_g7_accounting": accounting, "ref_n3_n6_running": running, "ref_n5_recent": recent, "ref_a4_a7_counts": counts, "ref_a5_a6_files": files, "ref_g11_report": report,
    "ref_a17_training": training, "ref_g8_trained": trained, "ref_o4_o5_draws": drawn, "ref_a14_tracebacks": traceback_count, "ref_a15_freshness": fresh,
}
SQL = {
    "ref_p2_p3_geometry": f"""WITH b AS ({_BOX}), g AS (SELECT id, x0, x1, CAST(trunc(x1 - x0) AS INTEGER) AS width, CAST(trunc(y1 - y0) AS INTEGER) AS height, ((y0 + y1) / 2) / 800::DOUBLE AS yc, (x0 + x1) / 2 AS xc FROM b)
      SELECT id, width, height, CAST(width AS BIGINT) * height AS area, round(width / greatest(height, 1)::DOUBLE, 6) AS aspect_ratio, round(yc, 6) AS page_y_center,
        CASE WHEN yc < 0.12::DOUBLE THEN 'header' WHEN yc > 0.88::DOUBLE THEN 'footer' WHEN xc < 60 OR xc > 540 THEN 'margin' ELSE 'body' END AS region, width < 20 OR height < 10 AS tiny FROM g""",
    "ref_p4_pixels": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN list_transform(range(0, 64), lambda i: 250::DOUBLE) ELSE list_transform(range(0, 64), lambda i: ((p_partkey * (i + 3) * 7) % 256)::DOUBLE) END AS x FROM part),
      m AS (SELECT p_partkey, x, list_sum(x) / 64 AS mean FROM p), s AS (SELECT p_partkey, x, mean, sqrt(greatest(list_sum(list_transform(x, lambda v: v * v)) / 64 - mean * mean, 0)) AS sd FROM m)
      SELECT p_partkey, round(mean, 6) AS brightness_mean, round(sd, 6) AS brightness_std, len(list_filter(x, lambda v: v > 240)) / 64::DOUBLE > 0.95::DOUBLE AS is_mostly_white, sd > 30 AS has_contrast FROM s""",
    "ref_p5_vectors": f"SELECT id, {', '.join(f'CASE WHEN {_WHOLE} THEN round({v}, 9) END AS v{i}' for i, v in enumerate(_VECTOR))} FROM {_O}",
    "ref_p6_structs": f"SELECT id, {', '.join(f'round({c}, 6) AS {c}' if c in ('aspect_ratio', 'page_y_center', 'surrounding_text_density', 'brightness_mean', 'brightness_std') else c for c in fe.FEATURES)} FROM {_O}",
    "ref_j6_j7_context": """WITH p AS (SELECT DISTINCT page_id, path, page_num, page_text FROM extracted_pages WHERE page_text IS NOT NULL),
      l AS (SELECT path, page_num, unnest(string_split(page_text, chr(10))) AS content, generate_subscripts(string_split(page_text, chr(10)), 1) - 1 AS n FROM p), b AS (SELECT path, page_num, content, n * 20::DOUBLE AS y0, n * 20::DOUBLE + 18 AS y1 FROM l),
      i AS (SELECT path, page_num, page_id AS image_no, CAST(page_id % 600 AS DOUBLE) AS y0 FROM p)
      SELECT i.path, i.page_num, i.image_no, round(coalesce(sum(length(content)) FILTER (b.y0 < i.y0 + 130 AND b.y1 > i.y0 - 50), 0) / 54000::DOUBLE * 10000, 6) AS surrounding_text_density,
        coalesce(bool_or(b.y0 < i.y0 + 130 AND b.y1 > i.y0 - 50 AND b.y0 > i.y0 + 80 AND b.y0 < i.y0 + 110 AND length(content) < 200 AND regexp_matches(lower(content), 'figure|fig\\.|image|photo|chart|table')), FALSE) AS has_nearby_caption
      FROM i LEFT JOIN b USING (path, page_num) GROUP BY i.path, i.page_num, i.image_no""",
    "ref_o2_a13_merge": r"""WITH p AS (SELECT DISTINCT page_id, page_text FROM extracted_pages), l AS (SELECT page_id, unnest(string_split(page_text, chr(10))) AS t, generate_subscripts(string_split(page_text, chr(10)), 1) - 1 AS n FROM p),
      s AS (SELECT page_id, n, length(t) AS c, regexp_replace(t, '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g') AS t FROM l)
      SELECT page_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY (n * 11) % 7, n)) AS text_md5, count(*) FILTER (n % 4 = 3) AS ocr_regions, CAST(coalesce(sum(c) FILTER (n % 4 = 3), 0) AS BIGINT) AS ocr_chars FROM s WHERE t <> '' GROUP BY page_id""",
    "ref_s9_s10_hybrid": r"""WITH p AS (SELECT DISTINCT page_id AS i, path || '/' || page_id AS path, page_num, page_text FROM extracted_pages WHERE page_text IS NOT NULL),
      l AS (SELECT i, unnest(string_split(page_text, chr(10))) AS t, generate_subscripts(string_split(page_text, chr(10)), 1) - 1 AS n FROM p),
      b AS (SELECT i, n * 20 AS y, n, regexp_replace(t, '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g') AS t, FALSE AS o FROM l
        UNION ALL SELECT i, i % 600, 1000000, CASE WHEN i % 600 % 5 = 0 THEN '' ELSE 'image 0 at ' || (i % 600) END, TRUE FROM p
        UNION ALL SELECT i, i * 7 % 600, 1000002, 'image 1 at ' || (i * 7 % 600), TRUE FROM p WHERE i % 40 >= 20),
      g AS (SELECT i, string_agg(t, chr(10) || chr(10) ORDER BY y, n) AS t, count(*) FILTER (o) AS k, CAST(coalesce(sum(length(t)) FILTER (o), 0) AS BIGINT) AS c FROM b WHERE t <> '' GROUP BY i),
      f AS (SELECT p.path, p.page_num, coalesce(g.t, '') AS t, coalesce(g.k, 0) AS k, coalesce(g.c, 0) AS c, CAST(CASE WHEN p.i % 40 < 20 THEN 1 ELSE 0 END AS BIGINT) AS s FROM p LEFT JOIN g ON p.i = g.i)
      SELECT path, page_num, 'hybrid' AS strategy, md5(t) AS text_md5, k > 0 AS used_ocr, k AS ocr_regions, c AS ocr_chars, s AS skipped,
        concat_ws(', ', CASE WHEN k > 0 THEN '+' || k || ' imgs (+' || c || ' chars)' END, CASE WHEN s > 0 THEN 'skipped ' || s END) AS message FROM f""",
    "ref_t13_recognised": "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name || chr(10) || 'x' WHEN 1 THEN n_name WHEN 2 THEN n_name || chr(10) || 'y' ELSE '' END AS text FROM nation",
    "ref_j8_rects": f"""WITH o AS (SELECT pdf_path, page_num, {{'seq': image_index, 'id': id, 'x0': CAST((id * 13) % 200 AS DOUBLE), 'y0': CAST((id * 29) % 200 AS DOUBLE),
        'x1': (id * 13) % 200 + width / 4::DOUBLE, 'y1': (id * 29) % 200 + height / 4::DOUBLE}} AS r FROM {_O} WHERE width IS NOT NULL AND height IS NOT NULL),
      p AS (SELECT pdf_path, page_num, list([r] ORDER BY r) AS l FROM o GROUP BY pdf_path, page_num),
      k AS (SELECT pdf_path, page_num, len(l) AS images, list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda q: b[1].x0 < q.x1 AND b[1].x1 > q.x0 AND b[1].y0 < q.y1 AND b[1].y1 > q.y0
        AND (b[1].x1 - b[1].x0) * (b[1].y1 - b[1].y0) > 0 AND abs((b[1].x1 - b[1].x0) * (b[1].y1 - b[1].y0) - (q.x1 - q.x0) * (q.y1 - q.y0)) / greatest((b[1].x1 - b[1].x0) * (b[1].y1 - b[1].y0), 1::DOUBLE) < 0.5::DOUBLE)) > 0
        THEN a ELSE list_concat(a, b) END) AS kept FROM p)
      SELECT pdf_path, page_num, CAST(images AS INTEGER) AS images, CAST(len(kept) AS INTEGER) AS kept FROM k""",
    "ref_n2_ordinals": f"SELECT id, row_number() OVER (PARTITION BY pdf_path, page_num ORDER BY image_index, id) - 1 AS ordinal FROM {_O}",
    "ref_a2_bins": f"SELECT {_SIZE} AS size_bin, {_LIGHT} AS brightness_bin, region, count(*) AS samples FROM {_O} WHERE ocr_performed GROUP BY 1, 2, 3",
    "ref_p8_heuristics": f"SELECT id, {_HEURISTIC} AS reason FROM {_O}",
    "ref_g1_g5_rates": f"""WITH s AS (SELECT p_partkey AS id, p_partkey % 700 AS n, (p_partkey % 101) / 100::DOUBLE AS e, p_partkey % 40 AS rc, p_partkey % 60 AS tot, p_partkey % 7 AS us, p_partkey % 90 AS reg, (p_partkey * 31 % 100) / 100::DOUBLE AS p, (p_partkey * 7919 % 1000) / 1000::DOUBLE AS dr FROM part),
      r AS (SELECT *, {_EXPLORE.format(n='n')} AS b FROM s),
      a AS (SELECT *, CASE WHEN rc < 20 THEN b ELSE greatest(0.05::DOUBLE, least(0.5::DOUBLE, CASE WHEN e > 0.5::DOUBLE THEN greatest(0.35::DOUBLE, b + 0.3::DOUBLE) WHEN e > 0.3::DOUBLE THEN b + e * 0.5::DOUBLE ELSE b + e * 0.3::DOUBLE END)) END AS ad,
        CASE WHEN reg < 5 THEN 0.3::DOUBLE WHEN n + 1 < 30 THEN 0.15::DOUBLE ELSE least(0.3::DOUBLE, sqrt(2::DOUBLE * ln(n + 1) / reg)) END AS bo FROM r)
      SELECT id, round(b, 6) AS explore, round(ad, 6) AS adaptive, round(CASE WHEN tot < 20 THEN 0.1::DOUBLE WHEN us / tot::DOUBLE > 0.3::DOUBLE THEN least(0.5::DOUBLE, 0.3::DOUBLE + (us / tot::DOUBLE - 0.3::DOUBLE)) ELSE greatest(0.05::DOUBLE, least(0.5::DOUBLE, 0.1::DOUBLE * sqrt(us / tot::DOUBLE / 0.1::DOUBLE))) END, 6) AS validate,
        round(bo, 6) AS bonus, dr < (1 - abs(p - 0.5::DOUBLE) * 2) * ad * 4 + bo AS explores FROM a""",
    "ref_g6_decisions": f"""WITH c AS (SELECT {_SIZE} AS sb, {_LIGHT} AS lb, region AS rg, count(*) AS k FROM {_O} WHERE ocr_performed GROUP BY 1, 2, 3),
      o AS (SELECT id, {_HEURISTIC} AS h, CASE WHEN id % 11 <> 0 THEN (id * 31 % 100) / 100::DOUBLE END AS p, (id * 31) % 100 AS pc, (id * 7919 % 1000) / 1000::DOUBLE AS d1, (id * 104729 % 1000) / 1000::DOUBLE AS d2, coalesce(c.k, 0) AS k
        FROM {_O} x LEFT JOIN c ON c.sb = {_SIZE} AND c.lb = {_LIGHT} AND c.rg = x.region),
      r AS (SELECT *, 0.0625::DOUBLE AS b, least(0.5::DOUBLE, 0.0625::DOUBLE + 0.2::DOUBLE * 0.3::DOUBLE) AS ad, CASE WHEN k < 5 THEN 0.3::DOUBLE ELSE least(0.3::DOUBLE, sqrt(2::DOUBLE * ln(600::DOUBLE) / k)) END AS bo, 0.1::DOUBLE * sqrt(6 / 40::DOUBLE / 0.1::DOUBLE) AS v FROM o),
      f AS (SELECT *, p IS NULL AND d1 < b AS rnd, p IS NOT NULL AND d1 < (1 - abs(p - 0.5::DOUBLE) * 2) * ad * 4 + bo AS unc FROM r), g AS (SELECT *, p IS NOT NULL AND p < 0.15::DOUBLE AS lo FROM f)
      SELECT id, CASE WHEN rnd THEN TRUE WHEN p IS NULL THEN h = 'heuristic: worth trying' WHEN unc THEN TRUE ELSE NOT lo OR d2 < v END AS do_ocr,
        CASE WHEN rnd THEN 'exploration (6%)' WHEN p IS NULL THEN h WHEN unc THEN 'uncertainty exploration (p=' || pc || '%)' WHEN lo AND d2 < v THEN 'skip-validation (p=' || pc || '%, rate=12%)' ELSE 'classifier: ' || pc || '% useful' END AS reason,
        rnd OR unc OR (lo AND d2 < v) AS is_exploration, CASE WHEN p IS NOT NULL THEN round(pc / 100::DOUBLE, 6) END AS stated FROM g""",
    "ref_g7_accounting": _ACCOUNT,
    "ref_n3_n6_running": f"""WITH o AS (SELECT id, recorded_at, ocr_performed, {_SIZE} AS s, {_LIGHT} AS l, region AS g FROM (SELECT DISTINCT id, recorded_at, ocr_performed, area, brightness_mean, region FROM ocr_outcomes WHERE recorded_at IS NOT NULL)),
      w AS (SELECT id, CAST(sum(ocr_performed::INTEGER) OVER (ORDER BY recorded_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_samples, CAST(sum(ocr_performed::INTEGER) OVER (PARTITION BY s, l, g ORDER BY recorded_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS region_samples FROM o)
      SELECT *, total_samples // 100 AS model_version FROM w""",
    "ref_n5_recent": f"""WITH o AS (SELECT id, recorded_at, CASE WHEN ((id * 31 % 100) / 100::DOUBLE < 0.5::DOUBLE) = is_useful THEN 1 ELSE 0 END AS e FROM {_O} WHERE recorded_at IS NOT NULL AND ocr_performed AND is_useful IS NOT NULL),
      w AS (SELECT id, count(*) OVER s AS recent_count, sum(e) OVER s AS x FROM o WINDOW s AS (ORDER BY recorded_at, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
      SELECT id, recent_count, CASE WHEN recent_count >= 20 THEN round(x / recent_count::DOUBLE, 6) END AS recent_error FROM w""",
    "ref_a4_a7_counts": _COUNTS,
    "ref_a5_a6_files": _FILES,
    "ref_g11_report": f"""WITH c AS ({_COUNTS}), f AS ({_FILES}), a AS ({_ACCOUNT})
      SELECT c.*, round({_EXPLORE.format(n='ocrd_records')}, 6) AS exploration_rate, f.*, a.*, round(1 - exploration_useful / nullif(exploration_useful + exploration_empty, 0)::DOUBLE, 6) AS skip_accuracy,
        round(skip_validation_useful / nullif(skip_validation_ocrs, 0)::DOUBLE, 6) AS skip_validation_error_rate FROM c, f, a""",
    "ref_a17_training": f"""WITH r AS (SELECT CAST(is_useful AS INTEGER)::DOUBLE AS label FROM {_O} WHERE ocr_performed AND is_useful IS NOT NULL AND {_WHOLE})
      SELECT label, count(*) AS rows, round((SELECT count(*) FROM r) / (2::DOUBLE * count(*)), 6) AS weight FROM r GROUP BY label""",
    "ref_o4_o5_draws": f"SELECT id, round((id * 7919 % 1000) / 1000::DOUBLE, 6) AS draw, (id * 7919 % 1000) / 1000::DOUBLE < 0.1::DOUBLE AS taken FROM {_O} ORDER BY draw, id",
    "ref_a14_tracebacks": f"""WITH l AS ({_LINES}), c AS (SELECT line, last_value(t IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS lt FROM l)
      SELECT count(*) AS tracebacks, count(*) FILTER (lt >= TIMESTAMP '2024-01-15 00:00:00') AS recent FROM c WHERE line LIKE 'Traceback%'""",
    "ref_a15_freshness": f"""WITH m AS (SELECT max(t) AS t FROM ({_LINES})) SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS last_ts, CAST(trunc(date_diff('second', t, TIMESTAMP '2025-06-01 00:00:00') / 3600) AS BIGINT) AS age_hours,
      trunc(date_diff('second', t, TIMESTAMP '2025-06-01 00:00:00') / 3600) > 72 AS warn FROM m""",
}
