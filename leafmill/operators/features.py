"""Image features, page layout and the merge of text and recognised blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.markdown import join_blocks, strip

# Search margin and depth below an image in page units, longest caption, and caption words.
MARGIN, BELOW, CAPTION_LENGTH = 50, 30, 200
CAPTION_WORDS = ("figure", "fig.", "image", "photo", "chart", "table")
# Numbers of the regions in a feature vector, and of any other one.
REGION_CODES = {"header": 0.0, "body": 0.5, "footer": 1.0, "margin": 0.25}
OTHER_REGION = 0.5
FEATURES = (
    "width", "height", "area", "aspect_ratio", "page_y_center", "region", "surrounding_text_density", "has_nearby_caption",
    "brightness_mean", "brightness_std", "is_mostly_white", "has_contrast",
)


def geometry(df: DataFrame) -> DataFrame:
    """Adds width, height, area, aspect_ratio, page_y_center and region to boxes on pages.

    Input columns: x0, y0, x1, y1, page_width, page_height. Sizes are cut to whole units.
    """
    df = df.withColumns({"width": (F.col("x1") - F.col("x0")).cast("int"), "height": (F.col("y1") - F.col("y0")).cast("int")})
    y = ((F.col("y0") + F.col("y1")) / 2) / F.greatest("page_height", F.lit(1))
    df = df.withColumns(
        {
            "area": F.col("width").cast("long") * F.col("height"),
            "aspect_ratio": F.col("width") / F.greatest("height", F.lit(1)),
            "page_y_center": y,
        }
    )
    return df.withColumn("region", region(F.col("page_y_center"), (F.col("x0") + F.col("x1")) / 2, F.col("page_width")))


def region(y_center: Column, x_center: Column, page_width: Column) -> Column:
    """Part of the page in which an image lies; the first rule that holds counts."""
    aside = (x_center < page_width * 0.1) | (x_center > page_width * 0.9)
    return F.when(y_center < 0.12, "header").when(y_center > 0.88, "footer").when(aside, "margin").otherwise("body")


def pixel_stats(pixels: Column) -> Column:
    """Mean and deviation of grey values, whether nearly all are white, and whether they differ enough."""
    n = F.size(pixels)
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x.cast("double") * x) / n
    deviation = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    white = F.size(F.filter(pixels, lambda x: x > 240)) / n
    return F.when(
        n > 0,
        F.struct(
            mean.alias("brightness_mean"), deviation.alias("brightness_std"), (white > 0.95).alias("is_mostly_white"), (deviation > 30).alias("has_contrast")
        ),
    )


def vector() -> Column:
    """The 14 numbers a classifier sees of the feature columns; a missing one makes no vector."""
    area = F.greatest(F.col("area"), F.lit(1))
    log_area = F.log10(area) / 6.0
    code = F.lit(OTHER_REGION)
    for name, value in REGION_CODES.items():
        code = F.when(F.col("region") == name, value).otherwise(code)
    body = F.when(F.col("region") == "body", F.log10(area) / 6.0).otherwise(0.0)
    parts = [
        F.col("width") / 1000.0, F.col("height") / 1000.0, F.col("area") / 1000000.0, log_area, body, F.col("aspect_ratio"), F.col("page_y_center"),
        code, F.col("surrounding_text_density") / 100.0, F.col("has_nearby_caption").cast("double"), F.col("brightness_mean") / 255.0,
        F.col("brightness_std") / 128.0, F.col("is_mostly_white").cast("double"), F.col("has_contrast").cast("double"),
    ]
    whole = F.array(*[p.cast("double") for p in parts])
    return F.when(~F.exists(whole, lambda x: x.isNull()), whole)


def as_struct() -> Column:
    return F.struct(*FEATURES)


def is_tiny(width: Column, height: Column) -> Column:
    """Too small to be worth rendering."""
    return (width < 20) | (height < 10)


def text_context(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds surrounding_text_density and has_nearby_caption to images ``(path, page_num, image_no, x0..y1)``.

    Text blocks ``(path, page_num, x0..y1, content)`` count if they overlap the image's box widened by the margin.
    Images and blocks meet on their page, so the comparison stays within a page.
    """
    b = blocks.select("path", "page_num", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")], "content")
    j = images.join(b, ["path", "page_num"], "left")
    near = (
        (F.col("bx0") < F.col("x1") + MARGIN) & (F.col("bx1") > F.col("x0") - MARGIN)
        & (F.col("by0") < F.col("y1") + MARGIN) & (F.col("by1") > F.col("y0") - MARGIN)
    )
    low = F.lower("content")
    worded = F.lit(False)
    for w in CAPTION_WORDS:
        worded = worded | low.contains(w)
    below = (F.col("by0") > F.col("y1")) & (F.col("by0") < F.col("y1") + BELOW) & (F.length("content") < CAPTION_LENGTH) & worded
    sums = j.groupBy(*images.columns).agg(
        F.coalesce(F.sum(F.when(near, F.length("content"))), F.lit(0)).alias("_chars"),
        F.coalesce(F.bool_or(near & below), F.lit(False)).alias("has_nearby_caption"),
    )
    searched = (F.col("x1") - F.col("x0") + 2 * MARGIN) * (F.col("y1") - F.col("y0") + 2 * MARGIN)
    return sums.withColumn("surrounding_text_density", F.col("_chars") / F.greatest(searched, F.lit(1)) * 10000).drop("_chars")


def distinct_rects(rects: Column, accepted: Column | None = None) -> Column:
    """Rectangles in order without those that intersect an accepted one of similar area; all of ``accepted`` come first."""

    def area(r: Column) -> Column:
        return (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])

    def taken(accepted: Column, r: Column) -> Column:
        def same(p: Column) -> Column:
            meets = (r["x0"] < p["x1"]) & (r["x1"] > p["x0"]) & (r["y0"] < p["y1"]) & (r["y1"] > p["y0"])
            return meets & (area(r) > 0) & (F.abs(area(r) - area(p)) / F.greatest(area(r), F.lit(1.0)) < 0.5)

        return F.exists(accepted, same)

    start = F.slice(rects, 1, 0) if accepted is None else accepted
    return F.aggregate(rects, start, lambda acc, r: F.when(taken(acc, r), acc).otherwise(F.concat(acc, F.array(r))))


def merge_page(blocks: DataFrame, *keys: str) -> DataFrame:
    """Text of pages from blocks ``(y0, seq, text, recognised)``: top to bottom, in order where heights are equal."""
    kept = blocks.where(strip(F.coalesce("text", F.lit(""))) != "")
    grouped = kept.groupBy(*keys).agg(
        F.collect_list(F.struct("y0", "seq", "text")).alias("_blocks"),
        F.count_if("recognised").alias("ocr_regions"),
        F.coalesce(F.sum(F.when(F.col("recognised"), F.length("text"))), F.lit(0)).cast("long").alias("ocr_chars"),
    )
    return grouped.withColumn("page_text", join_blocks(F.col("_blocks"))).drop("_blocks")
