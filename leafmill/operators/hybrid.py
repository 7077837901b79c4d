"""Pages from text blocks and recognised images: layout rows in, page texts with counters out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.markdown import strip
from leafmill.operators import features as fe
from leafmill.operators.status import page_strategy
from leafmill.session import stage

#: A row for each text block, image block and listed image of a page; ``kind`` is text, image or listed (or page, for its size). Pixels are grey values.
LAYOUT = (
    "path string, page_num int, seq int, kind string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, content string, pixels array<int>"
)
#: Resolution at which images are rendered, in dots an inch; layout units are 72 an inch.
DPI = 300
_PAGE = ("path", "page_num")
_RECT = ("x0", "y0", "x1", "y1")


def page_images(layout: DataFrame) -> DataFrame:
    """One row per image of a page with its ordinal ``image_no``.

    Image blocks count all; a listed image counts unless it meets one accepted before it of similar area. A page's
    rectangles are folded in order; they belong to one page, so the list is short.
    """
    rect = F.struct("seq", *_RECT, "page_width", "page_height", "pixels")
    lists = layout.where("kind <> 'text'").groupBy(*_PAGE).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == k, rect))).alias(k) for k in ("image", "listed")]
    )
    kept = lists.select(*_PAGE, F.posexplode(fe.distinct_rects(F.col("listed"), F.col("image"))).alias("image_no", "r"))
    return kept.select(*_PAGE, "image_no", "r.*")


def image_features(images: DataFrame, layout: DataFrame) -> DataFrame:
    """Images with geometry, text nearby and pixel figures; pixels that are missing leave the figures null."""
    texts = layout.where("kind = 'text'").select(*_PAGE, *_RECT, "content")
    near = fe.text_context(images.select(*_PAGE, "image_no", *_RECT), texts).select(*_PAGE, "image_no", "surrounding_text_density", "has_nearby_caption")
    stats = fe.geometry(images).withColumn("_p", fe.pixel_stats(F.col("pixels"))).select("*", "_p.*").drop("_p", "pixels")
    return stats.join(near, [*_PAGE, "image_no"])


def rendered_tiny(dpi: int = DPI) -> Column:
    """An image too small to be recognised once it is rendered."""
    return fe.is_tiny((F.col("x1") - F.col("x0")) * dpi / 72, (F.col("y1") - F.col("y0")) * dpi / 72)


def recognise(regions: DataFrame, make_engine: Callable[[], Callable[[dict], str]]) -> DataFrame:
    """``(path, page_num, image_no, text, error)`` of regions ``(path, page_num, image_no, x0..y1)``.

    ``make_engine`` is called once in each worker and returns ``recognise(region) -> text``, so a model is loaded once. A region
    that fails is a row with its error.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = None
        for frame in frames:
            texts, errors = [], []
            for region in frame.to_dict("records"):
                try:
                    engine = engine or make_engine()
                    text, error = engine(region), None
                except Exception as failure:
                    text, error = None, f"{type(failure).__name__}: {failure}"
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"path": frame["path"], "page_num": frame["page_num"], "image_no": frame["image_no"], "text": texts, "error": errors})

    return regions.select(*_PAGE, "image_no", *_RECT).mapInPandas(run, "path string, page_num int, image_no int, text string, error string")


def extract_pages(
    pages: DataFrame, layout: DataFrame, make_engine: Callable[[], Callable[[dict], str]], engine: str | None, force: bool = False,
    decide: Callable[[DataFrame], DataFrame] | None = None, dpi: int = DPI,
) -> tuple[DataFrame, DataFrame]:
    """Texts of pages ``(path, page_num, page_width, page_height)`` and the outcomes of their images.

    Pages: ``(path, page_num, strategy, page_text, used_ocr, ocr_regions, ocr_chars, skipped, message)``. Without an engine the
    text blocks make the text, with force the page is recognised as a whole, and with images text and recognised regions
    are merged from top to bottom. ``decide`` adds ``do_ocr`` and ``reason`` to image features; without it every image is recognised. Tiny
    images are skipped. Outcomes: the features with ``ocr_performed``, ``text`` and ``reason``. A failed region is left out;
    a page that fails as a whole falls back to its text blocks and says so. Empty pages have an empty text.
    """
    counts = layout.where("kind <> 'text'").groupBy(*_PAGE).agg(F.count("*").alias("_images"))
    planned = pages.join(counts, list(_PAGE), "left").withColumn(
        "strategy", page_strategy(F.lit(force), F.coalesce("_images", F.lit(0)), F.lit(engine).cast("string"))
    )
    own = layout.where("kind = 'text'").select(*_PAGE, "y0", "seq", F.col("content").alias("text"), F.lit(False).alias("recognised"))
    empty = F.lit(None).cast("string")
    if force:
        whole = planned.select(*_PAGE, F.lit(-1).alias("image_no"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("page_width").alias("x1"), F.col("page_height").alias("y1"))
        found = recognise(whole, make_engine).select(*_PAGE, "text", F.col("error").alias("failed"))
        plain = fe.merge_page(own, *_PAGE).select(*_PAGE, F.col("page_text").alias("plain"))
        j = planned.join(found, list(_PAGE), "left").join(plain, list(_PAGE), "left")
        good = F.col("failed").isNull()
        text = F.when(good, F.coalesce("text", F.lit(""))).otherwise(F.coalesce("plain", F.lit("")))
        chars = F.when(good, F.length(text)).otherwise(0).cast("long")
        note = F.when(good, F.concat(F.lit("OCR +"), F.format_number(chars, 0), F.lit(f" chars ({engine})"))).otherwise(F.concat(F.lit("FAILED - "), F.col("failed")))
        done = j.select(*_PAGE, "strategy", text.alias("page_text"), good.alias("used_ocr"), F.lit(0).cast("long").alias("ocr_regions"), chars.alias("ocr_chars"), F.lit(0).cast("long").alias("skipped"), note.alias("message"))
        return done, _outcomes(image_features(page_images(layout.where("false")), layout), empty)
    images = page_images(layout.join(planned.where("strategy = 'hybrid'").select(*_PAGE), list(_PAGE), "left_semi"))
    seen = image_features(images, layout).join(images.select(*_PAGE, "image_no", "seq", *_RECT), [*_PAGE, "image_no", "seq", *_RECT])
    judged = seen.withColumn("_tiny", rendered_tiny(dpi))
    judged = (decide(judged) if decide else judged.withColumns({"do_ocr": F.lit(True), "reason": empty})).withColumn("_do", F.col("do_ocr") & ~F.col("_tiny"))
    texts = recognise(judged.where("_do"), make_engine)
    outcomes = judged.join(texts, [*_PAGE, "image_no"], "left")
    blocks = own.unionByName(outcomes.where("_do AND error IS NULL").select(*_PAGE, "y0", "seq", "text", F.lit(True).alias("recognised")))
    merged = fe.merge_page(blocks, *_PAGE)
    skips = judged.groupBy(*_PAGE).agg(F.count_if(~F.col("_do")).alias("skipped"))
    j = planned.join(merged, list(_PAGE), "left").join(skips, list(_PAGE), "left")
    n, c, s = (F.coalesce(x, F.lit(0)).cast("long") for x in ("ocr_regions", "ocr_chars", "skipped"))
    parts = F.array_compact(F.array(F.when(n > 0, F.concat(F.lit("+"), n.cast("string"), F.lit(" imgs (+"), F.format_number(c, 0), F.lit(" chars)"))), F.when(s > 0, F.concat(F.lit("skipped "), s.cast("string")))))
    done = j.select(
        *_PAGE, "strategy", F.coalesce("page_text", F.lit("")).alias("page_text"), (n > 0).alias("used_ocr"), n.alias("ocr_regions"), c.alias("ocr_chars"), s.alias("skipped"),
        F.array_join(parts, ", ").alias("message"),
    )
    return done, _outcomes(outcomes.withColumn("ocr_performed", F.col("_do")), F.col("text"))


@dataclass(frozen=True)
class Recognition:
    """How pages of PDF files are recognised: what makes an engine, its name, and what reads the layout and decides on images."""

    make_engine: Callable[[], Callable[[dict], str]]
    engine: str | None
    force: bool = False
    reader: Callable[[bytes], list[tuple]] | None = None
    decide: Callable[[DataFrame], DataFrame] | None = None


def recognised_pages(files: DataFrame, how: Recognition) -> tuple[DataFrame, DataFrame]:
    """``(path, page_num, page_text, used_ocr, ocr_chars, error)`` of files ``(path, content)``, and the outcomes of their images.

    A file that cannot be read has one row with its error.
    """
    layout = stage(read_layout(files, how.reader or pdf_layout), "layout")
    pages = layout.where("kind = 'page'").select(*_PAGE, "page_width", "page_height")
    done, outcomes = extract_pages(pages, layout.where("kind IN ('text', 'image', 'listed')"), how.make_engine, how.engine, how.force, how.decide)
    good = done.select(*_PAGE, "page_text", "used_ocr", "ocr_chars", F.lit(None).cast("string").alias("error"))
    bad = layout.where("kind = 'error'").select("path", F.lit(0).alias("page_num"), F.lit("").alias("page_text"), F.lit(False).alias("used_ocr"), F.lit(0).cast("long").alias("ocr_chars"), F.col("content").alias("error"))
    return good.unionByName(bad), outcomes


def _outcomes(rows: DataFrame, text: Column) -> DataFrame:
    """What the learner records of each image."""
    for name, kind in (("ocr_performed", "boolean"), ("reason", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    length = F.coalesce(F.length(strip(F.coalesce(text, F.lit("")))), F.lit(0))
    return rows.select(*_PAGE, "image_no", *fe.FEATURES, "ocr_performed", "reason", length.alias("text_length"), F.coalesce(text, F.lit("")).alias("text"))


def pdf_layout(content: bytes) -> list[tuple]:
    """Layout rows of a PDF (without path), by a reader that is not part of this library; raises without it.

    Every page has a row of kind ``page`` with its size, so that empty pages are kept.
    """
    try:
        import pymupdf
    except ImportError as missing:
        raise RuntimeError("no PDF reader is installed") from missing
    rows = []
    with pymupdf.open(stream=content, filetype="pdf") as document:
        for number, page in enumerate(document, 1):
            size = (float(page.rect.width), float(page.rect.height))
            rows.append((number, -1, "page", 0.0, 0.0, *size, *size, "", None))
            seq = 0
            for x0, y0, x1, y1, text, _, kind in page.get_text("blocks"):
                rows.append((number, seq, "image" if kind else "text", x0, y0, x1, y1, *size, "" if kind else text, None))
                seq += 1
            for image in page.get_images(full=True):
                for r in page.get_image_rects(image[0]):
                    rows.append((number, seq, "listed", r.x0, r.y0, r.x1, r.y1, *size, "", None))
                    seq += 1
    return rows


def read_layout(files: DataFrame, reader: Callable[[bytes], list[tuple]] = pdf_layout) -> DataFrame:
    """Layout rows of files ``(path, content)``; a file that cannot be read has one row of kind ``error`` with its error as content."""
    names = [x.split()[0] for x in LAYOUT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows = [(path, *r) for r in reader(bytes(content))]
                except Exception as error:
                    rows = [(path, 0, 0, "error", *[0.0] * 6, f"{type(error).__name__}: {error}", None)]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, LAYOUT)
