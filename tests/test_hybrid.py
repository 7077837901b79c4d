from pyspark.sql import functions as F

from leafmill.operators import hybrid as hy

PAGES = "path string, page_num int, page_width double, page_height double"


def row(page, seq, kind, x0, y0, x1, y1, content="", pixels=None):
    return ("a", page, seq, kind, x0, y0, x1, y1, 600.0, 800.0, content, pixels)


LAYOUT = [
    row(1, 0, "text", 50.0, 300.0, 500.0, 320.0, " below "), row(1, 1, "text", 50.0, 10.0, 500.0, 30.0, "top"), row(1, 2, "text", 50.0, 40.0, 500.0, 60.0, "  "),
    row(1, 3, "image", 60.0, 100.0, 260.0, 200.0, pixels=[0, 255, 255]), row(1, 4, "image", 60.0, 100.0, 260.0, 200.0),
    row(1, 5, "listed", 61.0, 101.0, 260.0, 200.0), row(1, 6, "listed", 300.0, 100.0, 400.0, 200.0), row(1, 7, "listed", 301.0, 100.0, 400.0, 200.0),
    row(1, 8, "listed", 500.0, 500.0, 503.0, 503.0), row(2, 0, "text", 0.0, 0.0, 9.0, 9.0, "only text"), row(3, 0, "image", 0.0, 0.0, 90.0, 90.0),
]


def engine():
    def read(region):
        if region["page_num"] == 3:
            raise ValueError("unreadable")
        return f"image {region['image_no']}\n"

    return read


def run(spark, **options):
    pages = spark.createDataFrame([("a", n, 600.0, 800.0) for n in (1, 2, 3, 4)], PAGES)
    done, outcomes = hy.extract_pages(pages, spark.createDataFrame(LAYOUT, hy.LAYOUT), engine, **options)
    return {r.page_num: r for r in done.collect()}, {(r.page_num, r.image_no): r for r in outcomes.collect()}


def test_hybrid(spark):
    pages, outcomes = run(spark, engine="paddle")
    one = pages[1]
    assert one.page_text == "top\n\nimage 0\n\nimage 1\n\nimage 2\n\nbelow"
    assert (one.strategy, one.used_ocr, one.ocr_regions, one.ocr_chars, one.skipped) == ("hybrid", True, 3, 24, 1) and one.message == "+3 imgs (+24 chars), skipped 1"
    assert (pages[2].strategy, pages[2].page_text, pages[2].message) == ("text", "only text", "")
    assert (pages[3].strategy, pages[3].page_text, pages[3].ocr_regions, pages[3].skipped) == ("hybrid", "", 0, 0)
    assert pages[4].page_text == "" and len(pages) == 4
    assert {k: v.ocr_performed for k, v in outcomes.items()} == {(1, 0): True, (1, 1): True, (1, 2): True, (1, 3): False, (3, 0): True}
    assert outcomes[1, 0].text_length == 7 and outcomes[1, 0].brightness_mean == 170.0 and outcomes[1, 1].brightness_mean is None


def test_decisions_skip_images(spark):
    pages, outcomes = run(spark, engine="surya", decide=lambda df: df.withColumns({"do_ocr": F.col("image_no") == 2, "reason": F.lit("why")}))
    assert pages[1].page_text == "top\n\nimage 2\n\nbelow" and pages[1].skipped == 3 and outcomes[1, 0].reason == "why"


def test_full_and_none(spark):
    pages, _ = run(spark, engine="paddle", force=True)
    assert {r.strategy for r in pages.values()} == {"full"} and pages[1].message == "OCR +9 chars (paddle)" and pages[4].ocr_chars == 9
    assert not pages[3].used_ocr and pages[3].message.startswith("FAILED - ValueError")
    pages, outcomes = run(spark, engine=None)
    assert {r.strategy for r in pages.values()} == {"text"} and pages[1].page_text == "top\n\nbelow" and not outcomes


def test_layout_reader(spark):
    files = spark.createDataFrame([("x.pdf", b"1"), ("y.pdf", b"2")], "path string, content binary")

    def reader(content):
        if content == b"2":
            raise ValueError("broken")
        return [(1, 0, "text", 0.0, 0.0, 1.0, 1.0, 6.0, 8.0, "t", None)]

    rows = {r.path: r for r in hy.read_layout(files, reader).collect()}
    assert rows["x.pdf"].content == "t" and rows["y.pdf"].kind == "error" and "broken" in rows["y.pdf"].content
    assert hy.read_layout(files).first().kind == "error"


def test_documents_with_recognition(spark):
    from leafmill.sources import documents as src

    def reader(content):
        if content == b"broken":
            raise ValueError("no PDF")
        size = (600.0, 800.0)
        return [
            (1, -1, "page", 0.0, 0.0, 600.0, 800.0, *size, "", None), (1, 0, "text", 0.0, 50.0, 9.0, 60.0, *size, "text", None),
            (1, 1, "image", 0.0, 90.0, 100.0, 190.0, *size, "", None), (2, -1, "page", 0.0, 0.0, 600.0, 800.0, *size, "", None),
        ]

    files = spark.createDataFrame([("/a.pdf", b"x"), ("/b.PDF", b"broken"), ("/c.txt", b"t")], "path string, content binary")
    rows = {r.path: r for r in src.documents(files, recognition=hy.Recognition(engine, "paddle", reader=reader)).collect()}
    assert rows["/a.pdf"].pages == ["text\n\nimage 0", ""] and (rows["/a.pdf"].ocr_pages, rows["/a.pdf"].ocr_chars) == (1, 8) and "*Page 2*" in rows["/a.pdf"].markdown
    assert rows["/b.PDF"].error == "ValueError: no PDF" and rows["/c.txt"].error.startswith("ValueError: Unsupported")


def test_recognition_options():
    import pytest

    from leafmill import cli

    assert cli.recognition("", "paddle", False, False) is None and cli.recognition("tests.test_hybrid:engine", "paddle", True, False) is None
    assert cli.recognition("tests.test_hybrid:engine", "surya", False, True).force
    for bad in ("missing_module:f", "tests.test_hybrid:nothing"):
        with pytest.raises(ValueError):
            cli.recognition(bad, "paddle", False, False)
    with pytest.raises(ValueError):
        cli.recognition("", "paddle", False, True)
    assert cli.main(["convert", "/nowhere", "--force-ocr"]) == 1
