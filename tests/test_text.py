import math
import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import markdown as md
from leafmill.functions import strings as st
from leafmill.functions import text_quality as tq


def expected(text):
    """The score by its definition, one text at a time."""
    if not text or not text.strip():
        return (0.0,) * 5 + (0,)
    words = re.findall(r"\b[a-zA-Z]+\b", text.lower())
    n = len(words)
    if not n:
        return (0.0,) * 5 + (0,)
    cluster = "[bcdfghjklmnpqrstvwxz]{5,}"
    odd = sum(len(re.findall(p, text, f)) for p, f in (
        (r"(.)\1{3,}", 0), (cluster, re.I), (rf"\b{cluster}\b", re.I), ("â€|Ã©|Ã¨|Ã |ï»¿|\ufffd|\\\\x[0-9a-f]{2}", re.I), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", 0)
    ))
    real, content = sum(w in tq.COMMON_WORDS for w in words) / n, min(1.0, math.log10(n + 1) / 4)
    gib, punct = min(1.0, odd / max(n / 10, 1)), min(1.0, len(re.findall("[.!?]", text)) / (n / 15))
    return real, content, gib, punct, max(0.0, min(1.0, real * 0.35 + content * 0.3 - gib * 0.2 + punct * 0.15)), n


TEXTS = [
    None, "", "   \u00a0\u2003", "hello", "x" * 10000, "abc " * 500, "word " * 50000, "!!! ??? ...", "The quick test. It is good!", "bcdfgh strngthz aaaa bbbbbb",
    "cafÃ© naÃ¨ve â€ text Ã b \\x41 \ufffd", "a\x00b\x07 c\x7f\x85", "été e\u0301te\u0301 über straße", "line\r\n\u2028two\n\n three", "日本語 テキスト", "İstanbul KELVIN \u212a \u017fs",
]


def test_score_by_definition(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for row in tq.with_quality(df, "text").collect():
        want = expected(TEXTS[row.i])
        got = [row[m] for m in tq.METRICS]
        assert got == pytest.approx(want, abs=1e-12), TEXTS[row.i]
        assert 0 <= row.total_score <= 1


def test_common_words():
    assert len(tq.COMMON_WORDS) == len(set(tq.COMMON_WORDS)) == 239


def test_delta_classes(spark):
    deltas = [-0.5, -0.1, -0.02, -0.01, 0.0, 0.01, 0.02, 0.1, 0.5, None]
    df = spark.createDataFrame([(d,) for d in deltas], "d double")
    got = [r[0] for r in df.select(tq.delta_class(F.col("d"))).collect()]
    assert got == ["regressed"] * 2 + ["unchanged"] * 5 + ["improved"] * 2 + [None]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_markdown(spark):
    pages = F.array(F.lit("one"), F.lit("two"))
    text = one(spark, md.create_markdown(F.lit("/a/b.c.pdf"), pages, F.lit("Page")))
    assert text == "# b.c\n\n> Source: /a/b.c.pdf\n\n---\n\none\n\n---\n*Page 2*\ntwo"
    assert one(spark, md.strip_metadata(F.lit(text))) == "\n\n\none\n\ntwo"
    assert one(spark, md.strip_metadata(F.lit("*Section 2*\n  # x\n---\n keep "))) == "*Section 2*\n keep "
    assert one(spark, md.table_markdown(F.array(F.array(F.lit(" a|b "), F.lit("c")), F.array(F.lit("1"), F.lit("2"))))) == "| a\\|b | c |\n| --- | --- |\n| 1 | 2 |"
    assert one(spark, md.heading(F.lit("Heading 3"), F.lit("t"))) == "### t"
    assert one(spark, md.heading(F.lit("Heading"), F.lit("t"))) == "# t"
    assert one(spark, md.heading(F.lit("Normal"), F.lit("t"))) == "t"
    assert [one(spark, md.stem(F.lit(p))) for p in ("/a/.x", "b.tar.gz", "c")] == [".x", "b.tar", "c"]
    assert one(spark, md.page_label(F.lit("x.PDF"))) == "Page"


def test_strings(spark):
    assert one(spark, st.convert_windows_path(F.lit("C:\\a\\b.pdf"))) == "/mnt/c/a/b.pdf"
    assert one(spark, st.convert_windows_path(F.lit("/x/y"))) == "/x/y"
    assert one(spark, st.truncate_path(F.lit("abcdefghij"), 6)) == "...hij"
    assert one(spark, st.word_count(F.lit(" a\u00a0b\n c "))) == 3
    assert one(spark, st.temp_pattern(F.lit("A.TMP"))) == "*.tmp"
    assert one(spark, st.temp_pattern(F.lit("a.pdf"))) is None
    assert [one(spark, st.percent(F.lit(p))) for p in (0.005, 0.015, 0.125, 0.5)] == [0, 2, 12, 50]
    assert one(spark, st.reason_probability(F.lit("skip-validation (p=12%, rate=10%)"))) == 0.12
    assert one(spark, st.reason_probability(F.lit("heuristic: tiny image"))) is None
    assert one(spark, st.recognised_text(F.lit('{"rec_texts": ["a", "", null, "b"]}'))) == "a\nb"
    assert one(spark, st.recognised_text(F.lit('[[[[0,0],["a",0.9]],[[1,1],["b",0.8]]]]'))) == "a\nb"
    assert one(spark, st.recognised_text(F.lit("broken"))) == ""
