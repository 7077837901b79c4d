import unicodedata

from leafmill.llm import lookalike as lo


def by_hand(text):
    table = {ord(c): to for c, to in lo.char_map().items()}
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(table)).translate(table))


TEXTS = [
    "plain", "ｐｌａｉｎ", "pla​in", "plаin", "résumé", "résumé", "ﬁrst ㎜", "first mm", "Ậ", "Ậ", "Ậ", "m²", "m2", "a\nb", "a b", "a  b", "a　b",
    "co‑op", "co-op", "co–op", "отчёт", "отчёт", "", None, "​‍", "é" * 5000 + "é" * 5000, "q̣̇", "q̣̇", "Case", "case", "😀 x", "́a",
    "한국어", "\u1112\u1161\u11ab\u1100\u116e\u11a8\u110b\u1165", "하\u11ab국어", "ㄱㅏ", "가", "e" + "\u0301\u0323" * 100, "e" + "\u0323\u0301" * 100,
]


def test_forms(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "id long, text string, k string")
    got = {r.id: r.form for r in lo.one_form(df).collect()}
    for i, t in enumerate(TEXTS):
        if t is None:
            assert got[i] is None
        elif t != "​‍":  # nothing is left of it
            assert got[i] == by_hand(t), ascii(t)[:60]


def test_pairs(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS) if t is not None] + [(0, "plain", 1), (500, "plain", 1)]
    df = spark.createDataFrame(rows, "page_id long, page_text string, h int")
    got = {tuple(r) for r in lo.same_looks(df).collect()}
    unique = {i: t for i, t, _ in rows if t}
    want = {(a, b) for a in unique for b in unique if a < b and unique[a] != unique[b] and by_hand(unique[a]) == by_hand(unique[b])}
    assert got == want
    assert lo.same_looks(df.where("false")).count() == 0


def test_pages_readable(spark):
    rows = [(1, "Отчёт и чертёж о том"), (2, "Oтчёт и чepтёж o тoм"), (3, "ｎｏｔｅ"), (4, None), (5, ""), (6, "same"), (6, "same"), (7, "​")]
    df = spark.createDataFrame(rows, "page_id long, page_text string")
    got = {r.page_id: (r.form, r.changed) for r in lo.normalized_pages(df).collect()}
    assert got[1] == ("Отчёт и чертёж о том", False)
    assert got[2][0] == got[1][0] and got[2][1]
    assert got[3] == ("note", True) and got[4] == (None, False) and got[5] == ("", False) and got[6] == ("same", False) and got[7] == ("", True)
