import pytest

from leafmill.llm import scans as sc

NATIVE = (
    "The surveyor inspected the warehouse. The treasurer said that the ledger may be read again. According to the council, "
    "each record should have been archived within the harbour. A so-called cross-reference was found. Only the modern stock-taking was confirmed. "
) * 6
SCAN = """The ledger and the harbour | 12.3.1990

The survevor inspected tlie warehouse. The trea-
surer said that the ledger maybe read again. Accor­
ding to the council, each rec ord should have been
archived within the so-
called harbour. 1t was 19E3.

- 24 -"""


def words_and_pairs():
    import re
    from collections import Counter

    tokens = [t.strip(".,") for t in NATIVE.split()]
    pairs = Counter(zip(tokens, tokens[1:]))
    return {w: c for w, c in Counter(tokens).items() if re.fullmatch(r"[A-Za-z-]+", w)}, dict(pairs)


@pytest.fixture(scope="module")
def model():
    return sc.build(*words_and_pairs(), ["For internal use only"])


def test_kinds(model):
    lines, frame, broken, misread, corrected = sc.page_lines(SCAN, 24, model)
    assert frame == {0, 8}
    assert set(broken) == {2, 3}
    assert misread == {2, 3, 4, 6}
    assert "surveyor" in corrected[2] and "the" in corrected[2] and corrected[4][-5:-4] != ["rec"]


def test_paragraphs(model):
    text = sc.paragraphs(SCAN, 24, model)
    assert "The surveyor inspected the warehouse. The treasurer said that the ledger may be read again. According to the council, each record should" in text
    assert "so-called harbour" in text and "24" not in text and "12.3.1990" not in text


def test_two_pages_on_one_scan(model):
    body = ["The surveyor inspected the warehouse, said the", "treasurer, that the council should have been read", "again within the modern harbour of the ledger. The"]
    page = "\n".join(["THE LEDGER 1990", "", *body, "- 12 -", "THE LEDGER 1990", "treasurer said that the record was archived within", *body, "13"])
    _, frame, broken, misread, _ = sc.page_lines(page, 12, model)
    assert frame == {0, 5, 6, 11} and not broken and not misread


def test_notices_however_misread(model):
    lines = ["The surveyor inspected the warehouse again within", "the harbour that was found.", "", "F0r internal use on1y · 7"]
    assert sc.frame_lines(lines, 7, model) == {3}
    assert sc.frame_lines([""], None, model) == set()


def test_channel():
    assert sc.channel("tliat", "that") == sc.CONFUSED
    assert sc.channel("that", "that") == 0.0
    assert sc.channel("rnodem", "modern") == pytest.approx(2 * sc.CONFUSED)
    assert sc.channel("xyz", "that") < sc.LEAST_CHANNEL
    assert sc.align("zuriick", "zurück", {}) == (sc.START[sc.SHAPE], ["="]) and sc.align("ete", "été", {})[1] == ["~", "~"]
    assert sc.align("tliat", "that", {"li>h": -3.5})[0] == -3.5
    assert dict(sc.made_up("l9B7")) == {"1987": ("l>1", "B>8")} and sc.made_up("1987") == [] == sc.made_up("word")
    assert dict(sc.made_up("w0rd")) == {"word": ("0>o",)}
    assert sc.strokes("rn") == sc.strokes("m") and sc.strokes("cl") == sc.strokes("d")


def test_viterbi_prefers_what_follows(model):
    assert [w for _, _, w in sc.decode(["ledger", "maybe", "read"], model)] == ["ledger", "may be", "read"]
    assert [w for _, _, w in sc.decode(["each", "rec", "ord", "should"], model)] == ["each", "record", "should"]


def test_table(spark):
    scan = [(i, "p", 24, SCAN, "paddle", "k") for i in range(3)] + [(2, "p", 24, SCAN, "paddle", "k")]
    native = [(10 + i, f"n{i}", 1, NATIVE, "text", "k") for i in range(4)]
    rest = [(20, "p", 1, None, "paddle", "k"), (21, "p", 1, "", "surya", "k"), (22, "p", None, "word", "surya", "k"), (23, None, 1, NATIVE, None, "k"), (24, "p", 24, SCAN, None, "k"), (25, "p", 1, SCAN * 300, "surya", "k")]
    df = spark.createDataFrame(scan + native + rest, "page_id long, path string, page_num int, page_text string, engine string, kind string")
    rows = [tuple(r) for r in sc.damaged_lines(df).collect()]
    assert len(rows) == len(set(rows))
    got = {p: {(n, k) for i, n, k in rows if i == p} for p in range(30)}
    want = {(1, "furniture"), (9, "furniture"), (3, "hyphen"), (4, "hyphen"), (3, "misread"), (4, "misread"), (5, "misread"), (7, "misread")}
    assert got[0] == got[1] == got[2] == got[24] == want
    assert not any(got[i] for i in (10, 11, 12, 13, 20, 21, 23)) and got[25]
    pages = {r.page_id: r.paragraphs for r in sc.readable_pages(df).collect()}
    assert "surveyor inspected the warehouse" in pages[0] and 10 not in pages
    assert sc.damaged_lines(df.where("false")).count() == 0


def test_a_model_of_any_size_gives_the_same_rows(spark, monkeypatch):
    """Beyond the bound of the broadcast, pages are taken in blocks with what each can meet."""
    from leafmill.session import text_table

    pages = text_table(spark, "/root/testdata/sf0.001", "extracted_pages")
    whole = {tuple(r) for r in sc.damaged_lines(pages).collect()}
    texts = {tuple(r) for r in sc.readable_pages(pages).collect()}
    made = []
    held = sc.Statistics._held
    monkeypatch.setattr(sc.Statistics, "_held", lambda self, words, *rest: made.append(words.count()) or held(self, words, *rest))
    monkeypatch.setattr(sc, "MODEL_ROWS", 900)
    assert {tuple(r) for r in sc.damaged_lines(pages).collect()} == whole
    assert {tuple(r) for r in sc.readable_pages(pages).collect()} == texts
    assert len(made) >= 4


def test_rare_true_words_are_not_misread(spark):
    """A corpus of many rare words: new words on scans that are no confusion of known ones stay."""
    import random

    rng = random.Random(4)
    syllables = [a + b for a in "bdfgklmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er", "is")]

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(3, 4)))

    common = [word() for _ in range(300)]
    rare = list({word() for _ in range(3000)})
    native = [" ".join(rng.choice(common) if rng.random() < 0.9 else rng.choice(rare) for _ in range(200)) for _ in range(200)]
    new = [w for w in {word() for _ in range(400)} if w not in set(rare) and w not in set(common)][:120]
    lines = [" ".join([*(rng.choice(common) for _ in range(7)), new[k], rng.choice(common)]) for k in range(120)]
    lines += [x.replace("m", "rn", 1) for x in lines if " m" in x][:10]
    rows = [(i, f"n{i}", 1, t, "text") for i, t in enumerate(native)] + [(1000 + k, f"s{k}", 1, "\n".join(lines[k * 10 : k * 10 + 10]), "paddle") for k in range(13)]
    df = spark.createDataFrame(rows, "page_id long, path string, page_num int, page_text string, engine string")
    got = {((r.page_id - 1000) * 10 + r.line_no - 1) for r in sc.damaged_lines(df).collect() if r.kind == "misread"}
    assert len([k for k in got if k < 120]) <= 2, [lines[k] for k in got if k < 120]
    assert len([k for k in got if k >= 120]) >= len(lines) - 120 - 2


def test_confusions_are_estimated(spark):
    rows = [(i, f"n{i}", 1, NATIVE, "text") for i in range(20)] + [(100 + i, f"s{i}", 1, NATIVE.replace("warehouse", "warehovse" if i % 2 else "warehouse"), "paddle") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, path string, page_num int, page_text string, engine string")
    costs = sc.Statistics(df).costs
    assert costs["v>u"] > sc.CONFUSED and costs["v>u"] == max(costs.values())
