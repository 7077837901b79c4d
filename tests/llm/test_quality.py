from leafmill.llm import quality as q

WORDS = "the of and was surveyor treasurer inspected warehouse section under record number page read still next archive ledger council harbour before written".split()
PROSE = "The surveyor inspected the warehouse under section 12. Before the council the treasurer read the ledger.\nThe harbour record was still written. " * 4
CASES = {
    "prose": [PROSE, PROSE.upper(), "\n".join(PROSE.split(". ")), "# frame_a\n\n> Source: /x/frame_a.pdf\n\n---\n\n" + PROSE + "\n\n---\n*Page 2*\n\n" + PROSE, "The ledger."],
    "list": [
        "\n".join(f"- ledger {i} Harbourgate" for i in range(10)), "\n".join(f"{i}. the warehouse A{i}.77" for i in range(1, 9)), "\n".join(f"archive ledger {'.' * 9} {i}" for i in range(40, 50)),
        "\n".join(f"[x] record {i}" for i in range(9)), "\n".join(f"ledger AB-{i}77" for i in range(9)), "\n".join(f"archive Harbourgate ({i})" for i in range(9)),
    ],
    "table": [
        "| a | b |\n| --- | --- |\n" + "\n".join(f"| ledger | {i}.50 |" for i in range(9)), "\n".join(f"ledger;{i}.5;archive;" for i in range(9)), "\n".join(f"archive\t{i}\t3.20" for i in range(9)),
        "\n".join(f"archive     {i}55.20     ledger" for i in range(9)), "\n".join(f"warehouse,{i}8.5,AB-77,x" for i in range(9)),
    ],
    "junk": [
        "\n".join("0000561e  c6 d5 6f 73 51 12 a4 cc f8" for _ in range(5)), "dsfkj qwrtz plmkn bvcxs hjklm trwqp\n" * 5, "the of and was surveyor read written the ledger under and of was next still number page the of " * 5,
        "surveyor surveyor surveyor surveyor surveyor surveyor\n" * 5, "yyq/8AfgZZ0+" * 20, ">##[<¦)}</¤?+!#*¤<_<?*{\\+&<(§#~|§&\n" * 6,
    ],
}


def test_classes():
    known = set(WORDS).__contains__
    for kind, texts in CASES.items():
        for t in texts:
            assert q.measure(t, known, known)[-1] == kind, t[:80]


def test_figures():
    known = set(WORDS).__contains__
    names = (*q.METRICS, "text_class")
    m = dict(zip(names, q.measure("The ledger.\n\nThe ledger.", known, known)))
    assert m["word_count"] == 4 and m["real_word_ratio"] == 1.0 and m["line_end_ratio"] == 1.0 and m["duplicate_line_share"] == 0.5 and m["duplicate_paragraph_share"] == 0.5
    assert q.measure(None, known, known) is q.measure(" \n", known, known) is None


def test_documents(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate([PROSE, CASES["list"][0], None, "", "  \n", PROSE * 200])] + [(0, PROSE, "x", "y"), (None, PROSE, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, w string, text_class string")
    got = {r.doc_id: r.text_class for r in q.document_quality(df, words=WORDS).collect()}
    assert got == {0: "prose", 1: "list", 5: "prose"}
    assert {r.w for r in q.vocabulary(df, least=2).collect()} >= {"surveyor", "the"}
    assert q.document_quality(df.where("false")).count() == 0


def test_held_out_labels(spark):
    """Rules and vocabulary use no labels, so all of them are held out; labels themselves are partly wrong."""
    d = "/root/testdata/sf0.01"
    found = q.document_quality(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "text_class")
    labels = spark.read.parquet(f"{d}/text_class_labels.parquet").where("text_class IS NOT NULL").withColumnRenamed("text_class", "label")
    both = labels.join(found, "doc_id").collect()
    assert sum(r.label == r.text_class for r in both) >= 0.9 * len(both)


MENU = "Home ledger archive\n"


def test_repetition_decides(monkeypatch):
    """Without the statistics of repetition each of these texts has another class."""
    known = set(WORDS).__contains__
    few = "The ledger of the council was read and read again. " * 12
    texts = {
        "list": "\n".join(f"surveyor inspected the warehouse under section {w} {w} record" for w in WORDS[4:12]),
        "junk": "Ledger council read " * 20,
    }
    assert q.measure(few, known, known)[-1] == "prose"
    with_rules = {k: q.measure(t, known, known)[-1] for k, t in texts.items()}
    assert with_rules == {"list": "list", "junk": "junk"}
    figures = dict(zip((*q.METRICS, "text_class"), q.measure(PROSE + "\n" + MENU * 4, known, known)))
    assert figures["boilerplate_share"] > 0.05 and figures["text_class"] == "prose"
    assert q.measure(MENU * 4, known, known)[-1] == "list"
    mixed = "archive ledger council harbour record still\n" * 6 + "- ledger 1\n- council 2\n- record 3\n- page 4\n- section 5\n"
    assert q.measure(mixed, known, known)[-1] == "list"
    monkeypatch.setattr(q, "BOILERPLATE", 10**9)
    monkeypatch.setattr(q, "TEMPLATE", 10**9)
    monkeypatch.setattr(q, "DOMINANT", 10**9)
    assert [q.measure(t, known, known)[-1] for t in (texts["list"], texts["junk"], mixed)] == ["junk", "prose", "junk"]


def test_a_vocabulary_of_any_size_gives_the_same_rows(spark, monkeypatch):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {tuple(r) for r in q.document_quality(documents).collect()}
    monkeypatch.setattr(q, "VOCABULARY_ROWS", 700)
    assert len(q._in_blocks(documents.select("doc_id", "text"), None)) > 1
    assert {tuple(r) for r in q.document_quality(documents).collect()} == whole
