import pytest

from leafmill.llm import encoding as en

SOUND = [
    "plain ascii", "Überprüfung der Straße für 748 m², § 12", "L’âge de l’étiquette était estimé à 348 ans", "NÃO CONSTA do processo; São necessárias", "¿Quién dijo que no?",
    "В 1986 году образец был оплачен", "Według opinii, którą wydał główny archiwista", "At 25 °C deviated by ±58 µm “quoted” – €453 £180", "A Ç Ã O     N Ã O", "", "été", "ｗｉｄｅ", "wоrd",
]
TEXTS = [
    "Überprüfung der Straße für die Bürgermeisterei", "la dirección técnica señaló la montaña", "“isn’t complete,” – €331", "Согласно описи нотариус полностью проверил", "Według opinii, którą wydał główny księgowy",
]


@pytest.mark.parametrize("line", SOUND)
def test_sound_lines_stay(line):
    assert en.repair_line(line) == (line, None)


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp437"])
def test_round_trip(text, read):
    garbled = "".join({b: c for c, b in reversed(en._sloppy(read)[0].items())}.get(b) or chr(b) for b in text.encode())
    restored, how = en.repair_line(garbled)
    assert how and restored == text
    twice = "".join({b: c for c, b in reversed(en._sloppy("cp1252")[0].items())}.get(b) or chr(b) for b in garbled.encode())
    assert en.repair_line(twice)[1]


def test_single_bytes_and_losses():
    assert en.repair_line("Согласно описи нотариус".encode("cp1251").decode("latin-1"))[0] == "Согласно описи нотариус"
    assert en.repair_line("la dirección del camión técnica".encode("cp1252").decode("cp850"))[0] == "la dirección del camión técnica"
    assert en.repair_line("l�ing�nieur")[1] == "lost"
    assert en.repair_line("fa\\xc3\\xa7ade") == ("façade", "escaped")
    assert en.encode("日", "cp1252") is None
    assert en.repair_line("annÃ©es dâ€™Ã©tude Ã  Pelmere, dÃ©jÃ  payÃ©s")[0] == "années d’étude à Pelmere, déjà payés"
    assert en.repair_line("o Ã\xadndice") == ("o índice", "cp1252")


def test_tables(spark):
    rows = [(1, "ok\nfaÃ§ade\nend", "x"), (1, "ok\nfaÃ§ade\nend", "x"), (2, None, "x"), (3, "", "x"), (4, "no", "x"), (5, "r�sum", "x"), (None, "Ã©", "x"), (6, "a\\xe2\\x80\\x99s", "x"), (7, "é" * 20000, "x")]
    df = spark.createDataFrame(rows, "page_id long, page_text string, line_no string")
    got = {(r.page_id, r.line_no): (r.restored, r.how) for r in en.garbled_lines(df).collect()}
    assert got == {(1, 2): ("façade", "cp1252"), (5, 1): ("r�sum", "lost"), (6, 1): ("a’s", "escaped")}
    pages = {r.page_id: (r.restored, r.garbled_lines, r.lost_lines) for r in en.restored_pages(df).collect()}
    assert pages[1] == ("ok\nfaçade\nend", 1, 0) and pages[2] == (None, 0, 0) and pages[5][2] == 1 and len(pages) == 7
    assert en.garbled_lines(df.where("false")).count() == 0


SCRIPTS = {
    "中文文本内容需要检查": [("gb18030", "cp1252"), ("gb18030", "latin-1")],
    "Ο επιθεωρητής εξέτασε την αποθήκη και το αρχείο": [("cp1253", "cp1252"), ("iso8859_7", "latin-1"), ("cp1253", "cp1251")],
    "הספרן בדק את המחסן ואת הרשומות של העירייה": [("cp1255", "cp1252"), ("cp1255", "cp1251")],
    "قام المفتش بفحص المستودع وسجلات البلدية القديمة": [("cp1256", "cp1252"), ("utf-8", "cp1256")],
}


@pytest.mark.parametrize("text", SCRIPTS)
def test_other_scripts_are_restored_or_left(text):
    assert en.repair_line(text) == (text, None)
    for meant, read in SCRIPTS[text]:
        table = en._sloppy(read)[1]
        garbled = "".join(chr(b) if b < 0x80 else table.get(b, chr(b)) for b in text.encode(meant))
        restored, how = en.repair_line(garbled)
        assert restored in (text, garbled) or how.endswith("lost"), (meant, read, restored)
    meant, read = SCRIPTS[text][0]
    table = en._sloppy(read)[1]
    assert en.repair_line("".join(chr(b) if b < 0x80 else table.get(b, chr(b)) for b in text.encode(meant)))[0] == text
