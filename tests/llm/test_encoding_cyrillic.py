import pytest

from leafmill.llm import encoding as en

LINES = ["главный инженер обязан сообщить об этом в течение 403 дней.", "хранится отдельно, а склад частично исправлен.", "словарь насоса   721,45"]


@pytest.mark.parametrize("line", LINES)
@pytest.mark.parametrize("read,meant", [("koi8_r", "cp1251"), ("cp1251", "koi8_r")])
def test_lone_line_of_plain_letters(line, read, meant):
    garbled = line.encode(meant).decode(read)
    assert en._PLAIN.fullmatch(garbled) and not en.ODD.search(garbled)
    assert en.repair_line(garbled) == (line, f"{read}>{meant}")
    assert en.repair_text(f"Ledger\n{garbled}\n12") == [("Ledger", None), (line, f"{read}>{meant}"), ("12", None)]


@pytest.mark.parametrize("line", [*LINES, *(x.upper() for x in LINES), "ДНЕВНИК И РЕЕСТР", "924 дней.", "- счёт 11/RV914", "подшит.", "ФГУП", "* маяк H93.3323"])
def test_sound_cyrillic_stays(line):
    assert en.repair_line(line) == (line, None)


def test_short_line_beside_lines_of_the_same_swap():
    lines = ["главный инженер обязан сообщить", "список   576,39", "хранится отдельно, а склад исправлен"]
    text = "\n".join(x.encode("koi8_r").decode("cp1251") for x in lines)
    assert [x for x, _ in en.repair_text(text)] == lines
