"""What was found out is not worked out again, and shortcuts give what the long way gave."""

import random
import re

from leafmill.llm import encoding as en
from leafmill.llm import scans as sc

#: The odd things one by one, as they are stated; ``ODD`` looks for the characters that all of them have first.
PARTS = re.compile(
    r"â€|Â[°±µ²³·§£«»¿¡\xa0\xad¬]|Ã[^\w\s.,;:!?)\"'’”»\-–—]|[РС][°±µ·»«§–—‘’“”„•]|[^\W\dmk][³²±µ£§]|[³²±·](?=[^\W\d])|[^\W\d]·[^\W\d]|¿(?=[a-zà-ÿ])"
    r"|[a-z][ГВРСД]|[ГВРСД][a-z]|[а-яё][А-ЯЁ]|[a-zß-ÿ][À-ÝŁŚŹŻĆŃ]|â(?=[\s,.;:)]|$)|Ã(?=[ \xa0]|$)|­(?=[^\W\d]*[ÂÃ])|Ã[\xa0\xad]"
)


def _counted(monkeypatch, owner, name: str) -> list:
    calls, f = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda *a, **k: calls.append(a) or f(*a, **k))
    return calls


def test_neighbours_are_put_together_once(monkeypatch):
    words = {"the": 50, "ledger": 9, "record": 9, "should": 9, "each": 9}
    model = sc.build(words, {("the", "ledger"): 5}, [])
    line = ["each", "rec", "ord", "should"]
    found = sc.decode(line, model)
    assert [w for *_, w in found] == ["each", "record", "should"]
    calls = _counted(monkeypatch, model, "candidates")
    assert sc.decode(line, model) == found and not calls


def test_a_swap_of_a_character_is_worked_out_once(monkeypatch):
    line = "Главный инженер обязан сообщить об этом в правление завода"
    assert en.repair_line(line) == (line, None)
    calls = _counted(monkeypatch, en, "encode")
    assert en.repair_line(" ".join(line.split()[::-1])) == (" ".join(line.split()[::-1]), None) and not calls


def test_the_cost_of_a_line_is_summed_once(monkeypatch):
    calls = _counted(monkeypatch, en, "cost")
    line = "DespuÃ©s de la inundaciÃ³n quedÃ³ corregido"
    assert en.repair_line(line) == ("Después de la inundación quedó corregido", "cp1252")
    assert sum(a == (line,) for a in calls) == 1


def test_odd_things_and_cores():
    rng = random.Random(5)
    chars = "abzmk ÂÃâ€³²±µ£§·¿¡АЯЁРСГВДабё яÀÝŁŚŃéñà\xad\xa0„“–—…•°»«5.,)\n漢\x85Ð‘"
    for _ in range(20_000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(1, 8)))
        assert bool(en.ODD.search(text)) == bool(PARTS.search(text)), text
    core = re.compile(r"^[\"“”„«»'‘’(\[…¿¡]*(.*?)[\"“”„«»'’)\],.;:!?…]*$", re.S)
    for _ in range(20_000):
        token = "".join(rng.choice("\"“„«'‘(\\[…¿¡])»’,.;:!?ab1-") for _ in range(rng.randint(1, 7)))
        if token[0] != "(":
            assert sc._core(token) == core.match(token)[1], token
