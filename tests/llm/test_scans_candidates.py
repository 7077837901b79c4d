from itertools import product

from leafmill.llm import scans as sc


def test_every_candidate_meets_the_language_model():
    """The right word is the least likely of 26 by its strokes alone, and the only one that follows the word before."""
    words = {"".join(w): 2 for w in product("lit", repeat=3) if w not in (("l",) * 3, ("t",) * 3)} | {"the": 1_000_000, "ttt": 5000}
    model = sc.Model(words, {("the", "ttt"): 900_000}, set())
    assert len(model.candidates("lll")) == 26
    assert [w for *_, w in sc.decode(["the", "lll"], model)] == ["the", "ttt"]
