import random

from leafmill.llm import leakage as lk


def brute(docs, items, run):
    out = set()
    for d, t in docs:
        w = lk.words(t)
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for i, x in items:
            v = lk.words(x)
            if any(tuple(v[k : k + run]) in grams for k in range(len(v) - run + 1)):
                out.add((d, i))
    return out


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, item_id int")
    return d, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["Straße", "STRASSE", "alpha", "Beta", "g1", "été", "x", "no"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " – "]) for _ in range(n))

    items = [(i, text(rng.randint(0, 20))) for i in range(12)] + [(50, None), (51, "")]
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)] + [(100, None), (101, ""), (102, text(20_000))]
    docs += [(200 + i, "Intro. " + (t or "").upper().replace(" ", "  ") + " end") for i, t in items]
    docs += docs[:5]
    for size in (10**9, 40):
        got = {tuple(r) for r in lk.leaks(*frames(spark, docs, items), run=5, item_chars=size).collect()}
        assert got == brute(docs, items, 5)


def test_empty_tables(spark):
    d, i = frames(spark, [(1, "a b c d e f")], [(2, "a b c d e f")])
    assert lk.leaks(d.where("false"), i, run=5).count() == 0
    assert lk.leaks(d, i.where("false"), run=5).count() == 0
    assert lk.leaks(d, i, run=5).count() == 1
    assert lk.leak_report(lk.leaks(d, i, run=7), i).first().documents == 0


def test_shift_skips_and_finds_every_offset():
    machine = lk.WuManber([(1, "a b c d e f g h i j k l m")], run=12)
    for ahead in range(30):
        assert machine.owners("z " * ahead + "a b c d e f g h i j k l") == {1}
        assert machine.owners("z " * ahead + "b c d e f g h i j k l M!") == {1}
    assert machine.owners("a b c d e f g h i j k x") == set()


def test_tables_are_small():
    """Arrays and numbers of words stay below the bytes a character that the blocks of items reckon with."""
    import pickle

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9))) for _ in range(20_000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(400))) for i in range(400)]
    assert len(pickle.dumps(lk.WuManber(items))) < lk.CHAR_BYTES * sum(len(t) for _, t in items)


def test_short_runs_and_owners():
    items = [(7, "a b c d"), (8, "x a b c"), (9, "a b"), (7, "q r s"), (6, "a b c d")]
    machine = lk.WuManber(items, run=3, block=2)
    assert machine.owners("z A-b c") == {7, 8, 6} and machine.owners("b c d") == {7, 6} and machine.owners("q r s") == {7} and machine.owners("a b") == set() == machine.owners(None)
