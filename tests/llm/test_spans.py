import random
import time

import numpy as np

from leafmill.llm import pairs, spans
from leafmill.llm.fm_index import FMIndex, Matches, WaveletMatrix, sorted_rows


def points(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def brute(texts, least):
    found = set()
    rows = sorted(set(texts))
    grams = {(i, t): {t[k : k + least] for k in range(len(t) - least + 1)} for i, t in rows if t}
    for a, x in grams.items():
        for b, y in grams.items():
            if a[0] < b[0] and x & y:
                found.add((a[0], b[0]))
    return found


def test_rows_and_ranks():
    rng = random.Random(1)
    s = np.array([rng.randint(1, 4) for _ in range(300)] + [0])
    for depth in (2, 5, 40, 301):
        order, edge = sorted_rows(s, depth)
        keys = [tuple(s[i : i + depth]) for i in order]
        assert keys == sorted(keys)
        assert edge.tolist() == [True] + [a[: depth - 1] != b[: depth - 1] for a, b in zip(keys, keys[1:])]
    w = WaveletMatrix(s, 5)
    for c in range(5):
        base = w.rank(np.array([c]), np.array([0]))
        for at in (0, 1, 63, 64, 65, 200, 301):
            assert w.rank(np.array([c]), np.array([at])) - base == (s[:at] == c).sum()


def test_intervals_count_occurrences():
    texts = ["abracadabra", "cadabra 日本", "ab", ""]
    index = FMIndex([points(t) for t in texts], np.arange(4), 4)
    low, high = index.stream()
    for start, t in zip(index.starts, texts):
        for k in range(len(t) + 1):
            part = t[k : k + 4]
            want = sum(o[j : j + 4] == part for o in texts for j in range(len(o))) if len(part) == 4 else 0
            assert high[start + k] - low[start + k] == want


def test_windows_against_brute_force():
    rng = random.Random(2)
    for width in (2, 5, 30):
        for _ in range(20):
            texts = []
            for _ in range(10):
                t = "".join(rng.choice("abcé日" if width > 5 else "ab") for _ in range(rng.randint(0, 5 * width)))
                if texts and rng.random() < 0.6 and len(o := rng.choice(texts)) > 2 * width:
                    at = rng.randint(0, len(o) - width)
                    t = t[:40] + o[at : at + rng.randint(width - 2, 2 * width)] + t[40:]
                texts.append("aaaaa" * 20 if rng.random() < 0.15 else t)
            owners = np.arange(10) % 7
            found = Matches([points(t) for t in texts], owners, width)
            holders = {}
            for t, owner in zip(texts, owners):
                for k in range(len(t) - width + 1):
                    holders.setdefault(t[k : k + width], set()).add(owner)
            want = {(i, k) for i, t in enumerate(texts) for k in range(len(t) - width + 1) if len(holders[t[k : k + width]]) > 1}
            assert set(zip(found.text.tolist(), found.start.tolist())) == want
            covered = [set() for _ in texts]
            for i, k in want:
                covered[i] |= set(range(k, k + width))
            spans_of = [set() for _ in texts]
            for i, s, e in zip(*(x.tolist() for x in found.spans())):
                assert not spans_of[i] & set(range(s, e))
                spans_of[i] |= set(range(s, e))
            assert spans_of == covered
            pairs = {(i, j) for g in found.groups() for i in g.tolist() for j in g.tolist() if i < j and owners[i] != owners[j]}
            assert pairs == {(i, j) for i, j in brute(list(enumerate(texts)), width) if owners[i] != owners[j]}


def test_uniform_text_is_linear():
    began = time.time()
    found = Matches([points("a" * 1_000_000), points("a" * 1_000_000)], np.arange(2), 300)
    assert [x.tolist() for x in found.spans()] == [[0, 1], [0, 0], [1_000_000, 1_000_000]] and len(found.groups()) == 1
    assert time.time() - began < 60


def rows(spark, texts):
    return spark.createDataFrame([(i, t, -1) for i, t in texts], "doc_id long, text string, id int")


def corpus():
    rng = random.Random(5)

    def text(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    shared = [text(n) for n in (299, 300, 301, 900)]
    docs = [(i, text(rng.randint(0, 800))) for i in range(20)]
    docs += [(100 + i, text(50 * (i % 7)) + shared[i % 4] + text(30 * (i % 5))) for i in range(16)]
    docs += [(200, docs[21][1]), (201, docs[21][1]), (202, "short"), (203, "short"), (204, ""), (205, None), (206, "a" * 2000), (207, "b" + "a" * 1500), (208, "ab" * 400), (209, "ab" * 500)]
    return docs + docs[:4]


def test_pairs_against_brute_force(spark):
    docs = corpus()
    got = [tuple(r) for r in spans.shared_pairs(rows(spark, docs)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, 300)


def test_pairs_within_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 7)
    rows = [(k, i, i * 2) for k, n in (("x", 50), ("y", 1), ("z", 8)) for i in range(n)]
    got = [tuple(r) for r in pairs.pairs_within(spark.createDataFrame(rows, "k string, id long, v long"), "k").collect()]
    assert sorted(got) == sorted([(i, j, 2 * i, 2 * j) for n in (50, 8) for i in range(n) for j in range(i + 1, n)])


def test_anchors_of_unrelated_texts_with_even_holders(spark):
    rng = random.Random(7)
    one, two = ("".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(2))
    docs = [(1, one), (2, one + "x"), (3, two), (4, two + "x"), (5, one + one + "y"), (6, one + one + "z")]
    assert {tuple(r) for r in spans.shared_pairs(rows(spark, docs)).collect()} == brute(docs, 300)


def test_hot_passage_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "SHARD", 3_000)
    monkeypatch.setattr(spans, "PIECE", 500)
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh") for _ in range(400))
    docs = [(i, "".join(rng.choice("abcdefgh") for _ in range(200)) + passage + str(i)) for i in range(40)]
    got = {tuple(r) for r in spans.shared_pairs(rows(spark, docs)).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40)}


def test_shares(spark):
    docs = corpus()
    unique = dict(docs)
    got = {r.doc_id: r for r in spans.shared_spans(rows(spark, docs)).collect()}
    for i, t in unique.items():
        if t is None:
            assert i not in got
            continue
        covered = np.zeros(len(t) + 1, bool)
        for j, o in unique.items():
            if i != j and o:
                known = {o[k : k + 300] for k in range(len(o) - 299)}
                for k in range(len(t) - 299):
                    if t[k : k + 300] in known:
                        covered[k : k + 300] = True
        assert got[i].shared_chars == covered.sum(), i
        assert 0 <= got[i].shared_share <= 1


def test_large_sets_give_the_same_shares(spark, monkeypatch):
    docs = corpus()
    whole = {tuple(r) for r in spans.shared_spans(rows(spark, docs)).collect()}
    monkeypatch.setattr(spans, "SHARD", 800)
    assert {tuple(r) for r in spans.shared_spans(rows(spark, docs)).collect()} == whole


def test_empty(spark):
    empty = rows(spark, [(1, None)])
    assert spans.shared_pairs(empty).count() == 0
    assert spans.shared_spans(empty).count() == 0
