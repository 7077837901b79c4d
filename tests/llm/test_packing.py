import random
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import packing as pk


@pytest.mark.parametrize("capacity,n", [(512, 3000), (64, 500), (7, 100), (1, 5), (4096, 3000), (100, 1), (100, 0)])
def test_plan_is_exact_and_tight(capacity, n):
    rng = random.Random(n)
    histogram = Counter(min(capacity, max(1, int(rng.lognormvariate(0, 0.7) * capacity / 4))) for _ in range(n))
    made = pk.plan(dict(histogram), capacity)
    back = Counter()
    for filling, repeats, _ in made:
        assert repeats > 0 and sum(k * c for k, c in filling.items()) <= capacity
        for k, c in filling.items():
            back[k] += c * repeats
    assert back == histogram
    total, used = sum(k * c for k, c in histogram.items()), sum(r for _, r, _ in made)
    if n >= 500:
        assert used <= 1.06 * total / capacity + 2


def test_plan_refuses_what_cannot_fit():
    with pytest.raises(ValueError):
        pk.plan({11: 1}, 10)


def test_best_pattern_against_all():
    from itertools import combinations_with_replacement

    rng = np.random.default_rng(1)
    for _ in range(20):
        gain, unused = rng.normal(size=6), -abs(rng.normal()) / 3
        value, counts = pk.best_pattern(gain, unused)
        every = [m for k in range(7) for m in combinations_with_replacement(range(6), k) if sum(b + 1 for b in m) <= 6]
        best = max(sum(gain[b] for b in m) + unused * (6 - sum(b + 1 for b in m)) for m in every)
        assert value == pytest.approx(best)
        assert counts @ np.array([1, 2, 3, 4, 5, 6, 1]) == 6 and counts[:6] @ gain + counts[6] * unused == pytest.approx(best)


def test_fit_takes_up_a_histogram_that_fills_containers():
    rng = np.random.default_rng(2)
    for _ in range(5):
        histogram = np.zeros(16)
        for _ in range(4):  # sums of full patterns
            b = rng.integers(1, 8)
            for k in (b, 16 - b):
                histogram[k - 1] += 100
        patterns, times = pk.fit(histogram)
        assert (times >= 0).all() and np.allclose(patterns[:16] @ times, histogram, rtol=0.02, atol=2)
        assert patterns[16] @ times < 0.02 * 16 * times.sum()


def test_most_texts_come_from_fitted_patterns():
    rng = random.Random(3)
    histogram = Counter(min(4096, max(1, int(rng.lognormvariate(5.5, 0.9)))) for _ in range(20000))
    for capacity in (512, 1024, 4096):
        rest = Counter()
        for n, c in histogram.items():
            rest[n % capacity] += c
        del rest[0]
        made = pk.plan(dict(rest), capacity)
        fitted = sum(sum(f.values()) * r for f, r, fit in made if fit)
        assert fitted >= 0.9 * sum(rest.values())
        assert sum(k * c for k, c in rest.items()) >= 0.985 * capacity * sum(r for _, r, _ in made)


def test_every_text_is_placed_whole(spark):
    rng = random.Random(9)
    lengths = [(i, rng.choice([100, 100, 100, rng.randint(1, 400)])) for i in range(2000)] + [(5000, 0), (5001, 2500), (5002, 1000), (5003, 1)]
    df = spark.createDataFrame(lengths, "doc_id long, tokens long")
    rows = pk.pack(df, {"a": 500, "b": 1000}).collect()
    for kind, capacity in (("a", 500), ("b", 1000)):
        own = [r for r in rows if r.container_kind == kind]
        fill, parts = Counter(), {}
        for r in own:
            fill[r.container_id] += r.tokens
            parts.setdefault(r.doc_id, []).append((r.from_token, r.tokens, r.part))
        assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
        for i, n in lengths:
            got = sorted(parts[i])
            assert sum(t for _, t, _ in got) == n and len(got) == max(1, -(-n // capacity))
            assert [f for f, _, _ in got] == [capacity * k for k in range(len(got))]


def test_counts_and_edges(spark):
    df = spark.createDataFrame([(1, "two words", 3), (2, None, 3), (3, "", 3), (1, "two words", 3), (4, "word " * 100_000, 3)], "doc_id long, text string, tokens int")
    got = {r.doc_id: r.tokens for r in pk.token_counts(df).collect()}
    encode = pk._encoder(f"{pk.TOKENIZER_DIR}/{pk.TOKENIZER}").encode_ordinary
    assert got == {1: 2, 2: 0, 3: 0, 4: len(encode("word " * 100_000))}
    assert pk.pack(pk.token_counts(df.where("false")), {"a": 10}).count() == 0
    assert pk.pack(pk.token_counts(df), {}).count() == 0
    specs = spark.createDataFrame([("a", 5), ("a", 5), (None, 4), ("z", 0)], "container_kind string, capacity_tokens int")
    assert pk.container_kinds(specs) == {"a": 5}
