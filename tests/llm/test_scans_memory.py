import random

import pyarrow as pa
import pytest

from leafmill.llm import scans as sc
from leafmill.llm.tables import Counts, PairCounts, Scores, Table


def test_notice_paths_do_not_count_as_model_rows(spark, monkeypatch):
    """A notice on many paths is one row of the model, and so no reason for blocks."""
    text = "The surveyor inspected the warehouse again within\nthe harbour that was found.\nThe ledger was read again.\nFor internal use only"
    df = spark.createDataFrame([(i, f"s{i}", 1, text, "paddle") for i in range(400)], "page_id long, path string, page_num int, page_text string, engine string")
    monkeypatch.setattr(sc, "MODEL_ROWS", 100)
    assert len(sc.Statistics(df).models(sc._scans(df, "page_id", "page_num", "page_text", "engine"))) == 1


def test_rows_are_given_out_in_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64())], ["a"])
    sizes = [b.num_rows for b in sc._mapped(lambda a: [(a, k) for k in range(100)], "a bigint, b bigint")(iter([batch]))]
    assert sum(sizes) == 500_000 and max(sizes) <= 100_000


def test_a_worker_keeps_a_bounded_number_of_findings(monkeypatch):
    monkeypatch.setattr(sc, "KEPT", 60, raising=False)
    rng = random.Random(2)
    words = {"".join(rng.choice("abdegilmnorstu") for _ in range(6)): 9 for _ in range(300)}
    names = list(words)
    text = "\n".join(" ".join(w if rng.random() < 0.8 else w.replace("m", "rn", 1).replace("l", "1", 1) for w in rng.sample(names, 8)) for _ in range(200))
    model = sc.build(words, {(a, b): 5 for a, b in zip(names, names[1:])}, [])
    found = sc.page_lines(text, 1, model)[3]
    kept = [model.tokens, model.fine, model.options, model.pair_logs, model.known_candidates, model.unknown]
    assert max(map(len, kept)) <= 60
    monkeypatch.setattr(sc, "KEPT", 10**9)
    assert found == sc.page_lines(text, 1, sc.build(words, {(a, b): 5 for a, b in zip(names, names[1:])}, []))[3] and found


def test_probes_join_words_over_frame_lines_and_come_once():
    page = "The council of the trea-\n- 24 -\nTHE LEDGER 1990\nsurer was found"
    batch = pa.RecordBatch.from_arrays([pa.array([page] * 50)], ["t"])
    rows = [tuple(r.values()) for b in sc._probed(iter([batch])) for r in b.to_pylist()]
    assert ("t", "treasurer") in rows and ("s", sc.strokes("treasurer")) in rows and ("t", "council") in rows and ("t", "thetrea") not in rows
    assert len(rows) == len(set(rows))


def test_tables():
    many = {f"wörd{k}": k for k in range(5000)}
    counts = Counts.of((w, str(c)) for w, c in many.items())
    assert all(counts[w] == c for w, c in many.items()) and sorted(counts) == sorted(many) and len(counts) == 5000
    assert counts.get("word1") is None and "word1" not in counts and counts.get("word1", 0) == 0
    with pytest.raises(KeyError):
        counts["word1"]
    same = Table.of([("k", "a"), ("x", "b"), ("k", "c"), ("", "d")])
    assert sorted(same.all("k")) == ["a", "c"] and same.all("y") == [] and same[""] == "d" and not Table.of([]).all("k")
    assert PairCounts.of([("a\tb", "3")]).get(("a", "b"), 0) == 3 and ("b", "a") not in PairCounts.of([("a\tb", "3")])
    assert Scores.of([("a", "x y\t-1.5\nz\t-2.0"), ("b", "")]).get("a") == [("x y", -1.5), ("z", -2.0)]
