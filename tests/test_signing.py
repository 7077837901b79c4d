import os

import pytest

from leafmill.functions import signing
from leafmill.operators import learner as le


def test_blobs(tmp_path):
    key = signing.load_key(f"{tmp_path}/k/key")
    assert signing.load_key(f"{tmp_path}/k/key") == key and os.listdir(tmp_path / "k") == ["key"]
    for blob in (b"", b"model"):
        assert signing.verify(signing.sign(blob, key), key) == blob
    good = signing.sign(b"model", key)
    for bad in (None, b"", b"model", good[:10], good[:-1], good[:-1] + b"x", b"x" + good[1:], signing.sign(b"model", b"other")):
        assert signing.verify(bad, key) is None


def test_models(spark, sf, tmp_path):
    o = spark.read.parquet(f"{sf}/ocr_outcomes.parquet").distinct()
    root, key = f"file://{tmp_path}/m", b"k" * 32
    assert le.load_signed(root, key) == (None, 0)
    model, samples = le.load_or_train(root, o, key)
    assert model is not None and samples == o.where("ocr_performed").count()
    assert le.load_signed(root, key)[1] == samples and le.load_signed(root, b"other") == (None, 0)
    part = next(p for p in (tmp_path / "m" / "model" / "data").iterdir() if p.name.endswith(".parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    assert le.load_signed(root, key) == (None, 0)
    assert le.load_or_train(root, o.where("false"), key) == (None, 0)
    assert le.load_or_train(root, o, key)[1] == samples and le.load_signed(root, key)[1] == samples
    assert le.load_or_train(root, None, key)[1] == samples


def test_adaptive_inputs(spark):
    rows = [(i, float(i), True, i % 2 == 0, "classifier: 90% useful") for i in range(150)] + [(200 + i, 1.0, True, i < 3, "skip-validation (p=4%, rate=10%)") for i in range(9)] + [(300, 999.0, False, None, None)]
    got = le.adaptive_inputs(spark.createDataFrame(rows, "id long, recorded_at double, ocr_performed boolean, is_useful boolean, reason string")).first()
    assert got.recent_count == 100 and got.recent_error == pytest.approx(0.5) and (got.validated, got.validated_useful) == (9, 3)
    empty = le.adaptive_inputs(spark.createDataFrame([], "id long, recorded_at double, ocr_performed boolean, is_useful boolean, reason string")).first()
    assert tuple(empty) == (0.0, 0, 0, 0)
