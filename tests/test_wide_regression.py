"""The bag-of-words regression whose coefficients lie in the cluster against MLlib's on the driver."""

import random

import pytest

from tertulia.operators import classify as M
from tertulia.operators import wide_regression as W


def _rows():
    rng = random.Random(7)
    out = []
    for i in range(120):
        split = ("train", "train", "dev", "test")[i % 4]
        label = (0, 1, 3)[rng.randrange(3)]  # class 2 has no rows
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(12))] + [f"c{label}"] * rng.randrange(3)
        words += [f"only{i}"]  # in one row: outside the vocabulary where that is held out
        out.append((i // 2, split, label, words))  # ids come twice
    out += [(500, "train", 1, []), (501, "dev", 0, []), (502, "train", 0, ["w1"] * 300)]
    return out


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(_rows(), "tweet_id long, split string, sentiment int, toks array<string>").repartition(3)


def _few_steps(monkeypatch, n):
    full = M.logistic_regression
    monkeypatch.setattr(M, "logistic_regression", lambda *a: full(*a).setMaxIter(n))


@pytest.mark.parametrize("binary, steps", [(False, 13), (True, 3)])
def test_many_terms_stay_off_the_driver(spark, rows, monkeypatch, binary, steps):
    _few_steps(monkeypatch, steps)
    order = ["tweet_id", "split", "sentiment", "prediction"]
    want = M.text_classifier(rows, "toks", "sentiment", "split", binary=binary)
    expected = sorted(map(tuple, want.select(order).collect()))

    def on_the_driver(*args, **kwargs):
        raise AssertionError("a vocabulary on the driver")

    monkeypatch.setattr(M, "CountVectorizer", on_the_driver)
    monkeypatch.setattr(M, "DRIVER_COEFFICIENTS", 8)
    monkeypatch.setattr(W, "CELL_COUNTS", 16)
    monkeypatch.setattr(W, "CUT_EVERY", 4)
    got = M.text_classifier(rows, "toks", "sentiment", "split", binary=binary)
    assert got.columns == want.columns and got.schema["prediction"].dataType == want.schema["prediction"].dataType
    assert sorted(map(tuple, got.select(order).collect())) == expected


def test_training_rows_only(spark, rows, monkeypatch):
    _few_steps(monkeypatch, 2)
    monkeypatch.setattr(M, "DRIVER_COEFFICIENTS", 8)
    got = M.text_classifier(rows.filter("split = 'train'"), "toks", "sentiment", "split")
    assert got.collect() == []


def test_step_of_a_parabola():
    assert W.wolfe_step(lambda t: ((t - 3) ** 2, 2 * (t - 3)), 1.0, (9.0, -6.0)) == pytest.approx(3, abs=2.7)
    assert W.wolfe_step(lambda t: (t, 1.0), 1.0, (0.0, -1.0)) is None


def test_postings_of_slices(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(W, "TEXTS_AT_ONCE", 2)
    b = pa.record_batch([pa.array([5, 6, 7, 8], pa.int32()), pa.array([["a", "b", "a"], ["b"], None, ["a", "c"]])], names=["_at", "toks"])
    got = [r for p in W._postings([b]) for r in p.to_pylist()]
    assert got == [{"term": "a", "rows": [5], "counts": [2]}, {"term": "b", "rows": [5, 6], "counts": [1, 1]},
                   {"term": "a", "rows": [8], "counts": [1]}, {"term": "c", "rows": [8], "counts": [1]}]
