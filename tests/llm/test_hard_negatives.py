"""Hard negatives against brute force in Python's integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tertulia.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, row string, score string"


def brute(rows, anchor=lambda i: i % 10 == 0, k=5, m=5, floor=80):
    ok = []
    for i, v, lab, *_ in rows:
        if i is None or v is None or lab is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        ok.append((i, [math.floor(256 * x) for x in v], lab))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, v, lab) in enumerate(ok):
        if not anchor(i):
            continue
        scored = sorted((-dot(v, w), j, other) for o, (j, w, other) in enumerate(ok) if o != n)
        for s, j, other in [x for x in scored if x[2] == lab][:k]:
            window = [x for x in scored if x[2] != lab and floor * -s <= 100 * -x[0] <= 100 * -s][:m]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(window, 1)]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "k", "k") for r in rows], SCHEMA)
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % 10 == 0, **kw).collect()))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(centre)], rng.choice([0, 0, 1, 2])) for i in range(150)]
    rows += [rows[0], rows[10], rows[10], (20, rows[10][1], 1), (7, rows[3][1], 2)]  # repeated rows, repeated ids
    rows += [(200 + i, rows[30][1], i % 2) for i in range(30)]  # ties
    rows += [(None, [1.0] * 6, 1), (300, None, 1), (310, [1.0] * 6, None), (320, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1),
             (330, [float("nan")] * 6, 1), (340, [float("inf")] * 6, 0), (350, [1e306] * 6, 0), (360, [], 0), (370, [0.5, 0.5], 1),
             (380, [0.0] * 6, 2), (400, [2.0] * 6, 77)]
    want = brute(rows)
    assert len(want) > 100
    assert found(spark, rows) == want
    monkeypatch.setattr(H, "ANCHORS", 5)  # several blocks
    monkeypatch.setattr(H, "CELLS", 100)
    assert found(spark, rows) == want


def test_wide_components(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1e5, 1e5) for _ in range(4)], i % 3) for i in range(60)]
    assert found(spark, rows) == brute(rows) != []
    rows = [(i, [rng.uniform(-3e6, 3e6) for _ in range(4)], i % 3) for i in range(60)]
    assert found(spark, rows) == brute(rows) != []


@pytest.mark.parametrize("size", [1, 256, 2 ** 20, 2 ** 24, 2 ** 40, 2 ** 60])
def test_packed_scores(size):
    rng = random.Random(size)
    for n in (0, 1, 2, 5, 33):
        a = np.array([[float(rng.randint(-size, size)) for _ in range(7)] for _ in range(3)])
        c = np.array([[float(rng.randint(-size, size)) for _ in range(7)] for _ in range(n)]).reshape(n, 7)
        got = H.packed_scores(a, c)
        want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in c] for u in a]
        assert got.tolist() == want
    assert H.packed_scores(a, np.abs(c)).tolist() == [[sum(int(x) * int(abs(y)) for x, y in zip(u, v)) for v in c] for u in a]


def test_several_fields_a_word(monkeypatch):
    """Unit vectors of 64 components are packed two to a double."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 64))
    q = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    words = []
    matmul = np.ndarray.__matmul__

    class Seen(np.ndarray):
        def __matmul__(self, other):
            words.append(other.shape[1])
            return matmul(np.asarray(self), np.asarray(other))

    got = H.packed_scores(q[:3].view(Seen), q)
    assert np.array_equal(np.asarray(got), (q[:3] @ q.T).astype(np.int64)) and words == [25]


def test_empty_and_lonely(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1)]) == []
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [-1.0], 2)]) == []
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]) == [(0, 1, 1, 2, 65536, 256 * 230)]
    assert found(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)]) == []  # a negative score's window is empty


def test_relabelled(spark):
    df = spark.createDataFrame([(7, 9), (14, 3), (8, 9), (21, None), (None, 4)], "vec_id long, label int")
    assert [r.label for r in H.relabelled(df).collect()] == [0, 4, 9, None, 4]
