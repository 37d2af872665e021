"""Round 6: memory, disk and time that grow with the input."""

import collections

import pytest
from pyspark.sql import functions as F


# op11: what a worker and a row hold.
def test_alignment_rows_do_not_grow_with_their_block(spark, monkeypatch):
    from tertulia.llm import token_align as A
    kept = {}
    whole = A.stored
    monkeypatch.setattr(A, "stored", lambda df, name: kept.setdefault(name, whole(df, name)))
    rows = [(i, f"word{i % 7} and more words {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, A.alignment(df).collect()))
    blocks = kept["aligned"]
    assert blocks.filter("pos IS NULL").count() == 60  # a row each, not one for the block
    assert blocks.agg(F.max(F.size("idx"))).first()[0] < 30 < blocks.filter("pos IS NOT NULL").count()
    kept.clear()
    monkeypatch.setattr(A, "PACKED", 4)
    documents, longest = A._documents, spark.sparkContext.accumulator(0)

    def watched(batches):
        def seen():
            for b in batches:
                longest.add(sum(n > 4 for n in b.column("n").value_lengths().to_pylist() if n is not None))
                yield b
        return documents(seen())

    monkeypatch.setattr(A, "_documents", watched)
    assert sorted(map(tuple, A.alignment(df).collect())) == want
    assert longest.value == 0


def test_alignment_of_many_blocks_in_a_task(monkeypatch):
    import pyarrow as pa
    from tertulia.llm import token_align as A
    schema = pa.schema([("block", pa.int64()), ("pos", pa.int32()), ("n", pa.list_(pa.int64())), ("best", pa.list_(pa.int64())), ("doc_id", pa.string()),
                        *[(c, pa.int64()) for c in A.COUNTS], ("groups_sha256", pa.string()),
                        ("idx", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])
    entry = lambda b, p, n, best: dict(block=b, pos=p, n=n, best=best)
    doc = lambda b, i, idx, times: dict(block=b, doc_id=i, n_a=1, n_b=2, n_groups=3, n_links=4, groups_sha256="", idx=idx, times=times)
    rows = [entry(1, 0, [5], [1]), entry(1, 1, [7], [0]), doc(1, "a", [0, 1], [2, 3]), doc(1, None, [], []), doc(1, "a", [1], [1 << 40]),
            doc(2, "b", [], []), entry(3, 0, [11], [1]), doc(3, "c", [0], [2])]
    want = [("a", 2, 31), (None, 0, 0), ("a", 0, 7 << 40), ("b", 0, 0), ("c", 2, 22)]
    for size in (1, 2, 3, len(rows)):  # blocks and dictionaries that go on in the next batch
        batches = [pa.RecordBatch.from_pylist(rows[i:i + size], schema) for i in range(0, len(rows), size)]
        got = [r for b in A._documents(iter(batches)) for r in b.to_pylist()]
        assert [(r["doc_id"], r["n_best"], r["count_sum"]) for r in got] == want


def test_alignment_forgets_long_chunks(monkeypatch):
    from tertulia.llm import token_align as A
    monkeypatch.setattr(A, "REMEMBERED_BYTES", 20_000)
    al = A.Aligner(A.BYTE_BPE, A.PIECE_BPE)
    for i in range(12):  # one chunk each, without blanks
        A.block_of(al, [f"{i}" + "xyzw" * 500])
        assert sum(map(len, al.texts)) < 40_000


# classify_lr_counts: what lies on disk.
def test_regression_leaves_one_copy_of_its_state(spark, monkeypatch):
    import os
    import random
    from urllib.parse import urlparse
    from tertulia.operators import classify as M
    from tertulia.operators import wide_regression as W
    full = M.logistic_regression
    monkeypatch.setattr(M, "logistic_regression", lambda *a: full(*a).setMaxIter(14))
    monkeypatch.setattr(M, "DRIVER_COEFFICIENTS", 8)
    monkeypatch.setattr(W, "HISTORY", 4)
    root = os.path.dirname(urlparse(W.scratch_dir(spark, "x")).path)
    checkpoints = lambda: {d for d, _, files in os.walk(root) if os.path.basename(d).startswith("rdd-")}
    before, lying = checkpoints(), []
    settled = W._forget
    monkeypatch.setattr(W, "_forget", lambda sc, path: (settled(sc, path), lying.append(len(checkpoints() - before))))
    rng = random.Random(3)
    rows = [(i, ("train", "train", "dev")[i % 3], i % 3, [f"w{rng.randrange(30)}" for _ in range(9)] + [f"c{i % 3}"] * rng.randrange(2)) for i in range(90)]
    df = spark.createDataFrame(rows, "tweet_id long, split string, sentiment int, toks array<string>").repartition(3)
    assert M.text_classifier(df, "toks", "sentiment", "split").count() == 30
    # Counts, rows, coefficients, the history, and the new rows, coefficients and pair until the old ones go.
    assert 6 < max(lying) <= 4 + 6
    assert checkpoints() == before


def test_packed_pieces():
    import numpy as np
    from tertulia.operators import wide_regression as W
    new, lens = np.array([True, False, True, True]), np.array([2, 1, 1, 2])
    rows, counts = np.array([3, 9, 11, 2, 0, 10], "i4"), np.array([1, 2, 1, 300, 1, 1], "i4")
    cell = W._cell(new, lens, rows, counts, 10)
    got = W._unpacked(W._packed(cell))
    flat = lambda c: [x.tolist() for p in c for x in (p if isinstance(p, tuple) else (p,))]
    assert flat(got) == flat(cell) and got[0][1].dtype == cell[0][1].dtype


def test_products_of_state_and_history():
    import numpy as np
    from tertulia.operators import wide_regression as W
    rng = np.random.default_rng(1)
    v = lambda: rng.normal(size=(5, 2))
    g, s, y, s0, y0 = v(), *(v().astype("f4") for _ in range(4))
    got, = W._products(iter([(0, ("full", v(), g)), (0, ("pair", 1, s, y)), (0, ("pair", 0, s0, y0))]))
    named = {"g": g, ("s", 1): s, ("y", 1): y, ("s", 0): s0, ("y", 0): y0}
    assert {k for k in got} == {(a, b) for a in named for b in named if {a, b} & {"g", ("s", 1), ("y", 1)}}
    assert all(abs(x - W.dot(named[a], named[b])) < 1e-9 for (a, b), x in got.items())


# token_pipeline: only what changes is shuffled by term.
def test_token_pipeline_of_odd_rows(spark, monkeypatch):
    from tertulia.operators import token_pipeline as P
    corrections = spark.createDataFrame([("holla", "hola", "corrected"), ("ñu", "ño", "corrected"), ("x", "x", "unknown")],
                                        "term string, correction string, status string")
    mapping = spark.createDataFrame([("hola", "buenas"), ("q", "que")], "term string, canonical string")
    rows = [(1, ["holla", "q", "ñu", "a b", "holla"]), (2, []), (3, None), (4, ["x", None, "", "q"]), (None, ["hola"]),
            (None, ["z", "holla"]), (5, ["b", "q"]), (5, ["holla", "a"]), (6, ["z"])]
    df = spark.createDataFrame(rows, "id long, t array<string>").repartition(3)
    want = [(None, ["buenas", "z", "buenas"]), (1, ["buenas", "que", "ño", "a b", "buenas"]), (2, []), (3, []), (4, ["x", "", "que"]),
            (5, ["b", "buenas", "a", "que"]), (6, ["z"])]
    for common in (1, 2, 100):
        monkeypatch.setattr(P, "COMMON_TERMS", common)
        got = [(r.id, r.tokens) for r in P.token_pipeline(df, "id", "t", corrections, mapping).collect()]
        assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0)) == want


def test_token_pipeline_moves_documents_not_tokens(spark):
    from tertulia.operators.token_pipeline import token_pipeline
    corrections = spark.createDataFrame([("holla", "hola", "corrected")], "term string, correction string, status string")
    df = spark.createDataFrame([(i, ["a", "b", "c", "holla"] * 50) for i in range(20)], "id long, t array<string>")
    plan = token_pipeline(df, "id", "t", corrections)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan.lower()
