"""Hard-negative mining with Kronecker-packed products.

Components become integers, floor(256 x).  Of every block of candidates the
components are shifted to be non-negative and several candidates are packed
into the fields of one wide integer, so that one product with an anchor's
component multiplies all of them; the sum over the components holds one exact
inner product a field, which a shift and a mask take out and the shift's share
(bias times the sum of the anchor's components) is taken off.  A field is as
wide as the block's largest possible sum.  Two fields or more fit the 53 exact
bits of a double for components of usual size, where the products are one
matrix product; wider sums go into Python's unbounded integers by the same
scheme.  Scores are exact either way.

All anchors meet all rows: rows are dealt by a hash to parts of ``ROWS`` at
most on average, anchors to blocks of ``ANCHORS``, and one task holds one part
and one block.  The first pass finds each anchor's best rows of its own label,
the second, knowing these scores, the best other rows in the window below each
of them; a task gives at most ``k`` rows for each anchor (and positive), which
a window function merges.  Hot labels and repeated vectors spread with the hash.

Defined results: rows with a null id, label or vector, or with any component
null, not finite or so large that 256 times it is not finite take no part.
Rows are told apart by a key written with them, not by id: of repeated rows,
each is an anchor, a positive and a negative of its own.  Shorter vectors count
as padded with zeros.  An empty table, anchors without other rows of their
label and positives without a negative in their window give no rows; negative
positive scores have an empty window.  A score beyond 64 bits is an error.
Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this many hundredths of the positive's.
FLOOR = 80
ROWS = 32_768
ANCHORS = 16_384
#: Scores held at a time.
CELLS = 4_000_000
#: Bits of an integer that a double holds exactly, less a sign; fields of an unbounded integer.
DOUBLE_BITS = 52
WIDE_FIELDS = 16
NONE = np.iinfo(np.int64).min


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The exact inner products of integer vectors (held as doubles): int64, or Python integers where 64 bits
    could be too few."""
    n = len(rows)
    bias = max(0, -int(rows.min())) if rows.size else 0
    if not rows.size or not anchors.size:
        return np.zeros((len(anchors), n), np.int64)
    l1 = [int(v) for v in np.abs(anchors).sum(1)] if np.abs(anchors).max() < 2.0 ** 40 else \
        [sum(abs(int(x)) for x in a) for a in anchors]
    most = max(l1) * (int(rows.max()) + bias)
    width = most.bit_length() + 2
    fields = DOUBLE_BITS // width
    if fields:
        word = np.zeros((-(-n // fields), rows.shape[1]))
        for f in range(fields):
            part = rows[f::fields]
            word[:len(part)] += (part + bias) * 2.0 ** (width * f)
        offset = sum(1 << (width * (f + 1) - 1) for f in range(fields))
        total = (anchors @ word.T).astype(np.int64) + offset
        out = np.empty((len(anchors), len(word) * fields), np.int64)
        for f in range(fields):
            out[:, f::fields] = ((total >> (width * f)) & ((1 << width) - 1)) - (1 << (width - 1))
        return out[:, :n] - bias * anchors.sum(1).astype(np.int64)[:, None]
    whole = np.vectorize(int, otypes=[object])
    a, fields = whole(anchors), WIDE_FIELDS
    word = np.zeros((-(-n // fields), rows.shape[1]), object)
    for f in range(fields):
        part = rows[f::fields]
        if len(part):
            word[:len(part)] += (whole(part) + bias) * (1 << (width * f))
    offset = sum(1 << (width * (f + 1) - 1) for f in range(fields))
    total = a @ word.T + offset
    out = np.empty((len(anchors), len(word) * fields), object)
    for f in range(fields):
        out[:, f::fields] = ((total >> (width * f)) & ((1 << width) - 1)) - (1 << (width - 1))
    return out[:, :n] - bias * a.sum(1)[:, None]


def order_keys(scores: np.ndarray) -> np.ndarray:
    """int64 keys, distinct within a row, larger for a higher score and then an earlier column."""
    n = scores.shape[1]
    if scores.dtype == object or (scores.size and int(np.abs(scores).max()) * n >= 1 << 61):
        scores = np.unique(scores, return_inverse=True)[1].reshape(scores.shape).astype(np.int64)
    return scores * n + (n - 1 - np.arange(n))


def best(keys: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest keys of each row, largest first."""
    k = min(k, keys.shape[1])
    at = np.argpartition(keys, keys.shape[1] - k, axis=1)[:, keys.shape[1] - k:] if k else np.zeros((len(keys), 0), np.int64)
    return np.take_along_axis(at, np.argsort(np.take_along_axis(keys, at, 1), axis=1)[:, ::-1], 1)


def _vectors(*tables: pa.Table) -> list[np.ndarray]:
    """The integer vectors of the tables as matrices of one width."""
    columns = [t["embedding"].combine_chunks() for t in tables]
    sizes = [c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    width = max([1, *(int(s.max()) for s in sizes if len(s))])
    out = []
    for c, s in zip(columns, sizes):
        m = np.zeros((len(s), width))
        m[np.arange(width) < s[:, None]] = np.floor(SCALE * c.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        out.append(m)
    return out


def _slices(n: int, columns: int):
    step = max(1, CELLS // max(1, columns))
    return (slice(i, i + step) for i in range(0, n, step))


def _gathered(parts: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(np.concatenate([p[f.name] for p in parts]) if parts else [], f.type) for f in schema}, schema)


BEST_ROWS = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def best_rows(k: int, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Of a part of the rows, each anchor's ``k`` best of its label but itself."""
    rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    a, c = _vectors(anchors, rows)
    a_row, a_label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
    c_row, c_id, c_label = (rows[x].to_numpy() for x in ("row", "vec_id", "label"))
    parts = []
    for label in np.unique(a_label):
        mine, theirs = np.flatnonzero(a_label == label), np.flatnonzero(c_label == label)
        for s in _slices(len(mine), len(theirs)):
            i = mine[s]
            scores = packed_scores(a[i], c[theirs])
            keys = np.where(c_row[theirs] == a_row[i][:, None], NONE, order_keys(scores))
            at = best(keys, k)
            r, q = np.nonzero(np.take_along_axis(keys, at, 1) != NONE)
            j = at[r, q]
            parts.append({"anchor": a_row[i][r], "row": c_row[theirs][j], "vec_id": c_id[theirs][j], "score": scores[r, j]})
    return _gathered(parts, BEST_ROWS)


BEST_NEGATIVES = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("nth", pa.int64()), ("positive_id", pa.int64()),
                            ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def best_negatives(k: int, floor: int, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Of a part of the rows, each positive's ``k`` best of other labels in its window."""
    rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    a, c = _vectors(anchors, rows)
    a_row, a_id, a_label = (anchors[x].to_numpy() for x in ("row", "vec_id", "label"))
    c_id, c_label = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    positives = anchors["positives"].to_pylist()
    most = max(map(len, positives), default=0)
    parts = []
    for s in _slices(len(a), len(c)):
        i = np.arange(len(a))[s]
        scores = packed_scores(a[i], c)
        keys = np.where(c_label == a_label[i][:, None], NONE, order_keys(scores))
        for nth in range(most):
            have = [x for x in range(len(i)) if len(positives[i[x]]) > nth and positives[i[x]][nth]["score"] >= 0]
            if not have:
                continue
            mine = [positives[i[x]][nth] for x in have]
            p_id, p_score = (np.array([p[x] for p in mine], object if x == "score" else np.int64) for x in ("vec_id", "score"))
            if scores.dtype != object:
                p_score = p_score.astype(np.int64)
            sub = scores[have]
            window = np.where((sub <= p_score[:, None]).astype(bool), keys[have], NONE)
            at = best(window, k)
            near = (np.take_along_axis(sub, at, 1) * 100 >= floor * p_score[:, None]).astype(bool)
            r, q = np.nonzero(near & (np.take_along_axis(window, at, 1) != NONE))
            j, w = at[r, q], i[np.array(have)[r]]
            parts.append({"anchor": a_row[w], "anchor_id": a_id[w], "nth": np.full(len(w), nth), "positive_id": p_id[r],
                          "positive_score": p_score[r], "negative_id": c_id[j], "negative_score": sub[r, j]})
    return _gathered(parts, BEST_NEGATIVES)


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, parts: int, work, schema: str) -> DataFrame:
    """``work`` on every block of anchors with every part of the rows."""
    a = anchors.select("*", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("_b"),
                       F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("_p"))
    c = rows.select("*", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("_b"),
                    F.pmod(F.xxhash64("row"), F.lit(parts)).alias("_p"))
    return a.groupBy("_b", "_p").cogroup(c.groupBy("_b", "_p")).applyInArrow(work, schema)


def usable(vectors: DataFrame) -> DataFrame:
    """The rows that take part, each with its key ``row``, in a written table."""
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < 7e305, F.lit(False)))
    return stored(vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label"),
                                 F.monotonically_increasing_id().alias("row"))
                  .filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(fine), "hard-rows")


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   floor: int = FLOOR) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that
    ``is_anchor`` (a condition on vec_id) and each of its ``positives`` best others of its label, the
    ``negatives`` best rows of other labels that score at most as much, and ``floor`` % of it at least;
    ties go to the smaller vec_id."""
    rows = usable(vectors)
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("a")).first()
    blocks = max(1, math.ceil(count["a"] / ANCHORS))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(count["n"] / ROWS))
    anchors = rows.filter(is_anchor)
    found = _met(anchors, rows, blocks, parts, functools.partial(best_rows, positives),
                 "anchor long, row long, vec_id long, score long")
    nth = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row"))
    kept = (found.withColumn("nth", nth).filter(F.col("nth") <= positives).groupBy("anchor")
            .agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("positives")))
    known = stored(anchors.join(kept, anchors["row"] == kept["anchor"]).drop("anchor"), "hard-anchors")
    near = _met(known, rows, blocks, parts, functools.partial(best_negatives, negatives, floor),
                "anchor long, anchor_id long, nth long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor", "nth").orderBy(F.desc("negative_score"), "negative_id"))
    return (near.withColumn("rank", rank).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """Labels of every seventh id moved on by one, as mislabelled rows are."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
