"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are parted by norm into ranges of a factor of two, within which the
largest inner product is close to the nearest direction.  Directions are padded
to a power of two (if they have not one) and turned by pseudo-rotations: three
rounds of random signs and a fast Hadamard transform.  A vector's hash in a
table is the signed axis nearest to it, or the axes of two or three rotations
together: more of them, and so more and smaller buckets, the more vectors there
are (``SETTINGS``).  In each range, a query looks into the ``probes`` buckets of
the greatest summed closeness to their axes in each of ``tables`` tables, and
it meets all vectors of the ranges that hold fewer than ``SMALL``; what it meets
is ranked by the inner product of the original vectors in double precision.
Queries that met fewer than ``k`` + 1 ids probe four times as many buckets,
until they have them or meet all vectors.

Equal vectors are one class that carries its ``k`` + 1 smallest ids, all that
a result can need, so a vector that a third of the rows share costs one entry.
Counts of the parts of tables (at most ``tables`` x ``PARTS`` a range) come to the driver;
from them, both sides of a crowded part of a table are dealt to blocks of ``BLOCK``
candidates and ``BLOCK`` queries, every candidate block meeting every query
block, so that no group grows with the input and nothing is dropped.

Defined results: rows whose vector is null, all zero, or holds null or
non-finite components, rows with a null id, and vectors not of the table's
most common length take no part; repeated (id, vector) rows count once; an
empty table gives no rows; a table of ``k`` ids or fewer gives fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, short

#: By the number of hashed vectors, at most: rotations a hash, tables, probes.
SETTINGS = [(8192, (1, 8, 16)), (1 << 23, (2, 12, 192)), (None, (3, 24, 1024))]
#: Axes of one rotation that a query combines with those of the others, at least.
NEAR_AXES = 48
K = 20
BLOCK = 16_384
#: Groups that the buckets of a table are dealt to.
PARTS = 4
#: Norm ranges of fewer vectors than this are not hashed: every query meets all of them, as group WHOLE.
SMALL = 256
WHOLE = -1
GROUP_KEYS = ["g", "t", "part", "cs", "qs"]


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    signs = np.random.default_rng([7, table]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in a power of two of dimensions."""
    out = np.zeros((len(x), 1 << (x.shape[1] - 1).bit_length()))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    out[:, :x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def _first(score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the n highest scores of each row, highest first, and these scores."""
    near = np.argpartition(-score, min(n, score.shape[1] - 1), axis=1)[:, :n]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1)
    return near, np.take_along_axis(score, near, 1)


def buckets(x: np.ndarray, table: int, n: int, rotations: int = 1) -> np.ndarray:
    """The n buckets of a table nearest to each row, nearest first.  A bucket is the signed axes of its rotations
    (2 i for +i, 2 i + 1 for -i) as digits; its closeness is the sum of the row's components along them."""
    out = score = None
    for j in range(rotations):
        r = rotate(x, table * 3 + j)
        along = np.stack([r, -r], 2).reshape(len(r), 2 * r.shape[1])
        wide = n if rotations == 1 or n == 1 else max(NEAR_AXES, 3 * int(n ** (1 / rotations)))
        axis, value = _first(along, min(wide, along.shape[1]))
        if out is None:
            out, score = axis, value
            continue
        both = (score[:, :, None] + value[:, None, :]).reshape(len(x), score.shape[1] * value.shape[1])
        pick, score = _first(both, min(n, both.shape[1]))
        out = (np.take_along_axis(out, pick // axis.shape[1], 1) * along.shape[1]
               + np.take_along_axis(axis, pick % axis.shape[1], 1))
    return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def vector_classes(vectors: DataFrame, k: int, is_query) -> DataFrame:
    """(a, b, v, ids, q, size): distinct usable vectors, their k + 1 smallest ids, whether one is a query, log2 of the norm."""
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                        F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("v"))
         .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & usable & F.exists("v", lambda x: x != 0)))
    v = v.select("vec_id", "v", F.size("v").alias("n"), F.xxhash64("v").alias("a"), F.xxhash64("v", F.lit(7)).alias("b"))
    width = v.groupBy("n").count().orderBy(F.col("count").desc(), "n").select("n").first()
    v = v.filter(F.col("n") == (width["n"] if width else 0))
    ids = v.select("a", "b", "vec_id").distinct()
    first = W.partitionBy("a", "b").orderBy("vec_id")
    few = (ids.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
           .groupBy("a", "b").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    q = ids.groupBy("a", "b").agg(F.max(is_query(F.col("vec_id"))).alias("q"))
    classes = v.groupBy("a", "b").agg(F.first("v").alias("v")).join(few, ["a", "b"]).join(q, ["a", "b"])
    top = F.array_max(F.transform("v", F.abs))
    scaled = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top")))
    return classes.withColumn("top", top).withColumn("size", F.log2("top") + F.log2(scaled) / 2).drop("top")


def _groups(batch: pa.RecordBatch, parts: dict[int, int]) -> np.ndarray:
    """The search group of each row: its norm range if that is hashed, else WHOLE."""
    return np.array([r if r in parts else WHOLE for r in batch["r"].to_pylist()], np.int64)


def _bucket_counts(classes: DataFrame, rotations: int, tables: int, probes: int, parts: dict[int, int]) -> tuple[dict, dict]:
    """(group, table, part) -> candidates there, (parts, table, part) -> queries that probe a bucket of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, q = unit(_matrix(b["v"])), b["q"].to_numpy(zero_copy_only=False).astype(bool)
            g = _groups(b, parts)
            found = [(WHOLE, 1, 0, 0, int((g == WHOLE).sum()), int(q.sum()))]
            for t in range(tables if parts else 0):
                m = np.array([parts.get(r, 1) for r in g.tolist()], np.int64)
                own = np.stack([g, m, buckets(x, t, 1, rotations)[:, 0] % m], 1)[g != WHOLE]
                at, n = np.unique(own, axis=0, return_counts=True)
                found += [(r, m, t, part, c, 0) for (r, m, part), c in zip(at.tolist(), n.tolist())]
                near = buckets(x[q], t, probes, rotations)
                for m in set(parts.values()):
                    asked = np.zeros((len(near), m), bool)
                    np.put_along_axis(asked, near % m, True, 1)
                    found += [(None, m, t, part, 0, c) for part, c in enumerate(asked.sum(0).tolist())]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], ["g", "m", "t", "part", "nc", "nq"])

    rows = (classes.select("v", "q", "r").mapInArrow(run, "g long, m long, t long, part long, nc long, nq long")
            .groupBy("g", "m", "t", "part").agg(F.sum("nc").alias("nc"), F.sum("nq").alias("nq")).collect())
    return ({(r["g"], r["t"], r["part"]): r["nc"] for r in rows if r["nc"]},
            {(r["m"] if r["g"] is None else WHOLE, r["t"], r["part"]): r["nq"] for r in rows if r["nq"]})


def _splits(candidates: dict, asked: dict, parts: dict[int, int], block: int) -> dict:
    """(group, table, part) -> numbers of candidate and of query blocks."""
    return {(g, t, part): tuple(max(1, -(-x // block)) for x in (n, asked.get((parts.get(g, WHOLE), t, part), 0)))
            for (g, t, part), n in candidates.items()}


def _deal(classes: DataFrame, rotations: int, tables: int, probes: int, parts: dict[int, int], splits: dict) -> DataFrame:
    """Rows of the search groups: candidates with their bucket, queries with the buckets they probe there."""
    schema = ("g long, t long, part long, cs long, qs long, query boolean, buckets array<long>, a long, b long, "
              "ids array<long>, v array<double>")
    hashed = {m: [g for g in sorted(parts) if parts[g] == m] for m in sorted(set(parts.values()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, q = unit(_matrix(b["v"])), b["q"].to_numpy(zero_copy_only=False).astype(bool)
            key = b["a"].to_numpy().view(np.uint64)
            groups = _groups(b, parts)
            asking = np.flatnonzero(q)
            for t in range(tables if parts else 1):
                rows, keys, used = [], [], []

                def candidate(i: int, g: int, axis: int) -> None:
                    part = axis % parts.get(g, 1)
                    nc, nq = splits[g, t, part]
                    for s in range(nq):
                        rows.append(i)
                        keys.append((g, t, part, int(key[i] % nc), s, False))
                        used.append([axis])

                def query(i: int, g: int, part: int, probed: list[int]) -> None:
                    nc, nq = splits.get((g, t, part), (0, 0))
                    for s in range(nc):
                        rows.append(i)
                        keys.append((g, t, part, s, int((key[i] >> np.uint64(20)) % nq), True))
                        used.append(probed)

                if t == 0:
                    for i in np.flatnonzero(groups == WHOLE).tolist():
                        candidate(i, WHOLE, 0)
                    for i in asking.tolist():
                        query(i, WHOLE, 0, [0])
                if parts:
                    own = buckets(x, t, 1, rotations)[:, 0]
                    for i in np.flatnonzero(groups != WHOLE).tolist():
                        candidate(i, int(groups[i]), int(own[i]))
                    for i, near in zip(asking.tolist(), buckets(x[q], t, probes, rotations).tolist()):
                        for m, ranges in hashed.items():
                            by_part: dict[int, list[int]] = {}
                            for axis in near:
                                by_part.setdefault(axis % m, []).append(axis)
                            for g in ranges:
                                for part, probed in by_part.items():
                                    query(i, g, part, probed)
                for at in range(0, len(rows), 10_000):
                    take = pa.array(rows[at:at + 10_000], pa.int64())
                    cols = list(zip(*keys[at:at + 10_000]))
                    yield pa.record_batch(
                        [*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.bool_()),
                         pa.array(used[at:at + 10_000], pa.list_(pa.int64())),
                         *(b[c].take(take) for c in ("a", "b", "ids", "v"))],
                        ["g", "t", "part", "cs", "qs", "query", "buckets", "a", "b", "ids", "v"])

    return classes.mapInArrow(run, schema)


def _search(k: int):
    out = pa.schema([("qa", pa.int64()), ("qb", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group["query"].to_numpy()
        c, q = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
        if not len(c) or not len(q):
            return out.empty_table()
        cv, qv = _matrix(c["v"]), _matrix(q["v"])
        own = c["buckets"].combine_chunks().flatten().to_numpy()
        probed = q["buckets"].combine_chunks()
        asker = np.repeat(np.arange(len(q)), probed.value_lengths().to_numpy())
        probed = probed.flatten().to_numpy()
        lowest = np.array([x[0] for x in c["ids"].to_pylist()])
        best: list[list[np.ndarray]] = [[] for _ in range(len(q))]
        by_own, by_probe = np.argsort(own, kind="stable"), np.argsort(probed, kind="stable")
        met = np.intersect1d(own, probed)
        spans = [np.searchsorted(s, met, side).tolist() for s in (own[by_own], probed[by_probe]) for side in ("left", "right")]
        for a0, a1, w0, w1 in zip(*spans):
            at, who = np.sort(by_own[a0:a1]), asker[by_probe[w0:w1]].tolist()
            for lo in range(0, len(who), 256):
                some = who[lo:lo + 256]
                s = qv[some] @ cv[at].T
                if len(at) > k + 1:
                    edge = -np.partition(-s, k, axis=1)[:, k]
                    edge -= 1e-9 * (1 + np.abs(edge))  # all ties and what rounding may hide stay
                    keep = s >= edge[:, None]
                else:
                    keep = np.ones(s.shape, bool)
                for i, row in zip(some, keep):
                    best[i].append(at[row])
        qa, qb, ids, scores = [], [], [], []
        own_ids = c["ids"].to_pylist()
        a, b = q["a"].to_numpy(), q["b"].to_numpy()
        for i, found in enumerate(best):
            if not found:
                continue
            at = np.concatenate(found)
            s = np.einsum("ij,j->i", cv[at], qv[i])
            order = np.lexsort((lowest[at], -s))[:k + 1]
            rows = sorted((-float(s[o]), x) for o in order.tolist() for x in own_ids[at[o]])[:k + 1]
            qa += [a[i]] * len(rows)
            qb += [b[i]] * len(rows)
            ids += [x for _, x in rows]
            scores += [-x for x, _ in rows]
        return pa.table([pa.array(qa, pa.int64()), pa.array(qb, pa.int64()), pa.array(ids, pa.int64()),
                         pa.array(scores, pa.float64())], out)

    return run


def _lists(classes: DataFrame, k: int, rotations: int, tables: int, probes: int, parts: dict[int, int], block: int) -> DataFrame:
    """(qa, qb, l): the k + 1 nearest that each query class met, as (r, vec_id, score)."""
    splits = _splits(*_bucket_counts(classes, rotations, tables, probes, parts), parts, block)
    dealt = _deal(classes, rotations, tables, probes, parts, splits)
    found = (dealt.groupBy(*GROUP_KEYS).applyInArrow(_search(k), "qa long, qb long, vec_id long, score double")
             .groupBy("qa", "qb", "vec_id").agg(F.max("score").alias("score")))
    near = W.partitionBy("qa", "qb").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
            .groupBy("qa", "qb").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("l")))


def nearest(vectors: DataFrame, k: int = K, tables: int | None = None, probes: int | None = None, block: int = BLOCK,
            is_query=lambda vec_id: F.pmod(vec_id, F.lit(20)) == 0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each query row
    of ``vectors`` (vec_id, embedding), nearest first, ties to the smaller id."""
    classes = cut(vector_classes(vectors, k, is_query))
    top = classes.agg(F.max("size"), F.max(F.size("v"))).first()
    classes = classes.withColumn("r", F.floor(F.lit(top[0] or 0.0) - F.col("size")).cast("long")).drop("size")
    sizes = [(r["r"], r["count"]) for r in classes.groupBy("r").count().collect()]
    parts = {r: min(PARTS, n // SMALL) for r, n in sizes if n >= SMALL}
    hashed = sum(n for _, n in sizes if n >= SMALL)
    rotations, own_tables, own_probes = next(s for most, s in SETTINGS if most is None or hashed <= most)
    tables, probes = tables or own_tables, probes or own_probes
    n_buckets = (2 << ((top[1] or 1) - 1).bit_length()) ** rotations
    asking, lists = classes, None
    while True:
        if probes >= (n_buckets if rotations == 1 else n_buckets // 8):
            parts = {}
        met = cut(_lists(asking, k, rotations, tables, probes, parts, block))
        full = met.filter(F.size("l") > k) if parts else met
        lists = full if lists is None else lists.unionAll(full)
        left = asking.filter("q").select("a", "b").join(
            full.select(F.col("qa").alias("a"), F.col("qb").alias("b")), ["a", "b"], "left_anti")
        if not parts or (left := cut(left)).isEmpty():
            break
        asking = classes.drop("q").join(short(left.withColumn("q", F.lit(True))), ["a", "b"], "left").withColumn(
            "q", F.coalesce("q", F.lit(False)))
        probes *= 4
    queries = (vectors.select(F.col("vec_id").cast("long").alias("query_id"),
                              F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("v"))
               .filter(is_query(F.col("query_id")) & F.col("v").isNotNull())
               .select("query_id", F.xxhash64("v").alias("qa"), F.xxhash64("v", F.lit(7)).alias("qb")).distinct())
    others = F.filter("l", lambda x: x["vec_id"] != F.col("query_id"))
    return (queries.join(lists, ["qa", "qb"])
            .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("p", "x"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"))
