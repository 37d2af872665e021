"""Multinomial logistic regression on more terms than the driver can hold.

The same fit as MLlib's ``LogisticRegression`` without standardization (L2
penalty, intercept, L-BFGS over terms scaled by their deviation, strong Wolfe
steps, the same stopping rules), with every vector over the terms kept in the
cluster: terms lie in blocks, each with its column slice of the counts, its
coefficients and its part of the L-BFGS history.  The step comes from the dot
products of the history (vector-free L-BFGS), so the driver sees those, the
intercepts and losses only.  Per iteration the rows' residuals go to the blocks
and the blocks' margins to the rows; the counts themselves never move again.
Counts, rows, coefficients and each pair of the history lie once in the checkpoint
folder (the counts compressed), superseded ones go at once, and what a step shuffled
goes every few steps, as nothing refers to it.

The classes' coefficients sum to 0 as their gradients do, so the last class is
not kept.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir

HISTORY = 10
CUT_EVERY = 3  # iterations after which the driver collects garbage, and so the shuffle files of steps
CELL_COUNTS = 1 << 20  # counts a piece of a term block holds
TEXTS_AT_ONCE = 2048
ROWS_A_BLOCK = 1 << 16
DISK = StorageLevel.DISK_ONLY


def _home(key: int) -> int:
    return key


def _placed(rdd: RDD, n: int) -> RDD:
    return rdd.partitionBy(n, _home)


# ---------------------------------------------------------------------------
# Counts by term block
# ---------------------------------------------------------------------------
def _numbered(df: DataFrame, first: int) -> tuple[DataFrame, int]:
    """``df``, a written table or rows of it (read in the same order each time),
    with dense row numbers ``_at`` from ``first``, and the number after the last."""
    df = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    starts, at = [], first
    for part, n in sorted((r[0], r[1]) for r in df.groupBy("_part").count().collect()):
        starts.append((part, at))
        at += n
    starts = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    df = df.join(F.broadcast(starts), "_part")
    return df.withColumn("_at", (F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")).drop("_id", "_part", "_start"), at


def _postings(batches):
    """(row number, tokens) -> (term, rows, counts), a row per term of a batch."""
    for b in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
        toks = b.column(1)
        pairs = pa.table({"term": pc.list_flatten(toks), "row": b.column(0).take(pc.list_parent_indices(toks))})
        pairs = pairs.group_by(["term", "row"]).aggregate([([], "count_all")]).sort_by([("term", "ascending"), ("row", "ascending")])
        if not pairs.num_rows:
            continue
        term = pairs["term"].combine_chunks()
        new = np.append(True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False))
        at = pa.array(np.append(np.flatnonzero(new), len(new)), pa.int32())
        yield pa.RecordBatch.from_arrays([
            term.filter(pa.array(new)), pa.ListArray.from_arrays(at, pairs["row"].combine_chunks().cast(pa.int32())),
            pa.ListArray.from_arrays(at, pairs["count_all"].combine_chunks().cast(pa.int32()))], names=["term", "rows", "counts"])


def _cell(new, lens, rows, counts, n: int):
    """A piece of a term block: the training rows' and the other rows' counts by
    term, of the terms that training rows have, with their mean and 1/deviation."""
    col = np.repeat(np.cumsum(new) - 1, lens)
    fit = rows < n
    in_rows = np.bincount(col[fit], minlength=int(new.sum()))
    known = in_rows > 0
    total = np.bincount(col[fit], counts[fit], len(known))[known]
    squares = np.bincount(col[fit], counts[fit].astype("f8") ** 2, len(known))[known]
    mean = total / n
    spread = np.sqrt(np.maximum(squares - n * mean * mean, 0.0) / max(n - 1, 1))
    fits = in_rows[known] < n  # the same count everywhere: rounding must not make a deviation of it
    spread = np.where(fits | (spread > 1e-9), spread, 0.0)
    rest = ~fit & known[col]
    kind = "u1" if counts.max() < 256 else "u4"
    part = lambda at, k: (k, rows[at], counts[at].astype(kind))
    return (part(fit, in_rows[known]), part(rest, np.bincount(col[rest], minlength=len(known))[known]), mean,
            np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0))


def _packed(cell) -> bytes:
    """A piece for the cluster's disks: its rows as differences, compressed."""
    (lens, rows, counts), (lens_rest, rows_rest, counts_rest), *terms = cell
    steps = lambda x: np.diff(x, prepend=x.dtype.type(0))
    raw = pickle.dumps(((lens.astype("i4"), steps(rows), counts), (lens_rest.astype("i4"), steps(rows_rest), counts_rest), *terms), 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes):
    raw = pa.decompress(pa.py_buffer(packed)[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd")
    *parts, mean, inverse = pickle.loads(raw)
    return (*((lens, np.cumsum(rows, dtype=rows.dtype), counts) for lens, rows, counts in parts), mean, inverse)


def _cells(n: int):
    """Postings sorted by term -> the pieces of the partition's term block, pickled."""
    def run(batches):
        j = TaskContext.get().partitionId()
        held, last = [], None

        def emit(parts):
            cell = _cell(*parts, n)
            if len(cell[2]):
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([_packed(cell)], pa.binary())], names=["j", "cell"])

        for b in batches:
            if not b.num_rows:
                continue
            term, rows, counts = b.columns
            new = np.append(term[0].as_py() != last, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)).astype(bool)
            last = term[-1].as_py()
            held.append((new, pc.list_value_length(rows).to_numpy(zero_copy_only=False), pc.list_flatten(rows).to_numpy(), pc.list_flatten(counts).to_numpy()))
            if sum(len(h[2]) for h in held) >= CELL_COUNTS:
                new, lens, rows, counts = (np.concatenate(x) for x in zip(*held))
                cut = np.flatnonzero(new)[-1]  # the last term may go on in the next batch
                at = int(lens[:cut].sum())
                held = [(new[cut:], lens[cut:], rows[at:], counts[at:])]
                if cut:
                    yield from emit((new[:cut], lens[:cut], rows[:at], counts[:at]))
        if held:
            yield from emit(tuple(np.concatenate(x) for x in zip(*held)))

    return run


# ---------------------------------------------------------------------------
# What a block does
# ---------------------------------------------------------------------------
def dot(a: np.ndarray, b: np.ndarray) -> float:
    """Inner product over all classes of two vectors without the last."""
    a, b = a.astype("f8"), b.astype("f8")
    return float((a * b).sum() + (a.sum(1) * b.sum(1)).sum())


def _margins(items, part: int, first: int, n: int, size: int):
    """Coefficients, then cells -> (row block, margins of its rows) of this term block."""
    out, w, lo = None, None, 0
    for j, (tag, *x) in items:
        if tag == "cell":
            x = _unpacked(*x)
            lens, rows, counts = x[part]
            hi = lo + len(lens)
            c, counts = w[lo:hi] * x[3][:, None], counts.astype("f8")
            at = rows - first if first else rows
            for k in range(out.shape[0]):
                out[k] += np.bincount(at, counts * np.repeat(c[:, k], lens), n)
            lo = hi
        elif tag in ("d", "full"):
            w = x[0]
            out = np.zeros((w.shape[1], n))
    if out is not None:
        for i in range(0, n, size):
            yield i // size, ("part", out[:, i:i + size].T.copy())


def _stepped(items, alpha: float, k: int, n: int, classes: int, reg: float):
    """Old state, direction, residuals, older pairs, cells -> state and pair after
    the step, and the dot products of the new vectors as ``("dots", ...)``."""
    r, d, w, g, lo, grads, inverse = np.zeros((n, classes - 1)), None, None, None, 0, [], []
    where, by_class = None, None
    for j, (tag, *x) in items:
        where = j
        if tag == "r":
            r[x[0]:x[0] + len(x[1])] = x[1]
        elif tag == "d":
            d = x[0]
        elif tag == "full":
            w, g = x
        elif tag == "cell":
            x = _unpacked(*x)
            lens, rows, counts = x[0]
            starts = np.append(0, np.cumsum(lens)[:-1])
            by_class, counts = np.ascontiguousarray(r.T) if by_class is None else by_class, counts.astype("f8")
            sums = np.stack([np.add.reduceat(each.take(rows) * counts, starts) for each in by_class], 1)
            grads.append((sums - x[2][:, None] * r.sum(0)) * x[3][:, None] / n)
            inverse.append(x[3])
    if not grads:
        return
    inverse, new_g = np.concatenate(inverse), np.concatenate(grads)
    new_w = w + alpha * d if d is not None else np.zeros_like(new_g)
    new_g += reg * (inverse ** 2)[:, None] * new_w
    yield where, ("full", new_w, new_g)
    if d is not None:
        yield where, ("pair", k, (new_w - w).astype("f4"), (new_g - g).astype("f4"))


def _products(items):
    """New state and pair, then older pairs -> dot products by names."""
    out, new, whole = {}, {}, None
    for _, (tag, *x) in items:
        if tag == "full":
            vectors = {"g": x[1]}
        else:
            vectors = {("s", x[0]): x[1], ("y", x[0]): x[2]}
        vectors = {a: v.astype("f8").ravel() for a, v in vectors.items()}
        if tag == "full" or len(new) == 1 and "g" in new:
            new |= vectors
            # With the last class's part, which is not kept: dot(v, u) is the sum of (v + v's row sums) times u.
            whole = {a: (v.reshape(-1, k) + v.reshape(-1, k).sum(1, keepdims=True)).ravel()
                     for k in [x[1].shape[1]] for a, v in new.items()}
        for a, v in vectors.items():
            for b, u in whole.items():
                out[a, b] = out[b, a] = float(u @ v)
    yield out


def _direction(items, weights: dict):
    d, where = None, None
    for j, (tag, *x) in items:
        if tag == "full":
            d, where = (0.0 if d is None else d) + weights["g"] * x[1], j
        else:
            for a, v in (("s", x[1]), ("y", x[2])):
                part = np.multiply(v, weights[a, x[0]], dtype="f8")
                d = part if d is None else np.add(d, part, out=part)
    if where is not None:
        yield where, ("d", d)


def _penalties(items):
    """State, direction, means and deviations -> products that the line search needs."""
    x = {tag: v for _, (tag, *v) in items}
    if "d" in x:
        d, w, (mean, inverse) = x["d"][0], x["full"][0], x["terms"]
        over = inverse[:, None]
        yield np.array([dot(w * over, w * over), dot(w * over, d * over), dot(d * over, d * over), dot(d, d), *((mean * inverse) @ d)])


def _rows_moved(items, shift: np.ndarray, alpha: float):
    """Rows after the last step, and the blocks' margins of the new direction."""
    for i, rows in _grouped(items):
        x, parts = rows["rows"][0], rows.get("part", [])
        first, y, m, md = x
        step = np.full(m.shape, shift)
        for p in parts:
            step[:, :-1] += p[0]
            step[:, -1] -= p[0].sum(1)
        yield i, ("rows", first, y, m + alpha * md, step)


def _grouped(items):
    got: dict = {}
    for i, (tag, *x) in items:
        if tag == "part" and i in got and "part" in got[i]:
            got[i]["part"][0][0][...] += x[0]
        else:
            got.setdefault(i, {}).setdefault(tag, []).append(x)
    return got.items()


def _shares(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = m.max(1, keepdims=True)
    e = np.exp(m - top)
    total = e.sum(1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def _loss(alpha: float):
    """Of the rows after a step: loss, slope, gradient of the intercepts."""
    def run(items):
        value, slope, sums = 0.0, 0.0, 0.0
        for _, (_, _, y, m, md) in items:
            at = m + alpha * md
            p, log_total = _shares(at)
            each = np.arange(len(y))
            value += float((log_total - at[each, y]).sum())
            slope += float((p * md).sum() - md[each, y].sum())
            sums = sums + p.sum(0) - np.bincount(y, minlength=p.shape[1])
        if value or slope:
            yield np.array([value, slope, *sums])

    return run


def _residuals(alpha: float, blocks: int):
    def run(items):
        for _, (_, first, y, m, md) in items:
            p, _ = _shares(m + alpha * md)
            p[np.arange(len(y)), y] -= 1
            for j in range(blocks):
                yield j, ("r", first, p[:, :-1])

    return run


# ---------------------------------------------------------------------------
# Steps
# ---------------------------------------------------------------------------
def wolfe_step(phi, t: float, low: tuple, c1: float = 1e-4, c2: float = 0.9) -> float | None:
    """Strong Wolfe step of ``phi(t) -> (value, slope)`` from ``low`` at 0; None where none is found."""
    value0, slope0 = low
    low = (0.0, *low)

    def between(a, b):
        d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
        d2 = math.sqrt(max(d1 * d1 - a[2] * b[2], 0.0))
        reach = b[0] - a[0]
        down = b[2] - a[2] + 2 * d2
        t = b[0] - reach * (b[2] + d2 - d1) / down if down else a[0] + reach / 2
        return min(max(t, a[0] + 0.1 * reach), a[0] + 0.9 * reach)

    def zoom(low, high):
        for _ in range(10):
            t = between(*sorted((low, high)))
            c = (t, *phi(t))
            if c[1] > value0 + c1 * t * slope0 or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= c2 * abs(slope0):
                    return t
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        return None

    for i in range(10):
        c = (t, *phi(t))
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value0 + c1 * t * slope0 or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= c2 * abs(slope0):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    return None


def two_loops(dots: dict, pairs: list[int]) -> dict:
    """Weights of g and the history in the L-BFGS direction, from dot products."""
    q = {"g": 1.0}
    with_q = lambda a: sum(v * dots[a, b] for b, v in q.items())
    alphas = {}
    for k in reversed(pairs):
        alphas[k] = with_q(("s", k)) / dots[("s", k), ("y", k)]
        q["y", k] = -alphas[k]
    if pairs:
        k = pairs[-1]
        scale = dots[("s", k), ("y", k)] / dots[("y", k), ("y", k)]
        q = {a: v * scale for a, v in q.items()}
    for k in pairs:
        q["s", k] = alphas[k] - with_q(("y", k)) / dots[("s", k), ("y", k)]
    return {a: -v for a, v in q.items()}


def _add(a: dict, b: dict) -> dict:
    return {k: a.get(k, 0.0) + b.get(k, 0.0) for k in a.keys() | b.keys()}


def wide_logistic_predictions(x: DataFrame, tokens_col: str, label_col: str, split_col: str, id_col: str, histogram: list[int],
                              settings: LogisticRegression) -> DataFrame:
    """Fits on the ``train`` rows of the written table ``x`` and predicts the others
    (id, split, label, prediction).  ``histogram``: training rows by class;
    ``settings``: penalty, iterations and tolerance."""
    reg, max_iter, tol = settings.getRegParam(), settings.getMaxIter(), settings.getTol()
    spark, sc = x.sparkSession, x.sparkSession.sparkContext
    blocks, classes = sc.defaultParallelism, len(histogram)
    train, n = _numbered(x.filter(F.col(split_col) == "train"), 0)
    rest, end = _numbered(x.filter(F.col(split_col) != "train"), n)
    size = max(1, min(ROWS_A_BLOCK, -(-n // blocks)))
    homes = max(1, -(-max(n, end - n) // size))

    texts = train.select("_at", tokens_col).unionByName(rest.select("_at", tokens_col))
    postings = texts.mapInArrow(_postings, "term string, rows array<int>, counts array<int>")
    cells = postings.repartition(blocks, "term").sortWithinPartitions("term").mapInArrow(_cells(n), "j int, cell binary")
    counted = scratch_dir(spark, "wide-cells")
    cells.write.parquet(counted)
    sc._jvm.System.gc()  # the postings' shuffle files go before the cells move
    cells = _placed(spark.read.parquet(counted).rdd.map(lambda r: (r[0], r[1])), blocks)
    cells = _settled(cells.mapValues(lambda c: ("cell", bytes(c))))
    _forget(sc, counted)
    terms = cells.mapPartitions(lambda it: [(c[0][0], ("terms", np.concatenate([v[0] for _, v in c]), np.concatenate([v[1] for _, v in c])))
                                            for c in [[(j, _unpacked(v[1])[2:]) for j, v in it]] if c], True).persist(DISK)

    def rows_of(r):
        at = np.array([v[0] for v in r[1]])
        order = np.argsort(at)
        y = np.array([v[1] for v in r[1]], "i4")[order]
        m = np.zeros((len(y), classes))
        return int(r[0]), ("rows", int(at.min()), y, m, m)

    start = np.log1p(np.array(histogram, "f8"))
    b = start - start.mean()
    labels = train.groupBy(F.floor(F.col("_at") / F.lit(size)).alias("_block")).agg(
        F.collect_list(F.struct("_at", F.col(label_col).cast("int"))))
    rows = _placed(labels.rdd.map(rows_of), homes)
    rows = rows.mapPartitions(lambda it: _rows_moved(it, b, 0.0), True)
    rows = _settled(rows.mapValues(lambda v: (*v[:3], v[4], np.zeros_like(v[4]))))

    def united(*rdds):
        return sc.union(list(rdds))

    def evaluate(alpha):
        return rows.mapPartitions(_loss(alpha)).sum() / n

    def step(alpha, k, *before):
        r = _placed(rows.mapPartitions(_residuals(alpha, blocks)), blocks)
        new = united(*before, r, cells).mapPartitions(lambda it: _stepped(it, alpha, k, n, classes, reg), True).persist(DISK)
        return new

    def only(tag):
        return lambda v: v[1][0] == tag

    new = step(0.0, -1)
    state = _settled(new.filter(only("full")))
    new.unpersist()
    value, _, *gb = evaluate(0.0)
    value, gb = float(value), np.array(gb)
    dots = state.mapPartitions(_products).reduce(_add)
    dots["g", "g"] += float(gb @ gb)
    history, pairs, own, values, failed, alpha = {}, [], {}, [value], False, 0.0
    mean_w = np.zeros(classes - 1)
    first_value, k = value, 0
    while k < max_iter:
        weights = two_loops(dots, pairs)
        d = united(state, *[history[p] for p in pairs]).mapPartitions(lambda it: _direction(it, weights), True).persist(DISK)
        found = united(state, d, terms).mapPartitions(_penalties).sum()
        ww, wd, dd, length = (float(v) for v in found[:4])
        mean_d = found[4:]
        db = weights["g"] * gb + sum(((weights["s", p] * own["s", p] + weights["y", p] * own["y", p]) for p in pairs), np.zeros(classes))
        shift = db - np.append(mean_d, -mean_d.sum())
        parts = _placed(united(d, cells).mapPartitions(lambda it: _margins(it, 0, 0, n, size)), homes)
        old_rows, last = rows, alpha
        rows = united(old_rows, parts).mapPartitions(lambda it: _rows_moved(it, shift, last), True).persist(DISK)
        rows.checkpoint()
        del parts

        intercepts, values_at = {}, {}

        def phi(t):
            v = evaluate(t)
            intercepts[t] = v[2:]
            values_at[t] = float(v[0]) + reg / 2 * (ww + 2 * t * wd + t * t * dd)
            return values_at[t], float(v[1]) + reg * (wd + t * dd)

        slope = sum(v * dots[a, "g"] for a, v in weights.items())
        norm = math.sqrt(length + float(db @ db))
        alpha = wolfe_step(phi, 1.0 if k and pairs else 1.0 / max(norm, 1e-300), (value, slope)) if slope < 0 else None
        rows = _settled(rows)
        _forget(sc, old_rows.getCheckpointFile())
        if alpha is None:  # once from the gradient alone, then the fit has ended
            d.unpersist()
            alpha = 0.0
            if failed or not pairs:
                break
            failed, pairs = True, []
            continue
        new = step(alpha, k, state, d)
        new_gb = intercepts[alpha]
        own["s", k], own["y", k] = alpha * db, new_gb - gb
        kept = pairs[-(HISTORY - 1):]
        old_state, state, history[k] = state, new.filter(only("full")), new.filter(only("pair"))
        state.checkpoint()
        history[k].checkpoint()
        fresh = united(state, history[k], *[history[p] for p in kept]).mapPartitions(_products).reduce(_add)
        everything = {("s", p): own["s", p] for p in [*kept, k]} | {("y", p): own["y", p] for p in [*kept, k]} | {"g": new_gb}
        for (a, c) in fresh:
            fresh[a, c] += float(everything[a] @ everything[c])
        dots = {(a, c): v for (a, c), v in dots.items() if a in everything and c in everything and "g" not in (a, c)} | fresh
        state, history[k] = _settled(state), _settled(history[k])
        for done in (d, new):
            done.unpersist()
        for gone in (old_state, *[history.pop(p) for p in [*history] if p not in (*kept, k)]):
            _forget(sc, gone.getCheckpointFile())
        del old_rows, old_state, gone, done, d, new
        pairs, gb, b, mean_w = [*kept, k], new_gb, b + alpha * db, mean_w + alpha * mean_d
        value = values_at[alpha]
        k += 1
        if k % CUT_EVERY == 0:
            sc._jvm.System.gc()  # lets Spark's cleaner remove the shuffle files of past iterations
        size_g = math.sqrt(dots["g", "g"])
        if abs(value - max(values)) <= tol * abs(first_value) or size_g <= max(tol * abs(value), 1e-8):
            break
        values = [*values, value][-20:]

    offset = b - np.append(mean_w, -mean_w.sum())
    held = end - n

    def predicted(it):
        for i, parts in _grouped(it):
            m = np.full((len(parts["part"][0][0]), classes), offset)
            for (p,) in parts["part"]:
                m[:, :-1] += p
                m[:, -1] -= p.sum(1)
            for at, c in enumerate(m.argmax(1)):
                yield n + i * size + at, int(c)

    scores = _placed(united(state, cells).mapPartitions(lambda it: _margins(it, 1, n, held, size)), homes).mapPartitions(predicted)
    path = scratch_dir(spark, "wide-predictions")
    spark.createDataFrame(scores, "_at int, prediction int").write.parquet(path)
    terms.unpersist()
    for done in (cells, rows, state, *history.values()):
        _forget(sc, done.getCheckpointFile())
    return rest.join(spark.read.parquet(path), "_at", "left").select(
        id_col, split_col, F.col(label_col).cast("int").alias(label_col), "prediction")


def _settled(rdd: RDD) -> RDD:
    """``rdd`` as it lies in the checkpoint folder; nothing refers to what it came from, or keeps it."""
    if not rdd.isCheckpointed():
        rdd.checkpoint()
        rdd._jrdd.count()
    if rdd.is_cached:
        rdd.unpersist()
    return RDD(rdd._jrdd, rdd.ctx, rdd._jrdd_deserializer)


def _forget(sc, path: str | None) -> None:
    """Removes a superseded checkpoint of this fit."""
    if path:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
