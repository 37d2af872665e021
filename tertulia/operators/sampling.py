"""Reproducible splits, oversampling, quota samples, corpus unions, weights.

Row order comes from a seeded hash of the row id (``md5('<seed>:<id>')``),
so results do not depend on partitioning and can be recomputed in SQL.

Exact positional cuts never use a global single-partition window: the hash at
a cut's rank is selected by counts of hash prefixes, and rows then compare
their own hash with it; dense ranks add the rank in a prefix's bucket to the
running sum of the bucket counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import broadcast_if_small

SHUFFLE_SEED = 1234
SPLIT_3WAY = (0.7, 0.85)   # train | dev | test cut fractions
SPLIT_2WAY = (0.85,)       # train | dev
ROWS_PER_BUCKET = 100_000  # target rows per hash bucket
MAX_BROADCAST_BUCKETS = 1 << 16
RADIX_DIGITS = 4           # hex digits a pass of the rank selection counts by
HASH_DIGITS = 32           # of an md5
QUOTA_SALTS = 64           # tasks that rank a class before the last one does
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def seeded_hash(id_col: Column | str, seed: int = SHUFFLE_SEED) -> Column:
    """Hex md5 of ``'<seed>:<id>'`` — a seeded, partition-independent order."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def hash_to_int(h: Column, digits: int = 15) -> Column:
    """First ``digits`` hex digits of a hex hash as a non-negative BIGINT."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("bigint")


def prefix_length(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hex-prefix length giving buckets of about ``rows_per_bucket`` rows."""
    if n_rows <= rows_per_bucket:
        return 1
    return max(1, min(8, math.ceil(math.log(n_rows / rows_per_bucket, 16))))


def dense_index(df: DataFrame, hash_col: str, by: list[str] | None = None,
                n_rows: int | None = None, out: str = "_idx") -> DataFrame:
    """0-based rank of ``hash_col`` within the ``by`` groups, fully distributed.

    Rows are partitioned by (group, hash prefix) — a hot group is spread over
    many buckets — ranked inside their bucket and shifted by the bucket's
    running offset, computed on the bucket-count aggregate.
    """
    by = list(by or [])
    if n_rows is None:
        n_rows = df.count()
    L = prefix_length(n_rows)
    x = df.withColumn("_b", F.substring(F.col(hash_col), 1, L))
    counts = x.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = (Window.partitionBy(*by).orderBy("_b") if by else Window.orderBy("_b")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*by, "_b", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    if not by and 16 ** L <= MAX_BROADCAST_BUCKETS:
        offs = F.broadcast(offs)   # at most 16^L rows: proven bound
    elif by:
        offs = broadcast_if_small(offs)   # 16^L rows per group: check the size
    x = x.join(offs, [*by, "_b"])
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(hash_col))
    return x.withColumn(out, F.col("_off") + rank - 1).drop("_b", "_off")


def hash_at_ranks(hashes: DataFrame, ranks_of: Callable[[int], list[int]],
                  few: int = ROWS_PER_BUCKET) -> list[str | None]:
    """The hashes at given 0-based ranks of the one-column table ``hashes``
    (hex, of equal length), by radix selection.

    A pass counts the rows by the next four hex digits (map-side partial
    aggregates, at most 16^4 counts for each rank sought); the counts name the
    one bucket that holds a rank and its rank in it, and the next pass reads
    only those buckets, until they hold ``few`` rows, which are sorted.
    ``ranks_of`` maps the number of rows to the ranks; a rank beyond the rows
    gives None.
    """
    col = hashes.columns[0]

    def counted(df: DataFrame, digits: int) -> list[tuple[str, int]]:
        rows = df.groupBy(F.substring(col, 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        return sorted((r["b"], r["n"]) for r in rows)

    sizes = counted(hashes, RADIX_DIGITS)
    ranks = ranks_of(sum(n for _, n in sizes))
    out: list[str | None] = [None] * len(ranks)
    todo = {}  # position in ``ranks`` -> (bucket, rank in it, its size)

    def locate(at: int, rank: int, buckets: list[tuple[str, int]]) -> None:
        for b, n in buckets:
            if rank < n:
                todo[at] = (b, rank, n)
                return
            rank -= n

    for at, rank in enumerate(ranks):
        locate(at, rank, sizes)
    digits = RADIX_DIGITS
    while todo:
        inside = hashes.filter(F.substring(col, 1, digits).isin(*{b for b, _, _ in todo.values()}))
        if max(n for _, _, n in todo.values()) <= few or digits >= HASH_DIGITS:
            # A bucket of the whole hash holds equal values only: one of them is enough.
            values = inside if digits < HASH_DIGITS else inside.distinct()
            held = sorted(r[0] for r in values.collect())
            for at, (b, rank, _) in todo.items():
                mine = [h for h in held if h.startswith(b)]
                out[at] = mine[min(rank, len(mine) - 1)]
            return out
        digits += RADIX_DIGITS
        buckets = counted(inside, digits)
        for at, (b, rank, _) in list(todo.items()):
            locate(at, rank, [x for x in buckets if x[0].startswith(b)])
    return out


def assign_split(df: DataFrame, id_col: str, three_way: bool = True,
                 seed: int = SHUFFLE_SEED, out: str = "split") -> DataFrame:
    """Exact seeded split, ``floor(.7n)``/``floor(.85n)`` or ``floor(.85n)``.

    Returns ``df`` plus ``split`` in {train, dev, test} (or {train, dev}).
    The hashes at the cut ranks are selected first, on the ids alone
    (``hash_at_ranks``); the split is then a projection, ``hash < cut``, so
    whatever reads the result scans ``df`` once and shuffles nothing for it.
    Rows that repeat an id share a split; null ids hash like an empty id.
    """
    fracs = SPLIT_3WAY if three_way else SPLIT_2WAY
    names = ["train", "dev", "test"] if three_way else ["train", "dev"]
    h = seeded_hash(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed)
    cuts = hash_at_ranks(df.select(h.alias("h")), lambda n: [int(math.floor(f * n)) for f in fracs])
    split = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        if cut is None:  # no row lies at or beyond the cut
            split = F.lit(name)
        else:
            split = F.when(h < F.lit(cut), name).otherwise(split)
    return df.withColumn(out, split)


def hash_split(df: DataFrame, id_col: str, three_way: bool = True,
               seed: int = SHUFFLE_SEED, out: str = "split") -> DataFrame:
    """R1 option: split by seeded-hash threshold — no count, no shuffle,
    sizes only approximately 70/15/15 (or 85/15)."""
    fracs = SPLIT_3WAY if three_way else SPLIT_2WAY
    names = ["train", "dev", "test"] if three_way else ["train", "dev"]
    u = hash_to_int(seeded_hash(id_col, seed), 8) / F.lit(float(1 << 32))
    e = F.lit(names[-1])
    for f, name in reversed(list(zip(fracs, names))):
        e = F.when(u < F.lit(f), F.lit(name)).otherwise(e)
    return df.withColumn(out, e)


def upsample(df: DataFrame, label_col: str, id_col: str,
             keep: list[str] | None = None, seed: int = SHUFFLE_SEED) -> DataFrame:
    """R2: random oversampling with replacement up to the largest class.

    Every original row is kept (``draw = 0``); class ``c`` with ``n_c`` rows
    receives ``max_n - n_c`` draws; draw ``j`` takes the row of class rank
    ``md5('<seed>:<c>:<j>') mod n_c``.  Draws are generated by ``range`` over
    many partitions and matched by an equi-join on (class, rank), so no class
    is ever gathered in one task.
    """
    keep = list(keep or [])
    cols = [id_col, label_col, *keep]
    base = df.select(*cols)
    counts = [(r[0], r[1]) for r in
              base.groupBy(label_col).count().collect()]   # one row per class
    if not counts:
        return base.withColumn("draw", F.lit(0).cast("bigint"))
    total = sum(n for _, n in counts)
    top = max(n for _, n in counts)
    needs = [(c, n, top - n) for c, n in sorted(counts, key=lambda t: str(t[0])) if top > n]
    orig = base.withColumn("draw", F.lit(0).cast("bigint"))
    if not needs:
        return orig
    indexed = dense_index(base.withColumn("_h", seeded_hash(id_col, seed)), "_h",
                          by=[label_col], n_rows=total).drop("_h")
    n_draws = sum(k for _, _, k in needs)
    draws = df.sparkSession.range(0, n_draws, numPartitions=max(1, n_draws // 1_000_000 + 1))
    # Map a draw number to its class with a CASE over the (few) class ranges.
    cls, start, size = F.lit(None), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    for c, n, k, s0 in _with_starts(needs):
        hit = (F.col("id") >= s0) & (F.col("id") < s0 + k)
        cls = F.when(hit, F.lit(c)).otherwise(cls)
        start = F.when(hit, F.lit(s0)).otherwise(start)
        size = F.when(hit, F.lit(n)).otherwise(size)
    draws = draws.select(
        cls.cast(df.schema[label_col].dataType).alias(label_col),
        (F.col("id") - start + 1).alias("draw"), size.alias("_n"))
    key = F.concat(F.lit(f"{seed}:"), F.col(label_col).cast("string"), F.lit(":"),
                   F.col("draw").cast("string"))
    draws = draws.withColumn("_idx", F.pmod(hash_to_int(F.md5(key)), F.col("_n"))).drop("_n")
    drawn = draws.join(indexed, [label_col, "_idx"]).select(*cols, "draw")
    return orig.unionByName(drawn)


def _with_starts(needs):
    s0 = 0
    for c, n, k in needs:
        yield c, n, k, s0
        s0 += k


def quota_sample(df: DataFrame, quotas: DataFrame, label_col: str, order_col: str,
                 locale_col: str = "locale", quota_col: str = "quota") -> DataFrame:
    """Per locale, the first ``quota`` rows of each class in ``order_col``
    order (locales may share rows; short classes give fewer rows).

    A class is ranked twice: within the tasks that read it, dealt to
    ``QUOTA_SALTS`` groups, then over what these leave.  The rank filters use a
    literal bound (largest quota), which Spark turns into a per-partition top-k
    before each shuffle (WindowGroupLimit), so a hot class never ships more
    than ``max quota`` rows a task and its last ranking sees at most
    ``QUOTA_SALTS`` times that.  Spark does so up to a bound of its own, which
    is raised in the session if the quotas go beyond it.
    """
    qmax = int(quotas.agg(F.max(quota_col)).first()[0] or 0)
    spark = df.sparkSession
    if int(spark.conf.get(GROUP_LIMIT, "1000")) < qmax:
        spark.conf.set(GROUP_LIMIT, str(qmax))
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(QUOTA_SALTS)))
    first = F.row_number().over(Window.partitionBy(label_col, "_salt").orderBy(order_col))
    left = salted.withColumn("_rn", first).filter(F.col("_rn") <= F.lit(qmax)).drop("_rn", "_salt")
    w = Window.partitionBy(label_col).orderBy(order_col)
    ranked = left.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.lit(qmax))
    q = broadcast_if_small(quotas.select(F.col(locale_col), F.col("label").alias("_ql"),
                                         F.col(quota_col).alias("_q")))
    out = ranked.join(q, (F.col(label_col) == F.col("_ql")) & (F.col("_rn") <= F.col("_q")))
    return out.drop("_ql", "_q")


def union_corpora(frames: dict[str, DataFrame], dedupe: bool = False,
                  name_col: str = "dataset") -> DataFrame:
    """Append corpora (missing columns become null), tagging each row.

    ``dedupe=True`` keeps one row of those repeated across corpora (equal in
    all other columns), with the first corpus name, which happens when two
    corpora share a training file.
    """
    out = None
    for name, f in frames.items():
        f = f.withColumn(name_col, F.lit(name))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if dedupe:
        out = out.groupBy(*[c for c in out.columns if c != name_col]).agg(F.min(name_col).alias(name_col))
    return out


def class_weights(df: DataFrame, label_col: str, out: str = "weight") -> DataFrame:
    """Balanced weights ``n / (k * count_c)`` joined onto every row.

    The per-class table has one row per class (bounded by the label set), so
    it is broadcast.
    """
    per = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy()
    per = per.select(label_col, (F.sum("_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("_c")))
                     .alias(out))
    return df.join(F.broadcast(per), label_col)


def class_weight_table(df: DataFrame, label_col: str) -> DataFrame:
    per = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy()
    return per.select(label_col, "n_rows",
                      (F.sum("n_rows").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_rows")))
                      .alias("weight"))
