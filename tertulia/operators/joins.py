"""Join helpers: broadcast only behind a size check or for a proven number of
rows, with a shuffle join beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows above which a dimension is joined with a shuffle instead of broadcast.
BROADCAST_ROW_LIMIT = 2_000_000
# Keys that ``heavy_join`` takes out of the shuffle.
HEAVY_KEYS = 1000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast-hint ``df`` when it has at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows of a (small) dimension; a
    larger table is returned unhinted so Spark plans a shuffle join (AQE can
    still switch to broadcast at run time from the real shuffle size).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def heavy_join(left: DataFrame, right: DataFrame, key: str, freq: DataFrame | None = None,
               heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """``left`` left-joined with ``right`` (one row per key) on ``key``, safe
    against keys that hold a large share of ``left``.

    The ``heavy_keys`` most frequent keys meet their rows of ``right`` by a
    broadcast of at most that many rows; rows of these keys go through the
    shuffle of the rest under a salt, so they spread over all tasks and match
    nothing there.  A key outside the list holds less than 1 / ``heavy_keys``
    of the rows.  ``freq`` (key, n) saves the count over ``left`` where the
    frequencies are known.  Null keys match nothing.  The salt is a hash of the
    row, so a repeated task deals its rows as before.

    Columns: those of ``left``, then those of ``right`` but the key.
    """
    if freq is None:
        freq = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = freq.filter(F.col(key).isNotNull()).orderBy(F.desc("n"), key).limit(heavy_keys).select(key)
    values = [c for c in right.columns if c != key]
    val = F.struct(*[F.col(f"`{c}`") for c in values])
    hot = right.join(F.broadcast(top), key, "left_semi").select(key, val.alias("_hot"))
    cold = right.select(key, val.alias("_cold"), F.lit(0).cast("long").alias("_salt"))
    salted = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(),
                        1 + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(1 << 20)))
        .otherwise(0))
    both = salted.join(cold, [key, "_salt"], "left")
    got = F.coalesce("_hot", "_cold")
    return both.select(*[F.col(f"`{c}`") for c in left.columns], *[got[c].alias(c) for c in values])
