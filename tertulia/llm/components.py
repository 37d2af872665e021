"""Connected components: union-find over blocks of edges, and large-star and
small-star steps between the blocks until one block or a fixed point is left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK = 500_000  # edges that a task joins in memory


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): v is the smallest node that the edges of a block join to u."""
    parent: dict[int, int] = {}
    read = 0

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        parent.clear()
        return pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    for b in batches:
        for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist()):
            a, c = root(u), root(v)
            parent[max(a, c)] = min(a, c)
        read += b.num_rows
        if read > BLOCK:
            yield flush()
            read = 0
    yield flush()


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One step: each node hands the smallest node it knows to its larger
    (large star) or to its smaller neighbours and itself (small star)."""
    if large:
        e = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = e.join(least, "u")
    if large:
        return j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = least.select("u", F.col("m").alias("v"))
    return (j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(own)
            .filter(F.col("u") != F.col("v")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the materialised ``edges`` (u, v) that has
    another neighbour than itself: label is the smallest node of its component.
    Each round is kept in the shared folder."""
    e, mark = edges.select("u", "v"), None
    while True:
        n = e.count()
        e = cut(e.coalesce(max(1, -(-n // BLOCK))).mapInArrow(_forest, "u long, v long"))
        if n <= BLOCK:
            break
        e = cut(_star(_star(e, True), False))
        found = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(3)))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    return (e.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct())
