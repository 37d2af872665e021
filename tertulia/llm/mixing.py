"""Mixing sources to target weights by weighted fair queueing (DataFrame
functions only).

Every document of a source stands in a queue, shuffled by a hash of its id and
passed up to ``repeats`` times.  Its virtual finish time is the number of
words queued up to its own end, divided by the target of its source.  All
queue entries are range-sorted by finish time over the cluster and served
until the total budget (the number of words in the corpus) is used up.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and
share the budget by weight; a target stops at ``repeats`` times its source's
size and the excess goes to the others by weight, until none is above.

Scale: the text is read once, for the word counts; what follows moves rows of
a few numbers.  Running sums inside a source are taken over hash buckets (4096
a source), so that a source with a third of all rows is spread over many
tasks; the sum over the global order is taken per range partition.  Two things
are handled as single groups: the table of sources (one row each) and the one
range partition in which the budget ends.

Defined results: null or blank text has size 0 and is never taken; null ids
share one place in the shuffle, in order of size; rows that repeat an id are
separate documents; a source without words has target 0.  With no words at
all, all targets are 0 and nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_RE, cut

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = "mix-1"
BUCKET_HEX = 3
ORDER = ["_finish", "_rk", "_e", "_b", "_rn"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, _rk, source_size, target) from rows (source, size)."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("_rk", F.row_number().over(by_name))
    src = src.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            (F.col("_rk") - 1) % n + 1))
    src = src.withColumn("_cap", F.col("source_size") * repeats)
    everything = W.partitionBy(F.lit(1))
    fills = everything.orderBy(F.col("_cap") / F.col("_w"), "_rk").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(fills), F.lit(0))
    open_w = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(fills), F.lit(0.0))
    src = src.withColumn("_level", left.cast("double") / open_w)
    src = src.withColumn("_level", F.max(F.when(F.col("_cap") > F.col("_w") * F.col("_level"),
                                                F.col("_level"))).over(everything))
    share = F.col("_w") * F.col("_level")
    return src.select("source", "_rk", "source_size",
                      F.when(F.col("_cap") > share, share).otherwise(F.col("_cap").cast("double"))
                      .alias("target"))


def _queues(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's place in its source's queue: bucket, row in it, and the
    words up to its own end."""
    q = (sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop("source")
         .withColumn("_b", F.substring("_key", 1, BUCKET_HEX)))
    before = (q.groupBy("_rk", "_b").agg(F.sum("size").alias("_s"))
              .select("_rk", "_b", (F.sum("_s").over(W.partitionBy("_rk").orderBy("_b")) - F.col("_s"))
                      .alias("_before")))
    inside = W.partitionBy("_rk", "_b").orderBy("_key", "doc_id", "size")
    return (q.join(before, ["_rk", "_b"])
            .withColumn("_rn", F.row_number().over(inside))
            .withColumn("_end", F.col("_before") + F.sum("size").over(
                inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
            .select("doc_id", "size", "source_size", "target", "_rk", "_b", "_rn", "_end"))


def _finish(epoch) -> Column:
    return F.when(F.col("target") > 0,
                  ((F.lit(epoch) - 1) * F.col("source_size") + F.col("_end")).cast("double") / F.col("target"))


def _last_served(queues: DataFrame, repeats: int):
    """The last queue entry within the budget, as a Row of ORDER, or None."""
    e = queues.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("_e"))
    e = (e.withColumn("_finish", F.when(F.col("target") > 0, (
            (F.col("_e") - 1) * F.col("source_size") + F.col("_end")).cast("double") / F.col("target")))
         .filter(F.col("_finish").isNotNull()).select(*ORDER, "size"))
    ranged = cut(e.repartitionByRange(*ORDER).select("*", F.spark_partition_id().alias("_pid")))
    parts = ranged.groupBy("_pid").agg(F.sum("size").alias("_s"))
    parts = parts.withColumn("_cum", F.sum("_s").over(W.orderBy("_pid")))
    budget = queues.agg(F.sum("size").alias("_budget"))
    end = (parts.crossJoin(budget).filter(F.col("_cum") > F.col("_budget"))
           .agg(F.min_by("_pid", "_pid").alias("_pid"), F.min_by(F.col("_cum") - F.col("_s"), "_pid").alias("_from"),
                F.max("_budget").alias("_budget")).first())
    if end is None or end["_pid"] is None:
        return ranged.select(*ORDER).orderBy(*[F.col(c).desc() for c in ORDER]).first()
    tail = (ranged.filter(F.col("_pid") == end["_pid"])
            .withColumn("_cum", F.sum("size").over(W.partitionBy("_pid").orderBy(*ORDER)) + end["_from"])
            .filter(F.col("_cum") <= end["_budget"]))
    before = ranged.filter(F.col("_pid") < end["_pid"])
    last = [x.select(*ORDER).orderBy(*[F.col(c).desc() for c in ORDER]).limit(1) for x in (tail, before)]
    return last[0].unionAll(last[1]).orderBy(*[F.col(c).desc() for c in ORDER]).first()


def mix_sources(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``."""
    sized = cut(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key")))
    queues = cut(_queues(sized, source_targets(sized, weights, repeats)))
    last = _last_served(queues, repeats)
    served = F.lit(0)
    if last is not None:
        edge = F.struct(*[F.lit(last[c]).cast(t).alias(c) for c, t in
                          zip(ORDER, ("double", "int", "int", "string", "int"))])
        for e in range(1, repeats + 1):
            here = F.struct(_finish(e).alias("_finish"), F.col("_rk").cast("int").alias("_rk"),
                            F.lit(e).alias("_e"), F.col("_b"), F.col("_rn").cast("int").alias("_rn"))
            served = served + F.when((F.col("target") > 0) & (here <= edge), 1).otherwise(0)
    return queues.select("doc_id", "size", "source_size", "target",
                         (F.col("size") * served).cast("long").alias("taken"))
