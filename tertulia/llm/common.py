"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_dir

#: A word: a run of characters other than ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage,
    so that a lost executor costs a re-read and not a re-computation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what ``cut`` does, but
    compressed and read by column."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row, the long columns ``_f`` and ``_i``, that every scan gives again: the hash of
    the file and the row's place in it where ``docs`` is columns or rows of a Parquet scan, else numbers written once with
    the rows."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter"):  # of the rows of a scan, these change no place
        plan = plan.child()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        place = docs.metadataColumn("_metadata")
        return docs.select("*", F.xxhash64(place["file_path"]).alias("_f"), place["row_index"].alias("_i"))
    return stored(docs.withColumn("_f", F.lit(0).cast("long")).withColumn("_i", F.monotonically_increasing_id()), "keyed-rows")


def short(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` (materialised, of a few short columns) with a broadcast hint if it
    is counted to have ``rows`` rows at most; else it takes part in a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def spans_text(spans: Column) -> Column:
    """array<struct<s, e, kind>> as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
