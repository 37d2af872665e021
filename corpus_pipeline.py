"""From raw documents to a training mix: toxic documents go, repeated lines go,
one document of each near-duplicate group stays and repeated passages of the
rest go, documents that hold benchmark items go, and the sources are mixed to
their target weights.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes
each stage's result as Parquet in the shared folder and reads it again for the
next.  All but the last return the columns of documents.  No stage but the
first and the fourth reads a table besides its input (labels, benchmark).

Defined results: rows with null or empty text pass all filters; a document
whose every line repeats earlier ones is a copy and goes with its lines; the
near-duplicate stage goes by rows, whatever ids they repeat or lack.  Passages
go after near-duplicates, which would else be left as scraps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tertulia.llm.common import table
from tertulia.llm.decontaminate import decontaminate
from tertulia.llm.line_dedup import dedup_lines
from tertulia.llm.mixing import mix_sources
from tertulia.llm.passages import one_of_each_without_passages
from tertulia.llm.toxicity import drop_toxic
from tertulia.session import scratch_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def _counted(out: DataFrame, docs: DataFrame, removed: str) -> DataFrame:
    """The columns of ``docs``, ``n_chars`` counted anew where something was removed."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long"))
                             .otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c in out.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return _counted(out, docs, "n_removed")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = one_of_each_without_passages(docs)
    return _counted(out.filter((F.col("n_gone") == 0) | (F.col("text") != "")), docs, "n_gone")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL cannot express the first and the third stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
