"""Corpus catalogue — file layouts resolved into one DataFrame with
``dataset`` and ``split`` columns.

Layouts:
* ``split_files``  — train / dev / test files;
* ``one_file``     — a single file split 70/15/15 (R1);
* ``train_test``   — train + test files, train split 85/15 into train/dev;
  ``train_from`` lets a corpus reuse another corpus's train file.
Unknown corpus names raise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions.labels import reduce_labels
from ..operators.sampling import assign_split
from .tsv import read_tsv

CORPUS_SCHEMA = StructType([
    StructField("tweet_id", LongType()), StructField("content", StringType()),
    StructField("sentiment", IntegerType()),
])


@dataclass(frozen=True)
class Corpus:
    layout: str                 # split_files | one_file | train_test
    root: str                   # folder holding <name>_<part> sub-folders
    train_from: str | None = None
    labels: str = "class"       # class (0-3) | rank (1-5) | aspect (0-2)


def reduced(labels: str, sentiment: Column, compat: bool = False) -> Column:
    """Three classes of a corpus's labels: classes 0, 1, 1, 2; ranks below,
    at and above 3; aspect votes as they are.  ``compat``: ranks like classes."""
    if labels == "aspect":
        return sentiment
    return reduce_labels(F.lit("coah" if labels == "rank" else "intertass"), sentiment, compat)


def read_corpus(spark: SparkSession, catalogue: dict[str, Corpus], name: str,
                id_col: str = "tweet_id", reduce: bool = False, compat: bool = False) -> DataFrame:
    """One corpus with ``split`` and ``dataset``; ``reduce``: three classes on read."""
    if name not in catalogue:
        raise KeyError(f"unknown corpus {name!r}")
    c = catalogue[name]

    def part(corpus: str, p: str) -> DataFrame:
        return read_tsv(spark, f"{catalogue[corpus].root}/{corpus}_{p}", CORPUS_SCHEMA)

    if c.layout == "split_files":
        out = (part(name, "train").withColumn("split", F.lit("train"))
               .unionByName(part(name, "dev").withColumn("split", F.lit("dev")))
               .unionByName(part(name, "test").withColumn("split", F.lit("test"))))
    elif c.layout == "one_file":
        out = assign_split(part(name, "all"), id_col, three_way=True)
    elif c.layout == "train_test":
        train = assign_split(part(c.train_from or name, "train"), id_col, three_way=False)
        out = train.unionByName(part(name, "test").withColumn("split", F.lit("test")))
    else:
        raise ValueError(f"unknown layout {c.layout!r}")
    if reduce:
        out = out.withColumn("sentiment", reduced(c.labels, F.col("sentiment"), compat).cast("int"))
    return out.withColumn("dataset", F.lit(name))


def read_catalogue(spark: SparkSession, catalogue: dict[str, Corpus], reduce: bool = False) -> DataFrame:
    out = None
    for name in catalogue:
        df = read_corpus(spark, catalogue, name, reduce=reduce)
        out = df if out is None else out.unionByName(df)
    return out
