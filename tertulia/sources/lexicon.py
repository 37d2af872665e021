"""Sentiment lexicon files — headerless, one word per line, ISO-8859-1,
set semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_word_list(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    return (spark.read.option("encoding", encoding).option("header", "false")
            .schema("word string").csv(path)
            .filter(F.col("word").isNotNull()).distinct())


def read_lexicon(spark: SparkSession, positive_path: str, negative_path: str,
                 encoding: str = "ISO-8859-1") -> DataFrame:
    """(word, polarity) with +1 for the positive list and -1 for the negative."""
    pos = read_word_list(spark, positive_path, encoding).withColumn("polarity", F.lit(1))
    neg = read_word_list(spark, negative_path, encoding).withColumn("polarity", F.lit(-1))
    return pos.unionByName(neg)


def write_word_list(df: DataFrame, path: str, encoding: str = "ISO-8859-1") -> None:
    df.select("word").write.mode("overwrite").option("encoding", encoding).csv(path)
