"""K3: prediction table (id, predictions, N, NEU, NONE, POS) as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_prediction_table(df: DataFrame, path: str) -> None:
    df.select("id", "predictions", "N", "NEU", "NONE", "POS").write.mode("overwrite").parquet(path)


def read_prediction_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
