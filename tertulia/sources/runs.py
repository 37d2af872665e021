"""``id<TAB>label`` gold / run files, with line order kept so that
the last duplicate of an id wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a sortable line-order key (file, split offset, row
    position inside the split) — stable however the files are split."""
    df = spark.read.text(path).select("value", "_metadata")
    key = F.struct(F.col("_metadata.file_path").alias("f"),
                   F.col("_metadata.file_block_start").alias("b"),
                   F.monotonically_increasing_id().alias("r"))
    return df.select("value", key.alias("line_order"))


def write_id_label(df: DataFrame, id_col: str, label_col: str, path: str) -> None:
    df.select(F.concat_ws("\t", F.col(id_col).cast("string"), F.col(label_col).cast("string"))
              .alias("value")).write.mode("overwrite").text(path)
