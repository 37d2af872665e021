"""``__label__<n> <text>`` lines (fastText format)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import label_prefix


def to_label_lines(df: DataFrame, label_col: str, text_col: str) -> DataFrame:
    """K2: one ``value`` column; text written unquoted."""
    return df.select(F.concat(label_prefix(F.col(label_col)), F.lit(" "), F.col(text_col))
                     .alias("value"))


def to_label_lines_tab(df: DataFrame, label_col: str, text_col: str) -> DataFrame:
    """K2 (older-years form): ``__label__<label><TAB><text>``."""
    return df.select(F.concat(label_prefix(F.col(label_col)), F.lit("\t"), F.col(text_col))
                     .alias("value"))


def write_label_lines(df: DataFrame, label_col: str, text_col: str, path: str) -> None:
    to_label_lines(df, label_col, text_col).write.mode("overwrite").text(path)


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """Split at the first space; keep lines whose label ends in 0-3 and
    whose text is not empty; the text is newline-free and stripped."""
    parts = F.split(F.col("value"), " ", 2)
    label, text = parts[0], parts[1]
    cls = F.substring(label, -1, 1)
    out = lines.select(cls.alias("_c"), text.alias("_t"))
    out = out.filter(F.col("_c").rlike("^[0-3]$") & F.col("_t").isNotNull() & (F.col("_t") != ""))
    return out.select(
        F.regexp_replace(F.regexp_replace("_t", "\n", ""),
                         r"^[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\p{Z}]+|[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\p{Z}]+\z",
                         "").alias("content"),
        F.col("_c").cast("int").alias("sentiment"))


def read_label_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """S8 (+R5): read one or more label-line files/folders (e.g. train + dev)."""
    return parse_label_lines(spark.read.text(list(paths)))
