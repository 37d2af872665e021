"""Label-dimension operators (L1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import broadcast_if_small


def encode_sorted(df: DataFrame, col: str, out: str) -> DataFrame:
    """L1: sorted distinct values -> 0..k-1 (``LabelEncoder`` order).

    The distinct set is small for a label column; it is ranked on its own
    (one tiny window) and joined back, broadcast behind a size check.
    """
    dim = df.select(col).distinct().filter(F.col(col).isNotNull())
    dim = dim.select(col, (F.dense_rank().over(Window.orderBy(col)) - 1).cast("int").alias(out))
    return df.join(broadcast_if_small(dim), col, "left")
