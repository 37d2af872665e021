"""Probability averaging ensemble (M7) and per-row top class (M8) over a
long probability table (id, model, label, prob)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _label_pos(label_col: str, labels: list[str]):
    arr = F.array(*[F.lit(x) for x in labels])
    return F.coalesce(F.array_position(arr, F.col(label_col)), F.lit(len(labels) + 1))


def top_label(probs: DataFrame, keys: list[str], labels: list[str],
              label_col: str = "label", prob_col: str = "prob") -> DataFrame:
    """M8: label with the highest probability per key; ties -> the label
    that comes first in ``labels``."""
    order = F.struct((-F.col(prob_col)).alias("neg"), _label_pos(label_col, labels).alias("pos"))
    return probs.groupBy(*keys).agg(
        F.min_by(F.col(label_col), order).alias(label_col),
        F.max(prob_col).alias(prob_col))


def average_predictions(probs: DataFrame, labels: list[str], id_col: str = "id",
                        model_col: str = "model", n_models: int | None = None) -> DataFrame:
    """M7: mean probability over models per (id, label); a label missing from
    any model does not count for that row; arg-max with ties to the first label
    of ``labels``.  A row for which no label is complete keeps its id, with a
    null label.  ``n_models`` saves the pass that counts the models."""
    if n_models is None:
        n_models = probs.select(F.countDistinct(model_col)).first()[0]
    avg = (probs.groupBy(id_col, "label")
           .agg(F.avg("prob").alias("prob"), F.count(F.lit(1)).alias("_k")))
    full = F.col("_k") == n_models
    order = F.struct((-F.col("prob")).alias("neg"), _label_pos("label", labels).alias("pos"))
    return avg.groupBy(id_col).agg(F.min_by(F.col("label"), F.when(full, order)).alias("label"),
                                   F.max(F.when(full, F.col("prob"))).alias("prob"))
