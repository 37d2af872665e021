"""The main classification run (lifecycle A) as one lazy Spark plan:
tweets -> split -> row features + lexicon ratios -> logistic regression,
an external batch model -> probability-averaging ensemble -> macro scores
per split and model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as M
from ..operators import ensemble as EN
from ..operators import evaluate as EV
from ..functions.generators import posexplode_rows
from . import tweets as TW
from .model_queries import FEATURES, LABELS, feature_table
from .registry import query


def classification_run(spark: SparkSession, sf: str) -> DataFrame:
    feats = feature_table(spark, sf)
    lr = M.fit_predict(feats, FEATURES, "sentiment", "split", kind="lr")
    lr_long = posexplode_rows(lr, ["tweet_id"], F.col("probability"), "_pos", "prob").select(
        "tweet_id", F.lit("lr").alias("model"), F.col("_pos").cast("string").alias("label"), "prob")
    tws = TW.tweets_split(spark, sf)
    held_out = tws.filter("split <> 'train'")
    ext = M.score_external(held_out, "content", "tweet_id", M.toy_length_model, LABELS,
                           cache_key="toy-length")
    ext_long = ext.select("tweet_id", F.lit("external").alias("model"), F.explode(F.array(*[
        F.struct(F.lit(x).alias("label"), F.col(f"p_{x}").alias("prob")) for x in LABELS])).alias("e")
    ).select("tweet_id", "model", "e.label", "e.prob")
    probs = lr_long.unionByName(ext_long)
    per_model = EN.top_label(probs, ["tweet_id", "model"], LABELS)
    ens = EN.average_predictions(probs, LABELS, id_col="tweet_id").withColumn("model", F.lit("ensemble"))
    preds = per_model.select("tweet_id", "model", "label").unionByName(ens.select("tweet_id", "model", "label"))
    gold = held_out.select("tweet_id", "split", F.col("sentiment").cast("string").alias("gold"))
    j = preds.join(gold, "tweet_id").withColumnRenamed("label", "pred")
    return EV.macro_scores(j, by=["split", "model"])


@query("classification_run")
def classification_run_query(spark, sf):
    return classification_run(spark, sf)
