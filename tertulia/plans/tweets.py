"""The derived ``tweets`` table and the small derived inputs of the tests.

``documents`` carries no hashtags, mentions, URLs or emoji, so the view
appends them deterministically from ``doc_id``; labels come from ``labels``
when present.  The whole document text is used (never a prefix).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import assign_split

# Appended snippets keyed by doc_id % 7 (fixed test values).
SNIPPETS_BY_MOD7 = {
    0: " jajaja JAJA hahaha jaja jajaja xD",
    1: " holaaaa?",
    2: " xq q bueno!!",
    3: " 😀 👍",
    4: " ¿NO LO SE? ‘no’ 2015",
}

LABEL_NAMES = ["N", "NEU", "NONE", "P"]   # code 0..3


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Guard against under-split inputs.

    Text work is row-local and CPU-bound, so it needs at least as many
    partitions as task slots.  A large input arrives in thousands of file
    splits and is left alone (no shuffle); an input that arrives in fewer
    splits than the cluster has slots (one big row group, a handful of
    files) is hash-partitioned by its key, which also gives later per-key
    aggregations their partitioning for free.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, key)


def _content(doc_id: Column, text: Column, source: Column) -> Column:
    hashtag = F.when(doc_id % 2 == 0, F.concat(
        F.lit(" #Sol"), F.upper(F.substring(source, 1, 1)), source.substr(F.lit(2), F.length(source)))
    ).otherwise(F.lit(""))
    user = F.when(doc_id % 3 == 0, F.concat(F.lit(" @user"), (doc_id % 50).cast("string"))
                  ).otherwise(F.lit(""))
    url = F.when(doc_id % 5 == 0, F.concat(F.lit(" http://t.co/a"), doc_id.cast("string"))
                 ).otherwise(F.lit(""))
    snip = F.lit("")
    for k in sorted(SNIPPETS_BY_MOD7, reverse=True):
        snip = F.when(doc_id % 7 == k, F.lit(SNIPPETS_BY_MOD7[k])).otherwise(snip)
    return F.concat(text, hashtag, user, url, snip)


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tweets(tweet_id, content, lang, dataset, sentiment)."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"),
               "doc_id")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    # Left join on the document key: a shuffle join at scale (labels is not
    # bounded), AQE turns it into a broadcast when labels turns out small.
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("tweet_id"),
        _content(F.col("doc_id"), F.col("text"), F.col("source")).alias("content"),
        F.col("lang"),
        F.col("source").alias("dataset"),
        F.coalesce(F.col("quality") * 2 + F.col("toxic"), F.col("doc_id") % 4)
        .cast("int").alias("sentiment"),
    )


def tweets_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tweets + ``split`` (train/dev/test, exact 70/15/15 by seeded hash)."""
    return assign_split(tweets(spark, sf_dir), "tweet_id", three_way=True)


# ---------------------------------------------------------------------------
# Small inline inputs (FIXTURES §3)
# ---------------------------------------------------------------------------
LEXICON_POSITIVE = ["bueno", "la", "de", "que", "los"]
LEXICON_NEGATIVE = ["no", "se", "en", "de", "las"]
TERM_MAP = [("holaaaa", "hola"), ("jajaja", "risa"), ("jaja", "risa"), ("xq", "porque"),
            ("q", "que"), ("bueno", "bien")]
# Quota per locale and class label (0 N, 1 NEU, 2 NONE, 3 P).
QUOTAS = {
    "ES": {1: 670, 2: 644, 0: 2241, 3: 1545},
    "CR": {1: 670, 2: 979, 0: 1958, 3: 1520},
    "MX": {1: 450, 2: 330, 0: 2182, 3: 1200},
    "PE": {1: 670, 2: 1480, 0: 758, 3: 789},
    "UY": {1: 670, 2: 325, 0: 1375, 3: 1093},
}


def lexicon(spark: SparkSession) -> DataFrame:
    """lexicon(word, polarity) with +1 / -1 rows."""
    rows = [(w, 1) for w in LEXICON_POSITIVE] + [(w, -1) for w in LEXICON_NEGATIVE]
    return spark.createDataFrame(rows, "word string, polarity int")


def term_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERM_MAP, "term string, canonical string")


def quotas(spark: SparkSession) -> DataFrame:
    rows = [(loc, lab, q) for loc, m in QUOTAS.items() for lab, q in m.items()]
    return spark.createDataFrame(rows, "locale string, label int, quota int")
