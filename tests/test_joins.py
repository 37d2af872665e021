"""The join helpers against plain joins."""

from collections import Counter

from pyspark.sql import functions as F

from tertulia.operators.joins import broadcast_if_small, heavy_join


def test_heavy_join_equals_left_join(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 400).cast("string"))).alias("key"), F.col("id").alias("v"))
    right = spark.range(300).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id").union(
        spark.createDataFrame([("hot", -1), ("unused", -2)], "key string, id long"))
    want = Counter(map(tuple, left.join(right, "key", "left").collect()))
    for heavy_keys in (1, 7, 1000):
        got = heavy_join(left, right, "key", heavy_keys=heavy_keys)
        assert got.columns == ["key", "v", "id"]
        assert Counter(map(tuple, got.collect())) == want
    freq = spark.createDataFrame([("hot", 9), ("k3", 1)], "key string, n long")
    assert Counter(map(tuple, heavy_join(left, right, "key", freq).collect())) == want
    assert heavy_join(left.limit(0), right, "key").count() == 0


def test_heavy_join_broadcasts_bounded_rows_only(spark):
    left = spark.range(100).select((F.col("id") % 7).alias("key"))
    p = heavy_join(left, left.distinct().withColumn("x", F.lit(1)), "key", heavy_keys=2)
    text = p._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject(limit=2" in text


def test_broadcast_if_small(spark):
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(broadcast_if_small(spark.range(5), 5))
    assert not hint(broadcast_if_small(spark.range(6), 5))
