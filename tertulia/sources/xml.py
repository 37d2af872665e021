"""XML corpora parsed with Spark's built-in XML support (``from_xml``).

* tagged tweets (``rowTag=tweet``): id, content, date slices, first
  polarity value (older-years rule; also right for single-value rows);
* general corpus: first *recognised* value mapped to 0-3, else null;
* aspect tweets (mixed content): read as text records split at
  ``</tweet>`` and evaluated with ``xpath_string`` / ``xpath`` so the text
  keeps its order;
* hotel reviews (``rowTag=hotel_review``) and product reviews (``rowTag=review``,
  rank is an attribute of a nested ``review``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.labels import date_parts, encode_fixed
from ..session import scratch_dir

XML_OPTIONS = {"ignoreSurroundingSpaces": "false", "ignoreNamespace": "true"}

TWEET_SCHEMA = StructType([
    StructField("tweetid", StringType()),
    StructField("user", StringType()),
    StructField("content", StringType()),
    StructField("date", StringType()),
    StructField("lang", StringType()),
    StructField("sentiment", StructType([
        StructField("polarity", ArrayType(StructType([
            StructField("value", StringType()),
            StructField("type", StringType()),
        ]))),
    ])),
])

HOTEL_SCHEMA = StructType([
    StructField("id", StringType()), StructField("rank", StringType()),
    StructField("abstract", StringType()), StructField("review", StringType()),
])

PRODUCT_SCHEMA = StructType([
    StructField("summary", StringType()), StructField("body", StringType()),
    StructField("review", StructType([
        StructField("_rank", StringType()), StructField("summary", StringType()), StructField("body", StringType())])),
])


def xml_escape(c: Column) -> Column:
    """Escape ``& < >`` for element text."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def element(tag: str, c: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), xml_escape(c), F.lit(f"</{tag}>"))


def read_records(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """One string per ``<row_tag>`` element: files are cut at the closing
    tag (a splittable text read), so records may span lines and files of
    any size are read in parallel."""
    raw = spark.read.option("lineSep", f"</{row_tag}>").text(path)
    # What stands before the tag (declaration, root element) is no part of the record.
    rec = F.regexp_extract(F.col("value"), rf"(?s)<{row_tag}[\s>].*", 0)
    return (raw.select(rec.alias("_r")).filter(F.col("_r") != "")
            .select(F.concat(F.col("_r"), F.lit(f"</{row_tag}>")).alias("record")))


def nested_records(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Like ``read_records`` for elements that may hold elements of their own
    name: a record ends at the close tag that brings the depth back.

    The pieces between close tags are written once with their file, split and
    place.  The depth after a piece is a running sum of its open tags less its
    close tag, taken within each split and shifted by the sums of the splits
    before it (one row a split), so a file is never one task; a record ends
    where that sum is as low as it ever was in the file, which a stray close
    tag does not upset for the records after it.  Pieces that are whole records
    stay where they are; the others are gathered by record.  Tags inside
    comments do not count; CDATA sections must not hold the close tag.
    """
    raw = spark.read.option("lineSep", f"</{row_tag}>").text(path)
    pieces = raw.select("value", F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    store = scratch_dir(spark, "xml-pieces")
    pieces.write.parquet(store)
    pieces = spark.read.parquet(store)
    bare = F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    opens = F.regexp_count(bare, F.lit(rf"(?s)<{row_tag}(?=[\s>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<!/)>"))
    d = pieces.select("file", "block", "at", (opens - 1).cast("long").alias("d"))
    upto = Window.partitionBy("file", "block").orderBy("at")
    d = d.withColumn("s", F.sum("d").over(upto))
    d = d.withColumn("low", F.min("s").over(upto))
    splits = d.groupBy("file", "block").agg(F.sum("d").alias("sum"), F.min("s").alias("low"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    splits = splits.select("file", "block", "base", F.least(
        F.lit(0), F.coalesce(F.min(F.col("base") + F.col("low")).over(before), F.lit(0))).alias("floor"))
    d = d.join(splits, ["file", "block"])
    d = d.withColumn("end", ((F.col("base") + F.col("s")) == F.least("floor", F.col("base") + F.col("low"))).cast("long"))
    # A record's number is the number of ends before it in the file, again by splits.
    ends = d.groupBy("file", "block").agg(F.sum("end").alias("ends"))
    ends = ends.select("file", "block", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first"))
    d = d.withColumn("own", F.coalesce(F.sum("end").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(ends, ["file", "block"]).select("file", "at", (F.col("first") + F.col("own")).alias("rec"), "end")
    parts = d.join(d.groupBy("file", "rec").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("ended")), ["file", "rec"])
    odd = parts.filter("n > 1 OR ended = 0").select("file", "at", "rec", "ended")
    whole = pieces.join(odd, ["file", "at"], "left_anti").select("value")
    close = F.lit(f"</{row_tag}>")
    joined = (pieces.join(odd.filter("ended = 1"), ["file", "at"]).groupBy("file", "rec")
              .agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("p"))
              .select(F.array_join(F.col("p.value"), f"</{row_tag}>").alias("value")))
    rec = F.regexp_extract("value", rf"(?s)<{row_tag}[\s>].*", 0)
    return (whole.unionByName(joined).select(rec.alias("_r")).filter(F.col("_r") != "")
            .select(F.concat("_r", close).alias("record")))


def read_rows(spark: SparkSession, path: str, row_tag: str, schema: StructType) -> DataFrame:
    """Parse each record with ``from_xml`` against an explicit schema."""
    recs = read_records(spark, path, row_tag)
    return recs.select(F.from_xml(F.col("record"), schema, XML_OPTIONS).alias("_x")).select("_x.*")


def read_tagged_tweets(spark: SparkSession, path: str) -> DataFrame:
    """S3: (tweet_id, content, day_of_week, month, hour, lang, value)."""
    x = read_rows(spark, path, "tweet", TWEET_SCHEMA)
    return x.select(F.col("tweetid").cast("long").alias("tweet_id"), "content",
                    *date_parts(F.col("date")), "lang",
                    F.col("sentiment.polarity")[0]["value"].alias("value"))


def read_general(spark: SparkSession, path: str) -> DataFrame:
    """Content + first recognised value as 0-3 (null when none is)."""
    x = read_rows(spark, path, "tweet", TWEET_SCHEMA)
    codes = F.filter(F.transform(F.col("sentiment.polarity"), lambda p: encode_fixed(p["value"])),
                     lambda c: c.isNotNull())
    return x.select(F.col("tweetid").cast("long").alias("tweet_id"), "content",
                    F.try_element_at(codes, F.lit(1)).alias("sentiment"))


def read_aspects(spark: SparkSession, path: str) -> DataFrame:
    """Text of each ``<tweet>`` with tags stripped (document order kept,
    entities unescaped, newlines trimmed at the ends) and its polarities."""
    x = read_records(spark, path, "tweet").withColumnRenamed("record", "_x")
    text = F.expr("xpath_string(_x, 'string(/tweet)')")
    return x.select(F.expr("xpath_string(_x, '/tweet/@id')").cast("long").alias("tweet_id"),
                    F.regexp_replace(text, r"^\n+|\n+\z", "").alias("content"),
                    F.expr("xpath(_x, '/tweet/sentiment/@polarity')").alias("polarities"))


def read_hotel_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(id, sentiment rank, abstract, review)."""
    x = read_rows(spark, path, "hotel_review", HOTEL_SCHEMA)
    return x.select("id", F.col("rank").cast("int").alias("sentiment"), "abstract", "review")


def read_product_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(sentiment rank, summary, body).  The rank is an attribute of a
    ``review`` inside the ``review``; summary and body may stand in either."""
    recs = nested_records(spark, path, "review")
    x = recs.select(F.from_xml(F.col("record"), PRODUCT_SCHEMA, XML_OPTIONS).alias("_x")).select("_x.*")
    return x.select(F.col("review._rank").cast("int").alias("sentiment"),
                    F.coalesce("summary", "review.summary").alias("summary"),
                    F.coalesce("body", "review.body").alias("body"))


def write_xml_records(df: DataFrame, record: Column, path: str) -> None:
    """Write one XML record per line (a record may span lines)."""
    df.select(record.alias("value")).write.mode("overwrite").text(path)
