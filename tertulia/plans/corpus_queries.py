"""Registered queries: sources and sinks (S*, K*), sampling (R*), corpus
vectors (V*), classification (M*) and evaluation (E*).

Source queries write a fixture derived from ``tweets`` into a fresh folder
under the shared checkpoint directory and read it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions import clean as C
from ..functions import labels as LB
from ..functions import tokens as TK
from ..functions.generators import posexplode_rows
from ..operators import classify as M
from ..operators import ensemble as EN
from ..operators import evaluate as EV
from ..operators import sampling as R
from ..operators import terms as TM
from ..operators.labels import encode_sorted
from ..session import scratch_dir, stored
from ..sources import catalogue as CAT
from ..sources import label_lines as LL
from ..sources import runs as RUNS
from ..sources import tsv as TSV
from ..sources import vectors as VEC
from ..sources import xml as XML
from . import tweets as TW
from .profile_queries import D_DATE, R6, _lexicon_values, _lexr_body, tweet_date
from .registry import query, with_tweets
from .text_queries import W, d_c1, d_c2, d_older, d_treebank, d_words

R9 = 9


def _tw(spark, sf):
    return TW.tweets(spark, sf)


def _tws(spark, sf):
    return TW.tweets_split(spark, sf)


D_NAME = "CASE sentiment WHEN 0 THEN 'N' WHEN 1 THEN 'NEU' WHEN 2 THEN 'NONE' WHEN 3 THEN 'P' END"


# ---------------------------------------------------------------------------
# TSV round trip (partitioned by split)
# ---------------------------------------------------------------------------
TWEET_TSV_SCHEMA = StructType([
    StructField("tweet_id", LongType()), StructField("content", StringType()),
    StructField("lang", StringType()), StructField("dataset", StringType()),
    StructField("sentiment", IntegerType()),
])


@query("scan_tsv_roundtrip", with_tweets(
    "SELECT tweet_id, content, lang, dataset, sentiment, split FROM tweets_split", split=True))
def scan_tsv_roundtrip(spark, sf):
    path = scratch_dir(spark, "tsv")
    TSV.write_tsv(_tws(spark, sf), path, partition_by=["split"])
    return TSV.read_tsv(spark, path, TWEET_TSV_SCHEMA)


# ---------------------------------------------------------------------------
# Corpus catalogue over per-language corpora
# ---------------------------------------------------------------------------
# The corpora by language: intertass es, coah fr, general en, politics the test part of de, and the rest of de
# as the aspect corpora socialtv (even ids) and stompol (odd ids), whose labels are aspect votes.
def _write_corpora(spark, sf):
    from .profile_queries import aspect_polarities
    root = scratch_dir(spark, "corpora")
    tw = stored_tweets(spark, sf)
    cols = ["tweet_id", "content", "sentiment"]

    def put(df, name, part):
        TSV.write_tsv(df.select(*cols), f"{root}/{name}_{part}")

    es = tw.filter("lang = 'es'")
    for p in ["train", "dev", "test"]:
        put(es.filter(F.col("split") == p), "intertass", p)
    put(tw.filter("lang = 'fr'"), "coah", "all")
    en = tw.filter("lang = 'en'")
    put(en.filter("split IN ('train', 'dev')"), "general", "train")
    put(en.filter("split = 'test'"), "general", "test")
    put(tw.filter("lang = 'de' AND split = 'test'"), "politics", "test")
    aspects = tw.filter("lang = 'de'").withColumn("sentiment", LB.aspect_vote(aspect_polarities()))
    for name, odd in (("socialtv", 0), ("stompol", 1)):
        for file, part in (("train", "train"), ("test", "dev")):
            put(aspects.filter((F.col("split") == part) & (F.col("tweet_id") % 2 == odd)), name, file)
    return {
        "intertass": CAT.Corpus("split_files", root),
        "coah": CAT.Corpus("one_file", root, labels="rank"),
        "general": CAT.Corpus("train_test", root),
        "politics": CAT.Corpus("train_test", root, train_from="general"),
        "socialtv": CAT.Corpus("train_test", root, labels="aspect"),
        "stompol": CAT.Corpus("train_test", root, labels="aspect"),
    }


def stored_tweets(spark, sf):
    """The split tweets as a written table, for fixtures that write several files of them."""
    return stored(_tws(spark, sf), "tweets")


def _d_r1(source: str, part_by: str, fracs: tuple, names: tuple) -> str:
    """SQL: R1 split of ``source`` inside each ``part_by`` group."""
    case = " ".join(f"WHEN _rn < floor({f} * _n) THEN '{n}'" for f, n in zip(fracs, names))
    return f"""SELECT * EXCLUDE (_rn, _n), CASE {case} ELSE '{names[len(fracs)]}' END AS split FROM (
      SELECT *, row_number() OVER (PARTITION BY {part_by} ORDER BY md5('1234:' || CAST(tweet_id AS VARCHAR))) - 1 AS _rn,
             count(*) OVER (PARTITION BY {part_by}) AS _n FROM {source})"""


D_VOTE = """(SELECT CASE WHEN p < 0 THEN 0 WHEN p = 0 THEN 1 ELSE 2 END FROM (SELECT coalesce(list_sum(list_transform(
    range(CAST(tweet_id % 4 AS INTEGER)), lambda i: CASE (tweet_id + i) % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END)), 0) AS p))"""

D_CATALOGUE = f"""catalogue AS (
  SELECT tweet_id, content, sentiment, 'intertass' AS dataset, split FROM tweets_split WHERE lang = 'es'
  UNION ALL
  SELECT tweet_id, content, sentiment, 'coah' AS dataset, split FROM (
    {_d_r1("(SELECT tweet_id, content, sentiment, 1 AS g FROM tweets WHERE lang = 'fr')", 'g', (0.7, 0.85), ('train', 'dev', 'test'))})
  UNION ALL
  SELECT tweet_id, content, sentiment, d.dataset, split FROM (
    {_d_r1("(SELECT tweet_id, content, sentiment, 1 AS g FROM tweets_split WHERE lang = 'en' AND split IN ('train', 'dev'))", 'g', (0.85,), ('train', 'dev'))}
  ), (VALUES ('general'), ('politics')) d(dataset)
  UNION ALL
  SELECT tweet_id, content, sentiment, 'general', 'test' FROM tweets_split WHERE lang = 'en' AND split = 'test'
  UNION ALL
  SELECT tweet_id, content, sentiment, 'politics', 'test' FROM tweets_split WHERE lang = 'de' AND split = 'test'
  UNION ALL
  SELECT tweet_id, content, sentiment, dataset, split FROM (
    {_d_r1("(SELECT tweet_id, content, {vote} AS sentiment, CASE tweet_id % 2 WHEN 0 THEN 'socialtv' ELSE 'stompol' END AS dataset FROM tweets_split WHERE lang = 'de' AND split = 'train')".replace("{vote}", D_VOTE), 'dataset', (0.85,), ('train', 'dev'))})
  UNION ALL
  SELECT tweet_id, content, {D_VOTE}, CASE tweet_id % 2 WHEN 0 THEN 'socialtv' ELSE 'stompol' END, 'test'
  FROM tweets_split WHERE lang = 'de' AND split = 'dev')"""


@query("corpus_catalogue", with_tweets(
    "SELECT tweet_id, content, sentiment, split, dataset FROM catalogue", split=True, extra=D_CATALOGUE))
def corpus_catalogue(spark, sf):
    return CAT.read_catalogue(spark, _write_corpora(spark, sf))


@query("corpus_catalogue_reduced", with_tweets("""
SELECT tweet_id, CAST(CASE WHEN dataset IN ('socialtv', 'stompol') THEN sentiment
    WHEN dataset = 'coah' THEN CASE WHEN sentiment < 3 THEN 0 WHEN sentiment = 3 THEN 1 ELSE 2 END
    WHEN sentiment > 1 THEN sentiment - 1 ELSE sentiment END AS INTEGER) AS sentiment, split, dataset
FROM catalogue""", split=True, extra=D_CATALOGUE))
def corpus_catalogue_reduced(spark, sf):
    """S2 + L4: labels reduced to three classes on read, by each corpus's kind of label."""
    return CAT.read_catalogue(spark, _write_corpora(spark, sf), reduce=True).select("tweet_id", "sentiment", "split", "dataset")


@query("union_corpora", with_tweets(
    "SELECT tweet_id, content, sentiment, dataset FROM catalogue WHERE split = 'train'",
    split=True, extra=D_CATALOGUE))
def union_corpora(spark, sf):
    cat = _write_corpora(spark, sf)
    frames = {n: CAT.read_corpus(spark, cat, n).filter("split = 'train'")
              .select("tweet_id", "content", "sentiment") for n in cat}
    return R.union_corpora(frames)


@query("union_corpora_dedupe", with_tweets(
    "SELECT tweet_id, content, sentiment, min(dataset) AS dataset FROM catalogue WHERE split = 'train' "
    "GROUP BY tweet_id, content, sentiment", split=True, extra=D_CATALOGUE))
def union_corpora_dedupe(spark, sf):
    cat = _write_corpora(spark, sf)
    frames = {n: CAT.read_corpus(spark, cat, n).filter("split = 'train'")
              .select("tweet_id", "content", "sentiment") for n in cat}
    return R.union_corpora(frames, dedupe=True)


# ---------------------------------------------------------------------------
# XML corpora
# ---------------------------------------------------------------------------


def _polarity(value):
    return F.concat(F.lit("<polarity><value>"), value, F.lit("</value></polarity>"))


def _tweet_record(values):
    return F.concat(
        F.lit("<tweet>"), XML.element("tweetid", F.col("tweet_id").cast("string")),
        XML.element("user", F.concat(F.lit("user"), (F.col("tweet_id") % 50).cast("string"))),
        XML.element("content", F.col("content")), XML.element("date", tweet_date()),
        XML.element("lang", F.col("lang")),
        F.lit("<sentiment>"), values, F.lit("</sentiment></tweet>"))


@query("xml_tweets", with_tweets(f"""
SELECT tweet_id, content, substr(d, 1, 3) AS day_of_week, substr(d, 5, 3) AS month, substr(d, 12, 2) AS hour,
       lang, value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS sentiment
FROM (SELECT tweet_id, content, lang, {D_DATE} AS d, {D_NAME} AS value FROM tweets)"""))
def xml_tweets(spark, sf):
    """S3: tagged tweets; rows with id % 5 = 0 carry a second value, the
    first one counts.  Labels are encoded in sorted order (L1)."""
    tw = _tw(spark, sf)
    name = LB.decode(F.col("sentiment"))
    values = F.concat(_polarity(name), F.when(F.col("tweet_id") % 5 == 0, _polarity(F.lit("NONE")))
                      .otherwise(F.lit("")))
    path = scratch_dir(spark, "xml-tweets")
    XML.write_xml_records(tw, _tweet_record(values), path)
    x = XML.read_tagged_tweets(spark, path)
    return encode_sorted(x, "value", "sentiment")


@query("xml_general_labels", with_tweets("""
SELECT tweet_id, content, CASE WHEN tweet_id % 23 = 0 THEN NULL ELSE sentiment END AS sentiment FROM tweets"""))
def xml_general_labels(spark, sf):
    """First recognised value -> 0-3; ids % 9 = 0 start with an unknown
    value, ids % 23 = 0 have only an unknown value (null label)."""
    tw = _tw(spark, sf)
    name = _polarity(LB.decode(F.col("sentiment")))
    bad = _polarity(F.lit("X"))
    values = (F.when(F.col("tweet_id") % 23 == 0, bad)
              .when(F.col("tweet_id") % 9 == 0, F.concat(bad, name)).otherwise(name))
    path = scratch_dir(spark, "xml-general")
    XML.write_xml_records(tw, _tweet_record(values), path)
    return XML.read_general(spark, path)


@query("xml_aspects", with_tweets("""
SELECT t.tweet_id, t.content || coalesce(v.spans, '') || ' fin' AS content,
  CASE WHEN coalesce(v.pts, 0) < 0 THEN 0 WHEN coalesce(v.pts, 0) = 0 THEN 1 ELSE 2 END AS sentiment
FROM tweets t LEFT JOIN (
  SELECT tweet_id, string_agg(' x' || CAST(i AS VARCHAR), '' ORDER BY i) AS spans,
         sum(CASE (tweet_id + i) % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) AS pts
  FROM (SELECT tweet_id, unnest(range(CAST(tweet_id % 4 AS INTEGER))) AS i FROM tweets) GROUP BY tweet_id
) v ON t.tweet_id = v.tweet_id"""))
def xml_aspects(spark, sf):
    """Mixed-content tweets with aspect spans; label = aspect vote."""
    from .profile_queries import aspect_polarities
    tw = _tw(spark, sf).withColumn("_pols", aspect_polarities())
    spans = F.array_join(F.transform(
        F.col("_pols"), lambda p, i: F.concat(F.lit(' <sentiment aspect="a'), i.cast("string"),
                                              F.lit('" polarity="'), p, F.lit('">x'),
                                              i.cast("string"), F.lit("</sentiment>"))), "")
    rec = F.concat(F.lit('<tweet id="'), F.col("tweet_id").cast("string"), F.lit('">'),
                   XML.xml_escape(F.col("content")), spans, F.lit(" fin</tweet>"))
    path = scratch_dir(spark, "xml-aspects")
    XML.write_xml_records(tw, rec, path)
    x = XML.read_aspects(spark, path)
    return x.select("tweet_id", "content", LB.aspect_vote(F.col("polarities")).alias("sentiment"))


@query("xml_reviews", with_tweets("""
SELECT CAST(tweet_id AS VARCHAR) AS id, CAST(tweet_id % 5 + 1 AS INTEGER) AS sentiment,
       dataset || ' ' || lang AS abstract, content AS review FROM tweets"""))
def xml_reviews(spark, sf):
    """Hotel reviews (id, rank, abstract, review)."""
    tw = _tw(spark, sf)
    rec = F.concat(F.lit("<hotel_review>"), XML.element("id", F.col("tweet_id").cast("string")),
                   XML.element("rank", ((F.col("tweet_id") % 5) + 1).cast("string")),
                   XML.element("abstract", F.concat_ws(" ", "dataset", "lang")),
                   XML.element("review", F.col("content")), F.lit("</hotel_review>"))
    path = scratch_dir(spark, "xml-hotel")
    XML.write_xml_records(tw, rec, path)
    return XML.read_hotel_reviews(spark, path)


@query("xml_product_reviews", with_tweets("""
SELECT CAST(tweet_id % 5 + 1 AS INTEGER) AS sentiment, 'item ' || CAST(tweet_id AS VARCHAR) AS summary,
       content AS body FROM tweets"""))
def xml_product_reviews(spark, sf):
    """Product reviews; the rank is an attribute of a nested ``review``."""
    tw = _tw(spark, sf)
    rank = F.concat(F.lit('<review rank="'), ((F.col("tweet_id") % 5) + 1).cast("string"), F.lit('"'))
    summary = XML.element("summary", F.concat(F.lit("item "), F.col("tweet_id").cast("string")))
    body = XML.element("body", F.col("content"))
    # Every third record holds its body, every sixth its summary too, in the nested review.
    inner = F.when(F.col("tweet_id") % 3 == 0, F.concat(rank, F.lit(">"), F.when(F.col("tweet_id") % 6 == 0, summary)
                                                      .otherwise(F.lit("")), body, F.lit("</review>")))
    rec = F.when(F.col("tweet_id") % 6 == 0, F.concat(F.lit("<review>"), inner, F.lit("</review>"))).when(
        F.col("tweet_id") % 3 == 0, F.concat(F.lit("<review>\n"), inner, summary, F.lit("</review>"))).otherwise(
        F.concat(F.lit("<review>"), summary, body, rank, F.lit("/></review>")))
    path = scratch_dir(spark, "xml-product")
    XML.write_xml_records(tw, rec, path)
    return XML.read_product_reviews(spark, path)


# ---------------------------------------------------------------------------
# Label lines
# ---------------------------------------------------------------------------
def _embedding_clean():
    return C.clean_text(F.col("content"), C.EMBEDDING)


D_EMB = f"lower({d_c2(d_c1('content'))})"


@query("label_lines_write", with_tweets(
    f"SELECT '__label__' || CAST(sentiment AS VARCHAR) || ' ' || {D_EMB} AS value FROM tweets"))
def label_lines_write(spark, sf):
    tw = _tw(spark, sf).withColumn("text", _embedding_clean())
    path = scratch_dir(spark, "ftx-write")
    LL.write_label_lines(tw, "sentiment", "text", path)
    return spark.read.text(path)


@query("label_lines_read", with_tweets(
    f"SELECT content, sentiment FROM (SELECT {D_EMB} AS content, sentiment FROM tweets_split "
    "WHERE split IN ('train', 'dev')) WHERE content <> ''", split=True))
def label_lines_read(spark, sf):
    """S8 + R5: train and dev label-line files read together; invalid
    labels and empty texts are dropped."""
    tw = _tws(spark, sf).withColumn("text", _embedding_clean())
    root = scratch_dir(spark, "ftx-read")
    for part in ["train", "dev"]:
        rows = tw.filter(F.col("split") == part)
        lines = LL.to_label_lines(rows, "sentiment", "text").unionByName(
            rows.filter(F.col("tweet_id") % 31 == 0).select(
                F.concat(F.lit("__label__9 "), F.col("text")).alias("value"))).unionByName(
            rows.filter(F.col("tweet_id") % 37 == 0).select(
                F.concat(F.lit("__label__"), F.col("sentiment").cast("string"), F.lit(" ")).alias("value")))
        lines.write.mode("overwrite").text(f"{root}/{part}")
    return LL.read_label_lines(spark, f"{root}/train", f"{root}/dev")


@query("label_lines_older", with_tweets(
    "SELECT '__label__' || name || chr(9) || array_to_string(toks, ' ') AS value FROM ("
    f"SELECT {D_NAME} AS name, {d_treebank(d_older('content'))} AS toks FROM tweets)"))
def label_lines_older(spark, sf):
    """C14 + T1c + K2 (tab form): older-years cleaning, tokens joined by one
    space, label names as written by the older-years exporter."""
    tw = _tw(spark, sf).select(LB.decode(F.col("sentiment")).alias("name"),
                               TK.tokens_joined(C.clean_older(F.col("content"))).alias("text"))
    path = scratch_dir(spark, "ftx-older")
    LL.to_label_lines_tab(tw, "name", "text").write.mode("overwrite").text(path)
    return spark.read.text(path)


# ---------------------------------------------------------------------------
# Gold and run files
# ---------------------------------------------------------------------------
def _rule_pred():
    c = F.col("content")
    return F.when(c.contains("bueno"), 3).when(c.contains("NO"), 0).otherwise(2)


D_RULE = "CASE WHEN contains(content, 'bueno') THEN 3 WHEN contains(content, 'NO') THEN 0 ELSE 2 END"


@query("run_file_audit", with_tweets(f"""
SELECT
  CAST((SELECT count(*) FROM tweets WHERE tweet_id % 13 <> 0) + (SELECT count(*) FROM tweets WHERE tweet_id % 17 = 0)
       + (SELECT count(*) FROM tweets WHERE tweet_id % 13 <> 0 AND tweet_id % 19 = 0) AS BIGINT) AS valid_lines,
  CAST(1 AS BIGINT) AS malformed_lines,
  CAST((SELECT count(*) FROM tweets WHERE tweet_id % 17 = 0) AS BIGINT) AS unknown_lines,
  CAST((SELECT count(*) FROM tweets WHERE tweet_id % 13 <> 0 AND tweet_id % 19 = 0) AS BIGINT) AS duplicate_lines,
  CAST((SELECT count(*) FROM tweets WHERE tweet_id % 13 = 0) AS BIGINT) AS missing_ids,
  false AS valid_run"""))
def run_file_audit(spark, sf):
    tw = _tw(spark, sf).withColumn("pred", _rule_pred())
    root = scratch_dir(spark, "runs")
    RUNS.write_id_label(tw, "tweet_id", "sentiment", f"{root}/gold")
    kept = tw.filter(F.col("tweet_id") % 13 != 0)
    first = kept.filter(F.col("tweet_id") % 19 == 0).withColumn("pred", (F.col("pred") + 1) % 4)
    unknown = tw.filter(F.col("tweet_id") % 17 == 0).withColumn(
        "tweet_id", F.col("tweet_id") + 1_000_000_000)
    RUNS.write_id_label(first, "tweet_id", "pred", f"{root}/run/part1")
    RUNS.write_id_label(kept.unionByName(unknown), "tweet_id", "pred", f"{root}/run/part2")
    spark.createDataFrame([("malformed line without tab",)], "value string") \
        .write.mode("overwrite").text(f"{root}/run/part3")
    gold = RUNS.read_lines_ordered(spark, f"{root}/gold")
    run = RUNS.read_lines_ordered(spark, f"{root}/run/*")
    return EV.run_file_audit(gold, run, "line_order")


# ---------------------------------------------------------------------------
# Word vectors and mean embeddings
# ---------------------------------------------------------------------------
@query("word_vectors", f"""
SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
       round(CAST(unnest(embedding) AS DOUBLE), {R6}) AS value FROM embeddings""")
def word_vectors(spark, sf):
    emb = TW.read_table(spark, sf, "embeddings")
    dim = len(emb.select("embedding").first()[0])
    path = scratch_dir(spark, "vec")
    words = emb.select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
                       F.col("embedding").alias("vector"))
    VEC.write_vectors(words, "word", "vector", path)
    v = VEC.read_vectors(spark, path, dim)
    return posexplode_rows(v, ["word"], F.col("vector"), "dim", "value").select(
        "word", "dim", F.round(F.col("value").cast("double"), R6).alias("value"))


@query("word_vector_lines", """
SELECT CASE k WHEN 0 THEN 'header' WHEN 1 THEN 'malformed' ELSE 'vector' END AS kind, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN vec_id % 10 IN (3, 7) THEN 1 ELSE 2 END AS k, 1 AS n FROM embeddings UNION ALL SELECT 0, 1)
GROUP BY k""")
def word_vector_lines(spark, sf):
    """A file with its header, vectors of two-word words, lines of a wrong
    length (ids ending in 3) or with a field that is no number (in 7): every
    line is accounted for."""
    emb = TW.read_table(spark, sf, "embeddings")
    root = scratch_dir(spark, "vec-lines")
    size = emb.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    text = F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")
    word = F.concat(F.lit("w"), F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 4 == 0, " x").otherwise(F.lit("")))
    line = (F.when(F.col("vec_id") % 10 == 3, F.concat(word, F.lit(" 0.5")))
            .when(F.col("vec_id") % 10 == 7, F.concat(word, F.lit(" x"), F.substring(text, F.lit(2), F.length(text))))
            .otherwise(F.concat(word, F.lit(" "), text)))
    spark.createDataFrame([(f"{size['n']} {size['d']}",)], "value string").write.text(f"{root}/part0")
    emb.select(line.alias("value")).write.text(f"{root}/part1")
    lines = VEC.vector_lines(RUNS.read_lines_ordered(spark, f"{root}/*"), size["d"])
    return lines.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("mean_embedding", f"""
SELECT label, dim, round(avg(v), {R6}) AS mean FROM (
  SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v
  FROM embeddings) GROUP BY label, dim""")
def mean_embedding(spark, sf):
    emb = TW.read_table(spark, sf, "embeddings")
    m = TM.mean_embedding(emb, ["label"], "embedding")
    return m.withColumn("mean", F.round("mean", R6))


# ---------------------------------------------------------------------------
# sampling
# ---------------------------------------------------------------------------
@query("split_three_way", with_tweets("SELECT tweet_id, split FROM tweets_split", split=True))
def split_three_way(spark, sf):
    return R.assign_split(_tw(spark, sf).select("tweet_id"), "tweet_id", three_way=True)


@query("split_two_way", with_tweets(
    "SELECT tweet_id, split FROM (" + _d_r1("(SELECT tweet_id, 1 AS g FROM tweets)", "g", (0.85,),
                                            ("train", "dev")) + ")"))
def split_two_way(spark, sf):
    return R.assign_split(_tw(spark, sf).select("tweet_id"), "tweet_id", three_way=False)


@query("split_hash_threshold", with_tweets("""
SELECT tweet_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'dev' ELSE 'test' END AS split FROM (
  SELECT tweet_id, ('0x' || substr(md5('1234:' || CAST(tweet_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM tweets)"""))
def split_hash_threshold(spark, sf):
    return R.hash_split(_tw(spark, sf).select("tweet_id"), "tweet_id")


@query("upsample", with_tweets("""
SELECT tweet_id, sentiment, content, CAST(0 AS BIGINT) AS draw FROM tweets
UNION ALL
SELECT i.tweet_id, d.sentiment, i.content, d.draw FROM (
  SELECT c.sentiment, c.n, CAST(j AS BIGINT) AS draw,
         ('0x' || substr(md5('1234:' || CAST(c.sentiment AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 15))::BIGINT % c.n AS idx
  FROM (SELECT sentiment, count(*) AS n, max(count(*)) OVER () AS top FROM tweets GROUP BY sentiment) c,
       LATERAL (SELECT unnest(range(1, c.top - c.n + 1)) AS j)
) d JOIN (
  SELECT tweet_id, sentiment, content, row_number() OVER (PARTITION BY sentiment ORDER BY md5('1234:' || CAST(tweet_id AS VARCHAR))) - 1 AS idx
  FROM tweets) i ON d.sentiment = i.sentiment AND d.idx = i.idx"""))
def upsample(spark, sf):
    return R.upsample(_tw(spark, sf), "sentiment", "tweet_id", keep=["content"])


def _quota_values():
    rows = [(loc, lab, q) for loc, m in TW.QUOTAS.items() for lab, q in m.items()]
    return "(VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in rows) + ") AS q(locale, label, quota)"


@query("quota_sample", with_tweets(f"""
SELECT q.locale, r.tweet_id, r.sentiment FROM (
  SELECT tweet_id, sentiment, row_number() OVER (PARTITION BY sentiment ORDER BY tweet_id) AS rn FROM tweets) r
JOIN {_quota_values()} ON r.sentiment = q.label AND r.rn <= q.quota"""))
def quota_sample(spark, sf):
    tw = _tw(spark, sf).select("tweet_id", "sentiment")
    return R.quota_sample(tw, TW.quotas(spark), "sentiment", "tweet_id").select(
        "locale", "tweet_id", "sentiment")


@query("class_weights", with_tweets(f"""
SELECT sentiment, n_rows, round(sum(n_rows) OVER () / (count(*) OVER () * n_rows), {R9}) AS weight
FROM (SELECT sentiment, count(*) AS n_rows FROM tweets GROUP BY sentiment)"""))
def class_weights(spark, sf):
    return R.class_weight_table(_tw(spark, sf), "sentiment").withColumn(
        "weight", F.round("weight", R9))


# ---------------------------------------------------------------------------
# Corpus vectors
# ---------------------------------------------------------------------------
D_MAIN_TOKENS = d_words(f"lower({d_c2(d_c1('content'))})")


def _main_terms(spark, sf):
    tw = _tws(spark, sf)
    words = TK.words_apart(C.clean_text(F.col("content"), C.MAIN))
    return tw, TM.doc_terms_by_id(tw.select("tweet_id", "split", "sentiment", "content"), "tweet_id", words, ["split", "sentiment"])


D_DOC_TERMS = f"""doc_terms AS MATERIALIZED (
  SELECT tweet_id, term, count(*) AS tf FROM (
    SELECT tweet_id, unnest({D_MAIN_TOKENS}) AS term FROM tweets) GROUP BY tweet_id, term)"""


D_TRAIN_VOCABULARY = D_DOC_TERMS + """,
train_vocabulary AS MATERIALIZED (
  SELECT DISTINCT d.term FROM doc_terms d JOIN tweets_split t ON d.tweet_id = t.tweet_id WHERE t.split = 'train')"""


@query("count_vectors", with_tweets("""
SELECT d.tweet_id, d.term, d.tf AS value FROM doc_terms d JOIN train_vocabulary v ON d.term = v.term""",
    split=True, extra=D_TRAIN_VOCABULARY))
def count_vectors(spark, sf):
    terms = stored(_main_terms(spark, sf)[1], "doc-terms")
    return TM.count_vectors(terms, "tweet_id", F.col("split") == "train")


@query("binary_vectors", with_tweets("""
SELECT d.tweet_id, d.term, CAST(1 AS BIGINT) AS value FROM doc_terms d JOIN train_vocabulary v ON d.term = v.term""",
    split=True, extra=D_TRAIN_VOCABULARY))
def binary_vectors(spark, sf):
    terms = stored(_main_terms(spark, sf)[1], "doc-terms")
    return TM.count_vectors(terms, "tweet_id", F.col("split") == "train", binary=True)


@query("tfidf", with_tweets(f"""
SELECT tweet_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY tweet_id)), {R9}) AS weight FROM (
  SELECT d.tweet_id, d.term, d.tf * v.idf AS w FROM doc_terms d JOIN (
    SELECT term, ln((1 + (SELECT count(*) FROM tweets_split WHERE split = 'train')) / (1 + df)) + 1 AS idf FROM (
      SELECT term, sum(tf) AS tot, count(*) AS df FROM doc_terms
      WHERE tweet_id IN (SELECT tweet_id FROM tweets_split WHERE split = 'train')
      GROUP BY term ORDER BY tot DESC, term LIMIT {TM.TFIDF_MAX_FEATURES})) v ON d.term = v.term)""",
    split=True, extra=D_DOC_TERMS))
def tfidf(spark, sf):
    tw, terms = _main_terms(spark, sf)
    terms = stored(terms, "doc-terms")  # vocabulary and weights from one pass over the text
    n_train = tw.filter("split = 'train'").select(F.count(F.lit(1))).scalar()
    out = TM.tfidf(terms, "tweet_id", F.col("split") == "train", n_train)
    return out.withColumn("weight", F.round("weight", R9))


def _disc(spark, sf):
    tw = _tws(spark, sf).filter("split = 'train' AND sentiment IN (0, 3)")
    docs = tw.select("tweet_id", (F.col("sentiment") == 3).alias("is_pos"),
                     TK.treebank_tokens(F.col("content")).alias("toks"))
    return TM.discriminating_terms(docs, "tweet_id", "toks", "is_pos")


D_DISC = f"""disc AS (
  SELECT grp AS "group", CAST(row_number() OVER (PARTITION BY grp ORDER BY score, term) AS INTEGER) AS rank,
         term, a, b, score
  FROM (
    SELECT term, a, b, CASE WHEN a * nb >= b * na THEN 'positive' ELSE 'negative' END AS grp,
           lgamma(a + 1) + lgamma(b + 1) - lgamma(a + b + 2)
           + lgamma(na - a + 1) + lgamma(nb - b + 1) - lgamma(na - a + nb - b + 2) AS score
    FROM (
      SELECT term, a, b, na, nb FROM (
        SELECT term, count(*) FILTER (WHERE is_pos) AS a, count(*) FILTER (WHERE NOT is_pos) AS b,
               (SELECT count(*) FILTER (WHERE sentiment = 3) FROM tweets_split WHERE split = 'train' AND sentiment IN (0, 3)) AS na,
               (SELECT count(*) FILTER (WHERE sentiment = 0) FROM tweets_split WHERE split = 'train' AND sentiment IN (0, 3)) AS nb
        FROM (SELECT DISTINCT tweet_id, sentiment = 3 AS is_pos, unnest({d_treebank('content')}) AS term
              FROM tweets_split WHERE split = 'train' AND sentiment IN (0, 3))
        GROUP BY term)
      WHERE a + b >= {TM.DISCRIMINATING_MIN_DF} AND a + b <= {TM.DISCRIMINATING_MAX_DF} * (na + nb)
      ORDER BY a + b DESC, term LIMIT {TM.DISCRIMINATING_MAX_TERMS})))"""


@query("discriminating_terms", with_tweets(
    f'SELECT "group", rank, term, a, b, round(score, {R6}) AS score FROM disc WHERE rank <= {TM.DISCRIMINATING_TOP_N}',
    split=True, extra=D_DISC))
def discriminating_terms(spark, sf):
    d = _disc(spark, sf)
    return d.select("group", F.col("rank").cast("int").alias("rank"), "term", "a", "b",
                    F.round("score", R6).alias("score"))


@query("sentiment_vocabulary", with_tweets(f"""
SELECT DISTINCT word, polarity FROM (
  SELECT word, polarity FROM {_lexicon_values()}
  UNION ALL
  SELECT term AS word, CASE WHEN "group" = 'positive' THEN 1 ELSE -1 END AS polarity FROM disc
  WHERE rank <= {TM.DISCRIMINATING_TOP_N})""", split=True, extra=D_DISC))
def sentiment_vocabulary(spark, sf):
    return TM.sentiment_vocabulary(TW.lexicon(spark), _disc(spark, sf))


@query("lexicon_coverage", with_tweets(f"""
SELECT s.polarity,
  (SELECT count(DISTINCT word) FROM {_lexicon_values()} WHERE lex.polarity = s.polarity) AS lexicon_words,
  (SELECT count(DISTINCT word) FROM {_lexicon_values()} WHERE lex.polarity = s.polarity
     AND word IN (SELECT term FROM doc_terms)) AS lexicon_hits,
  (SELECT count(DISTINCT term) FROM kept WHERE kept.polarity = s.polarity) AS discriminating_terms,
  (SELECT count(DISTINCT term) FROM kept WHERE kept.polarity = s.polarity
     AND term NOT IN (SELECT word FROM {_lexicon_values()})) AS discriminating_not_in_lexicon
FROM (VALUES (1), (-1)) s(polarity)""",
    split=True, extra=D_DISC + ",\n" + D_DOC_TERMS + f""",
kept AS (SELECT term, CASE WHEN "group" = 'positive' THEN 1 ELSE -1 END AS polarity FROM disc
         WHERE rank <= {TM.DISCRIMINATING_TOP_N})"""))
def lexicon_coverage(spark, sf):
    _, terms = _main_terms(spark, sf)
    return TM.lexicon_coverage(terms, TW.lexicon(spark), _disc(spark, sf))


@query("feature_lexicon_fitted", with_tweets(_lexr_body("fitted AS lex"), split=True, extra=D_DISC + f""",
fitted AS (SELECT word, polarity FROM {_lexicon_values()}
           UNION ALL SELECT term, CASE WHEN "group" = 'positive' THEN 1 ELSE -1 END FROM disc
           WHERE rank <= {TM.DISCRIMINATING_TOP_N})"""))
def feature_lexicon_fitted(spark, sf):
    """F9 fed by F10: the lexicon and the discriminating terms of the training
    rows, applied to all rows.  The vocabulary is fitted once and written."""
    path = scratch_dir(spark, "fitted-vocabulary")
    TM.sentiment_vocabulary(TW.lexicon(spark), _disc(spark, sf)).write.parquet(path)
    tw = _tw(spark, sf).select("tweet_id", TK.treebank_tokens(F.col("content")).alias("toks"))
    r = TM.lexicon_ratios(tw, "tweet_id", "toks", spark.read.parquet(path))
    return r.select("tweet_id", *[F.round(c, R9).alias(c) for c in ["pos_voc", "neg_voc", "neu_voc", "none_voc"]])


@query("tfidf_vectors", with_tweets(f"""
SELECT tweet_id, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY tweet_id)), {R9}) AS weight FROM (
  SELECT d.tweet_id, v.idx, d.tf * v.idf AS w FROM doc_terms d JOIN (
    SELECT term, CAST(row_number() OVER (ORDER BY tot DESC, term) - 1 AS INTEGER) AS idx,
           ln((1 + (SELECT count(*) FROM tweets_split WHERE split = 'train')) / (1 + df)) + 1 AS idf FROM (
      SELECT d.term, sum(d.tf) AS tot, count(*) AS df FROM doc_terms d JOIN tweets_split t ON d.tweet_id = t.tweet_id
      WHERE t.split = 'train' GROUP BY d.term ORDER BY tot DESC, d.term LIMIT {TM.TFIDF_MAX_FEATURES})) v ON d.term = v.term)""",
    split=True, extra=D_DOC_TERMS))
def tfidf_vectors(spark, sf):
    """M1 on V3: the entries of the ML vectors that the classifier is fitted on."""
    v = tfidf_features(spark, sf).select("tweet_id", F.explode(TM.vector_entries(F.col("features"))).alias("e"))
    return v.select("tweet_id", "e.idx", F.round("e.weight", R9).alias("weight"))


def tfidf_features(spark, sf):
    """(tweet_id, split, sentiment, features)."""
    tw, terms = _main_terms(spark, sf)
    terms = stored(terms, "doc-terms")
    n_train = tw.filter("split = 'train'").select(F.count(F.lit(1))).scalar()
    return TM.tfidf_vectors(terms, tw.select("tweet_id", "split", "sentiment"), "tweet_id", F.col("split") == "train", n_train)


D_VECTORS = """n AS (SELECT count(*) AS n FROM embeddings),
vec AS MATERIALIZED (SELECT t.term, e.embedding FROM (
    SELECT DISTINCT term, ('0x' || substr(md5(term), 1, 8))::BIGINT % (SELECT n FROM n) AS vec_id FROM doc_terms) t
  JOIN embeddings e ON e.vec_id = t.vec_id WHERE ('0x' || substr(md5(t.term), 9, 2))::BIGINT < 200)"""


@query("document_embedding", with_tweets(f"""
SELECT t.tweet_id, coalesce(x.n_tokens, 0) AS n_tokens, x.dim, x.mean FROM tweets t LEFT JOIN (
  SELECT tweet_id, CAST(sum(tf) AS BIGINT) AS n_tokens, dim, round(sum(tf * v) / sum(tf), {R6}) AS mean FROM (
    SELECT d.tweet_id, d.tf, CAST(generate_subscripts(v.embedding, 1) - 1 AS INTEGER) AS dim,
           CAST(unnest(v.embedding) AS DOUBLE) AS v FROM doc_terms d JOIN vec v ON d.term = v.term)
  GROUP BY tweet_id, dim) x ON t.tweet_id = x.tweet_id""", extra=D_DOC_TERMS + ",\n" + D_VECTORS))
def document_embedding(spark, sf):
    """V6: mean word vectors of all documents; four in five terms have a
    vector, taken from ``embeddings`` by a hash of the term."""
    _, terms = _main_terms(spark, sf)
    terms = stored(terms, "doc-terms")
    emb = TW.read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = emb.count()
    words = terms.select("term").distinct()
    h = F.md5("term")
    words = words.filter(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") < 200).select(
        F.col("term").alias("word"), F.pmod(R.hash_to_int(h, 8), F.lit(n)).alias("vec_id"))
    vectors = words.join(emb, "vec_id").select("word", F.col("embedding").alias("vector"))
    d = TM.document_embedding(terms, _tw(spark, sf).select("tweet_id"), "tweet_id", vectors,
                              emb.agg(F.max(F.size("embedding"))).first()[0])
    d = d.select("tweet_id", "n_tokens", F.posexplode_outer("embedding").alias("dim", "mean"))
    return d.withColumn("mean", F.round("mean", R6))
