"""Registered queries: entities and profiles (X*), row features (F1-F8),
label mapping (L*), and the flagship per-class profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import features as FE
from ..functions import labels as LB
from ..functions import tokens as TK
from ..functions.generators import explode_rows
from ..operators import entities as X
from ..operators import terms as TM
from . import tweets as TW
from .registry import query, sql_str, with_tweets
from .text_queries import NW, W, d_c1, d_c2, d_emoji, d_words, NOT_SPACE

R6 = 6   # decimals kept for floating-point outputs (both engines round)


def _tw(spark, sf):
    return TW.tweets(spark, sf)


def _tws(spark, sf):
    return TW.tweets_split(spark, sf)


# ---------------------------------------------------------------------------
# Entities (X1-X7)
# ---------------------------------------------------------------------------
D_ENTITIES = f"""
  SELECT tweet_id, 'hashtag' AS kind, unnest(regexp_extract_all(content, '(^|{NW})(#{W}+)', 2)) AS value FROM tweets
  UNION ALL SELECT tweet_id, 'url', unnest(regexp_extract_all(content, 'http{NOT_SPACE}+', 0)) FROM tweets
  UNION ALL SELECT tweet_id, 'username', unnest(regexp_extract_all(content, '(^|{NW})(@{W}+)', 2)) FROM tweets
  UNION ALL SELECT tweet_id, 'number', unnest(regexp_extract_all(content, '\\p{{Nd}}+', 0)) FROM tweets
  UNION ALL SELECT tweet_id, 'emoji', unnest(regexp_extract_all({d_emoji('content')}, '(?i):[a-z_0-9]*?:', 0)) FROM tweets"""

D_LAUGHTER = "\n  UNION ALL ".join(
    f"SELECT tweet_id, '{s}' AS pattern, unnest(regexp_extract_all(content, '(?i)[a-zA-Z]*{s}[a-zA-Z]*', 0)) AS value FROM tweets"
    for s in C.LAUGH_STEMS_SIX)

D_ABBREV = f"""
  SELECT tweet_id, lower(t) AS kind, t AS value FROM (
    SELECT tweet_id, unnest({d_words('content')}) AS t FROM tweets)
  WHERE lower(t) IN ({', '.join(sql_str(a) for a, _ in C.ABBREVIATIONS)})"""

D_ALL_ENTITIES = f"""all_entities AS (
  {D_ENTITIES}
  UNION ALL SELECT tweet_id, 'laughter', value FROM ({D_LAUGHTER})
  UNION ALL SELECT tweet_id, kind, value FROM ({D_ABBREV}))"""


def _all_entities(spark, sf):
    """Entities, laughter hits and abbreviations from one pass over the text."""
    return X.extract_all(_tw(spark, sf), "tweet_id", "content")


@query("extract_entities", with_tweets(f"SELECT * FROM ({D_ENTITIES})"))
def extract_entities(spark, sf):
    return X.extract_entities(_tw(spark, sf), "tweet_id", "content")


@query("extract_letreps", with_tweets(f"""
SELECT tweet_id, ch[s] AS ch, repeat(ch[s], e - s - 1) AS rest FROM (
  SELECT tweet_id, ch, s, list_filter(range(s + 1, len(ch) + 2), lambda j: j > len(ch) OR ch[j] <> ch[s])[1] AS e
  FROM (SELECT tweet_id, ch, unnest(list_filter(range(1, len(ch) + 1), lambda i: regexp_full_match(ch[i], '{W}')
          AND (i = 1 OR ch[i-1] <> ch[i]) AND i + 2 <= len(ch) AND ch[i+1] = ch[i] AND ch[i+2] = ch[i])) AS s
        FROM (SELECT tweet_id, string_split(content, '') AS ch FROM tweets)))"""))
def extract_letreps(spark, sf):
    return X.extract_letreps(_tw(spark, sf), "tweet_id", "content")


@query("extract_laughter", with_tweets(f"SELECT * FROM ({D_LAUGHTER})"))
def extract_laughter(spark, sf):
    return X.extract_laughter(_tw(spark, sf), "tweet_id", "content")


@query("extract_abbrev", with_tweets(f"SELECT * FROM ({D_ABBREV})"))
def extract_abbrev(spark, sf):
    return X.extract_abbreviations(_tw(spark, sf), "tweet_id", "content")


@query("entity_counts", with_tweets(
    "SELECT kind, count(*) AS occurrences, count(DISTINCT value) AS distinct_values "
    "FROM all_entities GROUP BY kind", extra=D_ALL_ENTITIES))
def entity_counts(spark, sf):
    return X.entity_counts(_all_entities(spark, sf))


@query("entity_top5", with_tweets(
    "SELECT kind, value, n, rank FROM (SELECT kind, value, n, "
    "CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS INTEGER) AS rank FROM ("
    "SELECT kind, value, count(*) AS n FROM all_entities GROUP BY kind, value)) WHERE rank <= 5",
    extra=D_ALL_ENTITIES))
def entity_top5(spark, sf):
    return X.entity_top(_all_entities(spark, sf), 5)


# ---------------------------------------------------------------------------
# Profiles (X8-X15)
# ---------------------------------------------------------------------------
@query("unseen_hashtags", with_tweets(f"""
SELECT count(*) AS test_hashtags, count(*) FILTER (WHERE s.tag IS NULL) AS unseen_hashtags
FROM (SELECT unnest(regexp_extract_all(content, '(^|{NW})(#{W}+)', 2)) AS tag FROM tweets_split WHERE split = 'test') t
LEFT JOIN (SELECT DISTINCT unnest(regexp_extract_all(content, '(^|{NW})(#{W}+)', 2)) AS tag
           FROM tweets_split WHERE split IN ('train', 'dev')) s ON t.tag = s.tag""", split=True))
def unseen_hashtags(spark, sf):
    return X.unseen_hashtags(_tws(spark, sf))


@query("length_stats", with_tweets(f"""
SELECT split, max(len(string_split(content, ' '))) AS max_length,
       round(avg(len(string_split(content, ' '))), {R6}) AS avg_length
FROM tweets_split GROUP BY split""", split=True))
def length_stats(spark, sf):
    return X.length_stats(_tws(spark, sf)).withColumn("avg_length", F.round("avg_length", R6))


@query("hashtag_stats", with_tweets(f"""
SELECT split, round(avg(h), {R6}) AS avg_hashtags,
       round(100.0 * count(*) FILTER (WHERE h > 0) / count(*), {R6}) AS pct_with_hashtag
FROM (SELECT split, length(content) - length(replace(content, '#', '')) AS h FROM tweets_split)
GROUP BY split""", split=True))
def hashtag_stats(spark, sf):
    return X.hashtag_stats(_tws(spark, sf)).select(
        "split", F.round("avg_hashtags", R6).alias("avg_hashtags"),
        F.round("pct_with_hashtag", R6).alias("pct_with_hashtag"))


def _d_features():
    return {
        "tweet_length": "len(string_split(content, ' '))",
        "has_uppercase": f"len(list_filter(regexp_extract_all(content, '{W}+'), lambda t: regexp_full_match(t, '[A-Z]{{2,}}')))",
        "hashtag_number": "length(content) - length(replace(content, '#', ''))",
        "laughter_feature": "CASE WHEN regexp_matches(content, '" + "|".join(C.LAUGH_STEMS_FEATURE) + "') THEN 1 ELSE 0 END",
        "question_mark": "CASE WHEN contains(content, '?') THEN 1 ELSE 0 END",
        "exclamation_mark": "CASE WHEN contains(content, '!') THEN 1 ELSE 0 END",
        "letter_repetition": (f"CASE WHEN len(list_transform([string_split(content, '')], lambda ch: list_filter(ch, "
                              f"lambda c, i: regexp_full_match(c, '{W}') AND i > 2 AND c = ch[i-1] AND c = ch[i-2]))[1]) > 0 "
                              f"THEN 1 ELSE 0 END"),
    }


def tweet_date():
    """A UTC wall-clock date per tweet, independent of the session zone."""
    ts = F.expr("TIMESTAMP_NTZ '2019-01-01 00:00:00' + make_dt_interval(0, 0, 0, tweet_id * 2222)")
    return F.date_format(ts, LB.TWEET_DATE_FORMAT_UTC)


D_DATE = "strftime(TIMESTAMP '2019-01-01 00:00:00' + to_seconds(tweet_id * 2222), '%a %b %d %H:%M:%S +0000 %Y')"
D_DATE_PARTS = {"day_of_week": f"substr({D_DATE}, 1, 3)", "month": f"substr({D_DATE}, 5, 3)", "hour": f"substr({D_DATE}, 12, 2)"}
PROFILE_FEATURES = ["tweet_length", "has_uppercase", "hashtag_number", "laughter_feature",
                    "question_mark", "exclamation_mark", "letter_repetition"]


@query("feature_by_label", with_tweets("\nUNION ALL ".join(
    f"SELECT '{k}' AS feature, CAST({x} AS VARCHAR) AS value, sentiment, count(*) AS n FROM tweets GROUP BY 2, 3"
    for k, x in {**{k: f"CAST({_d_features()[k]} AS BIGINT)" for k in PROFILE_FEATURES}, **D_DATE_PARTS}.items())))
def feature_by_label(spark, sf):
    """X11: hour, month, weekday and the row features, in one pass."""
    tw = _tw(spark, sf)
    f = tw.select("tweet_id", "sentiment", *FE.feature_columns(F.col("content")), *LB.date_parts(tweet_date()))
    return X.feature_by_label(f, [*PROFILE_FEATURES, *D_DATE_PARTS])


BINS = {"tweet_length": (0, 50, 5), "pos_voc": (0, 4.9, 0.1), "neg_voc": (0, 4.9, 0.1), "neu_voc": (0, 4.8, 0.2),
        "none_voc": (0, 4.9, 0.1)}


def _d_binned():
    feats = ["SELECT 'tweet_length' AS feature, CAST(len(string_split(content, ' ')) AS DOUBLE) AS x, sentiment FROM tweets"]
    feats += [f"SELECT '{k}', {k}, sentiment FROM lexr JOIN tweets USING (tweet_id)" for k in list(BINS)[1:]]
    dims = ", ".join(f"('{k}', {lo}, {w}, {round((hi - lo) / w)})" for k, (lo, hi, w) in BINS.items())
    return with_tweets(f"""
SELECT feature, bin, CASE WHEN bin >= 0 THEN round(lo + bin * width, 9) END AS bin_lo,
       CASE WHEN bin < k THEN round(lo + (bin + 1) * width, 9) END AS bin_hi, sentiment, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT f.feature, f.sentiment, 1 AS n, CASE WHEN f.x IS NULL THEN NULL WHEN f.x <= d.lo THEN -1 WHEN f.x > d.lo + d.k * d.width THEN d.k
    ELSE CAST(ceil(round((f.x - d.lo) / d.width, 9)) - 1 AS BIGINT) END AS bin
  FROM feats f JOIN dims d ON f.feature = d.feature
  UNION ALL SELECT feature, sentiment, 0, unnest(range(k)) FROM dims, (VALUES (0), (1), (2), (3)) l(sentiment)) x
JOIN dims USING (feature) GROUP BY feature, bin, sentiment, lo, width, k""",
        extra=f"lexr AS ({_lexr_body()}),\nfeats AS ({' UNION ALL '.join(feats)}),\n"
              f"dims(feature, lo, width, k) AS (SELECT a, CAST(b AS DOUBLE), CAST(c AS DOUBLE), d FROM (VALUES {dims}) v(a, b, c, d))")


@query("binned_feature_by_label", lambda: _d_binned())
def binned_feature_by_label(spark, sf):
    """Word length and the lexicon ratios in right-closed bins per label,
    with the rows below and above the bins, in one pass."""
    tw = _tw(spark, sf).select("tweet_id", "sentiment", FE.tweet_length(F.col("content")).alias("tweet_length"),
                               TK.treebank_tokens(F.col("content")).alias("toks"))
    f = TM.lexicon_ratios(tw, "tweet_id", "toks", TW.lexicon(spark), carry=["sentiment", "tweet_length"])
    return X.binned_by_label(f, BINS, [0, 1, 2, 3])


@query("label_distribution", with_tweets(f"""
SELECT sentiment, n, round(n / sum(n) OVER (), {R6}) AS share
FROM (SELECT sentiment, count(*) AS n FROM tweets GROUP BY sentiment)"""))
def label_distribution(spark, sf):
    return X.label_distribution(_tw(spark, sf)).withColumn("share", F.round("share", R6))


@query("oov_report", with_tweets(f"""
SELECT count(*) FILTER (WHERE t.term IS NOT NULL) AS train_vocabulary,
       count(*) FILTER (WHERE d.term IS NOT NULL) AS dev_vocabulary,
       count(*) FILTER (WHERE d.term IS NOT NULL AND t.term IS NULL) AS oov_terms,
       round(100.0 * count(*) FILTER (WHERE d.term IS NOT NULL AND t.term IS NULL)
             / count(*) FILTER (WHERE d.term IS NOT NULL), {R6}) AS oov_pct
FROM (SELECT DISTINCT unnest({d_words('lower(content)')}) AS term FROM tweets_split WHERE split = 'train') t
FULL JOIN (SELECT DISTINCT unnest({d_words('lower(content)')}) AS term FROM tweets_split WHERE split = 'dev') d
ON t.term = d.term""", split=True))
def oov_report(spark, sf):
    tw = _tws(spark, sf)
    toks = explode_rows(tw, ["split"], TK.word_tokens(F.lower("content")), "term")
    r = X.oov_report(toks.filter("split = 'train'"), toks.filter("split = 'dev'"))
    return r.withColumn("oov_pct", F.round("oov_pct", R6))


@query("oov_words", with_tweets(f"""
SELECT 'oov' AS kind, CAST(NULL AS INTEGER) AS rank, term, n FROM terms WHERE split = 'dev'
  AND term NOT IN (SELECT term FROM terms WHERE split = 'train')
UNION ALL
SELECT split, CAST(rank AS INTEGER), term, n FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY n DESC, term) AS rank FROM terms) WHERE rank <= 10""",
    split=True, extra=f"""terms AS MATERIALIZED (SELECT split, term, count(*) AS n FROM (
  SELECT split, unnest({d_words('lower(content)')}) AS term FROM tweets_split WHERE split IN ('train', 'dev')) GROUP BY split, term)"""))
def oov_words(spark, sf):
    """The unknown words themselves, and the ten most frequent words of either side."""
    toks = explode_rows(_tws(spark, sf), ["split"], TK.word_tokens(F.lower("content")), "term")
    return X.oov_words(toks.filter("split = 'train'"), toks.filter("split = 'dev'"))


@query("oov_report_compat", with_tweets(f"""
SELECT count(*) FILTER (WHERE t.term IS NOT NULL) AS train_vocabulary,
       count(*) FILTER (WHERE d.term IS NOT NULL) AS dev_vocabulary,
       count(*) FILTER (WHERE d.term IS NOT NULL AND t.term IS NULL) AS oov_terms,
       round(100.0 * count(*) FILTER (WHERE d.term IS NOT NULL AND t.term IS NULL)
             / count(*) FILTER (WHERE d.term IS NOT NULL), {R6}) AS oov_pct
FROM (SELECT DISTINCT unnest({d_words('content')}) AS term FROM tweets_split WHERE split = 'train') t
FULL JOIN (SELECT DISTINCT unnest({d_words('lower(content)')}) AS term FROM tweets_split WHERE split = 'dev') d
ON t.term = d.term""", split=True))
def oov_report_compat(spark, sf):
    """X14 as the reference counts: training words keep their case, dev words do not."""
    text = F.when(F.col("split") == "train", F.col("content")).otherwise(F.lower("content"))
    toks = explode_rows(_tws(spark, sf), ["split"], TK.word_tokens(text), "term")
    r = X.oov_report(toks.filter("split = 'train'"), toks.filter("split = 'dev'"))
    return r.withColumn("oov_pct", F.round("oov_pct", R6))


# ---------------------------------------------------------------------------
# Row features (F1-F8)
# ---------------------------------------------------------------------------
def _feat_sql(name):
    return with_tweets(f"SELECT tweet_id, CAST({_d_features()[name]} AS BIGINT) AS {name} FROM tweets")


def _feat(spark, sf, col):
    return _tw(spark, sf).select("tweet_id", col)


@query("feature_length", _feat_sql("tweet_length"))
def feature_length(spark, sf):
    return _feat(spark, sf, FE.tweet_length(F.col("content")).alias("tweet_length"))


@query("feature_uppercase", _feat_sql("has_uppercase"))
def feature_uppercase(spark, sf):
    return _feat(spark, sf, FE.uppercase_words(F.col("content")).alias("has_uppercase"))


@query("feature_hashtags", _feat_sql("hashtag_number"))
def feature_hashtags(spark, sf):
    return _feat(spark, sf, FE.hashtag_count(F.col("content")).alias("hashtag_number"))


@query("feature_laughter", _feat_sql("laughter_feature"))
def feature_laughter(spark, sf):
    return _feat(spark, sf, FE.has_laughter(F.col("content")).cast("bigint").alias("laughter_feature"))


@query("feature_marks", with_tweets(
    f"SELECT tweet_id, CAST({_d_features()['question_mark']} AS BIGINT) AS question_mark, "
    f"CAST({_d_features()['exclamation_mark']} AS BIGINT) AS exclamation_mark FROM tweets"))
def feature_marks(spark, sf):
    c = F.col("content")
    return _tw(spark, sf).select("tweet_id", FE.has_question(c).cast("bigint").alias("question_mark"),
                                 FE.has_exclamation(c).cast("bigint").alias("exclamation_mark"))


@query("feature_letrep", _feat_sql("letter_repetition"))
def feature_letrep(spark, sf):
    return _feat(spark, sf, FE.has_letter_repetition(F.col("content")).cast("bigint").alias("letter_repetition"))


@query("feature_matrix", with_tweets("SELECT tweet_id, " + ", ".join(
    f"CAST({_d_features()[k]} AS BIGINT) AS {k}" for k in
    ["tweet_length", "has_uppercase", "question_mark", "exclamation_mark", "letter_repetition",
     "hashtag_number", "laughter_feature"]) + " FROM tweets"))
def feature_matrix(spark, sf):
    return _tw(spark, sf).select("tweet_id", *[c.cast("bigint") for c in FE.feature_columns(F.col("content"))])


# ---------------------------------------------------------------------------
# Lexicon features
# ---------------------------------------------------------------------------
def _lexicon_values():
    rows = [(w, 1) for w in TW.LEXICON_POSITIVE] + [(w, -1) for w in TW.LEXICON_NEGATIVE]
    return "(VALUES " + ", ".join(f"({sql_str(w)}, {p})" for w, p in rows) + ") AS lex(word, polarity)"


def _lexr_body(lexicon: str | None = None):
    from .text_queries import d_treebank
    lexicon = lexicon or _lexicon_values()
    return f"""
SELECT tweet_id,
  round(p / nullif(len, 0), 9) AS pos_voc, round(n / nullif(len, 0), 9) AS neg_voc,
  round(CASE WHEN p + n = 0 THEN 0.0 ELSE 1 - abs(p - n) / (p + n) END, 9) AS neu_voc,
  round(1 - (p + n) / nullif(len, 0), 9) AS none_voc
FROM (
  SELECT t.tweet_id, t.len,
         CAST(count(*) FILTER (WHERE f.is_pos) AS DOUBLE) AS p,
         CAST(count(*) FILTER (WHERE f.is_neg) AS DOUBLE) AS n
  FROM (SELECT tweet_id, len(toks) AS len, unnest(CASE WHEN len(toks) = 0 THEN [NULL] ELSE list_distinct(toks) END) AS word
        FROM (SELECT tweet_id, {d_treebank('content')} AS toks FROM tweets)) t
  LEFT JOIN (SELECT word, bool_or(polarity > 0) AS is_pos, bool_or(polarity < 0) AS is_neg
             FROM {lexicon} GROUP BY word) f ON t.word = f.word
  GROUP BY t.tweet_id, t.len)"""


def _d_lexicon_ratios():
    return with_tweets(_lexr_body())


@query("feature_lexicon_files", _d_lexicon_ratios())
def feature_lexicon_files(spark, sf):
    """S9 + F9: the lexicon written as two Latin-1 word lists and read back."""
    from ..session import scratch_dir
    from ..sources import lexicon as LEX
    root = scratch_dir(spark, "lexicon")
    lex = TW.lexicon(spark)
    LEX.write_word_list(lex.filter("polarity > 0"), f"{root}/positive")
    LEX.write_word_list(lex.filter("polarity < 0"), f"{root}/negative")
    tw = _tw(spark, sf).select("tweet_id", TK.treebank_tokens(F.col("content")).alias("toks"))
    r = TM.lexicon_ratios(tw, "tweet_id", "toks",
                          LEX.read_lexicon(spark, f"{root}/positive", f"{root}/negative"))
    return r.select("tweet_id", *[F.round(c, 9).alias(c) for c in
                                  ["pos_voc", "neg_voc", "neu_voc", "none_voc"]])


@query("feature_lexicon", _d_lexicon_ratios())
def feature_lexicon(spark, sf):
    tw = _tw(spark, sf).select("tweet_id", TK.treebank_tokens(F.col("content")).alias("toks"))
    r = TM.lexicon_ratios(tw, "tweet_id", "toks", TW.lexicon(spark))
    return r.select("tweet_id", *[F.round(c, 9).alias(c) for c in
                                  ["pos_voc", "neg_voc", "neu_voc", "none_voc"]])


# ---------------------------------------------------------------------------
# Labels (L1-L8)
# ---------------------------------------------------------------------------
D_NAME = "CASE sentiment WHEN 0 THEN 'N' WHEN 1 THEN 'NEU' WHEN 2 THEN 'NONE' WHEN 3 THEN 'P' END"


@query("label_encode", with_tweets(f"""
SELECT tweet_id, dataset, CAST(dense_rank() OVER (ORDER BY dataset) - 1 AS INTEGER) AS dataset_code,
       {D_NAME} AS label_name, CAST(dense_rank() OVER (ORDER BY {D_NAME}) - 1 AS INTEGER) AS label_code
FROM tweets"""))
def label_encode(spark, sf):
    from ..operators.labels import encode_sorted
    tw = _tw(spark, sf).select("tweet_id", "dataset", LB.decode(F.col("sentiment")).alias("label_name"))
    tw = encode_sorted(tw, "dataset", "dataset_code")
    return encode_sorted(tw, "label_name", "label_code")


@query("label_code_decode", with_tweets(f"""
SELECT tweet_id, sentiment, {D_NAME} AS label_name,
  CASE {D_NAME} WHEN 'N' THEN 0 WHEN 'NEU' THEN 1 WHEN 'NONE' THEN 2 WHEN 'P' THEN 3 END AS code
FROM tweets"""))
def label_code_decode(spark, sf):
    tw = _tw(spark, sf).select("tweet_id", "sentiment", LB.decode(F.col("sentiment")).alias("label_name"))
    return tw.withColumn("code", LB.encode_fixed(F.col("label_name")))


D_RAW = f"({D_NAME} || CASE WHEN tweet_id % 3 = 0 AND sentiment IN (0, 3) THEN '+' ELSE '' END)"


def _raw_label():
    name = LB.decode(F.col("sentiment"))
    return F.concat(name, F.when((F.col("tweet_id") % 3 == 0) & F.col("sentiment").isin(0, 3),
                                 F.lit("+")).otherwise(F.lit("")))


@query("label_collapse", with_tweets(f"""
SELECT tweet_id, {D_RAW} AS raw, CASE WHEN {D_RAW} IN ('N+', 'P+') THEN substr({D_RAW}, 1, 1) ELSE {D_RAW} END AS collapsed,
       CASE WHEN {D_RAW} IN ('NONE', 'NEU') THEN 'O' ELSE {D_RAW} END AS ternary
FROM tweets"""))
def label_collapse(spark, sf):
    tw = _tw(spark, sf).select("tweet_id", _raw_label().alias("raw"))
    return tw.select("tweet_id", "raw", LB.collapse_intensity(F.col("raw")).alias("collapsed"),
                     LB.ternary(F.col("raw")).alias("ternary"))


@query("label_reduce", with_tweets("""
SELECT tweet_id, sentiment, CASE WHEN sentiment > 1 THEN sentiment - 1 ELSE sentiment END AS reduced,
       CAST(tweet_id % 5 + 1 AS INTEGER) AS rank,
       CASE WHEN tweet_id % 5 + 1 < 3 THEN 0 WHEN tweet_id % 5 + 1 = 3 THEN 1 ELSE 2 END AS rank_reduced,
       CAST(CASE WHEN tweet_id % 5 + 1 > 1 THEN tweet_id % 5 ELSE tweet_id % 5 + 1 END AS INTEGER) AS rank_reduced_compat
FROM tweets"""))
def label_reduce(spark, sf):
    tw = _tw(spark, sf).select("tweet_id", "sentiment",
                               ((F.col("tweet_id") % 5) + 1).cast("int").alias("rank"))
    return tw.select(
        "tweet_id", "sentiment", LB.reduce_tweet_label(F.col("sentiment")).alias("reduced"), "rank",
        LB.reduce_labels(F.lit("coah"), F.col("rank")).alias("rank_reduced"),
        LB.reduce_labels(F.lit("coah"), F.col("rank"), compat=True).alias("rank_reduced_compat"))


def aspect_polarities():
    """Fixture aspects: tweet_id % 4 aspects, polarity i = P/N/NEU by (id+i) % 3."""
    n = (F.col("tweet_id") % 4).cast("int")
    pol = F.array(F.lit("P"), F.lit("N"), F.lit("NEU"))
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.element_at(pol, ((F.col("tweet_id") + i) % 3).cast("int") + 1))


@query("aspect_vote", with_tweets("""
SELECT t.tweet_id, CAST(t.tweet_id % 4 AS INTEGER) AS n_aspects,
  CASE WHEN coalesce(v.pts, 0) < 0 THEN 0 WHEN coalesce(v.pts, 0) = 0 THEN 1 ELSE 2 END AS vote
FROM tweets t LEFT JOIN (
  SELECT tweet_id, sum(CASE (tweet_id + i) % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) AS pts
  FROM (SELECT tweet_id, unnest(range(CAST(tweet_id % 4 AS INTEGER))) AS i FROM tweets) GROUP BY tweet_id
) v ON t.tweet_id = v.tweet_id"""))
def aspect_vote(spark, sf):
    tw = _tw(spark, sf).select("tweet_id", aspect_polarities().alias("pols"))
    return tw.select("tweet_id", F.size("pols").alias("n_aspects"), LB.aspect_vote(F.col("pols")).alias("vote"))


@query("date_parts", """
SELECT event_id, substr(d, 1, 3) AS day_of_week, substr(d, 5, 3) AS month, substr(d, 12, 2) AS hour
FROM (SELECT event_id, strftime(ts, '%a %b %d %H:%M:%S +0000 %Y') AS d FROM events)""")
def date_parts(spark, sf):
    ev = TW.read_table(spark, sf, "events")
    d = F.date_format(F.col("ts").cast("timestamp_ntz"), LB.TWEET_DATE_FORMAT_UTC)
    return ev.select("event_id", *LB.date_parts(d))


# ---------------------------------------------------------------------------
# Flagship: clean -> tokens -> features + lexicon ratios -> per-class means
# ---------------------------------------------------------------------------
def _d_flagship():
    feat = _d_features()
    avg = lambda e: f"round(avg({e}), {R6})"
    return with_tweets(f"""
SELECT t.sentiment, count(*) AS n_tweets,
  {avg(f"len(regexp_extract_all(lower({d_c2(d_c1('t.content'))}), '({W}+)', 1))")} AS avg_tokens,
  {avg(feat['tweet_length'].replace('content', 't.content'))} AS avg_length,
  {avg(feat['has_uppercase'].replace('content', 't.content'))} AS avg_uppercase,
  {avg(feat['hashtag_number'].replace('content', 't.content'))} AS avg_hashtags,
  {avg(feat['laughter_feature'].replace('content', 't.content'))} AS laughter_share,
  {avg(feat['letter_repetition'].replace('content', 't.content'))} AS repetition_share,
  {avg('r.pos_voc')} AS avg_pos_voc, {avg('r.neg_voc')} AS avg_neg_voc
FROM tweets t JOIN lexr r ON t.tweet_id = r.tweet_id
GROUP BY t.sentiment""", extra=f"lexr AS ({_lexr_body()})")


@query("flagship_class_profile", _d_flagship())
def flagship_class_profile(spark, sf):
    tw = _tw(spark, sf)
    clean = C.clean_text(F.col("content"), C.MAIN)
    base = tw.select("tweet_id", "sentiment", "content",
                     F.size(TK.word_tokens(clean)).alias("n_tokens"),
                     TK.treebank_tokens(F.col("content")).alias("toks"),
                     *FE.feature_columns(F.col("content")))
    carry = ["sentiment", "n_tokens", "tweet_length", "has_uppercase", "hashtag_number",
             "laughter_feature", "letter_repetition"]
    lex = TM.lexicon_ratios(base, "tweet_id", "toks", TW.lexicon(spark), carry=carry)
    j = lex.select(*carry, F.round("pos_voc", 9).alias("pos_voc"),
                   F.round("neg_voc", 9).alias("neg_voc"))
    return j.groupBy("sentiment").agg(
        F.count(F.lit(1)).alias("n_tweets"),
        F.round(F.avg("n_tokens"), R6).alias("avg_tokens"),
        F.round(F.avg("tweet_length"), R6).alias("avg_length"),
        F.round(F.avg("has_uppercase"), R6).alias("avg_uppercase"),
        F.round(F.avg("hashtag_number"), R6).alias("avg_hashtags"),
        F.round(F.avg("laughter_feature"), R6).alias("laughter_share"),
        F.round(F.avg("letter_repetition"), R6).alias("repetition_share"),
        F.round(F.avg("pos_voc"), R6).alias("avg_pos_voc"),
        F.round(F.avg("neg_voc"), R6).alias("avg_neg_voc"))
