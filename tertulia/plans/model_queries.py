"""Registered queries: classification (M1-M9) and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import features as FE
from ..functions import tokens as TK
from ..functions.generators import explode_rows
from ..operators import classify as M
from ..operators import ensemble as EN
from ..operators import evaluate as EV
from ..operators import terms as TM
from ..session import scratch_dir
from ..sources import predictions as PT
from . import tweets as TW
from ..sources import runs as RUNS
from .corpus_queries import D_DOC_TERMS, D_RULE, _main_terms, _rule_pred, tfidf_features
from .profile_queries import _d_features
from .registry import query, with_tweets

R9 = 9
MODELS = ["m1", "m2", "m3"]
LABELS = ["0", "1", "2", "3"]


def _tw(spark, sf):
    return TW.tweets(spark, sf)


def _tws(spark, sf):
    return TW.tweets_split(spark, sf)


# ---------------------------------------------------------------------------
# Probability fixture: three pseudo-models, md5-derived weights, a few labels
# missing, equal weights on tweet_id % 11 = 0.  Built row-locally.
# ---------------------------------------------------------------------------
def _h(m, l):
    return F.md5(F.concat(F.lit(f"{m}:"), F.col("tweet_id").cast("string"), F.lit(f":{l}")))


def _weight(m, l):
    w = F.conv(F.substring(_h(m, l), 1, 4), 16, 10).cast("double") + 1
    return F.when(F.col("tweet_id") % 11 == 0, F.lit(1.0)).otherwise(w)


def _present(m, l):
    return F.substring(_h(m, l), 5, 1) != "0"


def probs_long(tw):
    """(tweet_id, model, label, prob)."""
    entries = []
    for m in MODELS:
        total = None
        for l in LABELS:
            t = F.when(_present(m, l), _weight(m, l)).otherwise(F.lit(0.0))
            total = t if total is None else total + t
        for l in LABELS:
            entries.append(F.when(_present(m, l), F.struct(
                F.lit(m).alias("model"), F.lit(l).alias("label"),
                (_weight(m, l) / total).alias("prob"))))
    arr = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return explode_rows(tw, ["tweet_id"], arr, "e").select("tweet_id", "e.model", "e.label", "e.prob")


D_PROBS = """probs AS (
  SELECT tweet_id, model, label, w / sum(w) OVER (PARTITION BY tweet_id, model) AS prob FROM (
    SELECT tweet_id, m.model, l.label,
      CASE WHEN tweet_id % 11 = 0 THEN 1.0
           ELSE CAST(('0x' || substr(md5(m.model || ':' || CAST(tweet_id AS VARCHAR) || ':' || l.label), 1, 4))::BIGINT + 1 AS DOUBLE) END AS w
    FROM tweets, (VALUES ('m1'), ('m2'), ('m3')) m(model), (VALUES ('0'), ('1'), ('2'), ('3')) l(label)
    WHERE substr(md5(m.model || ':' || CAST(tweet_id AS VARCHAR) || ':' || l.label), 5, 1) <> '0'))"""


@query("ensemble_average", with_tweets(f"""
SELECT tweet_id, CASE WHEN bool_or(c = 3) THEN first(label ORDER BY c DESC, p DESC, label) END AS label,
  round(max(CASE WHEN c = 3 THEN p END), {R9}) AS prob FROM (
  SELECT tweet_id, label, count(*) AS c, round(avg(prob), 12) AS p FROM probs GROUP BY tweet_id, label)
GROUP BY tweet_id""", extra=D_PROBS))
def ensemble_average(spark, sf):
    p = probs_long(_tw(spark, sf)).withColumnRenamed("tweet_id", "id")
    out = EN.average_predictions(p, LABELS, id_col="id", n_models=len(MODELS))
    return out.select(F.col("id").alias("tweet_id"), "label", F.round("prob", R9).alias("prob"))


@query("argmax_label", with_tweets(f"""
SELECT tweet_id, model, first(label ORDER BY p DESC, label) AS label, round(max(p), {R9}) AS prob FROM (
  SELECT tweet_id, model, label, round(prob, 12) AS p FROM probs) GROUP BY tweet_id, model""", extra=D_PROBS))
def argmax_label(spark, sf):
    p = probs_long(_tw(spark, sf)).withColumn("prob", F.round("prob", 12))
    out = EN.top_label(p, ["tweet_id", "model"], LABELS)
    return out.withColumn("prob", F.round("prob", R9))


# ---------------------------------------------------------------------------
# M9 / K3: external batch scoring and the prediction table
# ---------------------------------------------------------------------------
D_EXT = """SELECT tweet_id, CAST(length(content) % 4 AS VARCHAR) AS predicted,
  CAST(CASE WHEN length(content) % 4 = 0 THEN 0.7 ELSE 0.1 END AS DOUBLE) AS p_0,
  CAST(CASE WHEN length(content) % 4 = 1 THEN 0.7 ELSE 0.1 END AS DOUBLE) AS p_1,
  CAST(CASE WHEN length(content) % 4 = 2 THEN 0.7 ELSE 0.1 END AS DOUBLE) AS p_2,
  CAST(CASE WHEN length(content) % 4 = 3 THEN 0.7 ELSE 0.1 END AS DOUBLE) AS p_3 FROM tweets"""


def _external(spark, sf):
    return M.score_external(_tw(spark, sf), "content", "tweet_id", M.toy_length_model,
                            LABELS, cache_key="toy-length")


@query("external_scoring", with_tweets(D_EXT))
def external_scoring(spark, sf):
    return _external(spark, sf)


@query("prediction_table", with_tweets(f"""
SELECT tweet_id AS id, CAST(predicted AS INTEGER) AS predictions, p_0 AS N, p_1 AS NEU, p_2 AS NONE, p_3 AS POS
FROM ({D_EXT})"""))
def prediction_table(spark, sf):
    s = _external(spark, sf)
    t = s.select(F.col("tweet_id").alias("id"), F.col("predicted").cast("int").alias("predictions"),
                 F.col("p_0").alias("N"), F.col("p_1").alias("NEU"), F.col("p_2").alias("NONE"),
                 F.col("p_3").alias("POS"))
    path = scratch_dir(spark, "predictions")
    PT.write_prediction_table(t, path)
    return PT.read_prediction_table(spark, path)


# ---------------------------------------------------------------------------
# M1-M6: classifiers
# ---------------------------------------------------------------------------
FEATURES = ["tweet_length", "has_uppercase", "question_mark", "exclamation_mark",
            "letter_repetition", "hashtag_number", "laughter_feature",
            "pos_voc", "neg_voc", "neu_voc", "none_voc"]


def feature_table(spark, sf):
    """F8 + F9 per tweet, with the split and label."""
    tw = _tws(spark, sf)
    base = tw.select("tweet_id", "split", "sentiment",
                     TK.treebank_tokens(F.col("content")).alias("toks"),
                     *FE.feature_columns(F.col("content")))
    carry = [c for c in base.columns if c not in ("tweet_id", "toks")]
    return TM.lexicon_ratios(base, "tweet_id", "toks", TW.lexicon(spark), carry=carry)


def _classify(spark, sf, kind):
    return M.fit_predict(feature_table(spark, sf), FEATURES, "sentiment", "split", kind=kind)


@query("classify_lr")
def classify_lr(spark, sf):
    return _classify(spark, sf, "lr")


@query("classify_tree")
def classify_tree(spark, sf):
    return _classify(spark, sf, "tree")


@query("classify_forest")
def classify_forest(spark, sf):
    return _classify(spark, sf, "forest")


@query("classify_ovr")
def classify_ovr(spark, sf):
    return _classify(spark, sf, "svc")


@query("classify_gbt")
def classify_gbt(spark, sf):
    return _classify(spark, sf, "gbt")


@query("classify_lr_counts")
def classify_lr_counts(spark, sf):
    tw = _tws(spark, sf).select("tweet_id", "split", "sentiment",
                                TK.word_tokens(C.clean_text(F.col("content"), C.MAIN)).alias("toks"))
    return M.text_classifier(tw, "toks", "sentiment", "split")


@query("classify_lr_tfidf")
def classify_lr_tfidf(spark, sf):
    return M.vector_classifier(tfidf_features(spark, sf), "sentiment", "split")


@query("classify_ngram")
def classify_ngram(spark, sf):
    tw = _tws(spark, sf).select("tweet_id", "split", "sentiment",
                                TK.word_tokens(C.clean_text(F.col("content"), C.MAIN)).alias("toks"))
    # the fitted PipelineModel is saved and reloaded before scoring
    return M.ngram_classifier(tw, "toks", "sentiment", "split",
                              path=scratch_dir(spark, "ngram-model"))


D_NB = """
train AS (SELECT tweet_id, sentiment FROM tweets_split WHERE split = 'train'),
tt AS (SELECT d.tweet_id, d.term, d.tf, t.sentiment FROM doc_terms d JOIN train t ON d.tweet_id = t.tweet_id),
ct AS (SELECT sentiment, term, sum(tf) AS ct FROM tt GROUP BY sentiment, term),
cls AS (
  SELECT c.sentiment, ln(c.nc / (SELECT count(*) FROM train)) AS prior,
         ln(coalesce(s.tot, 0) + (SELECT count(DISTINCT term) FROM tt)) AS den
  FROM (SELECT sentiment, count(*) AS nc FROM train GROUP BY sentiment) c
  LEFT JOIN (SELECT sentiment, sum(ct) AS tot FROM ct GROUP BY sentiment) s ON c.sentiment = s.sentiment),
ll AS (
  SELECT k.sentiment, v.term, ln(coalesce(ct.ct, 0) + 1) - k.den AS ll
  FROM (SELECT DISTINCT term FROM tt) v CROSS JOIN cls k
  LEFT JOIN ct ON ct.sentiment = k.sentiment AND ct.term = v.term),
test AS (SELECT tweet_id, split, sentiment FROM tweets_split WHERE split <> 'train'),
lik AS (
  SELECT d.tweet_id, l.sentiment, sum(d.tf * l.ll) AS s
  FROM doc_terms d JOIN ll l ON d.term = l.term WHERE d.tweet_id IN (SELECT tweet_id FROM test)
  GROUP BY d.tweet_id, l.sentiment)"""


@query("classify_nb", with_tweets("""
SELECT t.tweet_id, t.split, t.sentiment, first(k.sentiment ORDER BY k.prior + coalesce(l.s, 0) DESC, k.sentiment) AS prediction
FROM test t CROSS JOIN cls k LEFT JOIN lik l ON l.tweet_id = t.tweet_id AND l.sentiment = k.sentiment
GROUP BY t.tweet_id, t.split, t.sentiment""", split=True, extra=D_DOC_TERMS + "," + D_NB))
def classify_nb(spark, sf):
    tw, terms = _main_terms(spark, sf)
    return M.naive_bayes(terms, tw.select("tweet_id", "sentiment", "split"), "tweet_id",
                         "sentiment", "split", [0, 1, 2, 3])


# ---------------------------------------------------------------------------
# M7 on fitted models: naive Bayes on words and on row features
# ---------------------------------------------------------------------------
FEATURE_TERMS = {"l": "tweet_length", "u": "has_uppercase", "h": "hashtag_number", "j": "laughter_feature",
                 "q": "question_mark", "e": "exclamation_mark", "r": "letter_repetition"}


def _feature_term(letter):
    value = F.col(FEATURE_TERMS[letter]).cast("bigint")
    return F.concat(F.lit(letter), (F.floor(value / 10) if letter == "l" else value).cast("string"))


def feature_terms(tw):
    """Row features as terms (id, split, label, term, tf): one term a feature, lengths by tens."""
    f = tw.select("tweet_id", "split", "sentiment", *FE.feature_columns(F.col("content")))
    terms = F.explode(F.array(*[_feature_term(x) for x in FEATURE_TERMS]))
    return f.select("tweet_id", "split", "sentiment", terms.alias("term"), F.lit(1).cast("bigint").alias("tf"))


def fitted_probabilities(spark, sf):
    """(tweet_id, split, model, label, prob) of the held-out rows by the fitted models, as a written table."""
    tw, words = _main_terms(spark, sf)
    docs = tw.select("tweet_id", "sentiment", "split")
    out = None
    for name, terms in (("nb-words", words), ("nb-features", feature_terms(tw))):
        p = M.naive_bayes(terms, docs, "tweet_id", "sentiment", "split", [0, 1, 2, 3], probabilities=True)
        p = p.select("tweet_id", "split", F.lit(name).alias("model"), F.posexplode("probability").alias("label", "prob"))
        out = p if out is None else out.unionByName(p)
    path = scratch_dir(spark, "probabilities")
    out.withColumn("label", F.col("label").cast("string")).write.parquet(path)
    return spark.read.parquet(path)


D_FEATURE_TERMS = "feature_terms AS (" + " UNION ALL ".join(
    f"SELECT tweet_id, '{k}' || CAST({'CAST(floor(x / 10) AS BIGINT)' if k == 'l' else 'x'} AS VARCHAR) AS term, 1 AS tf "
    f"FROM (SELECT tweet_id, CAST({_d_features()[v]} AS BIGINT) AS x FROM tweets)" for k, v in FEATURE_TERMS.items()) + ")"


def _d_nb_tables(m, terms):
    return f"""
tt{m} AS (SELECT d.tweet_id, d.term, d.tf, t.sentiment FROM {terms} d JOIN train t ON d.tweet_id = t.tweet_id),
ct{m} AS (SELECT sentiment, term, sum(tf) AS n FROM tt{m} GROUP BY sentiment, term),
cls{m} AS (
  SELECT c.sentiment, ln(c.nc / (SELECT count(*) FROM train)) AS prior,
         ln(coalesce(s.tot, 0) + (SELECT count(DISTINCT term) FROM tt{m})) AS den
  FROM (SELECT sentiment, count(*) AS nc FROM train GROUP BY sentiment) c
  LEFT JOIN (SELECT sentiment, sum(n) AS tot FROM ct{m} GROUP BY sentiment) s ON c.sentiment = s.sentiment),
ll{m} AS (
  SELECT k.sentiment, v.term, ln(coalesce(c.n, 0) + 1) - k.den AS ll
  FROM (SELECT DISTINCT term FROM tt{m}) v CROSS JOIN cls{m} k
  LEFT JOIN ct{m} c ON c.sentiment = k.sentiment AND c.term = v.term),
lik{m} AS (
  SELECT d.tweet_id, l.sentiment, sum(d.tf * l.ll) AS s
  FROM {terms} d JOIN ll{m} l ON d.term = l.term WHERE d.tweet_id IN (SELECT tweet_id FROM test)
  GROUP BY d.tweet_id, l.sentiment),
p{m} AS (
  SELECT tweet_id, split, sentiment, exp(s - max(s) OVER w) / sum(exp(s - m)) OVER w AS p FROM (
    SELECT *, max(s) OVER (PARTITION BY tweet_id) AS m FROM (
      SELECT t.tweet_id, t.split, k.sentiment, k.prior + coalesce(l.s, 0) AS s
      FROM test t CROSS JOIN cls{m} k LEFT JOIN lik{m} l ON l.tweet_id = t.tweet_id AND l.sentiment = k.sentiment))
  WINDOW w AS (PARTITION BY tweet_id))"""


@query("ensemble_fitted", with_tweets(f"""
SELECT tweet_id, split, CAST(first(sentiment ORDER BY p DESC, sentiment) AS VARCHAR) AS label, round(max(p), {R9 - 3}) AS prob
FROM (SELECT a.tweet_id, a.split, a.sentiment, (a.p + b.p) / 2 AS p FROM p1 a JOIN p2 b
      ON a.tweet_id = b.tweet_id AND a.sentiment = b.sentiment)
GROUP BY tweet_id, split""", split=True, extra=D_DOC_TERMS + ",\n" + D_FEATURE_TERMS + """,
train AS (SELECT tweet_id, sentiment FROM tweets_split WHERE split = 'train'),
test AS (SELECT tweet_id, split FROM tweets_split WHERE split <> 'train'),""" + _d_nb_tables(1, "doc_terms") + ","
    + _d_nb_tables(2, "feature_terms")))
def ensemble_fitted(spark, sf):
    """M7: the mean of two fitted models' stored probabilities, and its top label."""
    probs = fitted_probabilities(spark, sf)
    e = EN.average_predictions(probs.select("tweet_id", "model", "label", "prob"), LABELS, id_col="tweet_id", n_models=2)
    split = probs.filter("model = 'nb-words' AND label = '0'").select("tweet_id", "split")
    return e.join(split, "tweet_id").select("tweet_id", "split", "label", F.round("prob", R9 - 3).alias("prob"))


# ---------------------------------------------------------------------------
# metrics
# ---------------------------------------------------------------------------
def _gold_pred(spark, sf):
    return _tw(spark, sf).select(F.col("sentiment").alias("gold"), _rule_pred().alias("pred"))


D_PC = f"""pairs AS (SELECT sentiment AS gold, {D_RULE} AS pred FROM tweets),
pc AS (
  SELECT cls, sum(tp) AS tp, sum(g) AS gold_n, sum(p) AS pred_n FROM (
    SELECT gold AS cls, CASE WHEN gold = pred THEN 1 ELSE 0 END AS tp, 1 AS g, 0 AS p FROM pairs
    UNION ALL SELECT pred, 0, 0, 1 FROM pairs) GROUP BY cls)"""


@query("macro_f1", with_tweets(f"""
SELECT round(avg(p), {R9}) AS macro_precision, round(avg(r), {R9}) AS macro_recall,
       round(100 * avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), {R9}) AS macro_f1
FROM (SELECT CASE WHEN pred_n = 0 THEN 0 ELSE tp / pred_n END AS p,
             CASE WHEN gold_n = 0 THEN 0 ELSE tp / gold_n END AS r FROM pc)""", extra=D_PC))
def macro_f1(spark, sf):
    m = EV.macro_scores(_gold_pred(spark, sf))
    return m.select(*[F.round(c, R9).alias(c) for c in m.columns])


@query("confusion_matrix", with_tweets(f"""
SELECT sentiment AS gold,
  count(*) FILTER (WHERE {D_RULE} = 0) AS pred_0, count(*) FILTER (WHERE {D_RULE} = 1) AS pred_1,
  count(*) FILTER (WHERE {D_RULE} = 2) AS pred_2, count(*) FILTER (WHERE {D_RULE} = 3) AS pred_3
FROM tweets GROUP BY sentiment"""))
def confusion_matrix(spark, sf):
    return EV.confusion_matrix(_gold_pred(spark, sf), [0, 1, 2, 3])


def _gold_run(spark, sf, perfect=False):
    tw = _tw(spark, sf)
    gold = tw.select(F.col("tweet_id").cast("string").alias("id"),
                     F.col("sentiment").cast("string").alias("label"))
    if perfect:
        return gold, gold
    pred = _rule_pred().cast("string")
    run = tw.filter(F.col("tweet_id") % 13 != 0).select(
        F.col("tweet_id").cast("string").alias("id"), pred.alias("label")).unionByName(
        tw.filter(F.col("tweet_id") % 17 == 0).select(
            (F.col("tweet_id") + 1_000_000_000).cast("string").alias("id"), pred.alias("label")))
    return gold, run


def _d_task(compat: bool, perfect: bool = False) -> str:
    run = ("SELECT CAST(tweet_id AS VARCHAR) AS id, CAST(sentiment AS VARCHAR) AS label FROM tweets" if perfect else
           f"""SELECT CAST(tweet_id AS VARCHAR) AS id, CAST({D_RULE} AS VARCHAR) AS label FROM tweets WHERE tweet_id % 13 <> 0
    UNION ALL SELECT CAST(tweet_id + 1000000000 AS VARCHAR), CAST({D_RULE} AS VARCHAR) FROM tweets WHERE tweet_id % 17 = 0""")
    if compat:
        p = "CASE WHEN tp = 0 OR fp = 0 THEN 0 ELSE tp / (tp + fp) END"
        r = "CASE WHEN tp = 0 OR fn = 0 THEN 0 ELSE tp / (tp + fn) END"
    else:
        p = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END"
        r = "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END"
    return with_tweets(f"""
SELECT round(CASE WHEN map + mar = 0 THEN 0 ELSE 2 * map * mar / (map + mar) END, {R9}) AS maf1,
       round(map, {R9}) AS map, round(mar, {R9}) AS mar,
       round(tp / (SELECT count(*) FROM gold), {R9}) AS a,
       round(mip, {R9}) AS mip, round(mir, {R9}) AS mir,
       round(CASE WHEN mip + mir = 0 THEN 0 ELSE 2 * mip * mir / (mip + mir) END, {R9}) AS mif1
FROM (SELECT tp, fp, fn, map, mar,
             CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS mip,
             CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS mir
      FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg({p}) AS map, avg({r}) AS mar FROM pc))""",
        extra=f"""gold AS (SELECT CAST(tweet_id AS VARCHAR) AS id, CAST(sentiment AS VARCHAR) AS label FROM tweets),
run AS ({run}),
j AS (SELECT g.label AS gold, coalesce(r.label, '?') AS pred FROM gold g LEFT JOIN run r ON g.id = r.id),
pc AS (
  SELECT cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
    SELECT gold AS cls, CASE WHEN gold = pred THEN 1 ELSE 0 END AS tp, 0 AS fp,
           CASE WHEN gold <> pred THEN 1 ELSE 0 END AS fn FROM j
    UNION ALL SELECT pred, 0, CASE WHEN gold <> pred THEN 1 ELSE 0 END, 0 FROM j)
  WHERE cls IN (SELECT label FROM gold) GROUP BY cls)""")


def _task(spark, sf, compat=False, perfect=False):
    gold, run = _gold_run(spark, sf, perfect)
    t = EV.task_scores(gold, run, compat=compat)
    return t.select(*[F.round(c, R9).alias(c) for c in t.columns])


@query("task_score", _d_task(False))
def task_score(spark, sf):
    return _task(spark, sf)


@query("task_score_compat", _d_task(True))
def task_score_compat(spark, sf):
    return _task(spark, sf, compat=True)


@query("task_score_perfect", _d_task(False, perfect=True))
def task_score_perfect(spark, sf):
    return _task(spark, sf, perfect=True)


# ---------------------------------------------------------------------------
# S11 -> E3/E4: scores from files
# ---------------------------------------------------------------------------
def _d_task_files():
    one = "SELECT '{}' AS run, true AS valid_run, CAST(0 AS BIGINT) AS malformed_lines, s.* FROM ({}) s"
    null = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in EV.SCORES)
    return "\nUNION ALL\n".join([
        one.format("good", _d_task(False)), one.format("good-compat", _d_task(True)), one.format("perfect", _d_task(False, perfect=True)),
        f"SELECT 'malformed', false, CAST(2 AS BIGINT), {null}"])


@query("task_score_files", _d_task_files())
def task_score_files(spark, sf):
    """Gold and run files scored line by line: every run names some ids first
    with a wrong label (the last line wins), misses some and has unknown ones;
    one run holds two malformed lines and is not scored; the gold file has
    malformed lines, which are skipped."""
    gold, run = _gold_run(spark, sf)
    root = scratch_dir(spark, "task-files")
    wrong = F.when(F.col("label") == "0", "1").otherwise("0")
    early = lambda d: d.filter(F.pmod(F.xxhash64("id"), F.lit(5)) == 0).withColumn("label", wrong)
    bad = spark.createDataFrame([("no tab here",), ("a\tb\tc",)], "value string").coalesce(1)
    for name, rows in (("gold", gold), ("good", run), ("perfect", gold)):
        RUNS.write_id_label(early(rows), "id", "label", f"{root}/{name}/part1")
        RUNS.write_id_label(rows, "id", "label", f"{root}/{name}/part2")
    bad.write.text(f"{root}/gold/part3")
    RUNS.write_id_label(run, "id", "label", f"{root}/malformed/part1")
    bad.write.text(f"{root}/malformed/part2")
    out = None
    for label, name, compat in (("good", "good", False), ("good-compat", "good", True), ("perfect", "perfect", False),
                                ("malformed", "malformed", False)):
        t = EV.score_files(spark, f"{root}/gold/*", f"{root}/{name}/*", compat)
        t = t.select(F.lit(label).alias("run"), "valid_run", "malformed_lines",
                     *[F.round(c, R9).alias(c) for c in EV.SCORES])
        out = t if out is None else out.unionByName(t)
    return out
