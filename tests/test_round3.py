"""Rank selection and splits, quotas, scores from files, nested records, token
pipeline, emoji sequences, vectors: expected values written out or recounted."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from tertulia.functions import clean as C
from tertulia.functions import tokens as TK
from tertulia.operators import classify as M
from tertulia.operators import entities as X
from tertulia.operators import evaluate as EV
from tertulia.operators import normalize as NZ
from tertulia.operators import sampling as R
from tertulia.operators import terms as TM
from tertulia.operators.token_pipeline import token_pipeline
from tertulia.sources import vectors as VEC
from tertulia.sources import xml as XML
from tertulia.sources.runs import read_lines_ordered


def plan(df):
    return df._jdf.queryExecution().toString()


def apply(spark, text, fn):
    return spark.createDataFrame([(text,)], "c string").select(fn(F.col("c"))).first()[0]


# -- R1, R3 -----------------------------------------------------------------
@pytest.mark.parametrize("few", [1, 7, 100_000])
def test_hash_at_ranks(spark, few):
    hashes = sorted(hashlib.md5(str(i % 300).encode()).hexdigest() for i in range(500))
    df = spark.createDataFrame([(h,) for h in hashes], "h string").repartition(3)
    ranks = [0, 1, 7, 250, 499, 500, 10_000]
    got = R.hash_at_ranks(df, lambda n: [r if n == 500 else -1 for r in ranks], few)
    assert got == [hashes[r] if r < 500 else None for r in ranks]
    assert R.hash_at_ranks(df.limit(0), lambda n: [n]) == [None]


def test_split_is_a_projection_with_exact_sizes(spark):
    for n in (0, 1, 3, 1000):
        df = spark.range(n).withColumnRenamed("id", "tweet_id")
        got = Counter(r.split for r in R.assign_split(df, "tweet_id").collect())
        a, b = math.floor(0.7 * n), math.floor(0.85 * n)
        assert got == Counter({k: v for k, v in (("train", a), ("dev", b - a), ("test", n - b)) if v})
    p = plan(R.assign_split(df, "tweet_id")).split("Physical Plan")[1]
    assert "Exchange" not in p and "Window" not in p and "Union" not in p
    with_null = spark.createDataFrame([(None,), (1,), (1,), (2,)], "tweet_id long")
    rows = R.assign_split(with_null, "tweet_id").collect()
    assert len(rows) == 4 and len({r.split for r in rows if r.tweet_id == 1}) == 1


def test_split_queries_scan_documents_once(spark):
    Q = E.queries()
    once = plan(Q["length_stats"](spark, SF_SMALL)).split("Physical Plan")[1]
    assert len(re.findall(r"documents\.parquet", once)) <= 2  # one scan, named by path and by file index
    assert once.count("FileScan") == 2  # documents, labels


def test_quota_sample_of_a_hot_class(spark):
    rows = [(i, 0 if i % 10 else 1) for i in range(6000)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "tweet_id long, sentiment int").repartition(5)
    q = spark.createDataFrame([("ES", 0, 2241), ("ES", 1, 9999), ("MX", 0, 3), ("MX", 2, 5)], "locale string, label int, quota int")
    got = R.quota_sample(df, q, "sentiment", "tweet_id")
    want = {("ES", i) for i, _ in [r for r in rows if r[1] == 0][:2241]} | {("ES", i) for i, c in rows if c == 1} \
        | {("MX", i) for i, _ in [r for r in rows if r[1] == 0][:3]}
    assert {(r.locale, r.tweet_id) for r in got.collect()} == want
    assert plan(got).count("WindowGroupLimit") >= 2


def test_union_dedupe_keeps_the_first_corpus(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, c string")
    b = spark.createDataFrame([(2, "y"), (3, None)], "id long, c string")
    got = R.union_corpora({"b": b, "a": a}, dedupe=True)
    assert sorted(map(tuple, got.select("id", "c", "dataset").collect()), key=str) == [(1, "x", "a"), (2, "y", "a"), (3, None, "b")]


# -- S11, E3 ----------------------------------------------------------------
def test_score_files(spark, tmp_path):
    gold = tmp_path / "gold.tsv"
    gold.write_text("1\tP\n2\tN\nbroken\n3\tP\n4\tN\n1\tN\n 5\tP \n")
    run = tmp_path / "run.tsv"
    lines = ["9\tP"] * 3 + ["1\tP", "2\tN", "3\tN"] + [f"x{i}\tP" for i in range(3000)] + ["1\tN", "5\tP"]
    run.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        r = EV.score_files(spark, str(gold), str(run)).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # gold: 1 N, 2 N, 3 P, 4 N, 5 P; run: 1 N, 2 N, 3 N, 4 missing, 5 P
    p_n, r_n, p_p, r_p = 2 / 3, 2 / 3, 1.0, 1 / 2
    mp, mr = (p_n + p_p) / 2, (r_n + r_p) / 2
    assert r.valid_run and r.malformed_lines == 0 and r.a == pytest.approx(3 / 5)
    assert (r["map"], r["mar"], r["maf1"]) == pytest.approx((mp, mr, 2 * mp * mr / (mp + mr)))
    (tmp_path / "bad.tsv").write_text("1\tP\n2\n3\tP\tQ\n")
    r = EV.score_files(spark, str(gold), str(tmp_path / "bad.tsv")).first()
    assert not r.valid_run and r.malformed_lines == 2 and r.maf1 is None and r.a is None


# -- S7 ---------------------------------------------------------------------
def test_nested_reviews(spark, tmp_path):
    f = tmp_path / "reviews.xml"
    f.write_text("<?xml version='1.0'?>\n<reviews>\n"
                 "<review><summary>one</summary><body>first</body><review rank=\"4\"/></review>\n"
                 "<review id='2'><review rank='5'><body>in\nside</body></review><summary>two</summary></review>"
                 "<review><review rank=\"1\"><summary>three</summary><body>a &lt; b<!-- <review> --></body></review></review>\n"
                 "<review><summary>alone</summary><body>no rank</body></review>\n</reviews>\n")
    want = [(4, "one", "first"), (5, "two", "in\nside"), (1, "three", "a < b"), (None, "alone", "no rank")]
    for size in ("134217728", "40", "7"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = XML.read_product_reviews(spark, str(f)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    stray = tmp_path / "stray.xml"
    stray.write_text("</review><review><body>x</body><review rank='2'/></review><review><review rank='3'>unclosed")
    got = [tuple(r) for r in XML.read_product_reviews(spark, str(stray)).collect()]
    assert (2, None, "x") in got


# -- tokens -----------------------------------------------------------------
@pytest.mark.parametrize("text, want", [
    ("that's", ["that", "'s"]), ("I can't", ["I", "ca", "n't"]), ("'hola'", ["'hola", "'"]), ("they'll", ["they", "'ll"]),
    ("Cannot", ["Can", "not"]), ("I'm gonna go", ["I", "'m", "gon", "na", "go"]), ("D'ye", ["D", "'ye"]), ("'Tis", ["'T", "is"]),
    ("a, b", ["a", ",", "b"]), ("end.", ["end", "."]), ("", []), (" ", []), ("we've", ["we", "'ve"])])
def test_treebank_at_the_ends(spark, text, want):
    assert apply(spark, text, TK.treebank_tokens) == want


def test_token_pipeline_switches(spark):
    df = spark.createDataFrame([(1, ["la", "caza", "jaja", "ñandú", "caza"]), (2, []), (3, None), (4, ["de", "la"])],
                               "id long, t array<string>")
    corrections = spark.createDataFrame([("caza", "casa", "corrected"), ("ñandú", "ñandú", "known"), ("jaja", "jajá", "corrected")],
                                        "term string, correction string, status string")
    mapping = spark.createDataFrame([("casa", "hogar"), ("la", "el"), ("caza", "never")], "term string, canonical string")

    def run(**kw):
        return {r.id: r.tokens for r in token_pipeline(df, "id", "t", **kw).collect()}

    assert run() == {1: ["la", "caza", "jaja", "ñandú", "caza"], 2: [], 3: [], 4: ["de", "la"]}
    assert run(corrections=corrections)[1] == ["la", "casa", "jajá", "ñandú", "casa"]
    assert run(mapping=mapping)[1] == ["el", "never", "jaja", "ñandú", "never"]
    assert run(corrections=corrections, mapping=mapping)[1] == ["el", "hogar", "jajá", "ñandú", "hogar"]
    assert run(corrections=corrections, mapping=mapping, accents=True)[1] == ["el", "hogar", "jaja", "nandu", "hogar"]
    every = run(corrections=corrections, mapping=mapping, accents=True, stopwords=True)
    assert every == {1: ["hogar", "jaja", "nandu", "hogar"], 2: [], 3: [], 4: []}
    assert run(accents=True, stopwords=True)[1] == ["caza", "jaja", "nandu", "caza"]


def test_spelling_ignores_terms_too_long_to_match(spark):
    vocab = spark.createDataFrame([("hola",), ("hol",), ("x" * 3000,)], "term string")
    known = spark.createDataFrame([("hola", 5)], "term string, freq long")
    got = {r.term: (r.correction, r.status) for r in NZ.spelling_corrections(vocab, known).collect()}
    assert got == {"hola": ("hola", "known"), "hol": ("hola", "corrected"), "x" * 3000: ("x" * 3000, "unknown")}


# -- cleaning ---------------------------------------------------------------
@pytest.mark.parametrize("text, want", [
    ("a 😀 b", "a :grinning_face: b"), ("👍🏽!", ":thumbs_up_sign_medium_skin_tone:!"), ("🇪🇸🇲🇽", ":flag_es::flag_mx:"),
    ("1️⃣ #⃣ 2", ":keycap_1: :keycap_#: 2"), ("👩‍🚀", ":woman_rocket:"), ("❤️x", ":heavy_black_heart:x"),
    ("👩🏿‍🚀", ":woman_dark_skin_tone_rocket:"), ("⭐⌚", ":white_medium_star::watch:"), ("🇪", "🇪"), ("no #1*", "no #1*"),
    ("1⃣", ":keycap_1:"), ("", ""), ("日本", "日本")])
def test_emoji_sequences(spark, text, want):
    assert apply(spark, text, C.emoji_to_alias) == want


def test_hashtags_of_any_length_and_noncharacters(spark):
    assert apply(spark, "a﷐b﷑ #AbCd", C.split_hashtags) == "a﷐b﷑ Ab Cd"
    long = "#" + "aB" * 50_000
    assert apply(spark, long, C.split_hashtags) == " ".join(["a", *["Ba"] * 49_999, "B"])
    assert apply(spark, "a#b #CdEf ##EfGh (#GhIj) é#XyZ #", C.split_hashtags) == "a#b Cd Ef #Ef Gh (Gh Ij) é#XyZ #"


# -- vectors ----------------------------------------------------------------
def test_vector_lines_are_all_accounted_for(spark, tmp_path):
    f = tmp_path / "v.vec"
    f.write_text("4 2\nhola 0.5 -1\nde la 1e-3 2 \nbad 1\nworse 1 x\n3 2\n\n 1 2\nlast 1 2\n")
    lines = VEC.vector_lines(read_lines_ordered(spark, str(f)), 2).orderBy("line_order").collect()
    assert [(r.kind, r.word) for r in lines] == [
        ("header", None), ("vector", "hola"), ("vector", "de la"), ("malformed", None), ("malformed", None),
        ("malformed", None), ("malformed", None), ("malformed", None), ("vector", "last")]
    assert [list(r.vector) for r in VEC.read_vectors(spark, str(f), 2).filter("word = 'hola'").collect()] == [[0.5, -1.0]]
    assert VEC.malformed_vectors(spark, str(f), 2).count() == 5


def test_document_embedding(spark):
    terms = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "zz", 9), (2, "zz", 1)], "id long, term string, tf long")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 4.0]), ("c", [9.0, 9.0])], "word string, vector array<float>")
    got = {r.id: (r.embedding, r.n_tokens) for r in TM.document_embedding(terms, docs, "id", v).collect()}
    assert got == {1: ([0.75, 1.0], 4), 2: (None, 0), 3: (None, 0)}


def test_tfidf_vectors_without_terms(spark):
    terms = spark.createDataFrame([(1, "train", "a", 2), (1, "train", "b", 1), (2, "dev", "c", 1)],
                                  "id long, split string, term string, tf long")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r.id: r.features for r in TM.tfidf_vectors(terms, docs, "id", F.col("split") == "train", F.lit(1), 10).collect()}
    assert got[1].size == 10 and list(got[1].indices) == [0, 1] and got[1].norm(2) == pytest.approx(1)
    assert list(got[1].values) == pytest.approx([2 / math.sqrt(5), 1 / math.sqrt(5)])
    assert got[2].numNonzeros() == got[3].numNonzeros() == 0


# -- M3, X12 ----------------------------------------------------------------
def test_naive_bayes_probabilities_and_hot_terms(spark):
    rng = random.Random(3)
    docs = [(i, i % 3, "train" if i % 4 else "test") for i in range(200)]
    terms = []
    for i, label, split in docs:
        words = Counter(rng.choices(["the", f"w{label}", f"v{rng.randrange(30)}"], [6, 2, 1], k=12))
        terms += [(i, split, label, w, n) for w, n in words.items()]
    d = spark.createDataFrame(docs, "tweet_id long, sentiment int, split string")
    t = spark.createDataFrame(terms, "tweet_id long, split string, sentiment int, term string, tf long")
    got = {r.tweet_id: r for r in M.naive_bayes(t, d, "tweet_id", "sentiment", "split", [0, 1, 2, 7], probabilities=True).collect()}
    train = [x for x in terms if x[1] == "train"]
    ct, tot = Counter(), Counter()
    for _, _, c, w, n in train:
        ct[c, w] += n
        tot[c] += n
    vocab = {x[3] for x in train}
    prior = Counter(c for _, c, s in docs if s == "train")
    for i, _, split in docs:
        if split == "train":
            continue
        own = [(w, n) for j, _, _, w, n in terms if j == i and w in vocab]
        s = [math.log(prior[c] / sum(prior.values())) + sum(n * math.log((ct[c, w] + 1) / (tot[c] + len(vocab))) for w, n in own)
             for c in (0, 1, 2)]
        z = sum(math.exp(x - max(s)) for x in s)
        assert got[i].probability == pytest.approx([math.exp(x - max(s)) / z for x in s] + [0.0])
        assert got[i].prediction == s.index(max(s))


def test_scoring_joins_terms_once(spark):
    p = plan(E.queries()["classify_nb"](spark, SF_SMALL)).split("Physical Plan")[1]
    assert p.count("[term#") >= 0 and "TakeOrderedAndProject" in p
    assert len(re.findall(r"(SortMergeJoin|ShuffledHashJoin) \[term", p)) <= 1


def test_bins_count_every_row(spark):
    rows = [(x, i % 2) for i, x in enumerate([0.0, 0.1, 0.30000000000000004, 0.95, 1.0, 1.2, -3.0, None, 0.5])]
    df = spark.createDataFrame(rows, "x double, sentiment int")
    got = X.binned_by_label(df, {"x": (0, 1, 0.1)}, [0, 1]).collect()
    assert sum(r.n for r in got) == len(rows) and len({r.bin for r in got if r.bin is not None and 0 <= r.bin < 10}) == 10
    by = Counter()
    for r in got:
        by[r.bin] += r.n
    assert by == Counter({-1: 2, 0: 1, 2: 1, 4: 1, 9: 2, 10: 1, None: 1, **{k: 0 for k in (1, 3, 5, 6, 7, 8)}})


def test_binned_query_sums_to_the_rows(spark):
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    got = E.queries()["binned_feature_by_label"](spark, SF_SMALL).groupBy("feature").agg(F.sum("n").alias("n")).collect()
    assert {r.feature: r.n for r in got} == dict.fromkeys(["tweet_length", "pos_voc", "neg_voc", "neu_voc", "none_voc"], n)
