"""Tests of the fourth round: work that grows no faster than the input."""

import hashlib
import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tertulia.functions import clean as C
from tertulia.functions import tokens as TK
from tertulia.llm import warc
from tertulia.operators import terms as TM


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_digest_is_taken_once(spark):
    """SHA-1 stood inside the lambda of the 32 letters: one digest of the payload for each."""
    import base64
    rows = [("",), ("a",), ("x" * 5000,), ("ñ😀",)]
    df = spark.createDataFrame(rows, "p string").withColumn("d", warc.sha1_base32(F.col("p").cast("binary")))
    assert {r.p: r.d for r in df.collect()} == {p: base64.b32encode(hashlib.sha1(p.encode()).digest()).decode() for p, in rows}
    assert "sha1" not in re.split(r"lambdafunction\(", plan(df.select("d")), maxsplit=1)[1].split("lambda")[0]


def test_laughter_patterns_only_where_the_stem_is(spark):
    texts = ["", None, "jaja hah JAJA jaja xjajx jaja", "no stem at all", "xd xd xd lmao lol", "jajahah hahjej joj"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.normalize_laughter(F.col("t"), compat=True)).collect()]

    def want(t):
        for stem in C.LAUGH_STEMS_MAIN:
            t = t and re.sub(f"[a-zA-Z]*{stem}[a-zA-Z]*", C.LAUGH_TOKEN, t, count=2)
        return t

    assert got == [want(t) for t in texts]
    # Each pattern is behind a search for its stem.
    p = plan(df.select(C.normalize_laughter(F.col("t"), compat=True)))
    assert p.count("Contains(") + p.count("contains(") >= 2 * len(C.LAUGH_STEMS_MAIN)


def test_treebank_rules_as_written(spark):
    """The guarded and rewritten rules give what the plain chain of the rules gives."""
    import random
    rng = random.Random(4)
    bits = ["a", "word", ".", "..", "...", "'", "''", '"', "``", "`", " ", "  ", "\n", "\t", " ", ",", ":", "3", "(", ")", "]", "[", "{", "<", ">",
            "--", "-", "'s", "'S", "n't", "'ll", "cannot", "Gimme", "'tis", "?", "!", "@", "#", "%", "ñ", "😀", "$1", "\\"]
    texts = ["", " ", ". .'\n", "a. .' b", "a. . b", ".", "a.", "x.'\n.'", 'a. ." b', "a.b. c.", "end:", "end,", '"q" \'r\' ']
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(3000)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    c = F.col("t")
    for pat, rep in TK.TREEBANK_RULES:
        c = F.regexp_replace(c, pat, rep)
    guarded, rules = F.col("t"), []
    for pat, rep in TK.TREEBANK_RULES:
        rules.append(pat)
        guarded = TK.treebank_rule(guarded, pat, rep)
    assert set(TK.TREEBANK_NEEDS) | set(TK.TREEBANK_FORMS) <= set(rules)
    assert df.filter(~c.eqNullSafe(guarded)).count() == 0
    assert df.filter(F.col("t").isNotNull()).count() == len(texts) - 1


def test_words_and_ends_as_before(spark):
    from tertulia.functions.regex import SPACE, WORD
    texts = ["", " ", "añb_3 ñoño éa1 x²y Ⅷ a", "\n a\nb 　", "‘x’ y", "q ", "\x1fz", "日本 abc日本abc", "a-b.c'd 😀e", None, "\n", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    stripped = F.regexp_replace(F.regexp_replace(t, "\n", ""), rf"^{SPACE}+|{SPACE}+\z", "")
    assert df.filter(~C.strip_newlines(t).eqNullSafe(stripped)).count() == 0
    assert df.filter(~C.unify_quotes(t).eqNullSafe(F.translate(t, "‘’", "''"))).count() == 0
    assert df.filter(~TK.word_tokens(t).eqNullSafe(F.regexp_extract_all(t, F.lit(f"({WORD}+)"), 1))).count() == 0


def test_lexicon_hits_without_a_row_per_token(spark, monkeypatch):
    rows = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["c", "d"]), (4, ["c", "d"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "id long, toks array<string>")
    lex = spark.createDataFrame([("a", 1), ("a", -1), ("b", 1), ("c", -1), (None, 1), ("a", 1)], "word string, polarity int")
    small = TM.lexicon_ratios(df, "id", "toks", lex)
    assert "explode" not in plan(small).lower() and "Generate" not in plan(small)
    small = sorted(map(tuple, small.collect()), key=str)
    monkeypatch.setattr(TM, "LEXICON_IN_PLACE", 0)
    assert sorted(map(tuple, TM.lexicon_ratios(df, "id", "toks", lex).collect()), key=str) == small
    assert (1, 2 / 3, 1 / 3, 1 - 1 / 3, 0.0) in small


def test_fitting_rows_meet_no_vocabulary(spark):
    rows = [(1, "train", "a", 2), (2, "dev", "a", 1), (2, "dev", "z", 1), (3, None, "a", 1), (None, "train", "q", 3), (4, "train", None, 1)]
    t = spark.createDataFrame(rows, "id long, split string, term string, tf long")
    fit = F.col("split") == "train"
    got = TM.count_vectors(t, "id", fit)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", 2), (2, "a", 1), (3, "a", 1), (None, "q", 3)], key=str)
    assert {r.value for r in TM.count_vectors(t, "id", fit, binary=True).collect()} == {1}
    assert "Union" in plan(got)


def test_embedding_of_hot_and_cold_terms(spark, monkeypatch):
    rows = [(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "q", 4), (3, "b", 3), (4, "q", 1), (5, "a", 1), (None, "a", 1)]
    t = spark.createDataFrame(rows, "id long, term string, tf long")
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [4.0, -1.0]), ("z", [9.0, 9.0]), ("q", None)], "word string, vector array<float>")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)], "id long")
    want = {1: ([2.0, 1.0], 3), 2: ([1.0, 2.0], 1), 3: ([4.0, -1.0], 3), 4: (None, 0), 5: ([1.0, 2.0], 1), 6: (None, 0)}
    for values in (0, 2, 1000):  # no hot term, one, all
        monkeypatch.setattr(TM, "EMBEDDING_HOT_VALUES", values)
        e = TM.document_embedding(t, docs, "id", v)
        assert {r.id: (r.embedding, r.n_tokens) for r in e.collect()} == want
    # A hash aggregate of plain columns: an object aggregate sorts the pairs with their vectors.
    assert "ObjectHashAggregate" not in plan(e) and "summarizer" not in plan(e).lower()
    freq = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "term string, n long")
    assert [TM.least_frequency(freq, k) for k in (0, 1, 2, 3, 4)] == [6, 5, 5, 3, 1]


def test_forest_in_parts_has_all_trees(spark, monkeypatch):
    from tertulia.operators import classify as M
    rows = [(i, "train" if i % 4 else "test", i % 3, float(i % 3) + (i % 7) / 10, float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "tweet_id long, split string, sentiment int, a double, b double")
    fits = []
    real = M.RandomForestClassifier

    def counted(**kw):
        fits.append(kw["numTrees"])
        return real(**kw)

    monkeypatch.setattr(M, "RandomForestClassifier", counted)
    monkeypatch.setattr(M, "FOREST_TREE_ROWS", 300 * 40)
    got = M.fit_predict(df, ["a", "b"], "sentiment", "split", kind="forest").collect()
    assert fits == [40, 40, 20] and len(got) == 100
    assert sum(r.prediction == r.sentiment for r in got) == 100
    assert all(abs(sum(r.probability) - 1) < 1e-9 and len(r.probability) == 3 for r in got)


def test_ngram_model_is_fitted_on_stored_vectors(spark, tmp_path):
    from tertulia.operators import classify as M
    rows = [(i, "train" if i % 4 else "test", i % 2, ["good", "day"] if i % 2 else ["bad", "day"]) for i in range(80)]
    df = spark.createDataFrame(rows, "tweet_id long, split string, sentiment int, toks array<string>").repartition(16)
    got = M.ngram_classifier(df, "toks", "sentiment", "split", labels=[0, 1], num_features=64, path=str(tmp_path / "m"))
    assert "_grams" not in plan(got)
    assert all(r.prediction == r.sentiment for r in got.collect()) and got.count() == 20


def test_fits_run_in_several_tasks(spark, monkeypatch):
    from tertulia.operators import classify as M
    monkeypatch.setattr(M, "FIT_ROWS", 10)
    df = spark.range(100).withColumnRenamed("id", "tweet_id").coalesce(1)
    out = M.in_all_slots(M.cut_lineage(df))
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and out.count() == 100
    monkeypatch.setattr(M, "FIT_ROWS", 1000)
    assert M.in_all_slots(M.cut_lineage(df)).rdd.getNumPartitions() == 1
