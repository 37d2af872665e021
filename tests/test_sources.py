"""Sources and sinks on small hand-made files."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tertulia.sources import catalogue as CAT
from tertulia.sources import label_lines as LL
from tertulia.sources import lexicon as LEX
from tertulia.sources import tsv as TSV
from tertulia.sources import xml as XML
from tertulia.sources import vectors as VEC


def test_tsv_roundtrip_keeps_tabs_quotes_newlines_and_empty(spark):
    d = tempfile.mkdtemp()
    rows = [(1, 'a\tb "q"\nnext', 2), (2, "", 0), (3, "  padded  ", 1)]
    df = spark.createDataFrame(rows, "tweet_id long, content string, sentiment int")
    TSV.write_tsv(df, d + "/t")
    back = TSV.read_tsv(spark, d + "/t", CAT.CORPUS_SCHEMA)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_unknown_corpus_raises(spark):
    with pytest.raises(KeyError):
        CAT.read_corpus(spark, {}, "nope")


def test_label_lines_filter(spark):
    lines = spark.createDataFrame([("__label__3 hola  ",), ("__label__9 x",), ("__label__1 ",),
                                   ("__label__0 a b c",)], "value string")
    out = sorted(map(tuple, LL.parse_label_lines(lines).collect()))
    assert out == [("a b c", 0), ("hola", 3)]


def test_xml_tagged_tweets_first_value(spark):
    d = tempfile.mkdtemp()
    rec = ("<tweet><tweetid>7</tweetid><user>u</user><content>a &amp; b\nc</content>"
           "<date>Sun Jan 05 13:04:05 +0000 2020</date><lang>es</lang><sentiment>"
           "<polarity><value>P</value></polarity><polarity><value>N</value></polarity>"
           "</sentiment></tweet>")
    spark.createDataFrame([(rec,)], "value string").write.text(d + "/x")
    r = XML.read_tagged_tweets(spark, d + "/x").first()
    assert (r.tweet_id, r.content, r.day_of_week, r.month, r.hour, r.value) == \
        (7, "a & b\nc", "Sun", "Jan", "13", "P")


def test_xml_aspects_text_order(spark):
    d = tempfile.mkdtemp()
    rec = '<tweet id="3">Me <sentiment aspect="x" polarity="P">gusta</sentiment> y <sentiment polarity="N">no</sentiment></tweet>'
    spark.createDataFrame([(rec,)], "value string").write.text(d + "/a")
    r = XML.read_aspects(spark, d + "/a").first()
    assert r.content == "Me gusta y no" and sorted(r.polarities) == ["N", "P"]


def test_lexicon_latin1(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "pos.csv"), "wb") as f:
        f.write("año\nbueno\nbueno\n".encode("latin-1"))
    with open(os.path.join(d, "neg.csv"), "wb") as f:
        f.write("malo\n".encode("latin-1"))
    lex = LEX.read_lexicon(spark, d + "/pos.csv", d + "/neg.csv")
    assert sorted(map(tuple, lex.collect())) == [("año", 1), ("bueno", 1), ("malo", -1)]


def test_word_vectors_skip_header(spark):
    lines = spark.createDataFrame([("2 3",), ("hola 0.5 1 -2",), ("adios 1 2 3",)], "value string")
    v = {r.word: r.vector for r in VEC.parse_vectors(lines, 3).collect()}
    assert v == {"hola": [0.5, 1.0, -2.0], "adios": [1.0, 2.0, 3.0]}


def test_xml_first_record_after_declaration_and_root(spark, tmp_path):
    from tertulia.sources.xml import read_records
    (tmp_path / "a.xml").write_text(
        '<?xml version="1.0"?>\n<tweets>\n' + "".join(f"<tweet><id>{i}</id></tweet>\n" for i in (1, 2, 3)) + "</tweets>\n")
    got = sorted(r.record for r in read_records(spark, str(tmp_path), "tweet").collect())
    assert got == [f"<tweet><id>{i}</id></tweet>" for i in (1, 2, 3)]
