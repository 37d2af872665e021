"""Registered queries: those with SQL equal it, the others give whole tables;
the pipeline's stages keep the columns of documents."""

import duckdb
import pytest

import corpus_pipeline
from conftest import SF_SMALL
from tertulia.llm import queries as Q
from tools.oracle_check import TABLES, digest


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF_SMALL)
    res = con.execute(Q.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, res.fetchall())[0]


@pytest.mark.parametrize("name, source", [("op3_html", "pages"), ("op5_toxicity", "documents"), ("op11_token_alignment", "documents"),
                                          ("op7_secrets", "documents"), ("op8_warc", "pages"),
                                          ("op10_pii", "documents")])
def test_one_row_each(spark, name, source):
    n = spark.read.parquet(f"{SF_SMALL}/{source}.parquet").count()
    assert Q.QUERIES[name](spark, SF_SMALL).count() == n


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert 0 < got.count() < docs.count()
