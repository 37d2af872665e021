"""Plan checks: no Python UDF in text operators, no cartesian products,
no duplicated regex work from inferred generator filters, pruned scans."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

ROW_LOCAL = ["clean_all_stages", "clean_preset_older", "tokenize_treebank", "extract_entities",
             "feature_matrix", "feature_lexicon", "vocabulary_stats", "tfidf", "count_vectors",
             "discriminating_terms", "spell_correct", "entity_top5", "classify_nb",
             "ensemble_average", "task_score", "upsample", "split_three_way", "quota_sample"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_no_python_no_cartesian(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    for bad in ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]:
        assert bad not in p, (name, bad)


@pytest.mark.parametrize("name", ["tokenize_words", "vocabulary_stats", "extract_entities"])
def test_no_inferred_filter_on_token_arrays(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "size(regexp_extract_all" not in p


def test_scan_reads_only_needed_columns(spark):
    p = plan(E.queries()["date_parts"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp" in p
    assert "value" not in p.split("ReadSchema")[1].split("\n")[0]


def test_quota_sample_limits_rows_before_shuffle(spark):
    p = plan(E.queries()["quota_sample"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_top_k_vocabulary_is_take_ordered(spark):
    df = E.queries()["tfidf"](spark, SF_SMALL)
    df.collect()
    p = plan(df)
    assert "TakeOrderedAndProject" in p or "TopK" in p or "Limit" in p


def test_spread_adds_no_shuffle_for_well_split_input(spark, tmp_path):
    """At scale the input has many splits: no repartition is added; the
    single-row-group test file does get spread."""
    from tertulia.plans import tweets as TW
    small = TW.spread(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), "doc_id")
    assert "REPARTITION_BY_NUM" in plan(small)
    many = str(tmp_path / "docs")
    slots = spark.sparkContext.defaultParallelism
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(slots * 2) \
        .write.parquet(many)
    big = TW.spread(spark.read.option("maxPartitionBytes", "1k").parquet(many), "doc_id")
    assert big.rdd.getNumPartitions() >= slots
    assert "REPARTITION_BY_NUM" not in plan(big)
