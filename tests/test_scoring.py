"""Repeated ids in the scorer, and incomplete rows in the ensemble."""

from tertulia.operators import ensemble as EN
from tertulia.operators import evaluate as EV


def test_repeated_run_ids_count_once(spark):
    gold = spark.createDataFrame([("1", "N"), ("2", "P")], "id string, label string")
    run = spark.createDataFrame([("1", "N", 1), ("1", "N", 2), ("1", "P", 0), ("2", "P", 3), ("9", "P", 4)],
                                "id string, label string, line int")
    assert sorted(tuple(r) for r in EV.one_per_id(run).collect()) == [("1", "N"), ("2", "P"), ("9", "P")]
    row = EV.task_scores(gold, run).first().asDict()
    assert all(v <= 1 for v in row.values() if isinstance(v, float))


def test_incomplete_rows_keep_their_id(spark):
    p = spark.createDataFrame([("a", "m", "0", 0.4), ("a", "n", "0", 0.6), ("b", "m", "0", 1.0), ("b", "n", "1", 1.0)],
                              "id string, model string, label string, prob double")
    out = {r["id"]: (r["label"], r["prob"]) for r in EN.average_predictions(p, ["0", "1"]).collect()}
    assert out == {"a": ("0", 0.5), "b": (None, None)}
