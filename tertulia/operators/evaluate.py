"""Evaluation (E1-E5): all metrics reduce the data to the k x k
(gold, predicted) count table first, so only k^2 rows are shuffled after the
first partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources.runs import read_lines_ordered

MISSING = "?"
SCORES = ["maf1", "map", "mar", "a", "mip", "mir", "mif1"]


def pair_counts(df: DataFrame, gold_col: str = "gold", pred_col: str = "pred",
                by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(gold_col).alias("gold"), F.col(pred_col).alias("pred")) \
             .agg(F.count(F.lit(1)).alias("n"))


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def per_class(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(class, tp, gold_n, pred_n) over the union of gold and predicted classes."""
    roles = F.explode(F.array(
        F.struct(F.col("gold").alias("cls"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("g"), F.col("n").alias("p"),
                 F.lit(0).cast("bigint").alias("tp"))))
    by = by or []
    return (pairs.select(*by, roles.alias("r"))
            .groupBy(*by, F.col("r.cls").alias("cls"))
            .agg(F.sum("r.tp").alias("tp"), F.sum("r.g").alias("gold_n"), F.sum("r.p").alias("pred_n")))


def macro_scores(df: DataFrame, gold_col: str = "gold", pred_col: str = "pred",
                 by: list[str] | None = None) -> DataFrame:
    """Macro precision, recall and F1 (F1 x 100) over the union of gold
    and predicted classes; 0/0 counts as 0.  ``by``: evaluate several
    (split, model, ...) groups in one aggregation."""
    by = by or []
    pc = per_class(pair_counts(df, gold_col, pred_col, by), by)
    p = _safe_div(F.col("tp"), F.col("pred_n"))
    r = _safe_div(F.col("tp"), F.col("gold_n"))
    f = _safe_div(2 * p * r, p + r)
    return pc.select(*by, p.alias("p"), r.alias("r"), f.alias("f")).groupBy(*by).agg(
        F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"),
        (100 * F.avg("f")).alias("macro_f1"))


def confusion_matrix(df: DataFrame, labels: list, gold_col: str = "gold",
                     pred_col: str = "pred") -> DataFrame:
    """Zero-filled gold x predicted counts (explicit pivot values)."""
    pv = (df.groupBy(F.col(gold_col).alias("gold"))
          .pivot(pred_col, labels).agg(F.count(F.lit(1))).na.fill(0))
    return pv.select("gold", *[F.col(str(v)).cast("bigint").alias(f"pred_{v}") for v in labels])


def last_wins(df: DataFrame, id_col: str, value_col: str, order_col: str) -> DataFrame:
    """Keep, per id, the value of the last line (``order_col`` ascending)."""
    return df.groupBy(id_col).agg(
        F.max_by(F.col(value_col), F.col(order_col)).alias(value_col))


def one_per_id(df: DataFrame, line_col: str = "line") -> DataFrame:
    """(id, label) with one row per id: the last line wins; without line
    numbers the largest label does."""
    if line_col in df.columns:
        return last_wins(df, "id", "label", line_col)
    return df.groupBy("id").agg(F.max("label").alias("label"))


def task_scores(gold: DataFrame, run: DataFrame, compat: bool = False) -> DataFrame:
    """The shared-task scorer.  Both sides are (id, label), with an
    optional ``line`` that orders repeated ids.

    Missing predictions count as ``?``; per-class precision/recall over gold
    classes only; macro-F1 = harmonic mean of macro-P and macro-R; accuracy =
    tp / gold rows; micro P/R/F1 with fp counted for gold classes only.
    ``compat=True`` reproduces the reference's zeroing of a class whose
    false-positive (or false-negative) entry is absent.
    """
    gold, run = one_per_id(gold), one_per_id(run)
    run_known = run.join(gold.select("id"), "id", "left_semi")
    j = gold.select("id", F.col("label").alias("gold")).join(
        run_known.select("id", F.col("label").alias("pred")), "id", "left")
    j = j.select("gold", F.coalesce("pred", F.lit(MISSING)).alias("pred"))
    pairs = pair_counts(j)
    # tp / fp / fn per class; fp and fn also remember whether they occurred.
    roles = F.explode(F.array(
        F.struct(F.col("gold").alias("cls"),
                 F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"),
                 F.when(F.col("gold") != F.col("pred"), F.col("n")).otherwise(0).alias("fn"),
                 F.lit(True).alias("is_gold")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(F.col("gold") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"),
                 F.lit(0).cast("bigint").alias("fn"), F.lit(False).alias("is_gold"))))
    pc = (pairs.select(roles.alias("r")).groupBy(F.col("r.cls").alias("cls"))
          .agg(F.sum("r.tp").alias("tp"), F.sum("r.fp").alias("fp"), F.sum("r.fn").alias("fn"),
               F.max("r.is_gold").alias("is_gold"))
          .filter("is_gold"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    if compat:
        p = F.when((tp == 0) | (fp == 0), 0.0).otherwise(tp / (tp + fp))
        r = F.when((tp == 0) | (fn == 0), 0.0).otherwise(tp / (tp + fn))
    else:
        p = _safe_div(tp, tp + fp)
        r = _safe_div(tp, tp + fn)
    f1 = _safe_div(2 * p * r, p + r)
    agg = pc.select(tp, fp, fn, p.alias("p"), r.alias("r"), f1.alias("f1")).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg("p").alias("map"), F.avg("r").alias("mar"))
    n_gold = gold.select(F.count(F.lit(1))).scalar()
    mip = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    mir = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return agg.select(
        _safe_div(2 * F.col("map") * F.col("mar"), F.col("map") + F.col("mar")).alias("maf1"),
        F.col("map"), F.col("mar"),
        (F.col("tp") / n_gold).alias("a"),
        mip.alias("mip"), mir.alias("mir"),
        _safe_div(2 * mip * mir, mip + mir).alias("mif1"))


def parse_id_label_lines(lines: DataFrame, order_col: str) -> DataFrame:
    """``id<TAB>label`` lines -> (id, label, ok, line order)."""
    v = F.regexp_replace(F.col("value"), r"^\s+|\s+$", "")
    ok = v.rlike(r"^(.+?)\t(.+?)$") & (F.size(F.split(v, "\t", -1)) == 2)
    parts = F.split(v, "\t", -1)
    return lines.select(
        F.when(ok, parts[0]).alias("id"), F.when(ok, parts[1]).alias("label"),
        ok.alias("ok"), F.col(order_col))


def score_files(spark: SparkSession, gold_path: str, run_path: str, compat: bool = False) -> DataFrame:
    """S11 -> E3/E4: the shared-task scores of a run file, one row.

    Lines are ordered by (file, place in it), so the last line of an id wins
    wherever the files are split.  Malformed gold lines are skipped; one
    malformed run line makes the whole run invalid: ``valid_run`` is false and
    all scores are null.  The run is read once: the count of malformed lines is
    observed while the parsed lines are written, before anything is scored.
    """
    seen = Observation("run lines")
    parsed = parse_id_label_lines(read_lines_ordered(spark, run_path), "line_order")
    parsed = parsed.observe(seen, F.count_if(~F.col("ok")).alias("malformed"))
    path = scratch_dir(spark, "run-lines")
    parsed.filter("ok").select("id", "label", F.col("line_order").alias("line")).write.parquet(path)
    malformed = seen.get["malformed"]
    head = [F.lit(malformed == 0).alias("valid_run"), F.lit(malformed).cast("long").alias("malformed_lines")]
    if malformed:
        return spark.range(1).select(*head, *[F.lit(None).cast("double").alias(c) for c in SCORES])
    gold = parse_id_label_lines(read_lines_ordered(spark, gold_path), "line_order").filter("ok")
    gold = gold.select("id", "label", F.col("line_order").alias("line"))
    return task_scores(gold, spark.read.parquet(path), compat).select(*head, *SCORES)


def run_file_audit(gold_lines: DataFrame, run_lines: DataFrame, order_col: str) -> DataFrame:
    """E5: counts of valid / malformed / unknown / duplicate / missing run
    ids (one row); ``valid_run`` is false when any run line is malformed
    (the reference scorer then aborts)."""
    g = parse_id_label_lines(gold_lines, order_col).filter("ok")
    r = parse_id_label_lines(run_lines, order_col)
    gold_ids = g.select("id").distinct().withColumn("_g", F.lit(True))
    rv = r.filter("ok").select("id").join(gold_ids, "id", "left")
    per_id = rv.groupBy("id").agg(F.count(F.lit(1)).alias("_k"), F.max("_g").alias("_g"))
    known = per_id.filter(F.col("_g").isNotNull())
    missing = gold_ids.join(known.select("id"), "id", "left_anti")
    spark = gold_lines.sparkSession
    return spark.range(1).select(
        r.select(F.count_if("ok")).scalar().alias("valid_lines"),
        r.select(F.count_if(~F.col("ok"))).scalar().alias("malformed_lines"),
        per_id.select(F.coalesce(F.sum(F.when(F.col("_g").isNull(), F.col("_k"))), F.lit(0))).scalar()
        .alias("unknown_lines"),
        known.select(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0))).scalar().alias("duplicate_lines"),
        missing.select(F.count(F.lit(1))).scalar().alias("missing_ids"),
        r.select(F.count_if(~F.col("ok")) == 0).scalar().alias("valid_run"))
