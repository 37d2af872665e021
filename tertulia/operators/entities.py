"""Entity extraction and corpus profiling.

Extraction is a row-local generator (``explode`` of per-kind match arrays):
no shuffle.  Profiles are aggregations whose shuffles carry partial
(map-side) aggregates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import ABBREVIATIONS, LAUGH_STEMS_SIX, _laugh_pattern
from ..functions.emoji import demojize
from ..functions.generators import explode_rows
from ..functions.features import hashtag_count, tweet_length
from ..functions.regex import NO_WORD_BEFORE, NOT_SPACE, WORD, DIGITS
from ..functions.tokens import word_tokens

HASHTAG = rf"{NO_WORD_BEFORE}#{WORD}+"
USERNAME = rf"{NO_WORD_BEFORE}@{WORD}+"
URL = rf"http{NOT_SPACE}+"
EMOJI_ALIAS = r"(?i):[a-z_0-9]*?:"
LETTER_RUN = rf"(({WORD})\2{{2,}})"


def _tagged(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def entity_arrays(text: Column) -> Column:
    """Array of (kind, value) for hashtags, URLs, usernames, numbers and
    emoji aliases, in that order; duplicates kept."""
    return F.flatten(F.array(
        _tagged("hashtag", F.regexp_extract_all(text, F.lit(HASHTAG), 0)),
        _tagged("url", F.regexp_extract_all(text, F.lit(URL), 0)),
        _tagged("username", F.regexp_extract_all(text, F.lit(USERNAME), 0)),
        _tagged("number", F.regexp_extract_all(text, F.lit(DIGITS), 0)),
        _tagged("emoji", F.regexp_extract_all(demojize(text), F.lit(EMOJI_ALIAS), 0)),
    ))


def extract_entities(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Long table (id, kind, value)."""
    return (explode_rows(df, [id_col], entity_arrays(F.col(text_col)), "e")
            .select(id_col, "e.kind", "e.value"))


def laughter_arrays(text: Column, stems: list[str] = LAUGH_STEMS_SIX, kind: str | None = None) -> Column:
    return F.flatten(F.array(*[
        _tagged(kind or s, F.regexp_extract_all(text, F.lit(f"(?i){_laugh_pattern(s)}"), 0))
        for s in stems]))


def abbreviation_array(text: Column) -> Column:
    shorts = [s for s, _ in ABBREVIATIONS]
    toks = F.filter(word_tokens(text), lambda t: F.lower(t).isin(*shorts))
    return F.transform(toks, lambda v: F.struct(F.lower(v).alias("kind"), v.alias("value")))


def extract_all(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """X1 + X3 + X4 in one generator: (id, kind, value) with kinds hashtag,
    url, username, number, emoji, laughter and the abbreviations."""
    t = F.col(text_col)
    arr = F.flatten(F.array(entity_arrays(t), laughter_arrays(t, kind="laughter"),
                            abbreviation_array(t)))
    return explode_rows(df, [id_col], arr, "e").select(id_col, "e.kind", "e.value")


def extract_letreps(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Letter-repeat runs as (char, rest) pairs."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(LETTER_RUN), 1)
    return (explode_rows(df, [id_col], runs, "run")
            .select(id_col, F.substring("run", 1, 1).alias("ch"),
                    F.expr("substring(run, 2)").alias("rest")))


def extract_laughter(df: DataFrame, id_col: str, text_col: str,
                     stems: list[str] = LAUGH_STEMS_SIX) -> DataFrame:
    """Laughter hits per pattern, case-insensitive; a word matching two
    patterns is counted under both."""
    return (explode_rows(df, [id_col], laughter_arrays(F.col(text_col), stems), "e")
            .select(id_col, F.col("e.kind").alias("pattern"), F.col("e.value").alias("value")))


def extract_abbreviations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole-word q/x/d/xq/pq hits, case-insensitive (original case kept)."""
    return (explode_rows(df, [id_col], abbreviation_array(F.col(text_col)), "e")
            .select(id_col, "e.kind", "e.value"))


def entity_counts(entities: DataFrame, approximate: bool = False) -> DataFrame:
    """Occurrences and distinct values per kind (exact by default;
    ``approximate=True`` uses a HyperLogLog++ sketch)."""
    distinct = F.approx_count_distinct("value") if approximate else F.countDistinct("value")
    return entities.groupBy("kind").agg(
        F.count(F.lit(1)).alias("occurrences"), distinct.alias("distinct_values"))


def entity_top(entities: DataFrame, k: int = 5) -> DataFrame:
    """Top-k values per kind by count, ties by value.  The literal bound
    lets Spark keep only k rows per kind and partition before the shuffle."""
    counts = entities.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), F.asc("value"))
    return (counts.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def unseen_hashtags(tw: DataFrame, id_col: str = "tweet_id", text_col: str = "content",
                    split_col: str = "split") -> DataFrame:
    """Test hashtag occurrences whose hashtag never occurs in train/dev."""
    tags = explode_rows(tw, [split_col], F.regexp_extract_all(F.col(text_col), F.lit(HASHTAG), 0), "tag")
    seen = (tags.filter(F.col(split_col).isin("train", "dev")).select("tag").distinct()
            .withColumn("_seen", F.lit(True)))
    test = tags.filter(F.col(split_col) == "test")
    return test.join(seen, "tag", "left").agg(
        F.count(F.lit(1)).alias("test_hashtags"),
        F.count_if(F.col("_seen").isNull()).alias("unseen_hashtags"))


def length_stats(tw: DataFrame, text_col: str = "content", split_col: str = "split") -> DataFrame:
    """Max and mean word length per split."""
    L = tweet_length(F.col(text_col))
    return tw.groupBy(split_col).agg(F.max(L).alias("max_length"),
                                      F.avg(L).alias("avg_length"))


def hashtag_stats(tw: DataFrame, text_col: str = "content", split_col: str = "split") -> DataFrame:
    """Mean ``#`` count per row and % of rows with at least one."""
    h = hashtag_count(F.col(text_col))
    return tw.groupBy(split_col).agg(
        F.avg(h).alias("avg_hashtags"),
        (100.0 * F.count_if(h > 0) / F.count(F.lit(1))).alias("pct_with_hashtag"))


def feature_by_label(features: DataFrame, feature_cols: list[str],
                     label_col: str = "sentiment") -> DataFrame:
    """X11: counts of (feature value, label) for several features in one
    aggregation (one Expand-like explode + one partial aggregate); values as
    text, since dates' parts are."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"),
                               F.col(f).cast("string").alias("value")) for f in feature_cols])
    return (features.select(label_col, F.explode(pairs).alias("p"))
            .groupBy(F.col("p.feature").alias("feature"), F.col("p.value").alias("value"),
                     F.col(label_col))
            .agg(F.count(F.lit(1)).alias("n")))


def binned_by_label(features: DataFrame, bins: dict[str, tuple[float, float, float]], labels: list[int],
                    label_col: str = "sentiment", decimals: int = 9) -> DataFrame:
    """Counts per feature, right-closed bin and label, all features in one
    aggregation.  ``bins``: feature -> (low, high, width).  Empty cells appear
    with 0.  What lies at or below ``low`` is counted in bin -1, what lies above
    ``high`` in bin n, null values in a null bin, so each feature's counts sum to
    the rows read.  Values are rounded to ``decimals`` first, so that a ratio on a
    bin's edge stays in the bin."""
    rows = []
    for name, (lo, hi, width) in bins.items():
        n = int(round((hi - lo) / width))
        x = F.round(F.col(name).cast("double"), decimals)
        inside = F.ceil(F.round((x - F.lit(lo)) / F.lit(width), decimals)).cast("long") - 1
        b = F.when(x <= lo, F.lit(-1).cast("long")).when(x > hi, F.lit(n).cast("long")).when(x.isNotNull(), inside)
        rows.append(F.struct(F.lit(name).alias("feature"), b.alias("bin")))
    counts = (features.select(label_col, F.explode(F.array(*rows)).alias("p"))
              .groupBy(F.col("p.feature").alias("feature"), F.col("p.bin").alias("bin"), label_col)
              .agg(F.count(F.lit(1)).alias("n")))
    spark = features.sparkSession
    edges = spark.createDataFrame([(name, float(lo), float(width), int(round((hi - lo) / width)))
                                   for name, (lo, hi, width) in bins.items()],
                                  "feature string, lo double, width double, n_bins int")
    cells = (edges.select("feature", F.expr("explode(sequence(0L, CAST(n_bins - 1 AS BIGINT)))").alias("bin"))
             .select("*", F.explode(F.array(*[F.lit(int(x)) for x in labels])).alias(label_col), F.lit(0).cast("long").alias("n")))
    every = counts.unionByName(cells).groupBy("feature", "bin", label_col).agg(F.sum("n").alias("n"))
    out = every.join(F.broadcast(edges), "feature")  # one row a feature
    lower = F.when(F.col("bin") >= 0, F.round(F.col("lo") + F.col("bin") * F.col("width"), decimals))
    upper = F.when(F.col("bin") < F.col("n_bins"), F.round(F.col("lo") + (F.col("bin") + 1) * F.col("width"), decimals))
    return out.select("feature", "bin", lower.alias("bin_lo"), upper.alias("bin_hi"), label_col, "n")


def label_distribution(df: DataFrame, label_col: str = "sentiment") -> DataFrame:
    """Count and share per label (share over the k-row aggregate)."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def oov_report(train_terms: DataFrame, dev_terms: DataFrame) -> DataFrame:
    """train/dev vocabulary sizes and out-of-vocabulary share (inputs
    are one-column ``term`` tables, duplicates allowed).  Lower-case both sides
    first; with only dev lower-cased, capitalised training words make their
    lower-cased forms count as unknown, as in the compatibility mode."""
    tv = train_terms.select("term").distinct().withColumn("_t", F.lit(True))
    dv = dev_terms.select("term").distinct().withColumn("_d", F.lit(True))
    both = tv.join(dv, "term", "full")
    return both.agg(
        F.count_if(F.col("_t").isNotNull()).alias("train_vocabulary"),
        F.count_if(F.col("_d").isNotNull()).alias("dev_vocabulary"),
        F.count_if(F.col("_d").isNotNull() & F.col("_t").isNull()).alias("oov_terms"),
    ).withColumn("oov_pct", 100.0 * F.col("oov_terms") / F.nullif(F.col("dev_vocabulary"), F.lit(0)))


def oov_words(train_terms: DataFrame, dev_terms: DataFrame, top: int = 10) -> DataFrame:
    """The dev terms that training lacks, with their occurrences, and the
    ``top`` most frequent terms of either side: (kind, rank, term, n), kind oov
    (rank null), train or dev.  Inputs are one-column ``term`` tables."""
    counts = lambda t: t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    train, dev = counts(train_terms), counts(dev_terms)
    oov = dev.join(train.select("term"), "term", "left_anti").select(
        F.lit("oov").alias("kind"), F.lit(None).cast("int").alias("rank"), "term", "n")
    out = oov
    for kind, c in (("train", train), ("dev", dev)):
        first = c.orderBy(F.desc("n"), "term").limit(top)  # a window over ``top`` rows
        rank = F.row_number().over(Window.orderBy(F.desc("n"), "term"))
        out = out.unionByName(first.select(F.lit(kind).alias("kind"), rank.alias("rank"), "term", "n"))
    return out
