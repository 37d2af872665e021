"""Corpus vectors and term statistics.

Documents are long tables ``(doc, term, tf)`` rather than driver-side
matrices: every statistic is a group-by with map-side partial aggregation,
and vocabularies are broadcast only when their size is bounded (top-k) or
checked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.generators import explode_rows
from ..session import stored
from .joins import broadcast_if_small

TFIDF_MAX_FEATURES = 5000
# Rows whose terms are counted at a time.
COUNTED_ROWS = 1000
# Lexicon words up to which each row looks its tokens up by itself.
LEXICON_IN_PLACE = 1000
# Vector values of the frequent terms that are broadcast (four or eight bytes each).
EMBEDDING_HOT_VALUES = 200_000 * 64
DISCRIMINATING_TOP_N = 50
DISCRIMINATING_MAX_TERMS = 1000
DISCRIMINATING_MIN_DF = 3
DISCRIMINATING_MAX_DF = 0.95


def doc_terms(df: DataFrame, id_col: str, tokens_col: str,
              carry: list[str] | None = None) -> DataFrame:
    """(id, [carry...], term, tf) from a token-array column.  ``carry``
    columns (e.g. ``split``) are functionally dependent on the id and ride
    along so later filters need no join back."""
    keys = [id_col, *(carry or [])]
    return (explode_rows(df, keys, F.col(tokens_col), "term")
            .groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf")))


def term_counter(keys: list[str], at_a_time: int = COUNTED_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (keys..., words with blanks between) in which equal keys stand together to
    (keys..., term, tf).  Nested, so that workers need no module of this library."""
    names = [*keys, "term", "tf"]

    def changes(rows) -> np.ndarray:
        """Whether each row but the first has other keys than the row before (null equals null)."""
        out = np.zeros(max(rows.num_rows - 1, 0), bool)
        for c in (rows.column(i) for i in range(len(keys))):
            null = np.asarray(c.is_null())
            out |= np.asarray(pc.fill_null(pc.not_equal(c[1:], c[:-1]), False)) | (null[1:] != null[:-1])
        return out

    def counted(batch: pa.RecordBatch) -> tuple[pa.Table, np.ndarray]:
        """The counts of a batch, and the number of the keys that each is of."""
        lists = pc.split_pattern(batch.column(len(keys)), " ")
        flat, sizes = lists.flatten(), np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        starts = np.append(0, np.flatnonzero(changes(batch)) + 1)
        owner = np.repeat(np.searchsorted(starts, np.arange(batch.num_rows), "right") - 1, sizes)
        word = pc.not_equal(flat, "")
        owner, flat = owner[np.asarray(word)], flat.filter(word)
        coded = flat.dictionary_encode()
        n = max(len(coded.dictionary), 1)
        found, tf = np.unique(owner * n + np.asarray(coded.indices), return_counts=True)
        row = pa.array(starts[found // n])
        return pa.table([*[batch.column(i).take(row) for i in range(len(keys))], coded.dictionary.take(pa.array(found % n)),
                         pa.array(tf, pa.int64())], names=names), found // n

    def added(a: pa.Table, b: pa.Table) -> pa.Table:
        """The counts of the same keys, put together."""
        sums = pa.concat_tables([a, b]).group_by("term").aggregate([("tf", "sum")])
        first = pa.array(np.zeros(sums.num_rows, np.int64))
        return pa.table([*[a.column(i).take(first) for i in range(len(keys))], sums["term"], sums["tf_sum"]], names=names)

    def run(batches):
        held = None  # the counts of the last keys, which may go on
        for whole in batches:
            for at in range(0, whole.num_rows, at_a_time):
                out, of = counted(whole.slice(at, at_a_time))
                if not out.num_rows:
                    continue
                if held is not None:
                    if changes(pa.concat_tables([held.slice(0, 1), out.slice(0, 1)]))[0]:
                        yield from held.combine_chunks().to_batches()
                    else:
                        first = int(np.searchsorted(of, of[0], "right"))
                        held, out, of = added(held, out.slice(0, first)), out.slice(first), of[first:]
                        if not out.num_rows:
                            continue
                        yield from held.combine_chunks().to_batches()
                last = int(np.searchsorted(of, of[-1]))
                if last:
                    yield from out.slice(0, last).combine_chunks().to_batches()
                held = out.slice(last)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def doc_terms_by_id(df: DataFrame, id_col: str, words: Column, carry: list[str]) -> DataFrame:
    """As ``doc_terms``, on ``words``: a text of the rows of ``df`` in which the
    tokens stand between blanks.  The rows move once by id and are sorted by it,
    so each task counts the terms of an id where its rows stand together: no
    hash table of all (document, term) pairs, and tokens are cut there only."""
    keys = [id_col, *carry]
    rows = df.repartition(id_col).sortWithinPartitions(*keys).select(*keys, words.alias("_words"))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return rows.mapInArrow(term_counter(keys), schema)


def vocabulary_stats(terms: DataFrame, id_col: str) -> DataFrame:
    """Per term, corpus frequency and document frequency."""
    return terms.groupBy("term").agg(F.sum("tf").alias("term_freq"),
                                     F.count(F.lit(1)).alias("doc_freq"))


# ---------------------------------------------------------------------------
# Lexicon features
# ---------------------------------------------------------------------------
def lexicon_flags(lexicon: DataFrame) -> DataFrame:
    """(word, is_pos, is_neg) — a word may be in both lists."""
    return lexicon.groupBy("word").agg(
        F.max(F.col("polarity") > 0).alias("is_pos"),
        F.max(F.col("polarity") < 0).alias("is_neg"))


def lexicon_ratios(df: DataFrame, id_col: str, tokens_col: str, lexicon: DataFrame,
                   carry: list[str] | None = None) -> DataFrame:
    """pos/neg/neu/none ratios per row.

    p, n = distinct positive / negative lexicon words present, len = token
    count with duplicates.  ``carry``: per-row columns kept through the
    aggregation (functionally dependent on the id), so callers need no join
    back.  Of a lexicon of at most ``LEXICON_IN_PLACE`` words each row counts
    its own hits (``array_intersect`` with the words as scalar subqueries):
    no row per token.  With a larger one the distinct tokens are exploded and
    matched with it (broadcast behind a size check).  Rows with equal id and
    columns count together.  Empty token lists give null ratios.
    """
    carry = list(carry or [])
    flags = lexicon_flags(lexicon)
    if flags.limit(LEXICON_IN_PLACE + 1).count() <= LEXICON_IN_PLACE:
        def hits(flag: str) -> Column:
            words = flags.agg(F.collect_list(F.when(F.col(flag), F.col("word"))).alias("w")).scalar()
            return F.coalesce(F.size(F.array_intersect(F.col("_toks"), words)), F.lit(0))

        x = df.select(id_col, *carry, F.col(tokens_col).alias("_toks"))
        agg = (x.select(id_col, *carry, F.size("_toks").alias("_len"), hits("is_pos").alias("_p"), hits("is_neg").alias("_n"))
               .groupBy(id_col, *carry, "_len").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n")))
    else:
        x = df.select(id_col, *carry, F.size(tokens_col).alias("_len"),
                      F.explode_outer(F.array_distinct(tokens_col)).alias("word"))
        agg = (x.join(broadcast_if_small(flags), "word", "left")
               .groupBy(id_col, *carry, "_len")
               .agg(F.count_if(F.col("is_pos")).alias("_p"), F.count_if(F.col("is_neg")).alias("_n")))
    p, n, L = F.col("_p"), F.col("_n"), F.nullif(F.col("_len"), F.lit(0))
    return agg.select(
        id_col, *carry,
        (p / L).alias("pos_voc"),
        (n / L).alias("neg_voc"),
        F.when(p + n == 0, F.lit(0.0)).otherwise(1 - F.abs(p - n) / (p + n)).alias("neu_voc"),
        (1 - (p + n) / L).alias("none_voc"))


def sentiment_vocabulary(lexicon: DataFrame | None, discriminating: DataFrame | None) -> DataFrame:
    """(word, polarity) from lexicons and/or discriminating terms."""
    parts = []
    if lexicon is not None:
        parts.append(lexicon.select("word", F.col("polarity").cast("int")))
    if discriminating is not None:
        parts.append(discriminating.select(
            F.col("term").alias("word"),
            F.when(F.col("group") == "positive", 1).otherwise(-1).cast("int").alias("polarity")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


# ---------------------------------------------------------------------------
# Count vectors / TF-IDF
# ---------------------------------------------------------------------------
def count_vectors(terms: DataFrame, id_col: str, fit: Column, binary: bool = False) -> DataFrame:
    """V1/V2: (id, term, value) restricted to the vocabulary of the fitting
    rows (``fit``: boolean column of ``terms``, e.g. ``split = 'train'``).
    The fitting rows are in it by themselves and move nowhere; only the others
    meet the vocabulary, which is not bounded, in a shuffle semi-join (AQE
    splits hot terms)."""
    fits = F.coalesce(fit, F.lit(False))
    val = F.lit(1).cast("bigint") if binary else F.col("tf")
    out = [id_col, "term", val.alias("value")]
    vocab = terms.filter(fits).select("term").distinct()
    known = terms.filter(fits & F.col("term").isNotNull()).select(*out)
    return known.unionAll(terms.filter(~fits).join(vocab, "term", "left_semi").select(*out))


def tfidf(terms: DataFrame, id_col: str, fit: Column, n_fit_docs: Column,
          max_features: int = TFIDF_MAX_FEATURES) -> DataFrame:
    """V3: smoothed TF-IDF, vocabulary = top ``max_features`` terms by
    frequency in the fitting rows (ties: term ascending),
    ``idf = ln((1+n)/(1+df)) + 1`` with ``n = n_fit_docs`` (documents with
    no token included), raw tf, rows L2-normalised."""
    # Bounded by max_features rows: safe to broadcast.
    vocab = F.broadcast(tfidf_vocabulary(terms, fit, n_fit_docs, max_features).drop("idx"))
    w = terms.join(vocab, "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", (F.col("_w") / norm).alias("weight"))


def tfidf_vocabulary(terms: DataFrame, fit: Column, n_fit_docs: Column, max_features: int = TFIDF_MAX_FEATURES) -> DataFrame:
    """(term, idx, idf) of the ``max_features`` most frequent terms of the
    fitting rows, idx counting them from 0 (ties: term ascending)."""
    stats = (terms.filter(fit).groupBy("term")
             .agg(F.sum("tf").alias("_tot"), F.count(F.lit(1)).alias("_df"))
             .orderBy(F.desc("_tot"), F.asc("term")).limit(max_features))
    # A window over at most max_features rows.
    rank = F.row_number().over(Window.orderBy(F.desc("_tot"), F.asc("term")))
    return stats.select("term", (rank - 1).cast("int").alias("idx"), (F.log((1 + n_fit_docs) / (1 + F.col("_df"))) + 1).alias("idf"))


def tfidf_vectors(terms: DataFrame, docs: DataFrame, id_col: str, fit: Column, n_fit_docs: Column,
                  max_features: int = TFIDF_MAX_FEATURES, out: str = "features") -> DataFrame:
    """``docs`` with V3 as an ML vector: sparse, L2-normalised, of
    ``max_features`` entries; rows without a term of the vocabulary get the
    zero vector.  Entries are gathered per document from the long table; the
    vocabulary stays in the cluster."""
    vocab = F.broadcast(tfidf_vocabulary(terms, fit, n_fit_docs, max_features))
    entry = F.struct("idx", (F.col("tf") * F.col("idf")).alias("w"))
    per = (terms.join(vocab, "term").groupBy(id_col)
           .agg(F.sort_array(F.collect_list(entry)).alias("_e"), F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("_n")))
    per = per.select(id_col, F.col("_e.idx").alias("_i"), F.transform("_e", lambda e: e["w"] / F.sqrt("_n")).alias("_w"))
    d = docs.join(per, id_col, "left")
    return d.withColumn(out, sparse_vector(max_features)("_i", "_w")).drop("_i", "_w")


def sparse_vector(size: int):
    """(indices, values) -> sparse ML vector, one small call a row at the ML edge."""
    from pyspark.ml.linalg import SparseVector, VectorUDT
    return F.udf(lambda i, w: SparseVector(size, i or [], w or []), VectorUDT())


def vector_entries(col: Column) -> Column:
    """The (idx, weight) entries of a sparse ML vector."""
    parts = F.udf(lambda v: [(int(i), float(x)) for i, x in zip(v.indices, v.values)], "array<struct<idx:int,weight:double>>")
    return parts(col)


# ---------------------------------------------------------------------------
# Most discriminating terms
# ---------------------------------------------------------------------------
# ln k! for k < 10 (exact), Stirling series beyond.
_LN_FACT_SMALL = [math.lgamma(k + 1) for k in range(10)]


def log_factorial(k: Column) -> Column:
    """ln k! for integer k >= 0 as a pure column expression (Spark has no
    lgamma): exact table for k < 10, Stirling series (error < 1e-12) above."""
    kd = k.cast("double")
    stirling = (kd * F.log(kd) - kd + 0.5 * F.log(2 * math.pi * kd)
                + 1 / (12 * kd) - 1 / (360 * F.pow(kd, 3)) + 1 / (1260 * F.pow(kd, 5)))
    small = F.element_at(F.array(*[F.lit(v) for v in _LN_FACT_SMALL]), k.cast("int") + 1)
    return F.when(k < 10, small).otherwise(stirling)


def discriminating_terms(docs: DataFrame, id_col: str, tokens_col: str, group_col: str,
                         top_n: int = DISCRIMINATING_TOP_N,
                         max_terms: int = DISCRIMINATING_MAX_TERMS,
                         min_df: int = DISCRIMINATING_MIN_DF,
                         max_df: float = DISCRIMINATING_MAX_DF) -> DataFrame:
    """V5: most discriminating terms between two document groups.

    ``group_col`` is boolean (True = first group).  Candidates: terms with
    document frequency >= ``min_df`` and <= ``max_df`` of the documents, the
    ``max_terms`` most frequent (ties by term).  A term belongs to the group
    where its document share is larger (ties -> first group).  Score (log
    marginal likelihood of the 2x2 table, document-set discovery method):
    ``lnB(a+1, b+1) + lnB(A-a+1, B-b+1)``; lower = more discriminating.
    Output: the ``top_n`` terms per group (group, rank, term, a, b, score).
    """
    d = explode_rows(docs, [id_col, F.col(group_col).alias("_g")],
                     F.array_distinct(tokens_col), "term")
    # Group sizes as one scalar subquery, from one scan of the groups alone.
    sizes = docs.agg(F.struct(F.count_if(F.col(group_col)).alias("a"), F.count_if(~F.col(group_col)).alias("b")).alias("n")).scalar()
    per = (d.groupBy("term").agg(F.count_if("_g").alias("a"), F.count_if(~F.col("_g")).alias("b"))
           .withColumn("_n", sizes).select("term", "a", "b", F.col("_n.a").alias("_A"), F.col("_n.b").alias("_B")))
    tot = F.col("a") + F.col("b")
    cand = (per.filter((tot >= min_df) & (tot <= F.lit(max_df) * (F.col("_A") + F.col("_B"))))
            .orderBy(tot.desc(), F.col("term").asc()).limit(max_terms))
    a, b, A, B = F.col("a"), F.col("b"), F.col("_A"), F.col("_B")

    def ln_beta(x1: Column, x2: Column) -> Column:  # lnB(x1+1, x2+1)
        return log_factorial(x1) + log_factorial(x2) - log_factorial(x1 + x2 + 1)

    scored = cand.select(
        "term", "a", "b",
        F.when(a * B >= b * A, F.lit("positive")).otherwise(F.lit("negative")).alias("group"),
        (ln_beta(a, b) + ln_beta(A - a, B - b)).alias("score"))
    w = Window.partitionBy("group").orderBy(F.asc("score"), F.asc("term"))
    return (scored.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= top_n))


# ---------------------------------------------------------------------------
# Embeddings
# ---------------------------------------------------------------------------
def mean_embedding(df: DataFrame, key_cols: list[str], vec_col: str) -> DataFrame:
    """V6: element-wise mean vector per key (long: key, dim, mean)."""
    x = df.select(*key_cols, F.posexplode(vec_col).alias("dim", "_v"))
    return x.groupBy(*key_cols, "dim").agg(F.avg("_v").alias("mean"))


def least_frequency(freq: DataFrame, keys: int) -> int:
    """The least n of (key, n) that at most ``keys`` keys reach (the table of
    how many keys have which n goes to the driver, some thousand rows)."""
    least, held = None, 0
    for n, count in sorted(map(tuple, freq.groupBy("n").agg(F.count(F.lit(1))).collect()), reverse=True):
        held += count
        if held > keys:
            return least if least is not None else n + 1
        least = n
    return least or 1


def document_embedding(terms: DataFrame, docs: DataFrame, id_col: str, vectors: DataFrame,
                       dims: int | None = None) -> DataFrame:
    """V6 (word vectors): ``docs`` with ``embedding``, the mean of the vectors
    of the document's tokens, and ``n_tokens``, how many tokens had one.

    ``terms``: (id, term, tf); ``vectors``: (word, vector) of ``dims`` values
    (counted if not given).  The most frequent terms, as many as
    ``EMBEDDING_HOT_VALUES`` values allow, meet their vectors in a broadcast
    and are summed where the documents lie; the other pairs are joined by term
    and each moves once with its vector, as it was given, to its document.
    Sums are plain columns (one hash aggregate), so no pair waits in a sort.
    Documents without a known token keep their id, with a null embedding.
    """
    v = vectors.select(F.col("word").alias("term"), "vector").dropDuplicates(["term"]).filter("vector IS NOT NULL")
    if dims is None:
        dims = v.agg(F.max(F.size("vector"))).first()[0] or 0
    freq = stored(terms.filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-frequencies")
    least = least_frequency(freq, EMBEDDING_HOT_VALUES // max(dims, 1))
    top = F.broadcast(freq.filter(F.col("n") >= least).select("term"))
    pairs = terms.select(id_col, "term", "tf")
    hot = pairs.join(F.broadcast(v.join(top, "term", "left_semi")), "term")
    cold = (pairs.join(top, "term", "left_anti").join(v.join(top, "term", "left_anti"), "term")
            .select(id_col, "tf", "vector").repartition(id_col))

    def sums(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(id_col).agg(F.sum("tf").cast("long").alias("n_tokens"), *[
            F.sum(F.get("vector", F.lit(i)).cast("double") * F.col("tf")).alias(f"_s{i}") for i in range(dims)])

    both = sums(hot).unionByName(sums(cold)).groupBy(id_col).agg(
        F.sum("n_tokens").alias("n_tokens"), *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(dims)])
    per = both.select(id_col, F.array(*[F.col(f"_s{i}") / F.col("n_tokens") for i in range(dims)]).cast("array<double>")
                      .alias("embedding"), "n_tokens")
    return docs.join(per, id_col, "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("long")))


def lexicon_coverage(terms: DataFrame, lexicon: DataFrame, discriminating: DataFrame) -> DataFrame:
    """Per polarity (1, -1), distinct lexicon words, those found in the
    corpus, discriminating terms of that polarity and those of them that the
    lexicon lists under neither polarity."""
    words = lexicon.select("word", F.signum(F.col("polarity").cast("double")).cast("int").alias("polarity")).distinct()
    disc = discriminating.select(F.col("term").alias("word"),
                                 F.when(F.col("group") == "positive", 1).otherwise(-1).alias("polarity")).distinct()
    every = words.select("word").distinct()
    hits = every.join(terms.select(F.col("term").alias("word")), "word", "left_semi").withColumn("_hit", F.lit(True))
    lex = words.join(hits, "word", "left").groupBy("polarity").agg(
        F.count(F.lit(1)).alias("lexicon_words"), F.count("_hit").alias("lexicon_hits"))
    new = disc.join(every.withColumn("_known", F.lit(True)), "word", "left").groupBy("polarity").agg(
        F.count(F.lit(1)).alias("discriminating_terms"),
        F.count_if(F.col("_known").isNull()).alias("discriminating_not_in_lexicon"))
    both = lexicon.sparkSession.range(2).select(F.when(F.col("id") == 0, 1).otherwise(-1).alias("polarity"))
    counts = ["lexicon_words", "lexicon_hits", "discriminating_terms", "discriminating_not_in_lexicon"]
    return both.join(lex, "polarity", "left").join(new, "polarity", "left").na.fill(0, counts).select("polarity", *counts)
