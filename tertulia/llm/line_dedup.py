"""Line dedup over overlapping windows of lines (DataFrame functions only).

A line is what stands between two ``\\n``; lines that hold only white space
are carried along and belong to no window.  Each run of ``window`` consecutive
(non-blank) lines of a document is hashed to 128 bits.  A window that occurs
more than once in the corpus keeps its first occurrence, in the order of
(doc_id, position), null ids last; the lines of all later occurrences are
removed, overlapping occurrences being merged into one covered stretch.

Only (document, position, hash) triples are shuffled by hash.  Windows are
counted with map-side partial aggregation, and the repeated ones meet their
occurrences in a join with one row per hash on one side, so a window that a
third of all documents share is split by the skew-join rule.

Defined results: null text stays null and has no lines; a text of fewer than
``window`` lines is left alone; rows that repeat a (doc_id, text) pair count
as one document and get the same result; other columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(line: Column) -> Column:
    return F.length(F.trim(F.translate(line, "\t\r\x0b\x0c", "    "))) > 0


def _row_key(id_col: str, text_col: str) -> list[Column]:
    t = F.coalesce(F.col(text_col), F.lit("\x00"))
    return [F.col(id_col).alias("_id"), F.xxhash64(t).alias("_t1"), F.xxhash64(t, F.lit(7)).alias("_t2")]


KEY = ["_id", "_t1", "_t2"]


def _windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(_id, _t1, _t2, _p, _h1, _h2): every window, _p counting non-blank lines from 0."""
    hashed = F.transform(F.filter(_lines(F.col(text_col)), _filled),
                         lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(7)).alias("b")))
    h = docs.select(*_row_key(id_col, text_col), hashed.alias("_h"))

    def at(i: Column, k: int, half: str) -> Column:
        return F.get(F.col("_h"), i + k)[half]

    starts = F.when(F.size("_h") >= window, F.sequence(F.lit(0), F.size("_h") - window))
    wins = F.transform(starts, lambda i: F.struct(
        i.alias("_p"),
        F.xxhash64(*[at(i, k, "a") for k in range(window)]).alias("_h1"),
        F.xxhash64(*[at(i, k, "b") for k in range(window)], F.lit(7)).alias("_h2")))
    # The outer form keeps Catalyst from evaluating the array twice for an inferred filter.
    return h.select(*KEY, F.inline_outer(wins)).filter(F.col("_p").isNotNull())


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """(_id, _t1, _t2, _gone): per document the covered positions among its non-blank lines."""
    w = _windows(docs, id_col, text_col, window)
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_t1").alias("t1"),
                     F.col("_t2").alias("t2"), F.col("_p").alias("p"))
    first = (w.groupBy("_h1", "_h2")
             .agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
             .filter(F.col("_first") != F.col("_last")).drop("_last"))
    later = w.join(first, ["_h1", "_h2"]).filter(place != F.col("_first"))
    return (later.groupBy(*KEY).agg(F.collect_set("_p").alias("_starts"))
            .select(*KEY, F.array_distinct(F.flatten(F.transform(
                "_starts", lambda p: F.sequence(p, p + (window - 1))))).alias("_gone")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                window: int = WINDOW) -> DataFrame:
    """``docs`` with the text less its repeated lines, and ``n_lines`` /
    ``n_removed`` (non-blank lines before, and how many of them went; input
    columns of these names are replaced).  A text that loses lines loses its
    blank lines too."""
    carried = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = repeated_lines(docs, id_col, text_col, window)
    docs = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)],
                       *[c.alias(f"k{i}") for i, c in enumerate(_row_key(id_col, text_col))])
    j = docs.join(gone, [F.col("k0").eqNullSafe(F.col("_id")), F.col("k1") == F.col("_t1"),
                         F.col("k2") == F.col("_t2")], "left")
    text = F.col(f"c{carried.index(text_col)}")

    def rest(body: Column) -> Column:
        # A lambda argument is evaluated once, a column inside a lambda once per element.
        kept = F.array_except(F.sequence(F.lit(0), F.size(body) - 1), F.col("_gone"))
        joined = F.array_join(F.transform(kept, lambda i: F.get(body, i)), "\n")
        return F.struct(F.size(body).cast("long").alias("n"),
                        F.when(F.col("_gone").isNull(), text).otherwise(joined).alias("t"))

    out = F.transform(F.array(F.filter(_lines(F.coalesce(text, F.lit(""))), _filled)), rest)[0]
    j = j.select("*", out.alias("_out"))
    cols = [F.col("_out.t") if c == text_col else F.col(f"c{i}") for i, c in enumerate(carried)]
    return j.select(*[x.alias(c) for x, c in zip(cols, carried)], F.col("_out.n").alias("n_lines"),
                    F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
