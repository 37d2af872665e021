"""Removal of passages that repeat, wherever in a line they begin and end.

A word is a run of characters other than ASCII white space.  In each run of
``SPAN`` - ``SIZE`` + 1 words that can start a window, the word of the smallest
hash (the first one of these) starts a window of ``SIZE`` words.  Which words
start windows depends on nothing but the words around them, so two documents
that share ``SPAN`` words share a window, and no shared run of ``SPAN`` words is
left.  A window that occurs more than once keeps its first occurrence in the
order of (doc_id, text hash, position), null ids last; the words of all later
ones are removed.

The windows (about two of ``SPAN`` - ``SIZE`` words start one) are computed once,
with numpy over batches of texts, and written as numbers: the row's key, its id
and text hash, the position and the window's two hashes.  The first place of
each window comes from a partial aggregate, so one that many documents share
moves once a task; its other places meet that by ``heavy_join``, which broadcasts
the places of the most frequent windows.  Texts move at most once, to be rewritten.

Defined results: null text stays null; a text of fewer than ``SIZE`` words is
left alone; rows that repeat a (doc_id, text) pair count as one document and
get the same result; the white-space character after a word goes with it; very
long texts are taken in pieces that share ``SPAN`` - 1 words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import heavy_join
from .common import keyed, short, stored
from .shingles import _hash_spans

SIZE = 25
SPAN = 50
PIECE = 1 << 16
#: Rows and starts of windows that may be broadcast for the rewriting.
FEW_ROWS, FEW_STARTS = 200_000, 1_000_000
_BLANK = r"[\x20\x09-\x0D]"
KEY = ["_f", "_i"]
_ODD = np.uint64(0x9FB21C651E98DF25)


def _words(text: Column) -> Column:
    """The words, each with one white-space character after it; further ones go with the next word."""
    return F.split(text, rf"(?<=[^\x20\x09-\x0D]{_BLANK})(?={_BLANK}*+[^\x20\x09-\x0D])", -1)


def _sums_of_runs(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """A second hash of the ``size`` word hashes from ``first`` on."""
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        x = h[first + k] ^ (h[first + k] >> np.uint64(31))
        out = (out ^ x) * _ODD
        out ^= out >> np.uint64(29)
    return out


def window_starts(words: list[bytes], size: int = SIZE, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, other hash) of the windows of a text, its words in order."""
    none = np.zeros(0, np.int64)
    if len(words) < size:
        return none, none.view(np.uint64), none.view(np.uint64)
    at, found = 0, ([], [], [])
    while True:
        part = words[at:at + PIECE]
        n = len(part)
        each = np.arange(n)
        h = _hash_spans(part, each, each)
        reach = min(span - size + 1, n - size + 1)
        runs = np.lib.stride_tricks.sliding_window_view(h[:n - size + 1], reach)
        first = np.unique(runs.argmin(1) + np.arange(len(runs)))
        found[0].append(first + at)
        found[1].append(_hash_spans(part, first, first + size - 1))
        found[2].append(_sums_of_runs(h, first, size))
        if at + n >= len(words):
            break
        at += n - span + 1
    p, one, two = map(np.concatenate, found)
    p, where = np.unique(p, return_index=True)
    return p, one[where], two[where]


WINDOWS = "_f long, _i long, _id long, _t long, _p int, _h1 long, _h2 long"


def _windows_of(size: int, span: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [window_starts(t.encode("utf-8", "surrogatepass").split() if t else [], size, span)
                 for t in b["text"].to_pylist()]
        reps = np.array([len(f[0]) for f in found], np.int64)
        if not reps.sum():
            continue
        rows = pa.array(np.repeat(np.arange(len(found)), reps))
        p, one, two = (np.concatenate([f[k] for f in found]) for k in range(3))
        yield pa.record_batch([*(b[c].take(rows) for c in ("_f", "_i", "_id", "_t")), pa.array(p.astype(np.int32)),
                               pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                              names=["_f", "_i", "_id", "_t", "_p", "_h1", "_h2"])


def windows(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, span: int = SPAN) -> DataFrame:
    """The windows of ``rows`` (with keys, see ``keyed``) as a written table."""
    d = rows.select(*KEY, F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("text"))
    return stored(d.mapInArrow(functools.partial(_windows_of, size, span), WINDOWS), "passage-windows")


def repeated_passages(wins: DataFrame) -> DataFrame:
    """(_f, _i, _starts): per row the positions of windows that stand in an earlier place, too."""
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_t").alias("t"), F.col("_p").alias("p"))
    wins = wins.withColumn("_h", F.struct("_h1", "_h2")).drop("_h1", "_h2")
    first = stored(wins.groupBy("_h").agg(F.min(place).alias("_first"), F.max(place).alias("_last"), F.count("*").alias("n"))
                   .filter(F.col("_first") != F.col("_last")).drop("_last"), "passage-first")
    met = heavy_join(wins, first.select("_h", "_first"), "_h", first.select("_h", "n"))
    later = met.filter(place != F.col("_first"))
    return later.groupBy(*KEY).agg(F.sort_array(F.collect_list("_p")).alias("_starts"))


def without_passages(rows: DataFrame, changes: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``rows`` less their passages and with ``n_gone``, the number of words removed.  ``changes``: (_f, _i,
    _starts), a null list for rows that go altogether."""
    changes = stored(changes.select(*KEY, "_starts", F.lit(True).alias("_changed")), "passage-changes")
    n = changes.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("_starts")).alias("starts")).first()
    few = n["rows"] <= FEW_ROWS and (n["starts"] or 0) <= FEW_STARTS
    columns = [c for c in rows.columns if c not in ("n_gone", *KEY)]
    j = rows.select(*KEY, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    j = j.join(F.broadcast(changes) if few else changes, KEY, "left").filter("_changed IS NULL OR _starts IS NOT NULL")
    text = F.col(f"c{columns.index(text_col)}")
    j = j.withColumn("_gone", F.array_distinct(F.flatten(F.transform("_starts", lambda p: F.sequence(p, p + (size - 1))))))

    def rest(words: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(words) - 1), F.col("_gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(words, i)), "")

    left = F.transform(F.array(_words(text)), rest)[0]
    cols = [F.when(F.col("_gone").isNull(), text).otherwise(left) if c == text_col else F.col(f"c{i}")
            for i, c in enumerate(columns)]
    return j.select(*[x.alias(c) for x, c in zip(cols, columns)],
                    F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_gone"))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   size: int = SIZE, span: int = SPAN) -> DataFrame:
    """``docs`` with the text less its repeated passages, and ``n_gone``, the
    number of words removed."""
    rows = keyed(docs)
    gone = repeated_passages(windows(rows, id_col, text_col, size, span))
    return without_passages(rows, gone, text_col, size)


def one_of_each_without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, and those less their repeated passages (``n_gone``
    words).  Both steps mark rows by their keys; the texts move once at most."""
    from .ngram_join import repeats
    rows = keyed(docs)
    gone = repeats(rows)
    left = windows(rows).join(short(gone), KEY, "left_anti")
    changes = repeated_passages(left).unionByName(gone.select(*KEY, F.lit(None).cast("array<int>").alias("_starts")))
    return without_passages(rows, changes)
