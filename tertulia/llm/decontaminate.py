"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are token sequences (lower-cased runs of letters
and digits).  A document that shares a seed, ``MIN_MATCH`` tokens in a row,
with an item is tiled against it: running Karp-Rabin hashes find the common
stretches, the longest is marked first, later ones may use unmarked tokens
only, and stretches cut short are tried again at their new length.  The share
of an item's tokens under tiles of ``MIN_MATCH`` or more is its coverage; an
item covered to ``COVERAGE`` or more contaminates the document, in whatever
order its passages stand.

An item of fewer than ``MIN_MATCH`` tokens matches where all of it stands.

Scale: one pass over the documents for each block of benchmark items, without
a shuffle.  A block goes to the tasks whole; its size is bounded by
``BLOCK_CHARS``, and a larger benchmark takes more blocks, of which the driver
holds one at a time.  Common seeds are found as runs on diagonals with numpy,
in pieces of ``PAIRS``, so a repetitive text costs its product with an item in
array operations, not in Python steps, and bounded memory.

Defined results: null or empty text, and items of fewer than ``MIN_ITEM``
tokens (a single common word would strike out the corpus), match nothing; rows
that repeat an item count as items of their own; every (document row, item row)
pair is judged by itself; long texts are tiled whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_MATCH = 5
MIN_ITEM = 3
COVERAGE = 0.6
BLOCK_CHARS = 16_000_000
#: Common seeds of a document and an item that are held at a time.
PAIRS = 4_000_000
TOKEN = re.compile(r"[^\W_]+")
MATCH_TYPE = ("array<struct<item_id: bigint, coverage: double, n_matched: bigint, n_tokens: bigint, "
              "n_tiles: bigint, longest: bigint>>")
MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_matched", pa.int64()),
                                  ("n_tokens", pa.int64()), ("n_tiles", pa.int64()), ("longest", pa.int64())]))
#: Base of the rolling hash, modulo 2**64 (odd, so that no token is shifted out).
BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all n-grams of token numbers, modulo 2**64."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * BASE + ids[k:len(ids) - n + 1 + k]
    return h


class Block:
    """Seeds and token numbers of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.n, self.vocab, self.items = min_match, {}, []
        seeds: dict[int, list[tuple[np.ndarray, int]]] = {}  # by seed length: MIN_MATCH, or a short item's length
        for item_id, text in items:
            words = TOKEN.findall((text or "").lower())
            if len(words) >= min(MIN_ITEM, min_match):
                q = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.uint64)
                n = min(min_match, len(q))
                seeds.setdefault(n, []).append((rolling(q, n), len(self.items)))
                self.items.append((item_id, q))
        self.seeds = {}
        for n, held in seeds.items():
            h = np.concatenate([x for x, _ in held])
            order = np.argsort(h, kind="stable")
            self.seeds[n] = (h[order], np.concatenate([np.full(len(x), k) for x, k in held])[order])

    def matches(self, text: str | None) -> list[dict]:
        if not text or not self.seeds:
            return []
        get = self.vocab.get
        d = np.array([get(w, 0) for w in TOKEN.findall(text.lower())], np.uint64)
        out = []
        for n, (seeds, items) in self.seeds.items():
            h = rolling(d, n)
            if not len(h):
                continue
            lo = np.searchsorted(seeds, h, "left")
            at = np.flatnonzero(seeds[np.minimum(lo, len(seeds) - 1)] == h)
            if not len(at):
                continue
            shared = np.unique(h[at])
            first, last = np.searchsorted(seeds, shared, "left"), np.searchsorted(seeds, shared, "right")
            near = np.unique(np.concatenate([items[a:b] for a, b in zip(first.tolist(), last.tolist())]))
            for k in near.tolist():
                item_id, q = self.items[k]
                tiles = tile(q, d, n, at, h)
                if tiles:
                    size = sum(tiles)
                    out.append({"item_id": item_id, "coverage": size / len(q), "n_matched": size, "n_tokens": len(q),
                                "n_tiles": len(tiles), "longest": max(tiles)})
        return out


def stretches(q: np.ndarray, d: np.ndarray, n: int, at: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, length) of the maximal stretches of ``n`` or more tokens that q has
    from i and d from j; ``at``: the places in d, in order, whose hash ``h`` may be a seed's."""
    own = rolling(q, n)
    order = np.argsort(own, kind="stable")
    own = own[order]
    lo, hi = np.searchsorted(own, h[at], "left"), np.searchsorted(own, h[at], "right")
    at, lo, many = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    found: list[tuple[np.ndarray, ...]] = []
    cuts = np.searchsorted(np.cumsum(many), np.arange(PAIRS, many.sum() + PAIRS, PAIRS), "right") if len(many) else []
    start = 0
    for stop in [*cuts, len(many)]:
        stop = min(max(int(stop), start + 1), len(many))
        if stop <= start:
            continue
        m = many[start:stop]
        j = np.repeat(at[start:stop], m)
        i = order[np.repeat(lo[start:stop] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        same = np.ones(len(i), bool)
        for k in range(n):  # equal hashes need not be equal tokens
            same &= q[i + k] == d[j + k]
        i, j = i[same], j[same]
        by = np.lexsort((i, j - i))
        i, j = i[by], j[by]
        new = np.ones(len(i), bool)
        new[1:] = (np.diff(j - i) != 0) | (np.diff(i) != 1)
        heads = np.flatnonzero(new)
        found.append((i[heads], j[heads], np.diff(np.append(heads, len(i)))))
        start = stop
    if not found:
        return []
    i, j, k = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((i, j - i))
    out: list[list[int]] = []
    for a, b, c in zip(i[by].tolist(), j[by].tolist(), k[by].tolist()):
        if out and out[-1][1] - out[-1][0] == b - a and out[-1][0] + out[-1][2] == a:
            out[-1][2] += c  # cut by the pieces
        else:
            out.append([a, b, c])
    return [(a, b, c + n - 1) for a, b, c in out]


def tile(q: np.ndarray, d: np.ndarray, n: int, at: np.ndarray, h: np.ndarray) -> list[int]:
    """Lengths of the tiles that greedy string tiling lays, longest first
    (ties: smaller item position, then smaller document position)."""
    heap = [(-length, i, j) for i, j, length in stretches(q, d, n, at, h)]
    heapify(heap)
    in_q, in_d, tiles = np.zeros(len(q), bool), np.zeros(len(d), bool), []
    while heap:
        size, i, j = heappop(heap)
        marked = in_q[i:i - size] | in_d[j:j - size]
        if not marked.any():
            in_q[i:i - size] = in_d[j:j - size] = True
            tiles.append(-size)
            if in_q.all():
                break
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([1], marked.view(np.int8), [1]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= n:
                heappush(heap, (a - b, i + a, j + a))
    return tiles


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``block_chars`` at most, one at a time.
    More than one block: the rows are numbered in a written table and dealt by number."""
    b = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = b.agg(F.coalesce(F.sum(F.length("text") + 8), F.lit(0))).first()[0]
    if size <= block_chars:
        yield [tuple(r) for r in b.collect()]
        return
    n = -(-2 * size // block_chars)
    b = stored(b.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))), "benchmark-blocks")
    for k in range(n):
        yield [tuple(r) for r in b.filter(F.col("part") == k).select("item_id", "text").collect()]


def matches_column(text: Column, items: list[tuple[int, str]], min_match: int = MIN_MATCH) -> Column:
    """Each text's tiled items of a block: array<struct<item_id, coverage, n_matched, n_tokens, n_tiles, longest>>."""
    @F.arrow_udf(MATCH_TYPE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = Block(items, min_match)
        for texts in batches:
            yield pa.array([block.matches(t) for t in texts.to_pylist()], MATCH_ARROW)

    return run(text)


def _by_block(benchmark: DataFrame, block_chars: int):
    """(items, whether another block follows)."""
    blocks = item_blocks(benchmark, block_chars)
    items = next(blocks)
    for following in blocks:
        yield items, True
        items = following
    yield items, False


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH,
                 coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item that contaminates it."""
    out = None
    for items, more in _by_block(benchmark, block_chars):
        m = docs.select("doc_id", matches_column(F.col("text"), items, min_match).alias("m"))
        m = (m.select("doc_id", F.inline_outer(F.filter("m", lambda x: x["coverage"] >= coverage)))
             .filter(F.col("item_id").isNotNull() | F.col("coverage").isNotNull()))
        # With several blocks each pass is written, so that the driver need not keep its items.
        m = stored(m, "contaminated") if more or out is not None else m
        out = m if out is None else out.unionAll(m)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH,
                  coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the documents that an item contaminates."""
    for items, more in _by_block(benchmark, block_chars):
        m = matches_column(F.col("text"), items, min_match)
        docs = docs.filter(~F.exists(m, lambda x: x["coverage"] >= coverage))
        docs = stored(docs, "decontaminated") if more else docs
    return docs
