"""N-gram Jaccard join with signature trees.

Documents are sets of 5-word shingles; two link when their Jaccard similarity
is ``SIMILARITY`` or more.  The result is exact: each document's component.

1. Equal sets are one class (a node of the join), so copies meet only once.
2. Two sets that link share one of the rarest tokens of each, whatever order
   ranks tokens (a set of n needs n - ceil(0.75 n) + 1 of them).  The order
   here is the hash, after which come tokens found frequent inside a batch of
   documents, by their count; it decides how much work there is, not the result.
3. The nodes that share such a token form a group; groups with equal members
   are kept once.  Crowded groups are dealt to parts of ``PART`` nodes.
4. In each group the nodes are the leaves of a signature tree: a node of it has
   the OR of the bitmaps below and their range of sizes.  A dual traversal
   drops the pairs of tree nodes that cannot hold enough common tokens
   (bits in common and tokens that share a bit, against the least size sum).
5. In the first ``ROUNDS`` rounds the traversal gives each node its most
   promising partner outside its component (all parts of a group get one node
   in common), enough to join near copies without pairing them all; the links
   that hold are joined to components.  Then it runs once more in the groups
   whose nodes are in several components, part against part, and gives all
   remaining pairs across them that share enough rare tokens.  Candidates are
   always verified on the whole sets.

What is shuffled: (token, node) pairs, the bitmaps of nodes that share a rare
token, and the sets of candidates.  The only lists at the driver are the
frequent tokens that shape the order (``FREQUENT_TOKENS`` at most; more of them
would change nothing in the result).

Defined results: null text and text without words have no shingles and link
with nothing; fewer than five words make one shingle; rows that repeat an id
are documents of their own; ``component_id`` is the smallest non-null id of
the component (null if there is none).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import cut, keyed, short, stored
from .components import components
from .shingles import shingle_sets

SIMILARITY = (3, 4)  # 0.75
BITS = 1024
LONGS = BITS // 64
PART = 1024
ROUNDS = 2
FANOUT = 16
FREQUENT_BATCH = 2_000_000
FREQUENT_TIMES = 8
FREQUENT_TOKENS = 200_000
NODE_ROWS = 2_000_000  # ids that may be broadcast
#: Two nodes, what the traversal says of them, their sizes and an id of each.
PAIR = {"u": "long", "v": "long", "x": "double", "n": "long", "m": "long", "a": "long", "b": "long"}


def _node(s: np.ndarray) -> int:
    import xxhash
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def _texts(batch: pa.RecordBatch, step: int = 1000) -> Iterator[tuple[int, list]]:
    for at in range(0, batch.num_rows, step):
        yield at, shingle_sets(batch["text"].slice(at, step).to_pylist())


def frequent_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of FREQUENT_TIMES sets or more in a batch, and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held or [np.empty(0, np.uint64)]), return_counts=True)
            held.clear()
            seen.clear()
            many = n >= FREQUENT_TIMES
            return pa.record_batch([pa.array(t[many].view(np.int64)), pa.array(n[many])], ["token", "n"])

        for b in batches:
            for _, sets in _texts(b):
                for s in sets:
                    if (key := s.tobytes()[:256]) not in seen:
                        seen.add(key)
                        held.append(s)
                        size += len(s)
                if size > FREQUENT_BATCH:
                    yield flush()
                    size = 0
        yield flush()

    rows = (docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
            .orderBy(F.col("n").desc(), "token").limit(FREQUENT_TOKENS).collect())
    token = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.array([r["n"] for r in rows], np.uint64)[order]


def rarest(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The tokens of a sorted set of which a set that links with it holds one."""
    token, count = frequent
    key = s >> np.uint64(1)
    if len(token):
        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
        often = token[at] == s
        key = np.where(often, np.uint64(1 << 63) | np.minimum(count[at], np.uint64((1 << 30) - 1)) << np.uint64(33)
                       | s >> np.uint64(31), key)
    n, (a, b) = len(s), SIMILARITY
    return s[np.argsort(key, kind="stable")[:n + (-n * a // b) + 1]]


def bitmap(s: np.ndarray, bits: int = BITS) -> bytes:
    flags = np.zeros(bits, np.uint8)
    flags[(s >> np.uint64(20)) & np.uint64(bits - 1)] = 1
    return np.packbits(flags).tobytes()


def shingled(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, node, n, bits) of each row, and the long columns ``carry``; null node and bits without shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, sets in _texts(b):
                yield pa.record_batch(
                    [b["doc_id"].slice(at, len(sets)),
                     pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                     *(b[c].slice(at, len(sets)) for c in carry)],
                    ["doc_id", "node", "n", "bits", *carry])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).mapInArrow(
        run, ", ".join(["doc_id long, node long, n long, bits binary", *(f"{c} long" for c in carry)]))


def rare_pairs(docs: DataFrame, frequent) -> DataFrame:
    """(token, node): the rarest tokens of every document's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, sets in _texts(b):
                rare = [(rarest(s, frequent), _node(s)) for s in sets if len(s)]
                if rare:
                    yield pa.record_batch(
                        [pa.array(np.concatenate([t for t, _ in rare]).view(np.int64)),
                         pa.array(np.repeat(np.array([n for _, n in rare], np.int64), [len(t) for t, _ in rare]))],
                        ["token", "node"])

    return docs.select("text").mapInArrow(run, "token long, node long")


def token_groups(docs: DataFrame) -> DataFrame:
    """(token, node, weight, k): nodes by the rare tokens they share; groups of
    equal members stand once, with the number of their tokens.  k: parts."""
    same = W.partitionBy("token")  # one shuffle of the pairs, where a join with the shared tokens would take two
    p = stored(rare_pairs(docs, frequent_tokens(docs))
               .select("*", (F.min("node").over(same) != F.max("node").over(same)).alias("shared"))
               .filter("shared").select("token", "node").distinct(), "ngram-pairs")
    members = p.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                     F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"))
    once = (members.groupBy("m", "x", "y").agg(F.min("token").alias("token"), F.count("*").alias("weight"))
            .select("token", "weight", F.ceil(F.col("m") / PART).cast("long").alias("k")))
    return stored(p.join(once, "token"), "ngram-groups")


class Tree:
    """A signature tree over leaves in order of size; level 0 is the leaves."""

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        spare = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, n, n, spare)]  # bitmaps, least and largest size, most tokens that share a bit
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, extra = self.levels[-1]
            cuts = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, cuts), np.minimum.reduceat(lo, cuts),
                                np.maximum.reduceat(hi, cuts), np.maximum.reduceat(extra, cuts)))


def possible(x, y, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of tree nodes: the largest overlap there can be, and whether it is enough."""
    top = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
        top[at:at + (1 << 16)] = np.bitwise_count(x[0][a] & y[0][b]).sum(1, dtype=np.int64)
    top += np.minimum(x[3][i], y[3][j])
    top = np.minimum(top, np.minimum(x[2][i], y[2][j]))
    a, b = SIMILARITY  # overlap >= a / (a + b) of the sizes' sum
    return top, top * (a + b) >= a * (x[1][i] + y[1][j])


def traverse(x: Tree, y: Tree | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf pairs (i, j, largest overlap) that may link: of x and y, or i < j of x alone."""
    other, up = (x if y is None else y), len(x.levels) - 1
    down = len(other.levels) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        top, ok = possible(x.levels[up], other.levels[down], i, j)
        i, j, top = i[ok], j[ok], top[ok]
        if up == 0 and down == 0:
            keep = i < j if y is None else np.ones(len(i), bool)
            return i[keep], j[keep], top[keep]
        if up >= down:
            up, i, j = up - 1, *_expand(i, j, len(x.levels[up - 1][0]))
        if down > up or y is None:
            down, (j, i) = down - 1, _expand(j, i, len(other.levels[down - 1][0]))
        if y is None:
            keep = i <= j
            i, j = i[keep], j[keep]


def _expand(parent: np.ndarray, fixed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    child = (parent[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    fixed = np.repeat(fixed, FANOUT)
    real = child < n
    return child[real], fixed[real]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by ``keys``, one at a time."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        t = t.combine_chunks()
        key = np.stack([t[k].to_numpy() for k in keys], 1)
        if not len(key):
            continue
        edges = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        bounds = [0, *edges.tolist()]
        for lo, hi in zip(bounds, bounds[1:]):
            yield t.slice(lo, hi - lo)
        held = t.slice(bounds[-1])
    if held is not None and len(held):
        yield held


def _leaves(group: pa.Table) -> tuple[np.ndarray, np.ndarray, Tree]:
    """The leaves (node, n, doc) in the order of their tree, their labels and the tree."""
    n, node = group["n"].to_numpy(), group["node"].to_numpy()
    bits = np.frombuffer(b"".join(group["bits"].to_pylist()), np.uint64).reshape(len(n), LONGS)
    order = np.lexsort((node, *bits.T[:2], n))
    leaves = np.stack([node, n, group["doc"].to_numpy()], 1)[order]
    return leaves, group["label"].to_numpy()[order], Tree(n[order], bits[order])


def _pairs(first: np.ndarray, second: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """The columns of ``PAIR`` for leaves side by side."""
    (u, n, a), (v, m, b) = first.T, second.T
    return [u, v, x, n, m, a, b]


def _by_group(rows: DataFrame, keys: list[str], pairs: Callable) -> DataFrame:
    """The ``PAIR`` rows that ``pairs`` gives for the groups of ``rows``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in _groups(batches, keys):
            found = pairs(group)
            if len(found[0]):
                held.append(found)
                size += len(found[0])
            if size > 200_000:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*held)], list(PAIR))
                held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*held)], list(PAIR))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        run, ", ".join(f"{c} {kind}" for c, kind in PAIR.items()))


def _partners(group: pa.Table) -> list[np.ndarray]:
    """Each node v and the node u of another component with which it may overlap most."""
    leaves, label, tree = _leaves(group)
    i, j, top = traverse(tree, None)
    ok = label[i] != label[j]
    i, j, top = i[ok], j[ok], top[ok]
    n = leaves[:, 1]
    share = np.tile(top / (n[i] + n[j]), 2)
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((i, -share, j))
    first = np.ones(len(order), bool)
    first[1:] = j[order][1:] != j[order][:-1]
    best = order[first]
    return _pairs(leaves[i[best]], leaves[j[best]], share[best])


def _across(group: pa.Table) -> list[np.ndarray]:
    """All pairs that may link of nodes in different components, u < v."""
    side = group["side"].to_numpy()
    if group["i"][0].as_py() == group["j"][0].as_py():
        one, label, tree = _leaves(group)
        two, other, j_tree = one, label, None
    elif side.min() == side.max():
        return _pairs(np.empty((0, 3), np.int64), np.empty((0, 3), np.int64), np.empty(0))
    else:
        (one, label, tree), (two, other, j_tree) = (_leaves(group.filter(pa.array(side == s))) for s in (0, 1))
    i, j, _ = traverse(tree, j_tree)
    ok = label[i] != other[j]
    x, y = one[i[ok]], two[j[ok]]
    swap = (x[:, 0] > y[:, 0])[:, None]
    return _pairs(np.where(swap, y, x), np.where(swap, x, y), np.full(len(x), float(group["weight"][0].as_py())))


def _of_nodes(docs: DataFrame, pairs: DataFrame, column: str, make: Callable, kind: str) -> DataFrame:
    """(node, ``column``) for the nodes of ``pairs``: what ``make`` gives for the
    sets, from one text each.  A text whose id stands in several rows may come twice."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    few = ids.count() <= NODE_ROWS
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    t = (t.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text")
         .unionAll(t.filter(F.col("doc_id").isNull()).select("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, sets in _texts(b, 200):
                sets = [s for s in sets if len(s)]
                if sets:
                    yield pa.record_batch([pa.array([_node(s) for s in sets], pa.int64()), make(sets)],
                                          ["node", column])

    return t.mapInArrow(run, f"node long, {column} {kind}")


def _wide(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([bitmap(s, 1 << (8 * len(s)).bit_length()) for s in sets], pa.binary())


def _whole(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))


@F.arrow_udf(T.BooleanType())
def may_link(x: pa.Array, n: pa.Array, y: pa.Array, m: pa.Array) -> pa.Array:
    """Whether sets of n and m tokens may link by their wide bitmaps (the wider is folded)."""
    a, b = SIMILARITY
    out = []
    for p, n_p, q, n_q in zip(x.to_pylist(), n.to_pylist(), y.to_pylist(), m.to_pylist()):
        p, q = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
        width = min(len(p), len(q))
        p, q = (np.bitwise_or.reduce(z.reshape(-1, width), 0) for z in (p, q))
        spare = min(n_p - int(np.bitwise_count(p).sum()), n_q - int(np.bitwise_count(q).sum()))
        out.append((int(np.bitwise_count(p & q).sum()) + spare) * (a + b) >= a * (n_p + n_q))
    return pa.array(out, pa.bool_())


def verified(pairs: DataFrame, docs: DataFrame, wide: bool) -> DataFrame:
    """The (u, v) of the materialised ``pairs`` whose whole sets are similar
    enough.  ``wide``: wide bitmaps, a byte for each token, first rule most
    others out, which pays where few of the pairs are expected to link."""
    def both(p: DataFrame, column: str, make: Callable, kind: str) -> DataFrame:
        d = _of_nodes(docs, p, column, make, kind)
        return (p.join(d.select(F.col("node").alias("u"), F.col(column).alias("x")), "u")
                .join(d.select(F.col("node").alias("v"), F.col(column).alias("y")), "v"))

    p = pairs.select("u", "v", "n", "m", "a", "b")
    if wide:
        p = cut(both(p, "wide", _wide, "binary").filter(may_link("x", "n", "y", "m")).select(p.columns).distinct())
    a, b = SIMILARITY
    return (both(p, "tokens", _whole, "array<long>")
            .filter(F.size(F.array_intersect("x", "y")) * (a + b) >= (F.col("n") + F.col("m")) * a)
            .select("u", "v").distinct())


def _share_enough(pairs: DataFrame) -> DataFrame:
    """The pairs with enough rare tokens in common: if the sets have the
    overlap o that a link needs, the first 1 + o - ceil(0.75 max(n, m)) of the
    common tokens are rare in both."""
    a, b = SIMILARITY
    p = pairs.groupBy("u", "v").agg(F.sum("x").alias("x"), *[F.min(c).alias(c) for c in ("n", "m", "a", "b")])
    need = F.ceil(a * (F.col("n") + F.col("m")) / (a + b)) - F.ceil(a * F.greatest("n", "m") / b) + 1
    return p.filter(F.col("x") >= need)


def _ordered(best: DataFrame) -> DataFrame:
    """The pairs (x: struct with u, n, a; v, m, b in it) with the smaller node as u."""
    swap = F.col("x.u") > F.col("x.v")
    ends = [(F.when(swap, F.col(f"x.{q}")).otherwise(F.col(f"x.{p}")).alias(p),
             F.when(swap, F.col(f"x.{p}")).otherwise(F.col(f"x.{q}")).alias(q)) for p, q in ("uv", "nm", "ab")]
    return best.select(*[c for both in ends for c in both]).distinct()


def _named(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """``rows`` with the label of each node's component."""
    if links is None:
        return rows.withColumn("label", F.col("node"))
    return (rows.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node")))


def _split_groups(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """The labelled rows of groups that hold nodes of several components; before
    there are links, that is every group."""
    named = _named(rows, links)
    if links is None:
        return named
    split = (named.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"))
             .filter("a != b").select("token"))
    return named.join(split, "token")


def near_links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): enough of the links between nodes to give their components."""
    groups = token_groups(docs)
    info = (sets.filter(F.col("node").isNotNull()).groupBy("node")
            .agg(F.min("n").alias("n"), F.coalesce(F.min("doc_id"), F.lit(-1)).alias("doc"),
                 F.first("bits").alias("bits")))
    info = stored(info.join(groups.select("node").distinct(), "node", "left_semi"), "ngram-bits")
    rows = groups.withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")))
    pivots = groups.filter("k > 1").groupBy("token", "weight", "k").agg(F.min("node").alias("node"))
    pivots = pivots.select("token", "node", "weight", "k", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
    parts = rows.unionByName(pivots.filter(F.col("i") != F.pmod(F.xxhash64("node"), F.col("k"))))
    tried = links = None
    for _ in range(ROUNDS):
        found = _by_group(_split_groups(parts, links).join(info, "node"), ["token", "i"], _partners)
        found = _ordered(found.groupBy("v").agg(F.max(F.struct("x", "u", "v", "n", "m", "a", "b")).alias("x")))
        found = cut(found if tried is None else found.join(tried, ["u", "v"], "left_anti"))
        good = cut(verified(found, docs, wide=False))
        tried = found if tried is None else tried.unionAll(found)
        links = good if links is None else links.unionAll(good)

    # Part i meets every part j: as the first side where i <= j, as the second where i > j.
    met = _split_groups(rows, links).select(
        "token", "node", "label", "weight", F.col("i").alias("p"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("o"))
    met = met.select("token", "node", "label", "weight", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"),
                     (F.col("p") > F.col("o")).cast("int").alias("side"))
    more = _by_group(met.join(info, "node"), ["token", "i", "j"], _across)
    more = cut(_share_enough(more).join(tried, ["u", "v"], "left_anti"))
    return links.unionAll(verified(more, docs, wide=True))


def _node_labels(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, least, label): of each node its smallest id and its component."""
    label = components(cut(near_links(docs, sets)))
    return (sets.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
            .join(label, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")))


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    sets = stored(shingled(docs), "ngram-sets")
    ids = _node_labels(docs, sets)
    whole = ids.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = ids.join(whole, "label").select("node", "component_id")
    return (sets.select("doc_id", "node", F.col("n").alias("n_shingles")).join(by_node, "node", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                    .otherwise(F.col("component_id")).alias("component_id")))


def repeats(docs: DataFrame) -> DataFrame:
    """(_f, _i): the rows of ``docs`` (with these keys, see ``keyed``) that go if one row of each component stays,
    the one of the smallest (doc_id, nulls last, text hash, key).  Rows without shingles stay."""
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    sets = stored(shingled(hashed, ("_f", "_i", "_hash")), "ngram-sets")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"),
                     F.col("_hash").alias("h"), F.col("_f").alias("f"), F.col("_i").alias("i"))
    # The first row of each node, then of each component.
    by_node = sets.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(place).alias("first"))
    kept = (by_node.join(_node_labels(docs, sets).select("node", "label"), "node")
            .groupBy("label").agg(F.min("first").alias("first"))
            .select(F.col("first.f").alias("_f"), F.col("first.i").alias("_i")))
    named = sets.filter(F.col("node").isNotNull()).select("_f", "_i")
    return stored(named.join(kept, ["_f", "_i"], "left_anti"), "ngram-repeats")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component (see ``repeats``)."""
    rows = keyed(docs)
    return rows.join(short(repeats(rows)), ["_f", "_i"], "left_anti").drop("_f", "_i")
