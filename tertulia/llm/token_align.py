"""Cross-tokenizer alignment by token spans.

A is a byte-level BPE of the tokenizers library, B a sentencepiece BPE with
byte fallback.  A's character offsets and the spans of B's proto are coarse
cuts: in ASCII without byte tokens they are the token ends.  Where a character
has several bytes, or B falls back to bytes, the ends are refined with the
bytes that the tokens decode to.  Byte offsets where tokens of both end cut
them into groups; every A token of a group is linked with every B token.

No token of either tokenizer reaches over the place between a visible
character and a blank or line break (A's splitting pattern always breaks there;
B has no piece with a blank after another character and none with a line
break, which is checked on its vocabulary).  So texts are cut into chunks at
these places, and a chunk is encoded and aligned once while a worker remembers
it; new chunks are encoded together, as the text they make.  A tokenizer
without this property takes whole texts.

Documents are put into blocks of ``BLOCK_CHARS`` characters (a longer text is a
block of its own), each with a dictionary of its distinct id pairs, and written
once: a row for each document, with places in the dictionary, and one for each
entry of the dictionary (``PACKED`` of them on their way back), so no row grows
with its block.  The number of documents
that hold a pair is a sum over the blocks' dictionaries, and it comes back by a
join of the dictionaries, where a pair stands once a block however frequent it
is; the texts take no part in either shuffle.  Documents meet the entries of their
block in one sort by block, in which the entries stand first: a worker holds those
of one block.  An A id's highest count is a table of at most as many rows as A has
tokens, which is broadcast.

Defined results: null and empty texts, and texts whose tokens decode to other
bytes (a literal U+2581, say), have no tokens: zeros and an empty digest; every
row counts as a document, repeated or null ids included; an empty table gives no
rows; extra columns are ignored; long texts are taken whole.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
BLOCK_CHARS = 2_000_000
#: Chunks a worker remembers and the bytes of their summaries (counted at the start of a block), their greatest length,
#: those encoded together, and texts taken out of Arrow at a time.
REMEMBERED = 300_000
REMEMBERED_BYTES = 48 << 20
SHORT = 64
TOGETHER = 20_000
TEXTS_AT_ONCE = 256
#: Entries of a dictionary that come back in a row.
PACKED = 1024
#: Links of a group beyond which its distinct ids are paired.
LARGE = 1 << 20
CHUNK = re.compile(r"(?<=\S)(?=[ \n]\s*\S)")
SPACE = "▁"
#: A chunk that stands in a text of such chunks as it does alone.
PLAIN = re.compile(f"[ \n](?:[^{SPACE}]*[^\\s{SPACE}])")


def tokenizer_file(name: str) -> str:
    """A path as it is, or the place of a public tokenizer's file of this name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return str(public_tokenizers.path(name))


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest in order
    from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and the chunks aligned so far."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(tokenizer_file(byte_bpe))
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
                        for t, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(piece_bpe))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.fallback = [self.b.is_byte(i) for i in range(len(pieces))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if f else p.replace(SPACE, " ").encode() for p, f in zip(pieces, self.fallback)]
        start = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        self.chunked = (start.get("type") == "ByteLevel" and start.get("use_regex", True) and not start.get("add_prefix_space")
                        and not any(re.search(f"[^{SPACE}]{SPACE}|[ \n]", p) for p in pieces))
        self.blank = self.b.piece_to_id(SPACE)
        self.fallback = np.array(self.fallback)
        self.b_lengths = np.array([len(x) for x in self.b_bytes])
        self.a_lengths = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_lengths[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        numbers = range(max(len(self.a_lengths), len(self.b_lengths)))
        self.comma, self.bar, self.semicolon = (np.array([f"{i}{sign}" for i in numbers], object) for sign in ",|;")
        self.forget()

    def chunks(self, text: str) -> list[str]:
        return CHUNK.split(" " + text) if self.chunked else [" " + text]

    def encode(self, chunks: list[str]):
        """For each chunk, (id, end) of its tokens by A and by B, ends in bytes; None where they decode to other bytes."""
        a = self.a.encode_batch(chunks, add_special_tokens=False)
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], return_type="proto", num_threads=1)
        for chunk, left, right in zip(chunks, a, b):
            raw, ids, spans = chunk.encode(), left.ids, [(p.id, p.begin, p.end) for p in right.pieces]
            skip = chunk[0] != " "
            if skip:  # the blank that B puts before its text
                if not spans or spans[0][0] != self.blank:
                    raise ValueError("a line break joins with the blank before it")
                spans = spans[1:]
            if b"".join([self.a_bytes[i] for i in ids]) != raw or b"".join([self.b_bytes[i] for i, _, _ in spans]) != raw:
                yield None
                continue
            if len(raw) == len(chunk) and not any(self.fallback[i] for i, _, _ in spans):
                yield [(i, e) for i, (_, e) in zip(ids, left.offsets)], [(i, e + (not skip)) for i, _, e in spans]
                continue
            # Several bytes a character, or byte tokens: ends by decoded bytes from the chunk's start.
            yield (list(zip(ids, np.cumsum([len(self.a_bytes[i]) for i in ids]).tolist())),
                   list(zip([s[0] for s in spans], np.cumsum([len(self.b_bytes[s[0]]) for s in spans]).tolist())))

    @staticmethod
    def groups(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, list[int], list[int]]]:
        """(end, A ids, B ids) of each group."""
        out, i, j = [], 0, 0
        for end in sorted({e for _, e in a} & {e for _, e in b}):
            left, right = [], []
            while i < len(a) and a[i][1] <= end:
                left.append(a[i][0])
                i += 1
            while j < len(b) and b[j][1] <= end:
                right.append(b[j][0])
                j += 1
            out.append((end, left, right))
        return out

    def add(self, tokens: list[tuple | None]) -> None:
        """Append summaries of chunks whose tokens are given one by one."""
        for t in tokens:
            a, b = (np.array(x, np.int64).reshape(-1, 2) for x in (t or ([], [])))
            self.append(a[:, 0], a[:, 1], b[:, 0], b[:, 1], a[-1:, 1], t is not None)

    def append(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, ends: np.ndarray, good: bool = True) -> None:
        """Append the summaries of chunks that end at ``ends`` of a run of text: ids and ends of its tokens by A and B.
        No chunks end in a bad one's empty tokens, which stand for one summary without any."""
        n = max(1, len(ends))
        cuts = np.intersect1d(a_end, b_end)
        of_a, of_b = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)  # the group of each token
        chunk = np.searchsorted(ends, cuts)  # the chunk of each group
        k_a, k_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
        to_a, to_b = np.cumsum(k_a), np.cumsum(k_b)
        # The digest's text: a group's A tokens, then its B tokens, each with the sign after it.
        place_a, place_b = np.arange(len(a)) + (to_b - k_b)[of_a], np.arange(len(b)) + to_a[of_b]
        words = np.empty(len(a) + len(b), object)
        words[place_a] = np.where(np.arange(len(a)) == to_a[of_a] - 1, self.bar[a], self.comma[a])
        words[place_b] = np.where(np.arange(len(b)) == to_b[of_b] - 1, self.semicolon[b], self.comma[b])
        # All pairs of a group; of a very large one only its distinct ids, with their number of links.
        large = np.flatnonzero(k_a * k_b > LARGE)
        k_pairs = np.where(k_a * k_b > LARGE, 0, k_b)[of_a]
        left = np.repeat(np.arange(len(a)), k_pairs)
        right = np.repeat((to_b - k_b)[of_a] - (np.cumsum(k_pairs) - k_pairs), k_pairs) + np.arange(k_pairs.sum())
        pairs, owner = [a[left] << 32 | b[right]], [chunk[of_a[left]]]
        times = [np.ones(len(left), np.int64)]
        for g in large:
            x, n_x = np.unique(a[to_a[g] - k_a[g]:to_a[g]], return_counts=True)
            y, n_y = np.unique(b[to_b[g] - k_b[g]:to_b[g]], return_counts=True)
            pairs.append((x[:, None] << 32 | y).ravel())
            owner.append(np.full(len(x) * len(y), chunk[g]))
            times.append((n_x[:, None] * n_y).ravel())
        order = np.argsort(np.concatenate(owner), kind="stable") if len(large) else slice(None)
        self.pairs.append(np.concatenate(pairs)[order])
        self.times.append(np.concatenate(times)[order])
        count = lambda x, w=None: np.bincount(x, w, n).astype(np.int64)
        self.lengths.append(count(np.concatenate(owner)))
        self.counts.append(np.stack([count(chunk[of_a]), count(chunk[of_b]), count(chunk), count(chunk, k_a * k_b)], 1))
        self.good.append(np.full(n, good))
        last = np.cumsum(count(chunk[of_a]) + count(chunk[of_b])).tolist()
        texts = ["".join(words[i:j])[:-1] for i, j in zip([0, *last], last)]
        self.texts += texts
        self.held += sum(map(len, texts)) + 16 * len(self.pairs[-1])

    def summarise(self, chunks: list[str]) -> None:
        """Append the summaries of ``chunks``, in order.  Those that stand in a text as they do alone are encoded as
        one text; the others, and all if that doesn't decode to itself, one by one."""
        for at in range(0, len(chunks), TOGETHER):
            part = chunks[at:at + TOGETHER]
            alone = not self.chunked or not all(map(PLAIN.fullmatch, part))
            found = None if alone else self.together(part)
            if found is None:
                self.add(list(self.encode(part)))
            else:
                self.append(*found)

    def together(self, chunks: list[str]) -> tuple | None:
        """Ids and ends of the tokens of plain chunks encoded as one text, and the chunks' ends; a first chunk of a
        blank and a letter is put before them, and taken off again."""
        text = " x" + "".join(chunks)
        raw = text.encode()
        left = self.a.encode(text, add_special_tokens=False)
        right = self.b.encode(text[1:], return_type="proto", num_threads=1).pieces
        a, b = np.array(left.ids, np.int64), np.array([p.id for p in right], np.int64)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw:
            return None
        spans = np.array(left.offsets, np.int64).reshape(-1, 2)
        if len(raw) == len(text):
            a_end, widths = spans[:, 1], np.fromiter(map(len, chunks), np.int64, len(chunks))
        else:
            # Character offsets in bytes; tokens that share a character with the next end where their bytes do.
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            byte = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
            shared = np.append(spans[1:, 0] < spans[:-1, 1], False)
            a_end = np.where(shared, np.cumsum(self.a_lengths[a]), byte[spans[:, 1]])
            widths = np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks))
        # B's spans count the bytes of its text; byte tokens end where their bytes do.
        b_end = np.array([p.end for p in right], np.int64) + 1
        if self.fallback[b].any():
            b_end = np.where(self.fallback[b], np.cumsum(self.b_lengths[b]), b_end)
        x, y = np.searchsorted(a_end, 2, "right"), np.searchsorted(b_end, 2, "right")
        return a[x:], a_end[x:] - 2, b[y:], b_end[y:] - 2, np.cumsum(widths)

    def numbered(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk's summary."""
        new = list(dict.fromkeys(c for c in chunks if c not in self.known))
        base = len(self.texts)
        self.known.update(zip(new, range(base, base + len(new))))
        self.summarise(new)
        out = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        for c in new:
            if len(c) > SHORT:
                del self.known[c]
        return out

    def forget(self) -> None:
        """Empty the memory of chunks."""
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.held = 0  # bytes of texts, pairs and their links
        self.pairs, self.times, self.lengths, self.counts, self.good = ([] for _ in range(5))

    def summaries(self) -> tuple[np.ndarray, ...]:
        """(pairs, their links, number of pairs of each chunk, its counts, whether it decodes to itself)."""
        for name in ("pairs", "times", "lengths", "counts", "good"):
            whole = getattr(self, name)
            setattr(self, name, [np.concatenate(whole)] if whole else [])
        empty = np.zeros(0, np.int64)
        return tuple(x[0] if x else y for x, y in zip((self.pairs, self.times, self.lengths, self.counts, self.good),
                                                      (empty, empty, empty, empty.reshape(0, 4), empty.astype(bool))))


@functools.lru_cache(maxsize=2)
def aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    return Aligner(byte_bpe, piece_bpe)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def block_of(al: Aligner, texts: list[str | None]) -> dict[str, np.ndarray | list]:
    """A block: per document its counts and digest, and its pairs (``ptr`` to ``idx``, places in the
    dictionary ``pair``, with ``times`` links); ``docs`` of the block hold a pair."""
    if len(al.texts) > REMEMBERED or al.held > REMEMBERED_BYTES:
        al.forget()
    cut = [al.chunks(t) if t else [] for t in texts]
    sizes = np.array([len(c) for c in cut], np.int64)
    n = len(texts)
    doc, chunk = np.repeat(np.arange(n), sizes), al.numbered([c for x in cut for c in x])
    pairs, links, lengths, counts, good = al.summaries()
    bad = np.bincount(doc, ~good[chunk], n) > 0
    doc, chunk = doc[~bad[doc]], chunk[~bad[doc]]
    sizes = np.where(bad, 0, sizes)
    out: dict = {name: np.bincount(doc, counts[chunk, i], n).astype(np.int64) for i, name in enumerate(COUNTS)}
    ends = np.cumsum(sizes).tolist()
    named = [al.texts[c] for c in chunk.tolist()]
    out["groups_sha256"] = [hashlib.sha256(";".join(named[i:j]).encode()).hexdigest() if j > i else ""
                            for i, j in zip([0, *ends], ends)]
    # Distinct (document, chunk), then their pairs, then distinct (document, pair).
    k = max(1, len(lengths))
    key, times = np.unique(doc * k + chunk, return_counts=True)
    doc, chunk = key // k, key % k
    reps = lengths[chunk]
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(starts[chunk] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    pair, place = np.unique(pairs[at], return_inverse=True)
    p = max(1, len(pair))
    key, where = np.unique(np.repeat(doc, reps) * p + place, return_inverse=True)
    out["idx"] = key % p
    out["ptr"] = np.searchsorted(key // p, np.arange(n + 1))
    out["times"] = np.bincount(where, links[at] * np.repeat(times, reps), len(key)).astype(np.int64)
    out |= {"pair": pair, "docs": np.bincount(out["idx"], minlength=len(pair))}
    return out


def _blocks(byte_bpe: str, piece_bpe: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the entries of its dictionary, then its documents."""
    al, part, number = aligner(byte_bpe, piece_bpe), TaskContext.get().partitionId(), 0
    ids, texts, chars = [], [], 0

    def rows(n: int, **columns) -> pa.RecordBatch:
        columns["block"] = pa.array(np.full(n, part << 32 | number))
        return pa.record_batch([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def block():
        b = block_of(al, texts)
        k, lists = len(b["pair"]), pa.array(b["ptr"], pa.int32())
        if k:
            yield rows(k, pos=pa.array(np.arange(k)), pair=pa.array(b["pair"]), docs=pa.array(b["docs"]))
        yield rows(len(texts), doc_id=pa.array(ids, schema.field("doc_id").type), groups_sha256=pa.array(b["groups_sha256"], pa.string()),
                   **{c: pa.array(b[c]) for c in COUNTS}, **{c: pa.ListArray.from_arrays(lists, pa.array(b[c])) for c in ("idx", "times")})

    for batch in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if texts and chars + len(text or "") > BLOCK_CHARS:
                yield from block()
                number += 1
                ids, texts, chars = [], [], 0
            ids.append(i)
            texts.append(text)
            chars += len(text or "")
    if texts:
        yield from block()


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the entries of each block with their corpus-wide counts, and then its documents, to documents."""
    last, held = None, []
    for batch in batches:
        block = batch.column("block").to_numpy(zero_copy_only=False)
        entry = batch.column("pos").is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (entry[1:] != entry[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
            if lo == hi:
                continue
            if block[lo] != last:
                last, held = block[lo], []
            part = batch.slice(lo, hi - lo)
            if entry[lo]:
                held.append([np.array(part.column(c).flatten().to_numpy(zero_copy_only=False)) for c in ("n", "best")])
                continue
            if len(held) > 1:
                held = [[np.concatenate(x) for x in zip(*held)]]
            n, best = held[0] if held else (np.zeros(0, np.int64),) * 2
            idx, times = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("idx", "times"))
            ptr = np.concatenate([[0], np.cumsum(part.column("idx").value_lengths().to_numpy(zero_copy_only=False))])
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v, dtype=np.int64)])[ptr])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("doc_id", *COUNTS)], pa.array(total(times * best[idx])), pa.array(total(times * n[idx])),
                 part.column("groups_sha256")], names=["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])


def alignment(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n_a, n_b, n_groups, n_links, n_best (links whose pair is held by as
    many documents as any of its A id), count_sum (of these numbers over the links) and groups_sha256."""
    id_type = docs.schema["doc_id"].dataType
    kept = [("doc_id", id_type), *[(c, T.LongType()) for c in COUNTS], ("groups_sha256", T.StringType()),
            ("idx", T.ArrayType(T.IntegerType())), ("times", T.ArrayType(T.LongType()))]
    names = [("block", T.LongType()), ("pos", T.IntegerType()), ("pair", T.LongType()), ("docs", T.IntegerType()), *kept]
    schema = T.StructType([T.StructField(n, t) for n, t in names])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    blocks = stored(docs.select("doc_id", "text").mapInArrow(functools.partial(_blocks, byte_bpe, piece_bpe, arrow), schema), "aligned")
    entries = blocks.filter("pos IS NOT NULL").select("block", "pos", "pair", "docs")
    pairs = entries.groupBy("pair").agg(F.sum("docs").alias("n"))
    pairs = stored(pairs.withColumn("a", F.shiftright("pair", 32)), "aligned-pairs")
    highest = pairs.groupBy("a").agg(F.max("n").alias("most"))  # at most one row a token of A
    counted = pairs.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    back = (entries.join(counted, "pair").groupBy("block", F.floor(F.col("pos") / F.lit(PACKED)).cast("int").alias("_k"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "n", "best"))).alias("c"))
            .select("block", F.col("_k").alias("pos"), F.col("c.n").alias("n"), F.col("c.best").alias("best")))
    both = blocks.filter("pos IS NULL").select("block", "pos", *[n for n, _ in kept]).unionByName(back, allowMissingColumns=True)
    out = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in (*COUNTS, "n_best", "count_sum")],
                        T.StructField("groups_sha256", T.StringType())])
    return both.repartition("block").sortWithinPartitions("block", F.col("pos").asc_nulls_last()).mapInArrow(_documents, out)


GROUP = "array<struct<start:int,end:int,a:array<int>,b:array<int>>>"


def aligned_groups(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """(doc_id, groups): the groups of each row's ``text``, with their bytes (from a leading blank on) and token ids."""
    out = T.StructType([docs.schema["doc_id"], T.StructField("groups", T._parse_datatype_string(GROUP))])
    kind = to_arrow_type(out["groups"].dataType)

    def work(batches):
        al = aligner(byte_bpe, piece_bpe)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                groups, base = [], 0
                for chunk, tokens in zip(c := al.chunks(text) if text else [], al.encode(c)):
                    if tokens is None:
                        groups = []
                        break
                    last = base
                    for end, left, right in al.groups(*tokens):
                        groups.append({"start": last, "end": base + end, "a": left, "b": right})
                        last = base + end
                    base += len(chunk.encode())
                rows.append(groups)
            yield pa.record_batch([batch.column(0), pa.array(rows, kind)], names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(work, out)
