"""Cross-tokenizer alignment against whole texts encoded at once and aligned byte by byte."""

import collections
import hashlib
import random

import sentencepiece
from tokenizers import Tokenizer

from conftest import SF_SMALL
from tertulia.llm import token_align as A


def whole(texts):
    """Per text None or (A tokens, B tokens) as (id, bytes), by the libraries on whole texts."""
    a = Tokenizer.from_file(A.tokenizer_file(A.BYTE_BPE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=A.tokenizer_file(A.PIECE_BPE))
    alphabet = A.byte_alphabet()
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        e = a.encode(" " + t, add_special_tokens=False)
        left = [(i, bytes(alphabet[c] for c in p)) for i, p in zip(e.ids, e.tokens)]
        right = []
        for i in b.encode(t):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        raw = (" " + t).encode()
        same = b"".join(x for _, x in left) == raw == b"".join(x for _, x in right)
        out.append((left, right) if same else None)
    return out


def brute(rows):
    encoded = whole([t for _, t in rows])
    digests, links = [], []
    for tokens in encoded:
        if tokens is None:
            digests.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [set(), set()]
        for side in (0, 1):
            at = 0
            for _, x in tokens[side]:
                at += len(x)
                ends[side].add(at)
        groups = []
        for side in (0, 1):
            at, mine = 0, [[]]
            for i, x in tokens[side]:
                at += len(x)
                mine[-1].append(i)
                if at in ends[0] & ends[1]:
                    mine.append([])
            groups.append(mine[:-1])
        pairs = [(x, y) for g, h in zip(*groups) for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in zip(*groups))
        digests.append((len(tokens[0]), len(tokens[1]), len(groups[0]), len(pairs), hashlib.sha256(text.encode()).hexdigest()))
        links.append(pairs)
    count = collections.Counter(p for x in links for p in set(x))
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [(i, *d[:4], sum(count[p] == most[p[0]] for p in x), sum(count[p] for p in x), d[4])
            for (i, _), d, x in zip(rows, digests, links)]


COLUMNS = ["doc_id", *A.COUNTS, "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  ", "a  b", "a\nb", "a\n\nb", "a \n b", "\n a", "\ta\tb", "a\r\nb c", "a\x0bb\x0c c",
       "ñandú 你好 世界", "\U0001f600\U0001f468‍\U0001f469‍\U0001f467 x", "naïve café", "<|endoftext|> <s> </s> <unk> <0x0A>",
       "a▁b", "x y 　z w", "é ﬁ ½", "don't 'll I'VE", "12345 678,9", "\x00a\x01", "a" * 3000, "ab " * 2000,
       "你" * 500, " \n" * 300 + "end", "x\u0085 y", "a\x1c b", "<0x41>A", "﻿bom", "क्षत्रिय ไทย", "tab\t \tmix  \n  up", "~" * 77]


def test_against_whole_texts(spark):
    rng = random.Random(2)
    letters = "ab cé你\n😀\t-' 1." + " " * 3
    rows = list(enumerate(ODD + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(150)]))
    rows += [rows[20], rows[20], (None, "null id"), (None, None)]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(40).collect()]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, n_a string, block int")
    want = collections.Counter(brute(rows))
    got = A.alignment(df)
    assert got.columns == COLUMNS
    assert collections.Counter(map(tuple, got.collect())) == want
    # Many blocks.
    small = [A.block_of(A.aligner(A.BYTE_BPE, A.PIECE_BPE), [t for _, t in rows[i:i + 7]]) for i in range(0, len(rows), 7)]
    assert [x for b in small for x in b["n_links"]] == [x[4] for x in brute(rows)]
    count = collections.Counter()
    for b in small:
        count.update(dict(zip(b["pair"].tolist(), b["docs"].tolist())))
    assert sum(w[6] for w in brute(rows)) == sum(
        int((b["times"] * [count[p] for p in b["pair"][b["idx"]].tolist()]).sum()) for b in small)


def test_groups(spark):
    df = spark.createDataFrame([(1, "a ñ 你"), (2, None), (3, "a▁b"), (4, "word\nword 😀")], "doc_id long, text string")
    got = {r.doc_id: r.groups for r in A.aligned_groups(df).collect()}
    assert got[2] == got[3] == []
    raw = " word\nword 😀".encode()
    assert got[4][0].start == 0 and got[4][-1].end == len(raw)
    assert all(x.end == y.start for x, y in zip(got[4], got[4][1:]))
    tokens = whole(["word\nword 😀"])[0]
    assert [i for g in got[4] for i in g.a] == [i for i, _ in tokens[0]]
    assert [i for g in got[4] for i in g.b] == [i for i, _ in tokens[1]]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert A.alignment(df).count() == 0 and A.aligned_groups(df).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, A.alignment(blank).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(A, "REMEMBERED", 10)
    al = A.Aligner(A.BYTE_BPE, A.PIECE_BPE)
    for i in range(8):
        got = A.block_of(al, [f"w{i} x{i} " + "y" * 100, "a b"])
        assert got["n_a"].tolist() == A.block_of(A.Aligner(A.BYTE_BPE, A.PIECE_BPE), [f"w{i} x{i} " + "y" * 100, "a b"])["n_a"].tolist()
        assert len(al.texts) <= 16 and all(len(c) <= A.SHORT for c in al.known)


def test_large_groups_pair_distinct_ids(monkeypatch):
    texts = ["你好世界" * 30, "naïve \U0001f468‍\U0001f469 " * 20, "plain words here", "x" * 500]
    one = A.block_of(A.Aligner(A.BYTE_BPE, A.PIECE_BPE), texts)
    monkeypatch.setattr(A, "LARGE", 1)
    two = A.block_of(A.Aligner(A.BYTE_BPE, A.PIECE_BPE), texts)
    assert {k: list(v) for k, v in one.items()} == {k: list(v) for k, v in two.items()}


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = A.alignment(df)._jdf.queryExecution().toString()
    assert "text" not in plan.split("Physical Plan")[1]
