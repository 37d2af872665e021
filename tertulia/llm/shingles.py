"""Word shingles as 64-bit hashes, computed with numpy over batches of texts.

Words are runs of characters other than ASCII white space, A-Z lower-cased.  A
shingle's hash is a polynomial in its bytes modulo 2**64, read off running
sums over the batch, and then mixed; it does not depend on where it stands.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 16  # words hashed at once
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        _powers.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


def _hash_spans(words: list[bytes], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the words first..last (inclusive) of each span, one space between them."""
    raw = np.frombuffer(b" ".join(words), np.uint8)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(lens + 1) - 1
    power, inverse = _tables(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=total[1:])
    s = (end - lens)[first]
    h = (total[end[last]] - total[s]) * inverse[s]
    h ^= h >> np.uint64(33)
    h *= _C1
    h ^= h >> np.uint64(29)
    h *= _C2
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], size: int = SIZE):
    """Each text's sorted distinct shingle hashes; a text of fewer words has
    its whole sequence as one shingle, one without words none."""
    words: list[bytes] = []
    spans: list[tuple[int, int, int]] = []  # text, first word, number of words
    sets: list = [None] * len(texts)

    def flush() -> None:
        if not words:
            return
        first, count = [], []
        for _, at, n in spans:
            k = max(1, n - size + 1)
            first.append(np.arange(at, at + k))
            count.append(k)
        starts = np.concatenate(first)
        ends = np.concatenate([f + min(n, size) - 1 for f, (_, _, n) in zip(first, spans)])
        at = 0
        h = _hash_spans(words, starts, ends)
        for (text, _, _), k in zip(spans, count):
            part = np.unique(h[at:at + k])
            sets[text] = part if sets[text] is None else np.union1d(sets[text], part)
            at += k
        words.clear()
        spans.clear()

    for i, text in enumerate(texts):
        w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        lo = 0
        while lo < len(w):  # a long text goes in pieces that share size - 1 words
            hi = min(len(w), lo + _PIECE)
            if 0 < len(w) - hi < size:
                hi = len(w)
            spans.append((i, len(words), hi - lo))
            words += w[lo:hi]
            lo = hi if hi == len(w) else hi - size + 1
            if len(words) >= _PIECE:
                flush()
    flush()
    empty = np.empty(0, np.uint64)
    return [empty if s is None else s for s in sets]
