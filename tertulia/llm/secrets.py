"""Secret scan: an Aho-Corasick automaton finds keywords, anchored regular
expressions run only where a keyword stands, and kinds with an embedded
checksum are kept only if it holds.

Kinds of the base scan, each leftmost and non-overlapping in the whole text:
``assign`` (keyword, separator, value of 6 characters or more), ``access``
(``AKIA`` and 20 characters or more in all), ``hex`` (lower-case hex, 24
characters or more; a kind without a keyword, so its expression scans the text
itself).  Kinds that the method adds: ``github`` and ``npm`` tokens (prefix, 30
base-62 characters and their CRC-32 in 6 more), ``jwt`` (three base64url parts,
the first two JSON objects), ``pem`` (private key block whose base64 body
decodes) and ``iban``-like ``lei`` codes (ISO 17442, modulus 97).

Each document is scanned by itself in Arrow batches: no shuffle, nothing kept
between documents.  Defined results: null and empty text have no spans; offsets
are code points, end exclusive; every row gives one row, repeated rows too;
other columns are carried through.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("assign", "access", "hex")
ALL_KINDS = (*BASE_KINDS, "github", "npm", "jwt", "pem", "lei")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPAN = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()),
                                 T.StructField("kind", T.StringType())]))


def _crc_ok(m: re.Match) -> bool:
    body, check = m[1], m[2]
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out == check


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


def _pem_ok(m: re.Match) -> bool:
    try:
        return len(base64.b64decode(re.sub(r"\s", "", m[1]), validate=True)) > 0
    except (ValueError, binascii.Error):
        return False


def _mod97_ok(m: re.Match) -> bool:
    return int("".join(str(int(c, 36)) for c in m[0])) % 97 == 1


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Each keyword stands at the head of its match (except lei, see below).
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_KEYS = "|".join(_either_case(w) for w in ASSIGN_WORDS)
KINDS = {
    "assign": (ASSIGN_WORDS, re.compile(
        rf"""(?:{_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(
        r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), _crc_ok),
    "npm": (("npm_",), re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), _crc_ok),
    "jwt": (("eyj",), re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"),
            lambda m: _json_part(m[1]) and _json_part(m[2])),
    "pem": (("-----begin",), re.compile(
        r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----\s([A-Za-z0-9+/=\s]+)-----END (?:[A-Z]+ )?PRIVATE KEY-----"), _pem_ok),
    "lei": (("lei:", "lei "), re.compile(r"(?<=[Ll][Ee][Ii][: ])[0-9A-Z]{18}[0-9]{2}(?![0-9A-Za-z])"), _mod97_ok),
}
HEX = re.compile(r"[0-9a-f]{24,}")
BASE64URL = re.compile(r"[A-Za-z0-9_-]+")
_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def _automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for kind, (words, _, _) in KINDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def scan(text: str, automaton) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of one text, by start, then kind."""
    low = text.lower()
    if len(low) != len(text):  # a few letters have longer lower-case forms
        low = text.translate(_TO_LOWER)
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in automaton.iter(low):
        hits.setdefault(kind, []).append(end + 1 if kind == "lei" else end + 1 - n)
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for kind, at in hits.items():
        _, pattern, valid = KINDS[kind]
        free = 0
        for s in sorted(at):
            if s < free:
                continue
            if m := pattern.match(text, s):
                free = m.end()
                if valid(m):
                    found.append((s, free, kind))
            elif kind == "jwt":  # its first part ends where this run does, wherever in the run it begins
                free = BASE64URL.match(text, s).end()
    return sorted(found, key=lambda x: (x[0], ALL_KINDS.index(x[2]), x[1]))


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, and ``spans``: array<struct<s, e, kind>>
    (an input column of that name is replaced)."""
    keep = [c for c in docs.columns if c not in (text_col, "spans")]
    names = [f"c{i}" for i in range(len(keep))]
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep)]
                          + [T.StructField("spans", SPAN)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        automaton = _automaton()
        span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            spans = [[dict(zip(("s", "e", "kind"), x)) for x in scan(t, automaton)] if t else []
                     for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(spans, span)], [*names, "spans"])

    out = (docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep)], F.col(text_col).alias("t"))
           .mapInArrow(run, schema))
    return out.toDF(*keep, "spans")
