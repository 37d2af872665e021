"""Token operators on ``array<string>`` columns (all built-in expressions).

* ``word_tokens``     — maximal word-character runs (the vectoriser pattern)
* ``treebank_tokens`` — Penn-Treebank-style rules as a ``regexp_replace``
  chain that pads separators with spaces, then a whitespace split
* ``detokenize``      — join and re-attach punctuation
* ``strip_accents``   — transliteration to ASCII (rule-built table)
* ``remove_stopwords`` / ``word_bigrams``
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import NOT_WORD, SPACE, WORD, once, where
from .stopwords_es import spanish_stopwords

# ---------------------------------------------------------------------------
# Treebank-style tokenisation.  (pattern, Java replacement) pairs applied in
# order; the RE2 forms used by the SQL oracle differ only in replacement
# syntax (``\\1`` for ``$1``).  Deviation from the sentence-splitting
# tokenizer: a period is split off when followed by whitespace or the end of
# the text (no abbreviation model).
# ---------------------------------------------------------------------------
_CLOSERS = r"""[\])}>"']"""
TREEBANK_RULES = [
    # opening double quotes
    (r'^"', " `` "),
    (r"(``)", " $1 "),
    (r"""([ (\[{<])("|'')""", "$1 `` "),
    # punctuation
    (r"([:,])([^\p{Nd}])", " $1 $2"),
    (r"([:,])\z", " $1 "),
    (r"\.\.\.", " ... "),
    (r"[;@#$%&]", " $0 "),
    (rf"([^.])(\.)({_CLOSERS}*)({SPACE}|\z)", "$1 $2$3 $4"),
    (r"[?!]", " $0 "),
    (r"([^'])' ", "$1 ' "),
    # brackets
    (r"[\]\[(){}<>]", " $0 "),
    (r"--", " -- "),
    # closing quotes and clitics, also at the ends of the text
    (r"\A", " "),
    (r"\z", " "),
    (r'"', " '' "),
    (r"([^\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\p{Z}])('')", "$1 $2 "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
]

# How Java runs a rule: what a text must hold for it to change anything (a plain
# search, many times cheaper than the pattern's pass over the text), and forms
# with the same result that do less at each character.  A period that the rule
# splits off follows a character that the match before has not taken (``\\G``).
TREEBANK_NEEDS = {
    r'^"': lambda x: x.startswith('"'),
    r"(``)": lambda x: x.contains("``"),
    r"""([ (\[{<])("|'')""": lambda x: x.contains('"') | x.contains("''"),
    r"([:,])\z": lambda x: x.endswith(":") | x.endswith(","),
    r"\.\.\.": lambda x: x.contains("..."),
    r"([^'])' ": lambda x: x.contains("' "),
    r"--": lambda x: x.contains("--"),
    r'"': lambda x: x.contains('"'),
    r"([^\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\p{Z}])('')": lambda x: x.contains("''"),
    r"([^' ])('[sS]|'[mM]|'[dD]|') ": lambda x: x.contains("'"),
    r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ": lambda x: x.contains("'"),
}
TREEBANK_FORMS = {
    rf"([^.])(\.)({_CLOSERS}*)({SPACE}|\z)": lambda x: F.regexp_replace(
        x, rf"\.(?<=[^.]\.)(?<!\G\.)({_CLOSERS}*)({SPACE}|\z)", " .$1 $2"),
    r"\A": lambda x: F.concat(F.lit(" "), x),
    r"\z": lambda x: F.concat(x, F.lit(" ")),
}

# Contractions that are two tokens, and where the first ends.
CONTRACTIONS = {"cannot": 3, "d'ye": 1, "gimme": 3, "gonna": 3, "gotta": 3, "lemme": 3, "more'n": 4, "wanna": 3,
                "'tis": 2, "'twas": 2}

# Detokeniser: (pattern, Java replacement).
DETOKENIZE_RULES = [
    (r"(``|'')", '"'),
    (rf"{SPACE}+([,.;:?!%)\]}}]|\.\.\.|'[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T)", "$1"),
    (rf"([(\[{{$]){SPACE}+", "$1"),
]


def word_tokens(c: Column) -> Column:
    """Maximal runs of word characters (Python ``\\w{1,}``).  The ASCII part
    of a run is taken by a table look-up, the rest by Unicode classes."""
    return F.regexp_extract_all(c, F.lit(f"([A-Za-z0-9_]++{WORD}*+|{WORD}++)"), 1)


def words_apart(c: Column) -> Column:
    """The tokens of ``word_tokens`` with blanks between, as one text (blanks may stand at its ends)."""
    return F.regexp_replace(c, f"{NOT_WORD}++", " ")


def treebank_rule(c: Column, pat: str, rep: str) -> Column:
    """One rule: its cheaper form, or its pattern where the text may hold a match."""
    if pat in TREEBANK_FORMS:
        return TREEBANK_FORMS[pat](c)
    if pat in TREEBANK_NEEDS:
        return where(c, TREEBANK_NEEDS[pat], lambda x: F.regexp_replace(x, pat, rep))
    return F.regexp_replace(c, pat, rep)


def treebank_tokens(c: Column) -> Column:
    """Treebank-style word tokens."""
    for pat, rep in TREEBANK_RULES:
        c = treebank_rule(c, pat, rep)
    tokens = F.filter(F.split(c, f"{SPACE}+"), lambda t: t != "")

    lengths = [len(w) for w in CONTRACTIONS]

    def contracted(t: Column) -> Column:
        return F.length(t).between(min(lengths), max(lengths)) & F.lower(t).isin(*CONTRACTIONS)

    def parts(t: Column) -> Column:
        out = F.array(t)
        for word, at in CONTRACTIONS.items():
            out = F.when(F.lower(t) == word, F.array(F.substring(t, 1, at), F.substring(t, at + 1, len(word)))).otherwise(out)
        return F.when(contracted(t), out).otherwise(F.array(t))

    return once(tokens, lambda x: F.when(F.exists(x, contracted), F.flatten(F.transform(x, parts))).otherwise(x))


def tokens_joined(c: Column) -> Column:
    """Tokens of ``c`` joined by single spaces (older-years files)."""
    return F.array_join(treebank_tokens(c), " ")


def detokenize(tokens: Column) -> Column:
    """Inverse of ``treebank_tokens`` (joins, re-attaches punctuation)."""
    c = F.array_join(tokens, " ")
    for pat, rep in DETOKENIZE_RULES:
        c = F.regexp_replace(c, pat, rep)
    return c


# ---------------------------------------------------------------------------
# Accent removal.  The one-to-one table is built by rule: Latin letters whose
# compatibility decomposition minus combining marks is ASCII.  Fixed values
# below are the one-to-many transliterations the rule cannot derive.
# ---------------------------------------------------------------------------
MULTI_CHAR_TRANSLIT = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th",
    "€": "EUR", "«": "<<", "»": ">>", "…": "...",
}
SINGLE_CHAR_TRANSLIT = {
    "ø": "o", "Ø": "O", "ð": "d", "Ð": "D", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L",
    "ı": "i", "¿": "?", "¡": "!", "‘": "'", "’": "'", "“": '"', "”": '"',
}


@functools.lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch)
                       if not unicodedata.combining(x))
        if len(base) == 1 and base.isascii() and base != ch:
            src.append(ch)
            dst.append(base)
    for k, v in SINGLE_CHAR_TRANSLIT.items():
        if k not in src:
            src.append(k)
            dst.append(v)
    return "".join(src), "".join(dst)


def strip_accents(c: Column) -> Column:
    """T3 on a string: ``ñ -> n``, ``ß -> ss``, ``¿ -> ?``."""
    for k, v in MULTI_CHAR_TRANSLIT.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    src, dst = accent_table()
    return F.translate(c, src, dst)


def strip_accents_tokens(tokens: Column) -> Column:
    """T3 on a token array."""
    return F.transform(tokens, strip_accents)


def stopwords(language: str = "spanish") -> tuple[str, ...]:
    """The stop words of ``language``: Spanish (functions/stopwords_es.py);
    other lists go into ``remove_stopwords`` as they are."""
    if language != "spanish":
        raise ValueError(f"no stop words for {language!r}")
    return spanish_stopwords()


def remove_stopwords(tokens: Column, words: tuple[str, ...] | None = None) -> Column:
    """T4: drop tokens that are stop words (case-sensitive), order and
    duplicates of the remaining tokens kept.  ``isin`` tests a hash set of
    literals."""
    words = stopwords() if words is None else words
    return F.filter(tokens, lambda t: ~t.isin(*words))


def word_bigrams(tokens: Column) -> Column:
    """V7: adjacent token pairs joined by a space."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n),
                      lambda a, b: F.concat(a, F.lit(" "), b))
