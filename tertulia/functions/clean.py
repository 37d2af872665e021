"""Social-text cleaning stages as ``Column -> Column`` expressions.

Each stage is a built-in string expression (``regexp_replace``, ``translate``,
``lower``) so a whole cleaner compiles into one projection inside
whole-stage codegen and runs unchanged on batch or streaming DataFrames.

The *main* cleaner applies its stages in a fixed order (C1 -> C12):
newline/strip, quotes, emoji, hashtags, URLs, usernames, letter repetition,
laughter, abbreviations, numbers, punctuation, lower-case.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .emoji import demojize
from .regex import (DIGITS, NOT_SPACE, NO_WORD_BEFORE, SPACE, WORD, once, replace_first, where, whole_word)

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------
# Laughter patterns of the main cleaner, in order (the second "hah" is part of
# the reference's list).
LAUGH_STEMS_MAIN = ["jaj", "hah", "jej", "joj", "jij", "lol", "hah", "lmao", "xd"]
# Laughter patterns of the masking cleaner and of the entity extractor.
LAUGH_STEMS_SIX = ["jaj", "hah", "jej", "joj", "jij", "lol"]
# Laughter patterns of the row feature (any match, case-sensitive).
LAUGH_STEMS_FEATURE = ["jaj", "hah", "jej", "joj", "jij", "lol", "lmao", "xd"]
LAUGH_TOKEN = "JAJAJA"
# Abbreviation expansions, applied in this order.
ABBREVIATIONS = [("x", "por"), ("d", "de"), ("q", "que"), ("xq", "porque"), ("pq", "porque")]
USER_TOKEN = "USUARIO"
# Punctuation kept by the main cleaner; everything else of Python's
# string.punctuation is removed, and so is the inverted exclamation mark.
PUNCT_KEEP = "!?#@_:"
PUNCT_REMOVED_MAIN = "".join(ch for ch in string.punctuation if ch not in PUNCT_KEEP) + "¡"
PUNCT_REMOVED_ALL = string.punctuation + "¡"
# Older-years cleaner: emoji ranges removed outright and its URL shape.
OLDER_EMOJI_RANGES = [(0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF),
                      (0x1F1E0, 0x1F1FF), (0x2702, 0x27B0), (0x24C2, 0x1F251)]
OLDER_URL_CHARS = "./?=&%"

_LEFT_QUOTE, _RIGHT_QUOTE = "‘", "’"


def _laugh_pattern(stem: str) -> str:
    """``[a-zA-Z]*STEM[a-zA-Z]*``.  Every match is a whole ASCII-letter run
    containing the stem (the left wing absorbs the run start, the greedy right
    wing the run end), so anchoring the start at a run boundary returns the
    same matches while skipping the quadratic retries inside each word."""
    return f"(?<![a-zA-Z])[a-zA-Z]*{stem}[a-zA-Z]*"


# ---------------------------------------------------------------------------
# Stages
# ---------------------------------------------------------------------------
def strip_newlines(c: Column) -> Column:
    """Delete ``\\n`` (joins the words around it), then Unicode strip."""
    c = F.replace(c, F.lit("\n"), F.lit(""))
    ends = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)).rlike(SPACE)
    return where(c, ends, lambda x: F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+\z", ""))


def unify_quotes(c: Column) -> Column:
    """Typographic single quotes -> ASCII apostrophe."""
    held = lambda x: x.contains(_LEFT_QUOTE) | x.contains(_RIGHT_QUOTE)
    return where(c, held, lambda x: F.translate(x, _LEFT_QUOTE + _RIGHT_QUOTE, "''"))


def emoji_to_alias(c: Column) -> Column:
    """Each emoji -> ``:alias:``."""
    return demojize(c)


def split_hashtags(c: Column) -> Column:
    """C4: ``#HablarPorHablar`` -> ``Hablar Por Hablar``.

    A hashtag is ``#`` not preceded by a word char, followed by word chars.
    The text is cut into hashtags and what stands between them; only the
    hashtags' bodies get spaces at lower->Upper and Upper->Upper+lower
    transitions (ASCII case classes, as in the reference).  Every character is
    looked at a bounded number of times, whatever the length of a hashtag, and
    texts without ``#`` are left alone.
    """
    pieces = lambda x: F.regexp_extract_all(x, F.lit(rf"({NO_WORD_BEFORE}#{WORD}++|[^#]++|#)"), 1)
    body = lambda p: F.regexp_replace(
        F.substring(p, F.lit(2), F.length(p)), r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    split = lambda x: F.array_join(F.transform(
        pieces(x), lambda p: F.when(p.startswith("#") & (p != "#"), body(p)).otherwise(p)), "")
    return once(c, lambda x: F.when(x.contains("#"), split(x)).otherwise(x))


def remove_urls(c: Column, token: str = "") -> Column:
    """``http\\S+`` -> token ('' by default)."""
    return F.regexp_replace(c, rf"http{NOT_SPACE}+", token)


def mask_usernames(c: Column, token: str = USER_TOKEN) -> Column:
    """``\\B@\\w+`` -> token."""
    return F.regexp_replace(c, rf"{NO_WORD_BEFORE}@{WORD}+", token)


def squeeze_repeats(c: Column) -> Column:
    """Three or more equal word characters -> one (two stay)."""
    return F.regexp_replace(c, rf"({WORD})\1{{2,}}", "$1")


def normalize_laughter(c: Column, compat: bool = False,
                       stems: list[str] | None = None,
                       token: str = LAUGH_TOKEN,
                       case_insensitive: bool | None = None) -> Column:
    """Letter runs containing a laughter stem -> ``JAJAJA``.

    Default (intent): every hit, case-insensitive.  ``compat=True`` keeps the
    reference's literal behaviour: case-sensitive, only the first two hits per
    pattern (its flag argument landed in the ``count`` slot).
    """
    stems = LAUGH_STEMS_MAIN if stems is None else stems
    if case_insensitive is None:
        case_insensitive = not compat
    flag = "(?i)" if case_insensitive else ""
    if not compat and token.isascii() and token.isalpha():
        # All-hits mode: every pattern turns a whole letter run containing its
        # stem into the (alphabetic) token, which is again one letter run that
        # any later pattern maps to itself — so the sequence equals a single
        # pass with the stems as alternatives.
        alt = "|".join(dict.fromkeys(stems))
        return F.regexp_replace(c, f"{flag}(?<![a-zA-Z])[a-zA-Z]*(?:{alt})[a-zA-Z]*", token)
    for stem in stems:
        p = flag + _laugh_pattern(stem)
        if compat:
            # Texts without the stem (most of them) are told by a plain search.
            held = lambda x, stem=stem: (F.lower(x) if case_insensitive else x).contains(stem)
            for _ in range(2):
                c = where(c, held, lambda x, p=p: F.regexp_replace(x, replace_first(p), "$1" + token))
        else:
            c = F.regexp_replace(c, p, token)
    return c


def expand_abbreviations(c: Column, compat: bool = False) -> Column:
    """Whole-word x/d/q/xq/pq -> por/de/que/porque/porque.

    Intent: all hits, case-insensitive.  ``compat``: first two, case-sensitive.
    One search for any of them comes first; texts without pass unchanged.
    """
    def expanded(x: Column) -> Column:
        for short, full in ABBREVIATIONS:
            if compat:
                p = whole_word(short)
                for _ in range(2):
                    x = F.regexp_replace(x, replace_first(p), "$1" + full)
            else:
                x = F.regexp_replace(x, "(?i)" + whole_word(short), full)
        return x

    any_of = whole_word("(?:" + "|".join(short for short, _ in ABBREVIATIONS) + ")")
    return once(c, lambda x: F.when(x.rlike("(?i)" + any_of), expanded(x)).otherwise(x))


def remove_numbers(c: Column) -> Column:
    """Unicode digit runs -> ''."""
    return F.regexp_replace(c, DIGITS, "")


def remove_punctuation(c: Column, chars: str = PUNCT_REMOVED_MAIN) -> Column:
    """C11: delete punctuation characters (one ``translate``)."""
    return F.translate(c, chars, "")


def lowercase(c: Column) -> Column:
    """C12."""
    return F.lower(c)


# ---------------------------------------------------------------------------
# Presets
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class CleanFlags:
    emojis: bool = False
    hashtags: bool = False
    url: bool = False
    username: bool = False
    letrep: bool = False
    laughter: bool = False
    xque: bool = False
    number: bool = False
    punctuation: bool = False
    lowercasing: bool = False
    all_prep: bool = False
    compat: bool = False

    def on(self, name: str) -> bool:
        return self.all_prep or getattr(self, name)


# Defaults in force for the main and the embedding cleaner: lower-case only.
MAIN = CleanFlags(lowercasing=True)
EMBEDDING = CleanFlags(lowercasing=True)
ALL = CleanFlags(all_prep=True)


def clean_text(c: Column, flags: CleanFlags = MAIN) -> Column:
    """The switchable cleaner, stages in the fixed order."""
    c = unify_quotes(strip_newlines(c))
    if flags.on("emojis"):
        c = emoji_to_alias(c)
    if flags.on("hashtags"):
        c = split_hashtags(c)
    if flags.on("url"):
        c = remove_urls(c)
    if flags.on("username"):
        c = mask_usernames(c)
    if flags.on("letrep"):
        c = squeeze_repeats(c)
    if flags.on("laughter"):
        c = normalize_laughter(c, compat=flags.compat)
    if flags.on("xque"):
        c = expand_abbreviations(c, compat=flags.compat)
    if flags.on("number"):
        c = remove_numbers(c)
    if flags.on("punctuation"):
        c = remove_punctuation(c)
    if flags.on("lowercasing"):
        c = lowercase(c)
    return c


def _older_emoji_class() -> str:
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in OLDER_EMOJI_RANGES) + "]"


def older_url_pattern() -> str:
    """``(https|http)?://(\\w|[./?=&%])*\\b`` with the trailing boundary
    resolved: the match ends at the last word character of the run."""
    chars = "".join("\\" + ch for ch in OLDER_URL_CHARS)
    return rf"(?:https|http)?://[\p{{L}}\p{{N}}_{chars}]*{WORD}"


def clean_older(c: Column) -> Column:
    """C14: the older-years cleaner (its own order and targets)."""
    c = strip_newlines(c)
    c = F.regexp_replace(c, _older_emoji_class() + "+", "")
    c = unify_quotes(c)
    c = split_hashtags(c)
    c = F.lower(c)
    c = F.regexp_replace(c, older_url_pattern(), "")
    c = mask_usernames(c, "")
    c = squeeze_repeats(c)
    c = F.regexp_replace(c, _laugh_pattern("jaj"), "jajaja")
    c = remove_numbers(c)
    return remove_punctuation(c, PUNCT_REMOVED_ALL)


def clean_masked(c: Column) -> Column:
    """The analytics cleaner: URL/username masks, squeeze, six
    case-sensitive laughter patterns (all hits), lower-case."""
    c = unify_quotes(strip_newlines(c))
    c = emoji_to_alias(c)
    c = remove_urls(c, "URL")
    c = mask_usernames(c, "USERNAME")
    c = squeeze_repeats(c)
    c = normalize_laughter(c, stems=LAUGH_STEMS_SIX, case_insensitive=False)
    return F.lower(c)


def clean_lower_punct(c: Column) -> Column:
    """newline/strip, quotes, punctuation, lower-case."""
    return F.lower(remove_punctuation(unify_quotes(strip_newlines(c))))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "replace")]
