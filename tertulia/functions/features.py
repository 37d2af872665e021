"""Row features (F1-F8) as column expressions over the raw text."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import LAUGH_STEMS_FEATURE
from .regex import NO_WORD_AFTER, WORD


def tweet_length(c: Column) -> Column:
    """number of pieces of a single-space split (empty text -> 1)."""
    return F.size(F.split(c, " ", -1)).cast("bigint")


def uppercase_words(c: Column) -> Column:
    """words of two or more ASCII capitals (Unicode word borders).  The
    border before is looked at where a capital stands, not at every character."""
    return F.regexp_count(c, F.lit(f"[A-Z](?<!{WORD}[A-Z])[A-Z]++{NO_WORD_AFTER}")).cast("bigint")


def hashtag_count(c: Column) -> Column:
    """number of ``#`` characters."""
    return (F.length(c) - F.length(F.replace(c, F.lit("#"), F.lit("")))).cast("bigint")


def has_laughter(c: Column) -> Column:
    """1 when any laughter stem occurs (case-sensitive)."""
    return F.when(functools.reduce(Column.__or__, [c.contains(s) for s in LAUGH_STEMS_FEATURE]), 1).otherwise(0)


def has_question(c: Column, compat: bool = False) -> Column:
    """1 when the text contains ``?`` (``compat``: constant 0, as the
    reference's ``is True`` test never holds)."""
    return F.lit(0) if compat else F.when(F.instr(c, "?") > 0, 1).otherwise(0)


def has_exclamation(c: Column, compat: bool = False) -> Column:
    """F6."""
    return F.lit(0) if compat else F.when(F.instr(c, "!") > 0, 1).otherwise(0)


def has_letter_repetition(c: Column, compat: bool = False) -> Column:
    """1 when a word character repeats three or more times; what repeats is
    looked for first, its class is tested there only."""
    return F.lit(0) if compat else F.when(c.rlike(rf"(?=(.)\1\1){WORD}"), 1).otherwise(0)


@dataclass(frozen=True)
class FeatureFlags:
    length: bool = True
    uppercase: bool = True
    question: bool = True
    exclamation: bool = True
    repetition: bool = True
    hashtags: bool = True
    laughter: bool = True
    compat: bool = False


def feature_columns(c: Column, flags: FeatureFlags = FeatureFlags()) -> list[Column]:
    """F8: the switched-on row features, named as in the reference."""
    out = []
    if flags.length:
        out.append(tweet_length(c).alias("tweet_length"))
    if flags.uppercase:
        out.append(uppercase_words(c).alias("has_uppercase"))
    if flags.question:
        out.append(has_question(c, flags.compat).alias("question_mark"))
    if flags.exclamation:
        out.append(has_exclamation(c, flags.compat).alias("exclamation_mark"))
    if flags.repetition:
        out.append(has_letter_repetition(c, flags.compat).alias("letter_repetition"))
    if flags.hashtags:
        out.append(hashtag_count(c).alias("hashtag_number"))
    if flags.laughter:
        out.append(has_laughter(c).alias("laughter_feature"))
    return out
