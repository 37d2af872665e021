"""Label mapping (L2-L8) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class codes: 0 N, 1 NEU, 2 NONE, 3 P (alphabetical order of the names).
LABEL_NAMES = ["N", "NEU", "NONE", "P"]
LABEL_PREFIX = "__label__"


def encode_fixed(name: Column) -> Column:
    """L2: N/NEU/NONE/P -> 0..3; anything else -> null (row kept)."""
    e = F.lit(None).cast("int")
    for code in reversed(range(len(LABEL_NAMES))):
        e = F.when(name == LABEL_NAMES[code], F.lit(code)).otherwise(e)
    return e


def decode(code: Column) -> Column:
    """0..3 -> name."""
    arr = F.array(*[F.lit(n) for n in LABEL_NAMES])
    return F.when((code >= 0) & (code < len(LABEL_NAMES)), F.element_at(arr, code.cast("int") + 1))


def collapse_intensity(raw: Column) -> Column:
    """L3: ``N+`` -> ``N``, ``P+`` -> ``P``."""
    return F.when(raw.isin("N+", "P+"), F.substring(raw, 1, 1)).otherwise(raw)


def ternary(raw: Column) -> Column:
    """L3: NONE/NEU -> ``O``, everything else unchanged (``P+`` stays)."""
    return F.when(raw.isin("NONE", "NEU"), F.lit("O")).otherwise(raw)


def reduce_tweet_label(x: Column) -> Column:
    """L4 (tweets): 0,1,2,3 -> 0,1,1,2 (NEU and NONE merged)."""
    return F.when(x > 1, x - 1).otherwise(x)


def reduce_rank(rank: Column) -> Column:
    """L4 (review ranks 1-5): <3 -> 0, 3 -> 1, >3 -> 2."""
    return F.when(rank < 3, 0).when(rank == 3, 1).otherwise(2)


def reduce_labels(dataset: Column, x: Column, compat: bool = False) -> Column:
    """L4 with the dataset switch; ``compat`` applies the tweet rule to every
    dataset (the reference's condition is always true)."""
    if compat:
        return reduce_tweet_label(x)
    return F.when(dataset == "coah", reduce_rank(x)).otherwise(reduce_tweet_label(x))


def aspect_vote(polarities: Column) -> Column:
    """+1 per P, -1 per N -> 0 (<0), 1 (=0), 2 (>0)."""
    pts = F.aggregate(polarities, F.lit(0),
                      lambda acc, p: acc + F.when(p == "P", 1).when(p == "N", -1).otherwise(0))
    return F.when(pts < 0, 0).when(pts == 0, 1).otherwise(2)


def label_prefix(code: Column) -> Column:
    """``__label__<code>``."""
    return F.concat(F.lit(LABEL_PREFIX), code.cast("string"))


def label_from_prefix(label: Column) -> Column:
    """The class is the last character of the label token."""
    return F.substring(label, -1, 1)


TWEET_DATE_FORMAT = "EEE MMM dd HH:mm:ss Z yyyy"
# Rendering of a UTC wall-clock (TIMESTAMP_NTZ) value: the offset is written
# literally so the text never depends on the session time zone.
TWEET_DATE_FORMAT_UTC = "EEE MMM dd HH:mm:ss '+0000' yyyy"


def date_parts(date_text: Column) -> list[Column]:
    """Weekday, month and hour slices of ``EEE MMM dd HH:mm:ss Z yyyy``."""
    return [F.substring(date_text, 1, 3).alias("day_of_week"),
            F.substring(date_text, 5, 3).alias("month"),
            F.substring(date_text, 12, 2).alias("hour")]
