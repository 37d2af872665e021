"""Emoji -> ``:alias:``, derived by rule from Unicode names.

The alias of a character is its lower-cased Unicode name with spaces and
hyphens turned into underscores (U+1F600 -> ``:grinning_face:``); only symbols
of the blocks below count.  Sequences are one emoji each: a skin tone adds its
name, joined characters (U+200D) join their names, a keycap is ``:keycap_1:``, a
flag ``:flag_es:``, and variation selectors after an emoji go with it.  These
rules spell some emoji otherwise than hand-curated lists do (U+1F44D is
``:thumbs_up_sign:``).
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import once

# Blocks scanned by the rule (start, end inclusive): pictographic blocks whole,
# of mixed blocks the characters that are emoji.
EMOJI_BLOCKS = [
    (0x231A, 0x231B), (0x2328, 0x2328), (0x23CF, 0x23CF), (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x24C2, 0x24C2),
    (0x25AA, 0x25AB), (0x25B6, 0x25B6), (0x25C0, 0x25C0), (0x25FB, 0x25FE),
    (0x2600, 0x27BF),    # miscellaneous symbols, dingbats
    (0x2B05, 0x2B07), (0x2B1B, 0x2B1C), (0x2B50, 0x2B50), (0x2B55, 0x2B55), (0x3030, 0x3030), (0x303D, 0x303D),
    (0x3297, 0x3297), (0x3299, 0x3299), (0x1F004, 0x1F004), (0x1F0CF, 0x1F0CF), (0x1F170, 0x1F171),
    (0x1F17E, 0x1F17F), (0x1F18E, 0x1F18E), (0x1F191, 0x1F19A), (0x1F201, 0x1F202), (0x1F21A, 0x1F21A),
    (0x1F22F, 0x1F22F), (0x1F232, 0x1F23A), (0x1F250, 0x1F251),
    (0x1F300, 0x1F5FF),  # symbols and pictographs
    (0x1F600, 0x1F64F),  # emoticons
    (0x1F680, 0x1F6FF),  # transport and map
    (0x1F7E0, 0x1F7EB), (0x1F7F0, 0x1F7F0),
    (0x1F900, 0x1F9FF),  # supplemental symbols and pictographs
    (0x1FA70, 0x1FAFF),  # symbols and pictographs extended-A
]
# The skin tones, U+1F3FB on.
SKIN_TONES = ["light", "medium_light", "medium", "medium_dark", "dark"]
KEYCAPS = "0123456789#*"
JOINER, VARIATION, KEYCAP_END = 0x200D, (0xFE0E, 0xFE0F), 0x20E3
REGIONAL = 0x1F1E6  # the letter a


@functools.lru_cache(maxsize=1)
def emoji_names() -> dict[str, str]:
    """Character -> name: emoji, skin tones, keycap signs and flag letters."""
    out = {}
    for lo, hi in EMOJI_BLOCKS:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            name = unicodedata.name(ch, None) if unicodedata.category(ch) in ("So", "Sm", "Po", "Pd") else None
            if name:
                out[ch] = name.lower().replace(" ", "_").replace("-", "_")
    out |= {chr(0x1F3FB + i): f"{tone}_skin_tone" for i, tone in enumerate(SKIN_TONES)}
    out |= {k: f"keycap_{k}" for k in KEYCAPS}
    return out | {chr(REGIONAL + i): chr(ord("a") + i) for i in range(26)}


@functools.lru_cache(maxsize=1)
def emoji_aliases() -> dict[str, str]:
    """Single emoji -> alias."""
    return {ch: f":{name}:" for ch, name in emoji_names().items()
            if any(lo <= ord(ch) <= hi for lo, hi in EMOJI_BLOCKS) and not 0x1F3FB <= ord(ch) <= 0x1F3FF}


def _cls(*ranges: tuple[int, int]) -> str:
    return "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges)


def _patterns() -> tuple[str, str, str]:
    """Java patterns: a flag, a keycap, a sequence of emoji characters."""
    every = _cls(*EMOJI_BLOCKS)
    letter = _cls((REGIONAL, REGIONAL + 25))
    variant, tone = _cls(VARIATION), _cls((0x1F3FB, 0x1F3FF))
    one = f"[{every}][{variant}]?[{tone}]?[{variant}]?"
    return (f"[{letter}][{letter}]", f"[{KEYCAPS.replace('*', '')}*][{variant}]?\\x{{{KEYCAP_END:X}}}",
            f"{one}(?:\\x{{{JOINER:X}}}{one})*+")


def demojize(c: Column) -> Column:
    """Replace every emoji, of one or several code points, by its alias; other
    text untouched.

    The text is cut into emoji and what stands between them, the longest
    sequence first; only emoji are looked up, so the work is linear in the text
    and never leaves the JVM.  Texts without any such character are not cut.
    """
    flag, keycap, sequence = _patterns()
    emoji = f"(?:{flag}|{keycap}|{sequence})"
    # No emoji is without a character from U+20E3 on, and one that begins below is a keycap.
    low, high = f"\\x{{0}}-\\x{{{KEYCAP_END - 1:X}}}", f"[\\x{{{KEYCAP_END:X}}}-\\x{{10FFFF}}]"
    plain = f"[{low}&&[^{KEYCAPS}]]++"
    pieces = lambda x: F.regexp_extract_all(x, F.lit(f"(?s)({emoji}|{plain}|.)"), 1)
    names = emoji_names()
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*[F.lit(v) for v in names.values()]))
    parts = lambda p: F.filter(F.transform(F.split(p, ""), lambda x: F.try_element_at(m, x)), lambda x: x.isNotNull())
    is_flag = lambda p: p.rlike(f"^{flag}\\z")
    alias = lambda p: F.when(is_flag(p), F.concat(F.lit(":flag_"), F.array_join(parts(p), ""), F.lit(":"))).otherwise(
        F.concat(F.lit(":"), F.array_join(parts(p), "_"), F.lit(":")))
    known = lambda p: p.rlike(f"^{emoji}\\z") & (F.size(parts(p)) > 0)
    done = lambda x: F.array_join(F.transform(pieces(x), lambda p: F.when(known(p), alias(p)).otherwise(p)), "")
    return once(c, lambda x: F.when(x.rlike(high), done(x)).otherwise(x))
