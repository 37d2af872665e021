"""Portable regular-expression building blocks.

Spark evaluates patterns with java.util.regex; the reference semantics are
Python ``re`` with Unicode classes.  The classes below are written so Java
(and RE2, used by the SQL oracle) agree with Python on real text:

* Python ``\\w`` (Unicode)  -> ``[\\p{L}\\p{N}_]``   (Java's default ``\\w`` is ASCII)
* Python ``\\d`` (Unicode)  -> ``\\p{Nd}``
* Python ``\\s`` / ``str.strip`` whitespace -> ``SPACE`` below
* Python ``\\B#`` / ``\\b`` -> explicit look-around on ``WORD``
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
# Characters Python's str.isspace() accepts (str.strip / \s).
SPACE = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\p{Z}]"
NOT_SPACE = r"[^\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\p{Z}]"
DIGITS = r"\p{Nd}+"

# Python \B before a non-word char == "previous char is not a word char".
NO_WORD_BEFORE = rf"(?<!{WORD})"
NO_WORD_AFTER = rf"(?!{WORD})"


def whole_word(word_regex: str) -> str:
    """Python ``\\bWORD\\b`` for a word made of word characters."""
    return f"{NO_WORD_BEFORE}(?:{word_regex}){NO_WORD_AFTER}"


def replace_first(pattern: str) -> str:
    """Pattern usable with ``regexp_replace(c, p, '$1' + repl)`` that replaces
    only the first match (Spark has no replace-first function): the lazy
    prefix is re-emitted through ``$1``."""
    return rf"(?s)^(.*?)(?:{pattern})"


def once(c: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(c)`` with ``c`` evaluated once, however often ``fn`` refers to it:
    a lambda's argument is a value, a column in an expression is computed again
    wherever the common parts are not found."""
    return F.transform(F.array(c), fn)[0]


def where(c: Column, test: Callable[[Column], Column], fn: Callable[[Column], Column]) -> Column:
    """``fn(c)`` where ``test(c)`` holds, else ``c``, both on one evaluation of
    ``c``: a cheap search for what a pattern cannot do without saves the
    pattern's pass over texts that lack it."""
    return once(c, lambda x: F.when(test(x), fn(x)).otherwise(x))
