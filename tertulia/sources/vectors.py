"""Word-vector text files (``word v1 v2 ... vd`` per line).

A first line ``count dim`` is a header.  Words may hold blanks: the last ``d``
fields are the vector.  Every line is accounted for: it is a vector, the
header, or reported as malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import read_lines_ordered

HEADER = r"^[0-9]+ ([0-9]+)\s*$"


def _fields(dim: int) -> tuple[Column, Column, Column]:
    """Word, vector, and whether the line holds both."""
    parts = F.split(F.regexp_replace("value", r"[\r\t ]+$", ""), " ", -1)
    n = F.size(parts)
    floats = F.transform(F.slice(parts, F.greatest(n - dim + 1, F.lit(1)), dim), lambda x: x.try_cast("float"))
    word = F.array_join(F.slice(parts, 1, F.greatest(n - dim, F.lit(0))), " ")
    return word, floats, (n > dim) & (word != "") & F.forall(floats, lambda x: x.isNotNull())


def vector_lines(lines: DataFrame, dim: int) -> DataFrame:
    """(line_order, value, kind, word, vector) of each line (``value``,
    ``line_order``); kind: vector, malformed, or header for a first line of a
    file that is ``count dim`` with this ``dim`` (a one-dimensional vector of
    the word ``count`` reads the same and is a header there, too)."""
    word, floats, good = _fields(dim)
    first = F.col("line_order") == F.col("_first")
    heads = lines.groupBy(F.col("line_order.f").alias("_f")).agg(F.min("line_order").alias("_first"))
    d = lines.join(F.broadcast(heads), F.col("line_order.f") == F.col("_f"))
    is_head = first & (F.regexp_extract("value", HEADER, 1) == str(dim))
    return d.select("line_order", "value",
                    F.when(is_head, "header").when(good, "vector").otherwise("malformed").alias("kind"),
                    F.when(~is_head & good, word).alias("word"), F.when(~is_head & good, floats).alias("vector"))


def parse_vectors(lines: DataFrame, dim: int) -> DataFrame:
    """(word, vector) of the lines (``value``) that hold both, in whatever order they come."""
    word, floats, good = _fields(dim)
    return lines.filter(good).select(word.alias("word"), floats.alias("vector"))


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(word, vector) of the good lines."""
    return vector_lines(read_lines_ordered(spark, path), dim).filter("kind = 'vector'").select("word", "vector")


def malformed_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(line_order, value) of the lines that are neither vectors nor headers."""
    return vector_lines(read_lines_ordered(spark, path), dim).filter("kind = 'malformed'").select("line_order", "value")


def write_vectors(df: DataFrame, word_col: str, vec_col: str, path: str) -> None:
    df.select(F.concat_ws(" ", F.col(word_col),
                          F.array_join(F.transform(vec_col, lambda x: x.cast("string")), " "))
              .alias("value")).write.mode("overwrite").text(path)
