"""Row generators that do not duplicate their input expression.

For an inner ``explode``, Catalyst infers ``size(arr) > 0`` and pushes that
filter below the generator — and below any repartition — so an expensive
array expression (a regex tokenizer) is evaluated twice, once close to the
scan.  ``explode_outer`` infers nothing; the empty-array rows it emits are
dropped right after the generator instead.  Arrays fed to these helpers
never hold null elements (regex matches, tokens, structs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, arr: Column, name: str) -> DataFrame:
    """One row per element of ``arr`` (rows with an empty/null array vanish)."""
    return df.select(*keep, F.explode_outer(arr).alias(name)).filter(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, keep: list, arr: Column, pos: str, name: str) -> DataFrame:
    """As ``explode_rows`` with the 0-based position of each element."""
    return (df.select(*keep, F.posexplode_outer(arr).alias(pos, name))
            .filter(F.col(pos).isNotNull()))
