"""Query registry: name -> (Spark builder, optional DuckDB oracle SQL).

Each builder takes (spark, sf_dir) and returns a DataFrame over the driver
tables (or data Spark derives from them).  The oracle SQL is a DuckDB
statement over the same tables; some of it shares word lists and rule tables
with the implementation, whose expected values the golden tests write out; rows-only queries (regex
look-around or back-references, seeded ML fits) register no SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str | Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a query; ``sql`` may be a function that makes the SQL when it
    is asked for."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def oracle_table() -> dict[str, str]:
    return {k: v() if callable(v) else v for k, v in ORACLE.items()}


# ---------------------------------------------------------------------------
# Shared SQL fragments (DuckDB dialect)
# ---------------------------------------------------------------------------
TWEETS_CTE = r"""tweets AS (
  SELECT d.doc_id AS tweet_id,
    d.text
    || CASE WHEN d.doc_id % 2 = 0 THEN ' #Sol' || upper(substr(d.source,1,1)) || substr(d.source,2) ELSE '' END
    || CASE WHEN d.doc_id % 3 = 0 THEN ' @user' || CAST(d.doc_id % 50 AS VARCHAR) ELSE '' END
    || CASE WHEN d.doc_id % 5 = 0 THEN ' http://t.co/a' || CAST(d.doc_id AS VARCHAR) ELSE '' END
    || CASE d.doc_id % 7 WHEN 0 THEN ' jajaja JAJA hahaha jaja jajaja xD' WHEN 1 THEN ' holaaaa?'
         WHEN 2 THEN ' xq q bueno!!' WHEN 3 THEN ' 😀 👍' WHEN 4 THEN ' ¿NO LO SE? ‘no’ 2015' ELSE '' END AS content,
    d.lang AS lang, d.source AS dataset,
    CAST(coalesce(l.quality*2 + l.toxic, d.doc_id % 4) AS INTEGER) AS sentiment
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

SPLIT_CTE = r"""tweets_split AS (
  SELECT * EXCLUDE (_rn, _n),
    CASE WHEN _rn < floor(0.7 * _n) THEN 'train' WHEN _rn < floor(0.85 * _n) THEN 'dev' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5('1234:' || CAST(tweet_id AS VARCHAR))) - 1 AS _rn,
               count(*) OVER () AS _n FROM tweets))"""


def with_tweets(body: str, split: bool = False, extra: str = "") -> str:
    ctes = [TWEETS_CTE] + ([SPLIT_CTE] if split else []) + ([extra] if extra else [])
    return "WITH " + ",\n".join(ctes) + "\n" + body


def duck_replacement(rep: str) -> str:
    """Java ``$n`` group references -> RE2 ``\\n``."""
    import re
    return re.sub(r"\$(\d)", r"\\\1", rep)


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
