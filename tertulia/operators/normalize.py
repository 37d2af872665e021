"""Term normalisation (T5) and spelling correction against a vocabulary.

Both are joins on the term, never a per-row library call: tokens are
exploded with their position, matched against a mapping table and, where a
row form is needed, re-assembled in position order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.generators import explode_rows, posexplode_rows
from .joins import broadcast_if_small


def explode_tokens(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    return posexplode_rows(df, [id_col], F.col(tokens_col), "pos", "term")


def normalize_terms(tokens: DataFrame, mapping: DataFrame) -> DataFrame:
    """T5: (id, pos, term) -> (id, pos, term) with each term replaced by its
    canonical form (``mapping``: term, canonical); unknown terms unchanged.
    The mapping is broadcast when its size check passes, else joined with a
    shuffle (AQE splits hot terms)."""
    m = broadcast_if_small(mapping.select("term", "canonical").dropDuplicates(["term"]))
    return (tokens.join(m, "term", "left")
            .select(*[c for c in tokens.columns if c != "term"],
                    F.coalesce("canonical", "term").alias("term")))


def drop_terms(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """T4 for large word lists: (id, pos, term) minus terms listed in
    ``words`` (column ``word``) — an anti-join, broadcast behind a size
    check; positions of the kept tokens are unchanged."""
    w = broadcast_if_small(words.select(F.col("word").alias("term")).distinct())
    return tokens.join(w, "term", "left_anti").select(*tokens.columns)


def reassemble(tokens: DataFrame, id_col: str, out: str = "tokens") -> DataFrame:
    """(id, pos, term) -> (id, array of terms in position order)."""
    return tokens.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))),
                    lambda s: s["term"]).alias(out))


def deletion_keys(term_col: str = "term") -> F.Column:
    """The term itself and every single-character deletion of it."""
    t = F.col(term_col)
    n = F.length(t)
    dels = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.concat(F.substring(t, F.lit(1), i - 1),
                                          F.substring(t, i + 1, n)))
    return F.array_distinct(F.concat(F.array(t), F.when(n > 0, dels).otherwise(F.array())))


def spelling_corrections(vocab: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Map every vocabulary term to a correction.

    ``vocab``: (term) distinct corpus terms; ``dictionary``: (term, freq)
    known words.  A known term stays; an unknown term takes the dictionary
    word at edit distance 1 with the highest frequency (ties: smaller word);
    otherwise it stays.  Candidates come from an equi-join on single-deletion
    keys (symmetric deletion neighbourhood), checked with ``levenshtein``;
    no cross join and no cap on candidates.
    Output: (term, correction, status in {known, corrected, unknown}).
    """
    known = dictionary.select("term", "freq")
    v = vocab.select("term").distinct()
    unknown = v.join(known, "term", "left_anti")
    # A term has as many keys as characters: those longer than any known word's neighbour need none.
    near = unknown.filter(F.length("term") <= known.agg(F.max(F.length("term"))).scalar() + 1)
    uk = explode_rows(near, ["term"], deletion_keys(), "_k")
    dk = explode_rows(known, [F.col("term").alias("cand"), "freq"], deletion_keys(), "_k")
    pairs = (uk.join(dk, "_k").select("term", "cand", "freq").distinct()
             .filter(F.levenshtein("term", "cand") == 1))
    best = pairs.groupBy("term").agg(
        F.min_by("cand", F.struct((-F.col("freq")).alias("f"), F.col("cand"))).alias("correction"))
    corrected = unknown.join(best, "term", "left").select(
        "term", F.coalesce("correction", "term").alias("correction"),
        F.when(F.col("correction").isNull(), F.lit("unknown")).otherwise(F.lit("corrected"))
        .alias("status"))
    kept = v.join(known.select("term"), "term", "left_semi").select(
        "term", F.col("term").alias("correction"), F.lit("known").alias("status"))
    return kept.unionByName(corrected)
