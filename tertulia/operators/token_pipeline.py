"""The composed token half of the cleaner (T1-T6): tokens, spelling, term
mapping, accents, stop words, text again.

Spelling and mapping are functions of the term alone, so they are composed
into one table of the terms that change before they meet any token.  The
distinct terms of a row meet it: those of the ``COMMON_TERMS`` most frequent in
a broadcast, so only rare ones are shuffled, and only what changes goes on to
its document.  Documents move once by id, as texts where their tokens have no
blanks.  Accents and stop words are column expressions after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as TK
from ..session import stored

# Terms that meet their changes in a broadcast.
COMMON_TERMS = 100_000


def term_changes(corrections: DataFrame | None, mapping: DataFrame | None) -> DataFrame | None:
    """(term, final): mapping after spelling, for the terms that either changes.
    ``corrections``: (term, correction, status) as of ``spelling_corrections``;
    ``mapping``: (term, canonical)."""
    spelled = None if corrections is None else corrections.filter("status = 'corrected'").select("term", "correction")
    direct = None if mapping is None else mapping.select("term", "canonical").dropDuplicates(["term"])
    if spelled is None:
        return None if direct is None else direct.select("term", F.col("canonical").alias("final"))
    if direct is None:
        return spelled.select("term", F.col("correction").alias("final"))
    by = direct.select(F.col("term").alias("correction"), "canonical")
    both = spelled.join(by, "correction", "left").select("term", F.coalesce("canonical", "correction").alias("final"))
    return both.unionByName(direct.join(spelled.select("term"), "term", "left_anti")
                            .select("term", F.col("canonical").alias("final")))


def term_hits(rows: DataFrame, id_col: str, changes: DataFrame) -> DataFrame:
    """(id, term, final) of the terms of ``rows`` (id, _toks) that change, once for each row."""
    pairs = rows.select(id_col, F.explode(F.array_distinct("_toks")).alias("term")).filter(F.col("term").isNotNull())
    top = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(COMMON_TERMS).select("term")
    common = top.join(changes, "term", "left").select("term", "final", F.lit(True).alias("_common"))
    met = pairs.join(F.broadcast(common), "term", "left")
    rare = met.filter("_common IS NULL").select(id_col, "term").join(changes, "term")
    return met.filter("final IS NOT NULL").select(id_col, "term", "final").unionByName(rare.select(id_col, "term", "final"))


def token_pipeline(df: DataFrame, id_col: str, tokens_col: str, corrections: DataFrame | None = None,
                   mapping: DataFrame | None = None, accents: bool = False, stopwords: bool = False) -> DataFrame:
    """(id, tokens, text): ``tokens_col`` through the stages that are switched
    on, in the fixed order spelling, mapping, accents, stop words, and
    detokenised.  Rows whose tokens all go, or that had none, keep their id
    with an empty list and text; ids are taken to be unique."""
    tokens = F.col(tokens_col)
    changes = term_changes(corrections, mapping)
    if changes is None:
        kept = df.select(id_col, F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
        if accents:
            kept = kept.withColumn("tokens", TK.strip_accents_tokens(F.col("tokens")))
        if stopwords:
            kept = kept.withColumn("tokens", TK.remove_stopwords(F.col("tokens")))
    else:
        known = F.coalesce(tokens, F.array().cast("array<string>"))
        words = F.array_join(known, " ")
        plain = F.coalesce(F.split(words, " ") == known, F.lit(False))
        docs = df.select(id_col, F.when(plain, words).alias("_words"), F.when(~plain, known).alias("_toks"), F.lit(None).alias("_hit"))
        hits = term_hits(df.select(id_col, tokens.alias("_toks")), id_col, stored(changes, "term-changes"))
        both = docs.unionByName(hits.select(id_col, F.struct("term", "final").alias("_hit")), allowMissingColumns=True)
        both = both.groupBy(id_col).agg(F.collect_list("_words").alias("_words"), F.collect_list("_toks").alias("_toks"),
                                        F.map_from_entries(F.collect_set("_hit")).alias("_to"))
        stops = TK.stopwords() if stopwords else []

        def placed(row):
            """(pos, term) of the terms of a row that stay."""
            row = F.transform(row, lambda t: F.coalesce(F.try_element_at("_to", t), t))
            if accents:  # ASCII has none
                row = F.transform(row, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(TK.strip_accents(t)))
            row = F.transform(row, lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
            return F.filter(row, lambda x: x["term"].isNotNull() & ~x["term"].isin(*stops) if stops else x["term"].isNotNull())

        rows = F.concat(F.transform("_words", lambda w: placed(F.split(w, " "))), F.transform("_toks", placed))
        kept = both.select(id_col, F.array_sort(F.flatten(rows))["term"].alias("tokens"))
    return kept.select(id_col, "tokens", TK.detokenize(F.col("tokens")).alias("text"))
