"""Registered queries: cleaning, tokens, entities, row features, labels.

All run on the derived ``tweets`` table (whole documents).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import tokens as TK
from ..functions.emoji import emoji_aliases
from ..functions.generators import posexplode_rows
from ..functions.regex import SPACE, NOT_SPACE
from ..operators import entities as X
from ..operators import normalize as NZ
from ..operators import terms as TM
from . import tweets as TW
from .registry import duck_replacement, query, sql_str, with_tweets

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def _tw(spark, sf):
    return TW.tweets(spark, sf)


def _clean_query(spark, sf, fn):
    return _tw(spark, sf).select("tweet_id", fn(F.col("content")).alias("cleaned"))


def _sql_clean(expr: str) -> str:
    return with_tweets(f"SELECT tweet_id, {expr} AS cleaned FROM tweets")


# DuckDB renderings of single stages (x = SQL expression text).
def d_c1(x):
    return f"regexp_replace(regexp_replace({x}, '\\n', '', 'g'), '^{SPACE}+|{SPACE}+\\z', '', 'g')"


def d_c2(x):
    return f"translate({x}, '‘’', {sql_str(chr(39) * 2)})"


def d_emoji(x):
    # The only pictographs in the tweets table are the fixture's two.
    al = emoji_aliases()
    for ch in ["😀", "👍"]:
        x = f"replace({x}, '{ch}', '{al[ch]}')"
    return x


def d_url(x, tok=""):
    return f"regexp_replace({x}, 'http{NOT_SPACE}+', {sql_str(tok)}, 'g')"


def d_user(x, tok="USUARIO"):
    return f"regexp_replace({x}, '(^|{NW})@{W}+', '\\1{tok}', 'g')"


def d_laugh(x, stems, ci=True, first_two=False):
    for s in stems:
        p = ("(?i)" if ci else "") + f"[a-zA-Z]*{s}[a-zA-Z]*"
        if first_two:
            x = f"regexp_replace(regexp_replace({x}, '{p}', 'JAJAJA'), '{p}', 'JAJAJA')"
        else:
            x = f"regexp_replace({x}, '{p}', 'JAJAJA', 'g')"
    return x


def d_num(x):
    return f"regexp_replace({x}, '\\p{{Nd}}+', '', 'g')"


def d_punct(x, chars=C.PUNCT_REMOVED_MAIN):
    return f"translate({x}, {sql_str(chars)}, '')"


def d_squeeze(x):
    """Letter squeeze without back-references: drop a word character that
    equals its predecessor when its run is at least three long."""
    return (f"list_transform([string_split({x}, '')], lambda ch: array_to_string(list_filter(ch, "
            f"lambda c, i: NOT (regexp_full_match(c, '{W}') AND i > 1 AND c = ch[i-1] AND "
            f"((i > 2 AND c = ch[i-2]) OR (i < len(ch) AND c = ch[i+1])))), ''))[1]")


def d_pieces_map(x, fn):
    """Apply ``fn(s, k, p)`` (SQL text) to the alternating word / non-word
    pieces of ``x`` and join them back."""
    return (f"list_transform([regexp_extract_all({x}, '({W}+|{NW}+)', 1)], lambda p: "
            f"array_to_string(list_transform(p, lambda s, k: {fn}), ''))[1]")


def d_hashtag(x):
    body = ("regexp_full_match(s, '" + W + "+') AND k > 1 AND suffix(p[k-1], '#') "
            "AND (length(p[k-1]) >= 2 OR k = 2)")
    camel = r"regexp_replace(regexp_replace(s, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    hash_mark = (f"k < len(p) AND suffix(s, '#') AND (length(s) >= 2 OR k = 1) "
                 f"AND regexp_full_match(p[k+1], '{W}+')")
    return d_pieces_map(x, f"CASE WHEN {body} THEN {camel} WHEN {hash_mark} "
                           f"THEN substr(s, 1, length(s) - 1) ELSE s END")


def d_abbrev(x):
    m = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in C.ABBREVIATIONS) + "}"
    return d_pieces_map(x, f"coalesce({m}[lower(s)], s)")


def d_abbrev_compat(x):
    for a, b in C.ABBREVIATIONS:
        for _ in range(2):
            x = f"regexp_replace({x}, '(^|{NW}){a}({NW}|$)', '\\1{b}\\2')"
    return x


def d_treebank(x):
    for pat, rep in TK.TREEBANK_RULES:
        x = f"regexp_replace({x}, {sql_str(pat)}, {sql_str(duck_replacement(rep))}, 'g')"
    parts = " ".join(f"WHEN {sql_str(w)} THEN [substr(t, 1, {k}), substr(t, {k + 1})]" for w, k in TK.CONTRACTIONS.items())
    return (f"flatten(list_transform(list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda t: t <> ''), "
            f"lambda t: CASE lower(t) {parts} ELSE [t] END))")


def d_words(x):
    return f"regexp_extract_all({x}, '({W}+)', 1)"


def d_long_tokens(list_expr: str, col: str = "token") -> str:
    """SQL body: (tweet_id, pos, token) from a list expression over tweets."""
    return with_tweets(
        f"SELECT tweet_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS {col} "
        f"FROM (SELECT tweet_id, {list_expr} AS l FROM tweets)")


def _long_tokens(df, tokens, col="token"):
    return posexplode_rows(df, ["tweet_id"], tokens, "pos", col)


def d_all_stages(x):
    x = d_emoji(d_c2(d_c1(x)))
    x = d_user(d_url(d_hashtag(x)))
    x = d_laugh(d_squeeze(x), C.LAUGH_STEMS_MAIN)
    return f"lower({d_punct(d_num(d_abbrev(x)))})"


def d_older(x):
    emo = "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in C.OLDER_EMOJI_RANGES) + "]"
    x = d_c2(f"regexp_replace({d_c1(x)}, '{emo}+', '', 'g')")
    x = f"lower({d_hashtag(x)})"
    x = f"regexp_replace({x}, {sql_str(C.older_url_pattern())}, '', 'g')"
    x = d_squeeze(d_user(x, ""))
    x = f"regexp_replace({x}, '[a-zA-Z]*jaj[a-zA-Z]*', 'jajaja', 'g')"
    return d_punct(d_num(x), C.PUNCT_REMOVED_ALL)


def d_masked(x):
    x = d_user(d_url(d_emoji(d_c2(d_c1(x))), "URL"), "USERNAME")
    return f"lower({d_laugh(d_squeeze(x), C.LAUGH_STEMS_SIX, ci=False)})"


# ---------------------------------------------------------------------------
# Cleaning (C1-C16)
# ---------------------------------------------------------------------------
@query("clean_basic", _sql_clean(d_c2(d_c1("content"))))
def clean_basic(spark, sf):
    return _clean_query(spark, sf, lambda c: C.unify_quotes(C.strip_newlines(c)))


@query("clean_emoji", _sql_clean(d_emoji("content")))
def clean_emoji(spark, sf):
    return _clean_query(spark, sf, C.emoji_to_alias)


@query("clean_hashtag_split", _sql_clean(d_hashtag("content")))
def clean_hashtag_split(spark, sf):
    return _clean_query(spark, sf, C.split_hashtags)


@query("clean_url", _sql_clean(d_url("content")))
def clean_url(spark, sf):
    return _clean_query(spark, sf, C.remove_urls)


@query("clean_username", _sql_clean(d_user("content")))
def clean_username(spark, sf):
    return _clean_query(spark, sf, C.mask_usernames)


@query("clean_letrep", _sql_clean(d_squeeze("content")))
def clean_letrep(spark, sf):
    return _clean_query(spark, sf, C.squeeze_repeats)


@query("clean_laughter", _sql_clean(d_laugh("content", C.LAUGH_STEMS_MAIN)))
def clean_laughter(spark, sf):
    return _clean_query(spark, sf, C.normalize_laughter)


@query("clean_laughter_compat",
       _sql_clean(d_laugh("content", C.LAUGH_STEMS_MAIN, ci=False, first_two=True)))
def clean_laughter_compat(spark, sf):
    return _clean_query(spark, sf, lambda c: C.normalize_laughter(c, compat=True))


@query("clean_abbrev", _sql_clean(d_abbrev("content")))
def clean_abbrev(spark, sf):
    return _clean_query(spark, sf, C.expand_abbreviations)


@query("clean_abbrev_compat", _sql_clean(d_abbrev_compat("content")))
def clean_abbrev_compat(spark, sf):
    return _clean_query(spark, sf, lambda c: C.expand_abbreviations(c, compat=True))


def _abbrev_map_sql():
    return "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in C.ABBREVIATIONS) + "}"


@query("clean_abbrev_tokens", d_long_tokens(
    f"list_transform({d_words('content')}, lambda t: coalesce({_abbrev_map_sql()}[lower(t)], t))"))
def clean_abbrev_tokens(spark, sf):
    """C9 on word tokens: each token equal (case-insensitively) to an
    abbreviation becomes its expansion."""
    m = F.create_map(*[F.lit(x) for kv in C.ABBREVIATIONS for x in kv])
    toks = F.transform(TK.word_tokens(F.col("content")),
                       lambda t: F.coalesce(F.try_element_at(m, F.lower(t)), t))
    return _long_tokens(_tw(spark, sf), toks)


@query("clean_number", _sql_clean(d_num("content")))
def clean_number(spark, sf):
    return _clean_query(spark, sf, C.remove_numbers)


@query("clean_punct", _sql_clean(d_punct("content")))
def clean_punct(spark, sf):
    return _clean_query(spark, sf, C.remove_punctuation)


@query("clean_lower", _sql_clean("lower(content)"))
def clean_lower(spark, sf):
    return _clean_query(spark, sf, C.lowercase)


@query("clean_all_stages", _sql_clean(d_all_stages("content")))
def clean_all_stages(spark, sf):
    return _clean_query(spark, sf, lambda c: C.clean_text(c, C.ALL))


@query("clean_default_stages", _sql_clean(f"lower({d_c2(d_c1('content'))})"))
def clean_default_stages(spark, sf):
    return _clean_query(spark, sf, lambda c: C.clean_text(c, C.MAIN))


@query("clean_preset_older", _sql_clean(d_older("content")))
def clean_preset_older(spark, sf):
    return _clean_query(spark, sf, C.clean_older)


@query("clean_preset_masked", _sql_clean(d_masked("content")))
def clean_preset_masked(spark, sf):
    return _clean_query(spark, sf, C.clean_masked)


@query("clean_preset_lower_punct", _sql_clean(f"lower({d_punct(d_c2(d_c1('content')))})"))
def clean_preset_lower_punct(spark, sf):
    return _clean_query(spark, sf, C.clean_lower_punct)


# ---------------------------------------------------------------------------
# Tokens (T1-T7, V7)
# ---------------------------------------------------------------------------
@query("tokenize_treebank", d_long_tokens(d_treebank("content")))
def tokenize_treebank(spark, sf):
    return _long_tokens(_tw(spark, sf), TK.treebank_tokens(F.col("content")))


@query("tokenize_words", d_long_tokens(d_words("content")))
def tokenize_words(spark, sf):
    return _long_tokens(_tw(spark, sf), TK.word_tokens(F.col("content")))


def _d_detok(list_expr):
    x = f"array_to_string({list_expr}, ' ')"
    for pat, rep in TK.DETOKENIZE_RULES:
        x = f"regexp_replace({x}, {sql_str(pat)}, {sql_str(duck_replacement(rep))}, 'g')"
    return x


@query("detokenize", with_tweets(
    f"SELECT tweet_id, {_d_detok(d_treebank('content'))} AS text FROM tweets"))
def detokenize(spark, sf):
    return _tw(spark, sf).select(
        "tweet_id", TK.detokenize(TK.treebank_tokens(F.col("content"))).alias("text"))


def _d_accents(x):
    x = f"strip_accents({x})"
    for k, v in TK.MULTI_CHAR_TRANSLIT.items():
        x = f"replace({x}, {sql_str(k)}, {sql_str(v)})"
    one = TK.SINGLE_CHAR_TRANSLIT
    return f"translate({x}, {sql_str(''.join(one))}, {sql_str(''.join(one.values()))})"


@query("remove_accents", d_long_tokens(
    f"list_transform({d_words('lower(content)')}, lambda t: {_d_accents('t')})"))
def remove_accents(spark, sf):
    return _long_tokens(_tw(spark, sf),
                        TK.strip_accents_tokens(TK.word_tokens(F.lower("content"))))


def _d_stop_list():
    return "[" + ", ".join(sql_str(w) for w in TK.stopwords()) + "]"


@query("remove_stopwords", lambda: d_long_tokens(
    f"list_filter({d_words('lower(content)')}, lambda t: NOT list_contains({_d_stop_list()}, t))"))
def remove_stopwords(spark, sf):
    return _long_tokens(_tw(spark, sf),
                        TK.remove_stopwords(TK.word_tokens(F.lower("content"))))


def _term_map_values():
    return "(VALUES " + ", ".join(f"({sql_str(a)}, {sql_str(b)})" for a, b in TW.TERM_MAP) + \
        ") AS m(term, canonical)"


@query("normalize_terms", with_tweets(
    "SELECT t.tweet_id, t.pos, coalesce(m.canonical, t.term) AS term FROM ("
    f"SELECT tweet_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS term "
    f"FROM (SELECT tweet_id, {d_words('lower(content)')} AS l FROM tweets)) t "
    f"LEFT JOIN {_term_map_values()} ON t.term = m.term"))
def normalize_terms(spark, sf):
    toks = NZ.explode_tokens(
        _tw(spark, sf).select("tweet_id", TK.word_tokens(F.lower("content")).alias("t")),
        "tweet_id", "t")
    return NZ.normalize_terms(toks, TW.term_map(spark)).select("tweet_id", "pos", "term")


SPELL_MIN_DF = 3   # a term seen in >= 3 documents counts as a known word


def _spell_inputs(spark, sf):
    from ..session import cut_lineage
    toks = _tw(spark, sf).select("tweet_id", TK.word_tokens(F.lower("content")).alias("t"))
    terms = TM.doc_terms(toks, "tweet_id", "t")
    # One pass over the text: the (much smaller) term table is checkpointed
    # and both the vocabulary and the dictionary are read from it.
    stats = cut_lineage(TM.vocabulary_stats(terms, "tweet_id"))
    dictionary = stats.filter(F.col("doc_freq") >= SPELL_MIN_DF).select(
        "term", F.col("doc_freq").alias("freq"))
    return stats.select("term"), dictionary


def _d_spelling(tokens):
    """CTEs vocab(term, df) and best(term, cand): spelling by deletion keys, made
    only for terms short enough to be one edit from a known word."""
    return rf"""
vocab AS MATERIALIZED (SELECT term, count(*) AS df FROM (
  SELECT DISTINCT tweet_id, unnest({tokens}) AS term FROM tweets) GROUP BY term),
short AS MATERIALIZED (SELECT term, df, length(term) AS len FROM vocab
  WHERE length(term) <= 1 + (SELECT max(length(term)) FROM vocab WHERE df >= {SPELL_MIN_DF})),
keys AS MATERIALIZED (
  SELECT term, df, term AS k, 0 AS pos, len FROM short
  UNION ALL
  SELECT term, df, substr(term, 1, i - 1) || substr(term, i + 1) AS k, i AS pos, len
  FROM (SELECT term, df, len, unnest(range(1, len + 1)) AS i FROM short)),
pairs AS (
  SELECT DISTINCT u.term, d.term AS cand, d.df AS freq
  FROM (SELECT * FROM keys WHERE df < {SPELL_MIN_DF}) u JOIN (SELECT * FROM keys WHERE df >= {SPELL_MIN_DF}) d ON u.k = d.k
  WHERE (u.pos = 0) <> (d.pos = 0) OR (u.pos > 0 AND d.pos > 0 AND u.pos = d.pos AND u.len = d.len)),
best AS (SELECT term, first(cand ORDER BY freq DESC, cand) AS cand FROM pairs GROUP BY term)"""


@query("spell_correct", with_tweets(rf"""
SELECT term, correction, status FROM (
  SELECT v.term, coalesce(b.cand, v.term) AS correction,
         CASE WHEN v.df >= {SPELL_MIN_DF} THEN 'known' WHEN b.cand IS NULL THEN 'unknown' ELSE 'corrected' END AS status
  FROM vocab v LEFT JOIN best b ON v.term = b.term)""", extra=_d_spelling(d_words("lower(content)"))))
def spell_correct(spark, sf):
    vocab, dictionary = _spell_inputs(spark, sf)
    return NZ.spelling_corrections(vocab, dictionary)


def _d_token_pipeline():
    toks = d_treebank("lower(content)")
    final = "coalesce(m.canonical, b.cand, t.term)"
    return with_tweets(f"""
SELECT tweet_id, CAST(count(term) AS BIGINT) AS n_tokens, {_d_detok("coalesce(list(term ORDER BY pos) FILTER (WHERE term IS NOT NULL), [])")} AS text
FROM (SELECT tweet_id, pos, CASE WHEN NOT list_contains({_d_stop_list()}, term) THEN term END AS term FROM (
  SELECT t.tweet_id, t.pos, {_d_accents(final)} AS term
  FROM (SELECT tweet_id, generate_subscripts(l, 1) AS pos, unnest(l) AS term FROM (
          SELECT tweet_id, CASE WHEN len(l) = 0 THEN [NULL] ELSE l END AS l FROM (SELECT tweet_id, {toks} AS l FROM tweets))) t
  LEFT JOIN best b ON t.term = b.term
  LEFT JOIN {_term_map_values()} ON coalesce(b.cand, t.term) = m.term))
GROUP BY tweet_id""", extra=_d_spelling(toks))


@query("token_pipeline", lambda: _d_token_pipeline())
def token_pipeline(spark, sf):
    """T1-T6 composed: cleaned text, Treebank tokens, spelling, term mapping,
    accents, stop words, text again."""
    from ..operators.token_pipeline import token_pipeline as run
    from ..session import cut_lineage, stored
    tw = stored(_tw(spark, sf).select("tweet_id", TK.treebank_tokens(F.lower("content")).alias("toks")), "pipeline-tokens")
    words = tw.select("tweet_id", F.array_join("toks", " ").alias("words"))  # texts move, not arrays
    stats = cut_lineage(TM.vocabulary_stats(TM.doc_terms_by_id(words, "tweet_id", F.col("words"), []), "tweet_id"))
    known = stats.filter(F.col("doc_freq") >= SPELL_MIN_DF).select("term", F.col("doc_freq").alias("freq"))
    corrections = NZ.spelling_corrections(stats.select("term"), known)
    out = run(tw, "tweet_id", "toks", corrections, TW.term_map(spark), accents=True, stopwords=True)
    return out.select("tweet_id", F.size("tokens").cast("bigint").alias("n_tokens"), "text")


@query("vocabulary_stats", with_tweets(f"""
SELECT term, CAST(sum(tf) AS BIGINT) AS term_freq, count(*) AS doc_freq FROM (
  SELECT tweet_id, term, count(*) AS tf FROM (
    SELECT tweet_id, unnest({d_words('lower(content)')}) AS term FROM tweets) GROUP BY tweet_id, term)
GROUP BY term"""))
def vocabulary_stats(spark, sf):
    toks = _tw(spark, sf).select("tweet_id", TK.word_tokens(F.lower("content")).alias("t"))
    return TM.vocabulary_stats(TM.doc_terms(toks, "tweet_id", "t"), "tweet_id")


@query("word_bigrams", with_tweets(
    "SELECT tweet_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS bigram FROM ("
    "SELECT tweet_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS l FROM ("
    f"SELECT tweet_id, {d_words('lower(content)')} AS w FROM tweets))"))
def word_bigrams(spark, sf):
    return _long_tokens(_tw(spark, sf), TK.word_bigrams(TK.word_tokens(F.lower("content"))),
                        col="bigram")
