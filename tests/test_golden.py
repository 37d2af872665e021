"""Golden strings for the look-around / back-reference operators (expected
values from the reference semantics, FIXTURES §4)."""

import pytest
from pyspark.sql import functions as F

from tertulia.functions import clean as C
from tertulia.functions import features as FE
from tertulia.functions import tokens as TK

HASHTAGS = [
    ("#HablarPorHablar", "Hablar Por Hablar"),
    ("#TVEspaña hola", "TV España hola"),
    ("#ABCDef", "ABC Def"),
    ("#añoNuevo", "año Nuevo"),
    ("#abc123Def", "abc123Def"),
    ("#ñÑa", "ñÑa"),
    ("a#b #CdEf ##EfGh (#GhIj) é#XyZ", "a#b Cd Ef #Ef Gh (Gh Ij) é#XyZ"),
    ("http://x.co/Ab#FooBar fin", "http://x.co/Ab#FooBar fin"),
]


def one(spark, text, expr):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(expr(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize("text,expected", HASHTAGS)
def test_hashtag_split(spark, text, expected):
    assert one(spark, text, C.split_hashtags) == expected


def test_letter_squeeze(spark):
    assert one(spark, "hoolaaa siiii 111 ÑÑÑ __ ___", C.squeeze_repeats) == "hoola si 1 Ñ __ _"


def test_laughter_first_two(spark):
    jaj = lambda c: C.normalize_laughter(c, compat=True, stems=["jaj"])
    xd = lambda c: C.normalize_laughter(c, compat=True, stems=["xd"])
    assert one(spark, "jaja jajajaja JAJA jajaja", jaj) == "JAJAJA JAJAJA JAJA jajaja"
    assert one(spark, "xD xd xdxd jaxdja axd", xd) == "xD JAJAJA JAJAJA jaxdja axd"


def test_laughter_intent_all_hits_case_insensitive(spark):
    assert one(spark, "jaja JAJA xD lol ok", C.normalize_laughter) == "JAJAJA JAJAJA JAJAJA JAJAJA ok"


def test_abbreviation_first_two_case_sensitive(spark):
    def q_only(c):
        from tertulia.functions.regex import replace_first, whole_word
        for _ in range(2):
            c = F.regexp_replace(c, replace_first(whole_word("q")), "$1que")
        return c
    assert one(spark, "x q d xq pq X Q áx x", q_only) == "x que d xq pq X Q áx x"


def test_abbreviations_intent(spark):
    assert one(spark, "x q d xq pq X Q áx x", C.expand_abbreviations) == \
        "por que de porque porque por que áx por"


def test_username(spark):
    assert one(spark, "@user @ñandu a@b", C.mask_usernames) == "USUARIO USUARIO a@b"


def test_uppercase_count(spark):
    assert one(spark, "HOLA ÁRBOL ESPAÑA ABC_D A1B OK", FE.uppercase_words) == 2
    assert one(spark, "jaja jajajaja JAJA jajaja", FE.uppercase_words) == 1


def test_length(spark):
    assert one(spark, "", FE.tweet_length) == 1
    assert one(spark, "a b  c ", FE.tweet_length) == 5


def test_newline_delete(spark):
    assert one(spark, "HOLA\nmundo", C.strip_newlines) == "HOLAmundo"
    assert one(spark, " \t　 a b  ", C.strip_newlines) == "a b"


def test_word_tokens(spark):
    assert one(spark, "½ x² año_1 d'l", TK.word_tokens) == ["½", "x²", "año_1", "d", "l"]


def test_punctuation_keeps_marks(spark):
    assert one(spark, "¡Hola, @ana! ¿qué? #tag_1: fin.", C.remove_punctuation) == \
        "Hola @ana! ¿qué? #tag_1: fin"


def test_emoji_alias(spark):
    assert one(spark, "a 😀 b", C.emoji_to_alias) == "a :grinning_face: b"


def test_treebank_and_detokenize(spark):
    toks = one(spark, 'Hola, "mundo" (bien). Fin?', TK.treebank_tokens)
    assert toks == ["Hola", ",", "``", "mundo", "''", "(", "bien", ")", ".", "Fin", "?"]
    assert one(spark, 'Hola, (bien). Fin?', lambda c: TK.detokenize(TK.treebank_tokens(c))) == \
        'Hola, (bien). Fin?'


def test_accents(spark):
    assert one(spark, "Ñandú ß Ærø ¿qué?", TK.strip_accents) == "Nandu ss AErø ?que?".replace("ø", "o")


def test_stopwords_list_is_sparks_spanish_list():
    words = TK.stopwords("spanish")
    assert "de" in words and "que" in words and len(words) >= 300
