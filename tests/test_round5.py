"""Tests of the fifth round: terms counted where their rows lie, row features by cheaper searches."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tertulia.functions import features as FE
from tertulia.functions import tokens as TK
from tertulia.operators import terms as TM


@pytest.mark.parametrize("size, at_a_time", [(1, 1), (3, 2), (7, 3), (50, 1000)])
def test_terms_of_rows_that_stand_together(size, at_a_time):
    rng = random.Random(size)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "train", "dev"]),
             rng.choice([None, "", " ", " ".join(rng.choices("abcñ", k=rng.randint(1, 6))), " a  b "])) for _ in range(50)]
    rows.sort(key=lambda r: (r[0] or 0, r[1] or ""))
    schema = pa.schema([("id", pa.int64()), ("split", pa.string()), ("w", pa.string())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + size]), schema)], schema=schema)
               for i in range(0, len(rows), size)]
    got = [tuple(r.values()) for b in TM.term_counter(["id", "split"], at_a_time)(iter(batches)) for r in b.to_pylist()]
    want = Counter((i, s, w) for i, s, t in rows for w in (t or "").split())
    assert len(got) == len(want) and {(i, s, w): n for i, s, w, n in got} == dict(want)


def test_terms_by_id_are_those_of_the_token_lists(spark):
    rng = random.Random(5)
    bits = ["hola", "Ñandú", "x1", "_", "²", "日本", "𝒜", "😀", ".", " ", "\n", "'", "-", "é", "́", " "]
    rows = [(rng.choice([None, *range(40)]), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for _ in range(400)] + [(7, None)]
    df = spark.createDataFrame([(i, "train" if (i or 0) % 2 else None, t) for i, t in rows], "id long, split string, t string").repartition(3)
    old = TM.doc_terms(df.select("id", "split", TK.word_tokens(F.col("t")).alias("w")), "id", "w", carry=["split"])
    new = TM.doc_terms_by_id(df, "id", TK.words_apart(F.col("t")), ["split"])
    assert new.schema.names == old.schema.names and [f.dataType for f in new.schema] == [f.dataType for f in old.schema]
    assert Counter(map(tuple, new.collect())) == Counter(map(tuple, old.collect()))


def test_row_features_as_by_the_plain_patterns(spark):
    rng = random.Random(6)
    bits = ["A", "AB", "ÑA", "Ab", "aaa", "ñññ", "...", "___", "𝒜𝒜𝒜", "\n\n\n", "11", "1", " ", "-", "jaj", "JAJ", "hah", "xd", "x", "d", "lmao", "É"]
    rows = [("".join(rng.choices(bits, k=rng.randint(0, 6))),) for _ in range(3000)] + [(None,), ("",)]
    c, w = F.col("t"), r"[\p{L}\p{N}_]"
    plain = [F.regexp_count(c, F.lit(rf"(?<!{w})[A-Z][A-Z]+(?!{w})")).cast("bigint"), F.when(c.rlike("|".join(FE.LAUGH_STEMS_FEATURE)), 1).otherwise(0),
             F.when(c.rlike(rf"({w})\1{{2,}}"), 1).otherwise(0)]
    now = [FE.uppercase_words(c), FE.has_laughter(c), FE.has_letter_repetition(c)]
    df = spark.createDataFrame(rows, "t string")
    for r in df.select("t", F.array(*plain).alias("plain"), F.array(*now).alias("now")).collect():
        assert r.plain == r.now, r.t
    # No regular expression runs for laughter, none looks behind at every character for capitals.
    p = df.select(*now)._jdf.queryExecution().optimizedPlan().toString()
    assert "jaj|hah" not in p and not re.search(r"regexp_count\(t#\d+, \(\?<!", p)
