"""Term normalisation and spelling correction against brute force."""

from tertulia.operators import normalize as NZ


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_spelling_matches_brute_force(spark):
    words = ["casa", "cosa", "caza", "casas", "perro", "pero", "ñandú", "ñandu", "año", "ano",
             "asa", "cas", "kasa", "perrro", "xyz", "de", "d", "e"]
    freq = {"casa": 5, "cosa": 3, "perro": 4, "pero": 6, "ñandú": 2, "año": 7, "de": 9, "caza": 3}
    vocab = spark.createDataFrame([(w,) for w in words], "term string")
    dictionary = spark.createDataFrame(list(freq.items()), "term string, freq long")
    got = {r.term: (r.correction, r.status) for r in NZ.spelling_corrections(vocab, dictionary).collect()}
    for w in words:
        if w in freq:
            assert got[w] == (w, "known")
            continue
        cands = [d for d in freq if lev(w, d) == 1]
        if not cands:
            assert got[w] == (w, "unknown")
        else:
            best = sorted(cands, key=lambda d: (-freq[d], d))[0]
            assert got[w] == (best, "corrected"), w


def test_normalize_and_reassemble(spark):
    toks = spark.createDataFrame([(1, ["holaaaa", "q", "tal"]), (2, [])], "id long, t array<string>")
    mapping = spark.createDataFrame([("holaaaa", "hola"), ("q", "que")], "term string, canonical string")
    long = NZ.normalize_terms(NZ.explode_tokens(toks, "id", "t"), mapping)
    out = {r.id: r.tokens for r in NZ.reassemble(long, "id").collect()}
    assert out == {1: ["hola", "que", "tal"]}


def test_deletion_keys(spark):
    df = spark.createDataFrame([("abc",), ("aab",)], "term string")
    keys = [set(r[0]) for r in df.select(NZ.deletion_keys()).collect()]
    assert keys == [{"abc", "bc", "ac", "ab"}, {"aab", "ab", "aa"}]


def test_drop_terms_keeps_positions(spark):
    toks = spark.createDataFrame([(1, ["el", "perro", "de", "la", "casa"])], "id long, t array<string>")
    words = spark.createDataFrame([("de",), ("la",), ("el",)], "word string")
    out = sorted((r.pos, r.term) for r in NZ.drop_terms(NZ.explode_tokens(toks, "id", "t"), words).collect())
    assert out == [(1, "perro"), (4, "casa")]


def test_entity_counts_approximate_close(spark):
    from tertulia.operators import entities as X
    ents = spark.createDataFrame([(i, "number", str(i % 50)) for i in range(500)], "id long, kind string, value string")
    exact = X.entity_counts(ents).first()
    approx = X.entity_counts(ents, approximate=True).first()
    assert exact.distinct_values == 50 and abs(approx.distinct_values - 50) <= 3
