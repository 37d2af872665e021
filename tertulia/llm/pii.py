"""Personal data by pattern, and information-theoretic sanitisation of the
terms that give it away (DataFrame functions only).

*Protected entities* are the valid matches of four patterns (email, ip, card,
phone), each found leftmost and non-overlapping over the whole text.  What a
term tells about an entity is estimated from the corpus: a term, any run of
``TERM_CHARS`` letters or more outside of the matches, co-occurs with an entity
where both stand in a document, however far apart.  With n(t) the documents
that hold term t, n(e) those that hold entity e, n(e,t) those that hold both
and N all documents,

    PMI(e;t) = log2(N n(e,t) / (n(e) n(t)))    IC(e) = log2(N / n(e))

and disclosure = PMI / IC: 0 for independent terms, 1 for a term that implies
the entity.  A pair counts if the entity stands in different contexts (the
``CONTEXT`` characters around it) in the documents that hold both: copies of one
passage are one piece of evidence.  A term with a disclosure of ``REMOVE`` or
more is removed, of ``GENERALISE`` or more is generalised to its shape, wherever
it stands in a document that holds that entity.  Base spans are masked by kind.

Scale: a document's spans are found inside its row.  Entities seen in one
context only say nothing and go first; only documents that hold one of the
others give (entity, term) pairs, each once a document, counted with partial
aggregates, so an entity of a third of all documents moves a count a task and
term.  Their terms meet the words of all documents before any shuffle if the
list is proven short (``TERM_ROWS``), else in a shuffle join; the words of a
document get their places only where one of them discloses something there.

Defined results: null or empty text has no spans; every input row gives one
result row, repeated rows too; spans are code-point offsets, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, keyed, short, stored

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "term", "shape")

# The patterns below match what the plain ones do.  Possessive quantifiers and
# the look-behind (a match starts at the head of a run, or where the last match
# ended) keep them linear and free of recursion on very long runs.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every valid match contains; texts without it skip the kind.
GUARDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"(?:[0-9][\x20-]?+){11}[0-9]"),
    "phone": lambda t: t.contains("+"),
}
#: Characters on either side that tell one context of an entity from another.
CONTEXT = 80
REMOVE, GENERALISE = 0.9, 0.5
TERM_ROWS = 500_000
#: A term is a run of letters of at least this length.
TERM_CHARS = 3


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.filter(F.split(F.reverse(_digits(m)), ""), lambda x: x != "")

    def step(x: Column, i: Column) -> Column:
        v = x.cast("int") * (i % 2 + 1)
        return v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.transform(d, step), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    n = F.length(_digits(m))
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    ip_ok = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    card_ok = F.when(n.between(12, 19), _luhn(m)).otherwise(False)
    return (F.when(kind == 0, True).when(kind == 1, ip_ok).when(kind == 2, card_ok)
            .otherwise(n.between(9, 15)))


def _matches(kind: int, text: Column) -> Column:
    """array<struct<k, i, gap, m, before, after>> of one kind: each match with
    the number of code points between it and the last one."""
    name = KINDS[kind]
    pieces = F.split(text, PATTERNS[name], -1)
    found = F.regexp_extract_all(text, F.lit(PATTERNS[name]), F.lit(0))
    left = F.zip_with(found, pieces, lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    both = F.zip_with(left, F.slice(pieces, F.lit(2), F.size(pieces)), lambda x, a: F.struct(
        x["m"].alias("m"), F.length(x["p"]).alias("gap"),
        F.right(x["p"], F.lit(CONTEXT)).alias("before"), F.left(a, F.lit(CONTEXT)).alias("after")))
    rows = F.transform(F.filter(both, lambda x: x["m"].isNotNull()), lambda x, i: F.struct(
        F.lit(kind).alias("k"), i.alias("i"), x["gap"].alias("gap"), x["m"].alias("m"),
        x["before"].alias("before"), x["after"].alias("after")))
    return F.when(GUARDS[name](text), rows)


def base_spans(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, k, s, e, m, before, after): every row of ``docs`` (rid,
    doc_id, text) once with k = -1, and each valid match; kept in the shared
    folder."""
    t = F.coalesce(F.col("text"), F.lit(""))
    head = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).alias("i"), F.lit(0).alias("gap"),
                            F.lit("").alias("m"), F.lit("").alias("before"), F.lit("").alias("after")))
    none = F.slice(head, 1, 0)
    items = F.concat(head, *[F.coalesce(_matches(k, t), none) for k in range(len(KINDS))])
    rows = docs.select("rid", "doc_id", F.inline(items))
    upto = W.partitionBy("rid", "k").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("e", F.sum(F.col("gap") + F.length("m")).over(upto))
    return cut(rows.filter((F.col("k") < 0) | _valid(F.col("k"), F.col("m")))
               .select("rid", "doc_id", "k", (F.col("e") - F.length("m")).alias("s"), "e", "m", "before", "after"))


def telling_entities(spans: DataFrame) -> DataFrame:
    """(rid, k, m, lo, hi): the documents that hold an entity which occurs in
    several contexts, and the least and greatest hash of its contexts there."""
    ctx = F.xxhash64(F.lower("before"), F.lower("after"))
    held = (spans.filter(F.col("k") >= 0).groupBy("rid", "k", F.lower("m").alias("m"))
            .agg(F.min(ctx).alias("lo"), F.max(ctx).alias("hi")))
    several = (held.groupBy("k", "m").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
               .filter("_lo <> _hi").select("k", "m"))
    return cut(held.join(several, ["k", "m"]).select("rid", "k", "m", "lo", "hi"))


def _outside(text: Column) -> Column:
    """``text`` with a blank for what any of the patterns matches, lower-cased."""
    out = text
    for k, name in enumerate(KINDS):
        out = F.when(GUARDS[name](text), F.regexp_replace(out, PATTERNS[name], " ")).otherwise(out)
    return F.lower(out)


def _terms(text: Column) -> Column:
    """The distinct terms of a lower-cased text."""
    return F.array_distinct(F.filter(F.split(text, r"[^\p{L}]+"), lambda w: F.length(w) >= TERM_CHARS))


def disclosing_terms(docs: DataFrame, spans: DataFrame, held: DataFrame,
                     remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """(k, m, t, disclosure): what the corpus says terms reveal.  ``docs``: (rid, text)."""
    ids = held.select("rid").distinct()
    texts = docs.join(short(cut(ids)), "rid", "left_semi").select("rid", _terms(_outside(F.col("text"))).alias("t"))
    pairs = (texts.join(held, "rid").select("k", "m", "lo", "hi", F.explode("t").alias("t"))
             .groupBy("k", "m", "t").agg(F.count("*").alias("n_et"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    pairs = cut(pairs.filter("lo <> hi AND n_et > 1").drop("lo", "hi"))
    wanted = pairs.select("t").distinct()
    # Distinct in the row, so that counting combines on the map side.
    words = docs.select(F.explode(_terms(F.lower(F.coalesce("text", F.lit(""))))).alias("t"))
    if pairs.count() <= TERM_ROWS:
        n_t = words.join(F.broadcast(wanted), "t", "left_semi").groupBy("t").agg(F.count("*").alias("n_t"))
    else:
        n_t = words.groupBy("t").agg(F.count("*").alias("n_t")).join(wanted, "t", "left_semi")
    n_e = (spans.filter("k >= 0").select("k", F.lower("m").alias("m"), "rid").groupBy("k", "m")
           .agg(F.countDistinct("rid").alias("n_e")))
    total = spans.filter("k = -1").agg(F.count("*").alias("n"))
    x = pairs.join(n_t, "t").join(n_e, ["k", "m"]).crossJoin(total)
    pmi = F.log2(F.col("n").cast("double") * F.col("n_et") / (F.col("n_e").cast("double") * F.col("n_t")))
    ic = F.log2(F.col("n").cast("double") / F.col("n_e"))
    return (x.withColumn("disclosure", F.when(ic > 0, pmi / F.when(ic > 0, ic)).otherwise(0.0))
            .filter(F.col("disclosure") >= min(remove, generalise))
            .select("k", "m", "t", "disclosure"))


def placed_terms(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, t, s, e): where the terms of the documents in ``wanted`` (rid, ...) stand.  ``docs``: (rid, text)."""
    t = docs.join(short(cut(wanted.select("rid").distinct())), "rid", "left_semi")
    gaps, words = F.split("text", r"\p{L}+", -1), F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    both = F.zip_with(words, F.slice(gaps, 1, F.size(words)), lambda w, g: F.struct(w.alias("w"), F.length(g).alias("g")))
    rows = t.select("rid", F.posexplode(both).alias("i", "x"))
    upto = W.partitionBy("rid").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select("rid", "x.w", F.sum(F.col("x.g") + F.length("x.w")).over(upto).alias("e"))
    return (rows.filter(F.length("w") >= TERM_CHARS)
            .select("rid", F.lower("w").alias("t"), (F.col("e") - F.length("w")).alias("s"), "e"))


def find_pii(docs: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE, rid: str | None = None) -> DataFrame:
    """(rid, doc_id, spans): per row of ``docs`` (doc_id, text) all spans as
    array<struct<s, k, e>> in order, k indexing ALL_KINDS.  ``rid``: the column
    of a row number that ``docs`` brings."""
    if rid is None:
        docs = keyed(docs.select("doc_id", "text")).select(F.struct("_f", "_i").alias("rid"), "doc_id", "text")
    else:
        docs = docs.select(F.col(rid).alias("rid"), "doc_id", "text")
    spans = base_spans(docs)
    held = telling_entities(spans)
    shown = disclosing_terms(docs, spans, held, remove, generalise)
    told = cut(held.join(shown, ["k", "m"]).groupBy("rid", "t").agg(F.max("disclosure").alias("d")))
    places = placed_terms(docs, told).join(told, ["rid", "t"])
    # Not inside of a match.
    found = spans.filter("k >= 0").select("rid", F.col("s").alias("_s"), F.col("e").alias("_e"))
    places = places.join(found, (places["rid"] == found["rid"]) & (F.col("s") < F.col("_e")) & (F.col("e") > F.col("_s")), "left_anti")
    extra = places.select("rid", F.lit(None).cast("long").alias("doc_id"),
                          F.when(F.col("d") >= remove, len(KINDS)).otherwise(len(KINDS) + 1).alias("k"), "s", "e")
    every = spans.select("rid", "doc_id", "k", "s", "e").unionByName(extra)
    one = F.struct(F.col("s").cast("long").alias("s"), F.col("k").cast("int").alias("k"),
                   F.col("e").cast("long").alias("e"))
    return (every.groupBy("rid")
            .agg(F.max("doc_id").alias("doc_id"), F.collect_list(F.when(F.col("k") >= 0, one)).alias("spans"))
            .select("rid", "doc_id", F.array_sort("spans").alias("spans")))


def spans_text(spans: Column, kinds: int = len(ALL_KINDS)) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(F.filter(spans, lambda x: x["k"] < kinds), lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda x: x["k"] == ALL_KINDS.index(kind))).cast("long")


def sanitise(docs: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """(doc_id, text): base spans masked as [KIND], disclosing terms removed
    or generalised to their shape (letters as ``x``).  Overlapping spans give
    way to the one that starts first."""
    # Numbered in a written table: two scans of ``docs`` need not number its rows alike.
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "pii-rows")
    found = find_pii(keyed, remove, generalise, "rid").select("rid", "spans")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""))

    def apply(acc: Column, x: Column) -> Column:
        t = F.coalesce(F.col("text"), F.lit(""))
        word = F.substring(t, (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int"))
        mask = F.when(x["k"] == len(KINDS) + 1, F.regexp_replace(word, r"\p{L}", "x")).otherwise(
            F.get(names, x["k"]))
        gap = F.substring(t, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
        return F.when(x["s"] < acc["at"], acc).otherwise(F.struct(
            x["e"].alias("at"), F.concat(acc["out"], F.array(gap, mask)).alias("out")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    j = keyed.join(found, "rid", "left")
    done = F.aggregate("spans", start, apply)
    j = j.withColumn("_z", done)
    rest = F.substring(F.coalesce("text", F.lit("")), (F.col("_z.at") + 1).cast("int"), F.lit(2147483647))
    return j.select("doc_id", F.when(F.size("spans") > 0, F.concat(F.array_join("_z.out", ""), rest))
                    .otherwise(F.col("text")).alias("text"))
