"""The operators against brute force on small tables with nulls, empty and
repeated rows, and clashing column names."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tertulia.llm import html_text, ngram_join, passages, pii, secrets, toxicity, warc
from tertulia.llm.ann import nearest
from tertulia.llm.common import spans_text
from tertulia.llm.decontaminate import contaminated, decontaminate
from tertulia.llm.html_training import PAGES
from tertulia.llm.line_dedup import dedup_lines
from tertulia.llm.mixing import mix_sources
from tertulia.llm.shingles import shingle_sets

DOC = "doc_id long, text string"


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "a\n\nb\nc"),
            (7, "q\nq\nq\nq\nq"), (1, "a\nb\nc\nd"), (None, "a\nb\nc")]
    df = spark.createDataFrame([(*r, "k", "n") for r in rows], DOC + ", _id string, n_lines string")
    got = sorted((tuple(r) for r in dedup_lines(df).select("doc_id", "text", "n_lines", "n_removed").collect()), key=str)
    want = [(1, "a\nb\nc\nd", 4, 0), (1, "a\nb\nc\nd", 4, 0), (2, "x\ny", 6, 4), (3, "a\nb", 2, 0), (4, None, 0, 0),
            # Five equal lines hold the window three times: the later two cover lines 1 to 4.
            (5, "", 0, 0), (6, "", 3, 3), (7, "q", 5, 4), (None, "", 3, 3)]
    assert got == sorted(want, key=str)
    assert dedup_lines(df.limit(0)).count() == 0


def test_passages_in_mid_line(spark):
    """Passages of 50 words on one line or over some, joined to other words at both ends."""
    import corpus_pipeline
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]

    def words(n):
        return rng.choices(vocabulary, k=n)

    def runs(text):
        w = (text or "").split()
        return {tuple(w[i:i + 50]) for i in range(len(w) - 49)}

    shared = [words(n) for n in (50, 50, 61, 200)]
    rows = [(i, "\n".join(" ".join(words(rng.randrange(1, 40))) for _ in range(12))) for i in range(40)]
    for i in range(40):
        before, after = rows[i][1], " ".join(words(rng.randrange(60, 150)))
        p = shared[i % 4]
        rows[i] = (i, f"{before} " + " ".join(p[:20]) + rng.choice([" ", "\n", "  "]) + " ".join(p[20:]) + f" {after}\n")
    rows += [(100, "word " * 30), (101, None), (102, ""), (103, "few words"), (0, rows[0][1]), (None, "x " + rows[1][1])]
    df = spark.createDataFrame([(*r, "k") for r in rows], DOC + ", n_gone string")
    got = passages.dedup_passages(df).select("doc_id", "text", "n_gone").collect()
    assert len(got) == len(rows)
    left = {r.doc_id: r.text for r in got}
    count = collections.Counter(x for t in left.values() for x in runs(t))
    assert max(count.values()) == 1
    for i in range(4):  # the first occurrences stay whole, as do words outside of passages
        assert left[i] == rows[i][1]
    for i, t in rows[4:40]:
        own = t.split()
        at = next(j for j in range(len(own)) if own[j:j + 20] == shared[i % 4][:20])
        assert left[i].split()[:at] == own[:at] and t.startswith(left[i][:len(" ".join(own[:at]))])
    assert left[101] is None and left[102] == "" and left[103] == "few words"
    stage = corpus_pipeline.ngram_join(spark, spark.createDataFrame(rows[:40], DOC), None).collect()
    assert max(collections.Counter(x for r in stage for x in runs(r.text)).values()) == 1
    assert passages.dedup_passages(df.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["a", "b", "c", None])) for i in range(400)]
    rows += [(None, "x y", "a"), (7, None, "c"), (5, "z", "only")]
    got = mix_sources(spark.createDataFrame(rows, DOC + ", source string").withColumnRenamed("x", "y")).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    targets = {(r.source_size, r.target) for r in got}
    assert abs(sum(t for _, t in targets) - total) < 1e-6 and all(t <= 3 * s for s, t in targets)
    taken = collections.Counter()
    for r in got:
        taken[r.source_size, r.target] += r.taken
    assert total - 30 <= sum(taken.values()) <= total
    assert all(abs(taken[s, t] - t) <= 60 for s, t in targets)
    assert mix_sources(spark.createDataFrame([], DOC + ", source string")).count() == 0
    assert [r.taken for r in mix_sources(spark.createDataFrame([(1, None, "a")], DOC + ", source string")).collect()] == [0]


def spans_of(text, patterns):
    found = []
    for order, (kind, pattern, valid) in enumerate(patterns):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if valid(m)]
    return ",".join(x[2] for x in sorted(found))


def luhn(digits):
    v = [int(c) * (i % 2 + 1) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in v) % 10 == 0


def n_digits(s):
    return len(re.sub("[^0-9]", "", s))


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
       ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
       ("card", r"[0-9]([\x20-]?[0-9])+",
        lambda m: 12 <= n_digits(m[0]) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))),
       ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= n_digits(m[0]) <= 15)]


def test_pii_base_spans(spark):
    rng = random.Random(2)
    parts = ["a@b.c", "a@b.cx%y@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "000000000001.2.3.4", "4111 1111 1111 1111",
             "4111111111111112", "+1 (407) 555-7710", "+1..2", "+12345678", "é", "\U0001F600", " ", "\n", "x", "12-34",
             "@", "+", "9" * 25]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(12))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "ab" * 50_000 + "@"), (203, "1" * 100_000), (0, rows[0][1]), (None, "a@b.c")]
    df = spark.createDataFrame(rows, DOC)
    got = sorted((r.doc_id or -1, r.s) for r in pii.find_pii(df).select(
        "doc_id", pii.spans_text(pii.F.col("spans"), 4).alias("s")).collect())
    assert got == sorted((i or -1, spans_of(t, PII)) for i, t in rows)
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_disclosure(spark):
    rows = [(i, f"{w} Zarquon writes from {w}{w} as z@q.org about {w}") for i, w in
            enumerate("oak elm ash fir yew bay box fig".split())]
    rows += [(100 + i, f"from the hills they write about {i}") for i in range(60)]
    df = spark.createDataFrame(rows, DOC)
    found = {r.doc_id: r.s for r in pii.find_pii(df).select("doc_id", pii.spans_text(pii.F.col("spans")).alias("s")).collect()}
    text = dict(rows)
    assert all("term:" + ":".join(map(str, re.search("Zarquon", text[i]).span())) in found[i] for i in range(8))
    assert all(found[i] == "" for i in text if i >= 100)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Zarquon" not in clean[0] and "[EMAIL]" in clean[0] and clean[130] == text[130]


def test_pii_terms_far_from_the_entity(spark):
    """A name hundreds of characters before the address, all letter runs of joined names, words inside matches,
    copies of one passage, and counts of disclosure by a plain recount."""
    import math
    far = "the day went on as days do and nothing much was said of it " * 9
    trees = "oak elm ash fir yew bay box fig".split()
    rows = [(i, f"Jean-Luc O'Brien came by. {far} {w} write {w} {w} to zq.anon@mail7.org for {w} {w} more {w} Brien") for i, w in enumerate(trees)]
    rows += [(50 + i, f"copied words Quillfeather here zz@copy.net and so on {'x' * 90}") for i in range(4)]
    rows += [(100 + i, f"{far} from the hills they came by for more and write about {i} " + ("Brien" if i < 4 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, DOC)
    found = {r.doc_id: r.s.split(",") for r in pii.find_pii(df).select("doc_id", pii.spans_text(pii.F.col("spans")).alias("s")).collect()}

    def spans(kind, i):
        t = dict(rows)[i]
        return sorted(t[int(a):int(b)] for k, a, b in (x.split(":") for x in found[i] if x) if k == kind)

    def disclosure(t):
        words = lambda x: set(re.findall(r"[^\W\d_]{3,}", x.lower()))
        n_et, n_t = sum(t in words(x) for i, x in rows if i < 8), sum(t in words(x) for _, x in rows)
        return math.log2(len(rows) * n_et / (8 * n_t)) / math.log2(len(rows) / 8)

    for i in range(8):
        assert spans("term", i) == ["Jean", "Luc"] and disclosure("jean") == 1
        assert spans("shape", i) == ["Brien", "Brien"] and 0.5 <= disclosure("brien") < 0.9
        assert spans("email", i) == ["zq.anon@mail7.org"]
    assert all(spans("term", 50 + i) == [] for i in range(4)) and disclosure("write") < 0.5
    assert all(found[100 + i] == [""] for i in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Jean" not in clean[3] and "O'xxxxx" in clean[3] and "[EMAIL]" in clean[3]


SEC = [("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= 6),
       ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]


def test_secrets(spark):
    rng = random.Random(3)
    parts = ["token=", "TOKEN : ", "api_key='", "ApiKey=", "secret", "paſſword=", "abc", "abcdef123", "AKIA", "AKIAKIA",
             "A" * 16, "0a" * 12, "İ", "=", "\"", " "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(15))) for i in range(300)] + [(900, None), (901, ""), (0, "x")]
    out = secrets.scan_secrets(spark.createDataFrame([(*r, 1) for r in rows], DOC + ", spans long"))
    base = secrets.F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    got = sorted((r.doc_id, r.s) for r in out.select("doc_id", spans_text(base).alias("s")).collect())
    assert got == sorted((i, spans_of(t, SEC)) for i, t in rows)


def test_secret_checksums():
    import zlib
    body, check, n = "a1B2" * 7 + "zz", "", 0
    n = zlib.crc32(body.encode())
    for _ in range(6):
        n, r = divmod(n, 62)
        check = secrets.BASE62[r] + check
    a = secrets._automaton()
    assert [k for *_, k in secrets.scan(f"x ghp_{body}{check} y", a)] == ["github"]
    assert secrets.scan(f"x ghp_{body}{check[::-1]}0 y", a) == []
    jwt = ".".join(base64.urlsafe_b64encode(b'{"a":1}').decode().rstrip("=") for _ in range(3))
    assert [k for *_, k in secrets.scan(jwt, a)] == ["jwt"]


def test_html_training_pages(spark):
    tree = html_text.train_tree(spark)
    for html, labels in PAGES:
        x = html_text.block_features(html_text.cut_blocks(html))
        assert "".join("m" if html_text.is_main(tree, f) else "b" for f in x) == labels
    page = ("<html><head><title>T</title></head><nav><a href=x>n</a></nav><article><h1>H &amp; I</h1><p>a <b>b</b>\n c"
            "&nbsp;&lt;d&gt;<br>e<p>f<!-- no --><script>no</script></article><footer>no")
    df = spark.createDataFrame([(1, page, "k"), (2, None, "k"), (3, "", "k"), (4, "<p", "k")],
                               "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert got == {1: "H & I\n\na b c <d> e\n\nf", 2: "", 3: "", 4: ""}


@pytest.mark.parametrize("html, want", [
    ("<html><head><meta charset=utf-8><title>T <b></title><body><p>one<p>two", ["one", "two"]),
    ("<head><title>T</title><style>s{}</style><article><p>one</p></article>", ["one"]),
    ("<head><title>T</title>one<p>two", ["one", "two"]),
    ("<head><title>T</title><noscript>no</noscript></head><p>one", ["one"]),
    ("<p>one <svg viewBox='0 0 1 1'/> two</p><p>three", ["one two", "three"]),
    ("<p>one</p><iframe src=x><p>two</p><object data=y><p>three", ["one", "two", "three"]),
    ("<p>one</p><iframe src=x><p>two</p><iframe src=z>no</iframe><p>three", ["one", "two", "three"]),
    ("<p>one</p><object>no<object>no</object>no</object><template>no</template><math><mi>no</mi></math><p>two", ["one", "two"]),
    ("<p>a<svg><title>no</title><text>no</text></svg>b<p>c<!-- <svg> -->d<svg>no<!-- </svg> -->no</svg>", ["ab", "cd"]),
    ("<p>one<object data=y /><p>two<iframe/><header><p>three", ["one", "two", "three"])])
def test_html_unclosed_elements(html, want):
    assert [b.text for b in html_text.cut_blocks(html)] == want


def test_warc_round_trip(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "a", fake), (2, None, "x" + fake + fake + "WARC/1.0\r\n"), (3, "b\r\nc", None), (4, "d", ""),
            (None, "f", "x"), (7, "g", "x"), (7, "g", "x"), (8, "h", "\r\n\r\n"), (9, "é", "ü WARC/1.0\r\nWARC-Type: é")]
    rows += [(i, "u", "p" * i + fake) for i in range(20, 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    ids = collections.defaultdict(list)
    for i, _, h in rows:
        ids[h or ""].append(i)
    want = []
    for i, _, h in rows:
        first = min((x for x in ids[h or ""] if x is not None), default=None)
        digest = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        want.append((i, digest, "response" if i == first else "revisit", None if i == first else first,
                     (h or "") if i == first else None))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = [tuple(r) for r in warc.round_trip(df).select(
            "page_id", "payload_digest", "record_type", "refers_to", "payload").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_urls_with_line_separators(spark, monkeypatch):
    """Every kind of line break and head-like text in a url; scans that split the files otherwise."""
    breaks = ["\u2028", "\u2029", "\u0085", "\n", "\r\n", "\x0b", "\x0c", "\x1e", "\r"]
    rows = [(i, f"http://a/{b}Content-Length: 5{b}WARC-Refers-To: <urn:page:3>{b}x", f"payload {i} " * 5) for i, b in enumerate(breaks)]
    rows += [(20, "plain", "payload 20"), (21, "plain\u2028", "payload 20")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    read = warc.read_warc

    def other_splits(s, path):
        out = read(s, path)
        s.conf.set("spark.sql.files.maxPartitionBytes", "64")  # whatever is scanned from now on
        return out

    monkeypatch.setattr(warc, "read_warc", other_splits)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = {r.page_id: r for r in warc.round_trip(df).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows)
    for i, url, html in rows[:-1]:
        assert (got[i].payload, got[i].record_type, got[i].refers_to) == (html, "response", None)
        assert got[i].url == "".join(c if c.isprintable() or c == " " else "".join(f"%{x:02X}" for x in c.encode()) for c in url)
    assert (got[21].record_type, got[21].refers_to) == ("revisit", 20)


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    words = item.split()
    rows = [(1, f"before {item.upper()} after"), (2, " ".join(words[6:] + ["x"] + words[:6])), (3, " ".join(words[:5])),
            (4, "nothing here"), (5, None), (6, ""), (1, "clean twin")]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], DOC + ", coverage double")
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_tiles, r.coverage) for r in contaminated(df, bench).collect())
    assert got == [(1, 1, 1, 1.0), (2, 1, 2, 1.0)]
    assert sorted(r.text or "" for r in decontaminate(df, bench).collect()) == sorted(
        t or "" for i, t in rows if (i, t) not in (rows[0], rows[1]))
    assert contaminated(df, bench.limit(0)).count() == 0


def test_html_held_out_pages(spark):
    """The tree splits on words and neighbours, and holds on pages that it was not trained on."""
    from tertulia.llm.html_training import held_out_pages
    tree = html_text.train_tree(spark)

    def splits(t):
        return set() if isinstance(t, bool) else {html_text.FEATURES[t[0]]} | splits(t[2]) | splits(t[3])

    assert {"links", "region", "inside"} < splits(tree)
    assert splits(tree) & {"words", "words_before", "words_after"} and splits(tree) & {"links_before", "links_after"}
    right = collections.Counter()
    for html, labels in held_out_pages():
        blocks = html_text.cut_blocks(html)
        for x, label in zip(html_text.block_features(blocks), labels, strict=True):
            right[html_text.is_main(tree, x), label] += 1
    assert right[True, "m"] / (right[True, "m"] + right[True, "b"]) > 0.98
    assert right[True, "m"] / (right[True, "m"] + right[False, "m"]) > 0.98


def test_html_names_that_mislead(spark):
    tree = html_text.train_tree(spark)
    p = "The river rose again last night and the lower fields are under water for the third time this year."
    nav, ad = "<nav><a href='/'>Home</a></nav>", "Buy one pair of boots and get two more today."
    cases = {f"<div class='content no-sidebar'><h1>Head</h1><p>{p}</p><p>{p}</p></div>": ["Head", p, p],
             f"<div id='page' class='site has-banner'>{nav}<article><h1>Head</h1><p>{p}</p></article></div>": ["Head", p],
             f"<article><h1>Head</h1><section class='legal-news'><p>{p}</p></section><p>{p}</p></article>": ["Head", p, p],
             f"<article><div class='entry-header'><h1>Head</h1></div><p>{p}</p></article>": ["Head", p],
             f"{nav}<div><p>{ad}</p></div><article><h1>Head</h1><p>{p}</p></article>": ["Head", p],
             f"<article><h1>Head</h1><p>{p}</p><div class='ad-box'><p>{ad}</p></div></article><div id='site-footer'>{ad}</div>": ["Head", p]}
    assert {h: html_text.main_text(h, tree).split("\n\n") for h in cases} == cases


def test_two_rotations_meet_few_pairs(monkeypatch, spark):
    """Recall and the share of all pairs that is scored, at the setting for larger tables; then the query at it."""
    from tertulia.llm import ann
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(40, 64))
    x = centre[rng.integers(0, 40, 12_000)] + rng.normal(size=(12_000, 64)) * 1.1
    rotations, tables, probes = next(s for most, s in ann.SETTINGS if most is None or len(x) <= most)
    assert rotations == 2
    assert ann.buckets(np.zeros((0, 64)), 0, 192, 2).shape == (0, 192)
    u, q = ann.unit(x), np.arange(0, 12_000, 120)
    exact = np.argsort(-(u[q] @ u.T), axis=1)[:, 1:21]
    seen, scored = np.zeros((len(q), len(x)), bool), 0
    for t in range(tables):
        own, near = ann.buckets(u, t, 1, 2)[:, 0], ann.buckets(u[q], t, probes, 2)
        assert near.shape == (len(q), probes) and (np.diff(np.sort(near, 1)) > 0).all()
        for i in range(len(q)):
            hit = np.isin(own, near[i])
            scored += hit.sum()
            seen[i] |= hit
    assert np.take_along_axis(seen, exact, 1).mean() >= 0.9
    assert scored / seen.size < 0.35
    monkeypatch.setattr(ann, "SETTINGS", [(None, (2, 12, 192))])
    few = [(int(i), x[i].tolist()) for i in range(2000)]
    got = {(r.query_id, r.vec_id) for r in nearest(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()}
    want = {(a, v) for a, _, v in exact_nearest(few)}
    assert len(got & want) / len(want) >= 0.9


def brute_tiles(q, d, n):
    """Greedy string tiling by comparing all places."""
    in_q, in_d, tiles = set(), set(), []
    while True:
        best = (n - 1, 0, 0)
        for i in range(len(q)):
            for j in range(len(d)):
                k = 0
                while i + k < len(q) and j + k < len(d) and q[i + k] == d[j + k] and i + k not in in_q and j + k not in in_d:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < n:
            return tiles
        in_q |= set(range(i, i + k))
        in_d |= set(range(j, j + k))
        tiles.append(k)


@pytest.mark.parametrize("pairs", [3, 4_000_000])
def test_decontamination_against_brute_force(spark, monkeypatch, pairs):
    from tertulia.llm import decontaminate as D
    monkeypatch.setattr(D, "PAIRS", pairs)
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices("abcdefgh", k=rng.choice([1, 2, 3, 4, 12, 20])))) for i in range(25)]
    items += [(90, "z " * 30), (91, "x y z w")]
    docs = []
    for i in range(60):
        words = rng.choices("abcdefghij", k=rng.randrange(0, 40))
        for _ in range(2):
            t = rng.choice(items)[1].split()
            a = rng.randrange(len(t))
            words[rng.randrange(len(words) + 1):0] = t[a:] + t[:a]
        docs.append((i, " ".join(words)))
    docs += [(100, "z " * 50), (101, "one X, Y; z W two"), (102, "x y z"), (103, None)]
    block = D.Block(items, 5)
    for _, text in docs:
        d = (text or "").lower().replace(",", "").replace(";", "").split()
        want = {}
        for k, t in items:
            q = t.split()
            if len(q) >= D.MIN_ITEM and (tiles := brute_tiles(q, d, min(5, len(q)))):
                want[k] = (sum(tiles), len(tiles), max(tiles))
        assert {m["item_id"]: (m["n_matched"], m["n_tiles"], m["longest"]) for m in block.matches(text)} == want
    if pairs == 3:
        return
    df, bench = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, contaminated(df, bench).collect()))
    assert one == sorted(map(tuple, contaminated(df, bench, block_chars=100).collect())) != []
    assert (101, 91) in {x[:2] for x in one}
    left = sorted(r.doc_id for r in decontaminate(df, bench).collect())
    assert left == sorted(r.doc_id for r in decontaminate(df, bench, block_chars=100).collect())
    assert left == sorted({i for i, _ in docs} - {x[0] for x in one})


def test_repetitive_texts_take_array_time():
    import time
    from tertulia.llm.decontaminate import Block
    t0 = time.perf_counter()
    assert Block([(1, "z " * 1000)], 5).matches("z " * 4000)[0]["coverage"] == 1
    assert secrets.scan("eyJ" * 100_000, secrets._automaton()) == []
    assert time.perf_counter() - t0 < 20


def test_toxicity(spark):
    rng = random.Random(4)
    calm = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.choices(calm, k=30) + (["grobian", "lummox"] if bad else []))))
        labels.append((i, int(bad)))
    model = toxicity.fit(spark.createDataFrame(rows, DOC), spark.createDataFrame(
        labels + [(None, 1), (5000, None)], "doc_id long, toxic int"))
    probe = [(1, "word1 grobian word2 word3"), (2, "word1 word2"), (3, None), (4, ""), (5, "such a grobjan and lummoxx here")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(probe, DOC), model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] == got[2] and got[5] > 0.5
    lex = toxicity.Lexicon({"grobian": 4.0})
    assert toxicity.features("grobian", lex)[0] > 0 and toxicity.features('he "grobian" x "', lex)[1] > 0
    empty = toxicity.fit(spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.lexicon == {}


def test_levenshtein_automaton_against_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]
    rng = random.Random(5)
    terms = {"".join(rng.choices("abc", k=rng.randrange(5, 8))): 1.0 for _ in range(15)}
    lex = toxicity.Lexicon(terms)
    for _ in range(2000):
        w = "".join(rng.choices("abc", k=rng.randrange(4, 9)))
        assert (lex.weight(w) > 0) == (min(distance(w, t) for t in terms) <= 1), w


def exact_nearest(rows, k=20):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, x, out = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), set()
    for i in np.flatnonzero(ids % 20 == 0):
        s = np.einsum("ij,j->i", x, x[i])
        out |= {(int(ids[i]), n + 1, int(ids[j])) for n, j in enumerate(
            [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k])}
    return out


def test_nearest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5) * rng.uniform(.1, 5)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(100)] + [(20, rows[20][1])]
    rows += [(2000, None), (2020, [0.0] * 5), (2040, [1.0, None, 0.0, 0.0, 0.0]),
             (2060, [1.0, float("nan"), 0.0, 0.0, 0.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"], r.vec_id) for r in nearest(df, block=32).collect()}
    want = exact_nearest(rows)
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
    assert nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("n, factor, least", [(2000, 1, 0.95), (2000, 5, 0.95), (2000, 100, 0.95), (400, 100, 0.93),
                                              (2000, None, 0.9)])
def test_nearest_with_unequal_norms(spark, n, factor, least):
    """64 dimensions, one vector longer than the others, or norms over several powers of two."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n // 50, 64))[rng.integers(n // 50, size=n)] + 0.7 * rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if factor:
        x[7] *= factor
    else:
        x *= rng.lognormal(size=(n, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {(r.query_id, r.vec_id) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {(q, v) for q, _, v in exact_nearest(rows)}
    assert len(got) == len(want) and len(got & want) >= least * len(want)


def test_nearest_widens_its_probes(spark):
    """One probe in one table meets few candidates; each query still gets all its neighbours."""
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 64)))]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tables=1, probes=1).collect()
    assert len(got) == 20 * 20 and {r["rank"] for r in got} == set(range(1, 21))


def brute_components(rows):
    sets = [frozenset(s.tolist()) for s in shingle_sets([t for _, t in rows])]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            o = len(s & sets[j])
            if s and 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("part", [1024, 16])
def test_ngram_components(spark, monkeypatch, part):
    monkeypatch.setattr(ngram_join, "PART", part)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)]

    def doc(n):
        return rng.choices(vocabulary, k=n)

    def edited(w, p):
        return [rng.choice(vocabulary) if rng.random() < p else x for x in w]

    shared, base = doc(60), doc(150)
    texts = [" ".join(doc(rng.randrange(1, 90)) + (shared if i % 2 else [])) for i in range(50)]
    texts += [" ".join(edited(base, rng.choice([.005, .02, .04]))) for _ in range(50)]
    for _ in range(15):
        b = doc(rng.randrange(5, 200))
        texts += [" ".join(edited(b, 0.015 * j)) for j in range(4)]
    texts += ["", None, "a b", "A b", "a  B\n", " ", "x y z w", "X Y Z W"] + [" ".join(base)] * 4
    rows = list(zip(rng.sample(range(1000), len(texts)), texts)) + [(None, texts[5]), (None, "alone with no id")]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    got = sorted((tuple(r) for r in ngram_join.near_components(df).collect()), key=str)
    assert got == brute_components(rows)
    if part == 16:
        assert ngram_join.near_components(df.limit(0)).count() == 0


def test_one_row_of_each_component(spark):
    """Copies of a row, an id with two texts, copies without an id, rows without words."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a)] * 5 + [(2, a), (2, b), (3, b), (3, c + " end"), (None, c + " end"), (None, d), (None, d)]
    rows += [(4, None), (4, ""), (None, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], DOC + ", k long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each(df).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, c + " end"), (None, d), (4, None), (4, ""), (None, "")], key=str)
    assert ngram_join.one_of_each(df).columns == df.columns


@pytest.mark.parametrize("block", [7, 500_000])
def test_components_in_blocks(spark, monkeypatch, block):
    """A long path, a star, a repeated edge and a loop, in one block and in many."""
    from tertulia.llm import components as C
    monkeypatch.setattr(C, "BLOCK", block)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 - i) for i in range(1, 30)] + [(70, 60), (70, 60), (5, 5)]
    got = C.components(spark.createDataFrame(edges, "u long, v long").repartition(5).checkpoint()).collect()
    want = {i: 0 for i in range(41)} | {i: 971 for i in range(971, 1001)} | {60: 60, 70: 60}
    assert len(got) == len(want) and {r["node"]: r["label"] for r in got} == want


def test_shingles_against_tuples():
    rng = random.Random(6)
    texts = [None, "", " \n", "a b", "A  b\tc"] + [" ".join(rng.choices(["a", "B", "é", "ccc"], k=rng.randrange(40)))
                                                  for _ in range(50)]
    for t, s in zip(texts, shingle_sets(texts)):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        assert len(s) == len({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else ())
