"""URL filter: urls taken apart, rules, and reputations against a plain recount."""

import math
import random
import re

from pyspark.sql import functions as F

from tertulia.llm import url_filter as U

LABELS = "doc_id long, quality int, toxic int"


def test_host_path_and_rules(spark):
    cases = {
        "http://A.Example.COM/en/1?x=/es/": ("a.example.com", "/en/1", "example.com/en/"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "https://m.www.example.com/en/9#t": ("m.www.example.com", "/en/9", "www.example.com/en/"),
        "https://www.example.com/en": ("www.example.com", "/en", "com/"),
        "https://badexample.com/en/": ("badexample.com", "/en/", "com/"),
        "x://com/a": ("com", "/a", "com/"),
        "x://com": ("com", "", None),
        "x://net/es/": ("net", "/es/", "net/es/"),
        "x://a.net/frx": ("a.net", "/frx", None),
        "x://a.net?/fr/": ("a.net", "", None),
        "x://a.b.net/fr/x\ny": ("a.b.net", "/fr/x\ny", "net/fr/"),
        "x://ÀB.org/p": ("Àb.org", "/p", None),
        "no scheme/com/": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
    }
    df = spark.createDataFrame([(u, "k") for u in cases], "url string, host string")
    host, path = U.host_path(F.col("url"))
    got = {r[0]: tuple(r)[1:] for r in df.select("url", host.alias("h"), path.alias("p"), U.fitting_rule(host, path).rule).collect()}
    assert got == cases


def test_domain_suffix(spark):
    cases = {"a.b.example.com": ("example.com", "com"), "example.com": ("example.com", "com"), "x.bbc.co.uk": ("bbc.co.uk", "co.uk"),
             "co.uk": ("co.uk", "co.uk"), "me:pw@a.example.org:8080": ("example.org", "org"), "localhost": ("localhost", ""),
             "10.0.0.1:80": ("10.0.0.1", ""), "": ("", ""), "a.example.com.": ("example.com", "com")}
    df = spark.createDataFrame([(h,) for h in cases], "host string")
    assert {r[0]: tuple(r)[1:] for r in df.select("host", *U.domain_suffix(F.col("host"))).collect()} == cases


def test_shown_document(spark):
    cases = {"/en/474.html": 474, "/en/853/": 853, "/fr/825": 825, "/en/x7": None, "/": None, "": None, "/12/ab": None,
             "/" + "9" * 19: None, "/7-title": 7}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r[0]: r[1] for r in df.select("path", U.shown_document(F.col("path"))).collect()} == cases


def brute(pages, labels):
    """Verdicts of rule-less pages by a plain recount, level by level."""
    good = {}
    for d, q, t in labels:
        g = 0 if t == 1 or q == 0 else 1 if q == 1 else None
        if d is not None and g is not None:
            good[d] = min(g, good.get(d, 1))
    counts = {}
    for _, host, doc in pages:
        n, g = counts.get(host, (0, 0))
        counts[host] = (n + (doc in good), g + good.get(doc, 0))
    up = {h: (".".join(h.split(".")[-2:]), h.split(".")[-1]) for h in counts}

    def total(level):
        out = {}
        for h, (n, g) in counts.items():
            k = up[h][level]
            out[k] = (out.get(k, (0, 0))[0] + n, out.get(k, (0, 0))[1] + g)
        return out

    doms, sufs = total(0), total(1)

    def strength(children, parent):
        ex = no = 0
        several = False
        for p in {parent[c] for c in children}:
            cs = [children[c] for c in children if parent[c] == p and children[c][0]]
            if not cs:
                continue
            n, g = map(sum, zip(*cs))
            m = g / n
            several |= len(cs) > 1
            ex += sum(x[0] * (x[1] / x[0] - m) ** 2 for x in cs) - (len(cs) - 1) * m * (1 - m)
            no += (n - sum(x[0] ** 2 for x in cs) / n) * m * (1 - m)
        return 10 if not several else 1000 if ex * 1001 <= no else max(1, no / ex - 1)

    dom_up = {d: s for d, s in up.values()}
    n, g = map(sum, zip(*counts.values()))
    root = (g + 1) / (n + 2)
    ws, wd, wh = strength(sufs, dict.fromkeys(sufs)), strength(doms, dom_up), strength(counts, {h: d for h, (d, _) in up.items()})
    ps = {s: (ws * root + g) / (ws + n) for s, (n, g) in sufs.items()}
    pd = {d: (wd * ps[dom_up[d]] + g) / (wd + n) for d, (n, g) in doms.items()}
    out = {}
    for h, (n, g) in counts.items():
        a = wh * pd[up[h][0]] + g
        b = wh * (1 - pd[up[h][0]]) + n - g
        out[h] = a / (a + b) - U.Z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) >= U.MIN_GOOD
    return out


def test_reputation_against_recount(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.d{i % 7}.{('org', 'net', 'info')[i % 3]}" for i in range(60)] + ["hot.d1.org"] * 30
    rate = {h: rng.choice([0.05, 0.5, 0.95]) for h in hosts}
    labels, pages = [], []
    for doc in range(1500):
        h = rng.choice(hosts)
        pages.append((doc, h, doc))
        if doc % 3:
            labels.append((doc, int(rng.random() < rate[h]), int(rng.random() < 0.05)))
    labels += [(5, 0, 0), (None, 1, 0), (9, None, None), (99999, 1, 0)]
    pages += [(2000 + i, f"new{i}.d{i}.org", None) for i in range(9)]
    want = brute(pages, labels)
    assert set(want.values()) == {True, False}
    df = spark.createDataFrame([(i, f"http://{h}/x/{'' if d is None else d}", "clash") for i, h, d in pages],
                               "page_id long, url string, host string")
    lab = spark.createDataFrame([(*x, "k") for x in labels], LABELS + ", good string")
    got = {r.page_id: r for r in U.judge(df, lab).collect()}
    assert len(got) == len(pages)
    for i, h, _ in pages:
        assert (got[i].host, got[i].rule, got[i].verdict) == (h, None, "allow" if want[h] else "block")


def test_empty_tables_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "x://a.org/1"), (1, "x://a.org/1"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], LABELS)
    assert U.judge(pages, none).count() == 3
    assert {r.verdict for r in U.judge(pages, none).collect()} == {"block"}  # one half, less the bound
    assert U.judge(pages.limit(0), none).count() == 0
    long = spark.createDataFrame([(1, "x://" + "." * 200_000 + "/" + "7" * 200_000)], "page_id long, url string")
    assert re.match(r"\.+$", U.judge(long, none).collect()[0].host)
