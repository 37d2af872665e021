"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at its block-level tags into flat blocks.  Each block has its
number of words and share of linked words, the same of the blocks before and
after it, and what its place says: its kind of tag, whether an ``article`` or
``main`` holds it (or any is on the page), and whether an enclosing element is
a region of navigation, advertising, forms or comments by its tag, role, or a
word of its class or id.  Such names are weighed, not believed: ``no-sidebar``,
``has-banner`` and ``legal-news`` name no region (a name counts if it and all
words joined to it mean regions or boxes), and the feature is the share of the
page's words that stand outside of the element, so a wrapper of the whole page
counts little whatever it is called.  A decision tree over these, trained with
Spark ML on the small labelled table of html_training.py, tells main text from
the rest.

Scale: pages are cut and classified one by one in Arrow batches, with no
shuffle; the tree is a few dozen numbers.  Defined results: null, empty or
text-free html gives the empty string; an unclosed comment, script, style or
tag runs to the end of the page; a head ends where anything begins that a head
cannot hold, closed or not; of svg, objects, frames and the like that are
self-closing or never closed only the tag goes; repeated rows each get their
row; other columns are carried through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after",
            "kind", "inside", "page_has", "region")
MAX_DEPTH = 8
MIN_LEAF = 3

_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)(?=[\s/>])" + _ATTRS + r">.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(" + _ATTRS + r")>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
#: Elements that go with what they hold.
EMBEDDED = frozenset("noscript template svg math iframe object".split())
IN_HEAD = frozenset("html head title base basefont bgsound link meta noscript template".split())
_TITLE_END = re.compile(r"</title\s*>", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KIND = {**dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 1.0), **dict.fromkeys(("p", "blockquote", "pre"), 2.0),
        **dict.fromkeys(("li", "dt", "dd"), 3.0), **dict.fromkeys(("td", "th", "figcaption", "caption"), 4.0)}
REGION_TAGS = frozenset("nav footer aside form menu dialog button select textarea fieldset".split())
REGION_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu "
                         "menubar toolbar tablist".split())
REGION_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored "
                         "sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs crumbs footer header "
                         "masthead topbar comment comments commentlist reply replies respond disqus discussion cookie "
                         "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
                         "subscription signup login share sharing social related recommended widget widgets search "
                         "toolbar pagination pager copyright legal disclaimer skip outbrain taboola".split())
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Words that leave a name's meaning to the word beside them (entry-header is a headline, site-header is not).
NEUTRAL = frozenset("area bar block bottom box btn button buttons col column container content div form global group id "
                    "inner item items left link links list main module outer page panel right row section site slot "
                    "spot text top unit wrap wrapper".split())
_JOINED = re.compile(r"[a-z]+|[0-9]+")


class Block(NamedTuple):
    text: str
    words: int
    links: float
    kind: float
    inside: float
    region: float


def is_region(tag: str, attrs: str, inside: bool) -> bool:
    if tag in REGION_TAGS or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("body", "html", "article", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        name = m[1].lower()
        if name == "role" and value in REGION_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and any(map(names_region, value.split())):
            return True
    return False


def names_region(name: str) -> bool:
    """Whether a class or id names a region: one of its words does, and no other says more than box or place."""
    words = [w for w in _JOINED.findall(name) if not w.isdigit()]
    return not REGION_NAMES.isdisjoint(words) and all(w in REGION_NAMES or w in NEUTRAL for w in words)


def embedded_ends(html: str) -> dict[int, int]:
    """End of the start tag -> end of the element, of each EMBEDDED element that is closed."""
    opened: dict[str, list[int]] = {}
    ends = {}
    for m in MARKUP.finditer(html):
        tag = (m[3] or "").lower()
        if tag not in EMBEDDED:
            continue
        if not m[2]:
            if not m[4].endswith("/"):
                opened.setdefault(tag, []).append(m.end())
        elif opened.get(tag):
            ends[opened[tag].pop()] = m.end()
    return ends


def cut_blocks(html: str) -> list[Block]:
    """The flat blocks of a page that hold text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # enclosing block elements: tag, inside article, outermost region's number
    inside, region, regions = False, 0, 0
    kind, parts, linked, anchors = 0.0, [], 0, 0
    in_head, ends = False, None

    def take(chunk: str) -> None:
        nonlocal linked
        if chunk:
            parts.append(t := unescape(chunk))
            if anchors:
                linked += len(t.split())

    def close() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(1.0, linked / len(words)), kind,
                                 float(inside), region))
            parts.clear()
            linked = 0

    at = 0
    while m := MARKUP.search(html, at):
        chunk = html[at:m.start()]
        in_head = in_head and not chunk.strip()
        if not in_head:
            take(chunk)
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1]:
                close()
            continue
        if tag == "head":
            close()
            in_head = not m[2]
            continue
        if in_head and not m[2]:
            in_head = tag in IN_HEAD
            if tag == "title":
                end = _TITLE_END.search(html, at)
                at = end.end() if end else at
                continue
        if tag in EMBEDDED:
            if tag != "svg":
                close()
            if not m[2]:
                ends = embedded_ends(html) if ends is None else ends
                at = ends.get(at, at)
            continue
        if tag in INLINE:
            if tag == "a":
                anchors = max(0, anchors - 1) if m[2] else (0 if m[4].rstrip().endswith("/") else 1)
            elif tag == "br":
                parts.append(" ")
            continue
        close()
        anchors = 0
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            kind = 0.0
        else:
            if tag == "p" or tag in KIND:  # these end an open paragraph or a sibling of their own kind
                while stack and stack[-1][0] in KIND and (stack[-1][0] == "p" or stack[-1][0] == tag):
                    stack.pop()
            inside, region = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            if tag not in VOID:
                if not region and is_region(tag, m[4], inside):
                    region = regions = regions + 1
                stack.append((tag, inside or tag in ("article", "main"), region))
        inside, region = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        kind = next((KIND[s[0]] for s in reversed(stack) if s[0] in KIND), 0.0)
    take(html[at:])
    close()
    # A region's number becomes the share of the page's words outside of it.
    held: dict[float, int] = {}
    for b in out:
        held[b.region] = held.get(b.region, 0) + b.words
    total = sum(held.values())
    return [b._replace(region=1 - held[b.region] / total if b.region else 0.0) for b in out]


def block_features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of each block."""
    page_has = float(any(b.inside for b in blocks))
    near = [(0.0, 0.0), *((float(b.words), b.links) for b in blocks), (0.0, 0.0)]
    return [(*near[i + 1], *near[i], *near[i + 2], b.kind, b.inside, page_has, b.region)
            for i, b in enumerate(blocks)]


def train_tree(spark: SparkSession, pages: list[tuple[str, str]] | None = None):
    """The tree, as nested (feature, threshold, below, above) with booleans at
    the leaves, from labelled pages (html, one letter for each block: m is main text)."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    if pages is None:
        from .html_training import training_pages
        pages = training_pages()
    rows = []
    for html, labels in pages:
        blocks = cut_blocks(html)
        if len(blocks) != len(labels):
            raise ValueError(f"{len(labels)} labels for {[b.text for b in blocks]}")
        rows += [(*x, float(y == "m")) for x, y in zip(block_features(blocks), labels)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in (*FEATURES, "label"))).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=MAX_DEPTH, maxBins=128, minInstancesPerNode=MIN_LEAF, seed=1).fit(
        VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df))

    def read(node):
        if node.numDescendants() == 0:
            return bool(node.prediction() > 0.5)
        s = node.split()
        return (s.featureIndex(), s.threshold(), read(node.leftChild()), read(node.rightChild()))

    return read(model._java_obj.rootNode())


def is_main(tree, x: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(html: str | None, tree) -> str:
    blocks = cut_blocks(html) if html else []
    return "\n\n".join(b.text for b, x in zip(blocks, block_features(blocks)) if is_main(tree, x))


def text_column(html: Column, tree) -> Column:
    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(h, tree) for h in pages.to_pylist()], pa.string())

    return run(html)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` in place of its html (an input column of that name is replaced)."""
    tree = train_tree(pages.sparkSession)
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, "text")]
    return pages.select(*keep, text_column(F.col(html_col), tree).alias("text"))
