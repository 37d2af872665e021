"""The labelled table of the block classifier: small pages, written for this
purpose, and a letter for each of their text blocks (m main text, b other).
``PAGES`` are written out; ``made_pages`` are put together from parts, so that
menus, teasers and notices without a telling name, short paragraphs between
long ones, and names that mislead occur in many neighbourhoods."""

import random

_P = "<p>The river rose again last night and the lower fields are under water for the third time this year.</p>"
_Q = "<p>Farmers met in the hall, where <a href='/x'>the mayor</a> told them that help was on its way.</p>"
_S = "<p>It rained.</p>"

PAGES = [
    # Article with short and long paragraphs, list menu, advert and footer.
    ("<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>"
     "Home</a></li><li><a href='/b'>News</a></li></ul></nav><!-- ad --><div class='ad'>Buy one pair of boots and "
     "get two more today.</div><article><h1>The river is back</h1>" + _P + _S + _Q + "<p>Soon.</p>" + _P +
     "</article><footer>&copy; example &middot; All the rights are kept by us.</footer></body></html>",
     "bbb" + "mmmmmm" + "b"),
    # Paragraphs that are never closed, bold heads, list and quotation in the article.
    ("<body><nav><a href='/'>Start</a> <a href='/c'>Contact</a></nav><article><p><b>High water<br>" + _P + _S +
     "<ul><li>Bring boots</li><li>Bring a lamp, a rope and some bread for the whole day</li></ul><blockquote>We shall "
     "stay.</blockquote><h2>Later</h2>" + _Q + "</article><footer><p>Printed weekly by the river press.</p>"
     "<a href='/i'>Imprint</a></footer>", "b" + "mmmmmmmm" + "bb"),
    # Site header, sidebar of teasers, comments below the article.
    ("<body><header><h1>River Press</h1><p>All the news from the valley since 1901</p></header><main><article><header>"
     "<h1>Third flood</h1></header>" + _P + _P + _S + "</article></main><aside><h3>More</h3><p>Read how the old bridge "
     "was built by hand a long time ago.</p><ul><li><a href='/1'>Bridges</a></li></ul></aside><section id='comments'>"
     "<h2>Comments</h2><div class='comment'><p>I was there and it was worse than you say, believe me.</p></div><div "
     "class='comment'><p>Thanks!</p></div><form><label>Your name</label><button>Send</button></form></section>"
     "<footer>Contact us</footer></body>", "bb" + "mmmm" + "bbb" + "bbb" + "bb" + "b"),
    # Comments, share bar, related list and newsletter form inside the article.
    ("<body><div class='cookie-notice'><p>We use cookies to make this page work for you and for our friends.</p><button>"
     "Fine</button></div><article><h1>Third flood</h1>" + _P + "<div class='share'><a href='#'>Share</a></div>" + _Q +
     "<div class='advert'><p>Our boots keep your feet dry for a lifetime or longer.</p></div>" + _S +
     "<form class='newsletter'><p>Get the news by letter.</p><input></form><div class='related'><h3>Related</h3><ul><li>"
     "<a href='/2'>Second flood</a></li></ul></div><div class='comments'><p>First! What a long and dreadful year it has "
     "been for all of us here.</p></div></article></body>", "bb" + "m" + "m" + "b" + "m" + "b" + "m" + "b" + "bb" + "b"),
    # No article element: plain divisions, menu and links by density.
    ("<body><div><a href='/'>Home</a> | <a href='/n'>News</a> | <a href='/s'>Sports</a></div><div><h1>Third flood in "
     "the valley</h1>" + _P + _Q + _P + "</div><div><a href='/3'>One</a> <a href='/4'>Two</a> <a href='/5'>Three</a>"
     "</div><div class='copyright'>(c) 1999</div></body>", "b" + "mmmm" + "b" + "b"),
    # No article element: named regions around plain paragraphs.
    ("<body><div id='header'>River Press, news from the valley</div><div class='menu'><ul><li><a href='/'>Home</a></li>"
     "<li><a href='/n'>News</a></li></ul></div><div id='content'><h2>Third flood</h2>" + _P + _S + _P + "</div><div "
     "class='sidebar'><p>The weather today is wet with more rain to come in the night.</p></div><div id='footer'><p>"
     "Write to us at the old mill, by the bridge, in the valley.</p></div></body>", "b" + "bb" + "mmmm" + "b" + "b"),
    # Main element with tables, captions and definition lists.
    ("<body><div role='banner'>Valley Times</div><main><h1>Levels</h1>" + _P + "<table><caption>Levels by day</caption>"
     "<tr><th>Day</th><th>Feet</th></tr><tr><td>Monday</td><td>12</td></tr></table><dl><dt>Foot</dt><dd>A third of a "
     "yard</dd></dl><figure><img><figcaption>The mill</figcaption></figure><div>" + _S + "</div>" + _P + "</main><div "
     "role='contentinfo'>About</div></body>", "b" + "mm" + "m" + "mmmm" + "mm" + "m" + "m" + "m" + "b"),
    # A page of links only, and one of an error.
    ("<body><ul><li><a href='/a'>Alpha</a></li><li><a href='/b'>Beta</a></li><li><a href='/c'>Gamma and more</a></li>"
     "</ul></body>", "bbb"),
    # Article whose text stands in divisions and bare text, after a notice.
    ("<body><div role='alert'>Please sign in to read all of this story.</div><article><div><h2>Short</h2><div>Rain fell "
     "on the hills all day and all night, and nobody went out.</div>Bare words stand here as well.<p>End.</p></div>"
     "</article><nav class='pager'><a href='/2'>Next</a></nav></body>", "b" + "m" + "m" + "m" + "m" + "b"),
    # Article with linked paragraphs and a list of sources.
    ("<body><article><h1>Sources</h1><p><a href='/r'>The whole report</a></p>" + _Q + "<ol><li><a href='/s'>Gauge "
     "readings</a></li><li>Letters</li></ol></article><div><p><a href='/t'>To the top</a></p></div></body>",
     "m" + "m" + "m" + "mm" + "b"),
    # No article element: long text with a paragraph of few words between.
    ("<body>" + _P + _P + "<p>So.</p>" + _Q + "<p><a href='/e'>Next</a> <a href='/d'>Last</a></p></body>", "mmmmb"),
    # The article ends the page; a page that breaks off; bare pages.
    ("<body><nav><a href='/'>Home</a></nav><article><h1>Short</h1>" + _P + _S + "</article></body>", "b" + "mmm"),
    ("<body><nav><a href='/'>Home</a></nav><div class='ad'>Boots!</div><article><h1>Cut</h1>" + _P + "<p>The text goes",
     "bb" + "mmm"),
    ("<body>" + _P + "<p>The end of it.</p></body>", "mm"),
    ("<p>Only one short line.</p>", "m"),
    ("No markup at all stands in this one.", "m"),
    ("<body><h1>Head</h1>" + _S + "<div>Last words, and no more.</div>", "mmm"),
]

_WORDS = ("river valley bridge mill field water night rain farmer mayor council school market road hill stone letter week "
          "summer winter house garden window story people morning light paper train village library garden boat").split()
_JOIN = "the of and in a to was that it for on with as his they at be this had from".split()
#: Attributes of boxes that hold main text, and of boxes that hold other text.
_PLAIN = ["", "", " class='content no-sidebar'", " id='page' class='site has-banner'", " class='col-8'", " id='main-content'",
          " class='post-body'", " class='two-columns with-menu'"]
_OTHER = [" class='sidebar'", " id='footer'", " class='cookie-notice'", " class='ad'", " class='site-footer'", " class='menu'",
          " class='related-links'", " class='newsletter-box'", " role='complementary'", " class='comments'", " id='top-banner'"]
_IN_ARTICLE = ["", "", " class='legal-news'", " class='entry-header'", " class='post-content'", " class='lead'"]


def _text(rng: random.Random, lo: int, hi: int, link: float = 0.0) -> str:
    words = [rng.choice(_JOIN if rng.random() < 0.4 else _WORDS) for _ in range(rng.randint(lo, hi))]
    words[0] = words[0].title()
    return " ".join(f"<a href='/{w}'>{w}</a>" if rng.random() < link else w for w in words) + ("." if hi > 6 and link < 1 else "")


def _menu(rng: random.Random) -> tuple[str, str]:
    n = rng.randint(2, 7)
    links = [f"<a href='/{i}'>{_text(rng, 1, 3)}</a>" for i in range(n)]
    if rng.random() < 0.5:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", "b" * n
    return "<div>" + rng.choice([" ", " | ", " &gt; "]).join(links) + "</div>", "b"


def _teasers(rng: random.Random) -> tuple[str, str]:
    n = rng.randint(2, 4)
    return "".join(f"<div><h3><a href='/{i}'>{_text(rng, 2, 5)}</a></h3><p>{_text(rng, 4, 12)} <a href='/{i}'>"
                   "Read all of it</a></p></div>" for i in range(n)), "bb" * n


def _small(rng: random.Random) -> tuple[str, str]:
    """Short lines between links: notices, adverts, imprints without a telling name."""
    return (f"<div>{_text(rng, 1, 4, 1.0)}</div><div>{_text(rng, 3, 10)}</div><div>{_text(rng, 1, 4, 1.0)}</div>", "bbb")


def _loose(rng: random.Random) -> tuple[str, str]:
    """Unnamed text beside an article: an advert, a teaser, a notice."""
    return f"<div><p>{_text(rng, 4, 30)}</p></div>", "b"


def _main(rng: random.Random) -> tuple[str, str]:
    parts, labels = [], ""
    if rng.random() < 0.8:
        k = rng.choice("112")
        parts.append(f"<h{k}>{_text(rng, 2, 8)}</h{k}>")
        labels += "m"
    for _ in range(rng.randint(2, 6)):
        lo, hi, link = rng.choice([(12, 60, 0.0), (12, 60, 0.05), (20, 80, 0.1), (1, 5, 0.0), (12, 30, 0.0)])
        if not labels.strip("m") and len(labels) < 2:
            lo, hi = 12, 50  # short paragraphs stand between long ones
        parts.append(f"<p>{_text(rng, lo, hi, link)}</p>")
        labels += "m"
    parts.append(f"<p>{_text(rng, 12, 40)}</p>")
    return "".join(parts), labels + "m"


def _named(rng: random.Random) -> tuple[str, str]:
    """A region by its tag or name, with text as long as main text."""
    paragraphs = rng.randint(1, 3)
    body = "".join(f"<p>{_text(rng, 3, 25)}</p>" for _ in range(paragraphs))
    tag = rng.choice(["nav", "footer", "aside", "div", "div", "div", "section"])
    attrs = rng.choice(_OTHER) if tag in ("div", "section") else ""
    return f"<{tag}{attrs}>{body}</{tag}>", "b" * paragraphs


def made_pages(n: int, seed: int) -> list[tuple[str, str]]:
    """``n`` labelled pages by a seed: with an ``article`` or without, in plain boxes or in boxes with misleading names."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        article = rng.random() < 0.5
        beside = [_loose] if article else []
        before = [rng.choice([_menu, _menu, _small, _named, *beside])(rng) for _ in range(rng.randint(0, 2))]
        after = [rng.choice([_menu, _teasers, _small, _named, *beside])(rng) for _ in range(rng.randint(0, 2))]
        html, labels = _main(rng)
        if article:
            extra = rng.choice([("", ""), ("", ""), _named(rng), _menu(rng)])
            attrs = rng.choice(_IN_ARTICLE)
            html = f"<article><div{attrs}>{html}</div>{extra[0]}</article>" if attrs else f"<article>{html}{extra[0]}</article>"
            labels += extra[1]
        elif len(labels) > 3 or rng.random() < 0.7:
            html = f"<div{rng.choice(_PLAIN)}>{html}</div>"
        box = rng.choice(["", "", " class='wrapper has-banner'", " id='page' class='no-sidebar'"])
        page = "".join(h for h, _ in before) + html + "".join(h for h, _ in after)
        out.append((f"<html><head><title>t</title></head><body><div{box}>{page}</div></body></html>" if box else
                    f"<body>{page}</body>", "".join(x for _, x in before) + labels + "".join(x for _, x in after)))
    return out


def training_pages() -> list[tuple[str, str]]:
    return PAGES * 4 + made_pages(300, 1)


def held_out_pages() -> list[tuple[str, str]]:
    return made_pages(300, 2)
