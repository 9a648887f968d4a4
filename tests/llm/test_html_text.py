import html
import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from docflow.llm.html_text import Page, extract, main_text
from docflow.llm.q_html_text import op8_html_extraction

P = "Some longer paragraph of plain words that makes up the article and goes on for a while."
NAV = '<nav><ul>' + "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(8)) + "</ul></nav>"
FOOT = "<footer><p>&copy; Somebody, all rights reserved. Imprint and other words of no use to anyone at all.</p></footer>"
ASIDE = f'<div class="sidebar"><p>{P} aside</p></div><aside><p>{P}</p></aside>'


def article(markup):
    return " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", re.sub(r"</?b>", "", markup))).split())


def test_query_equals_the_articles(spark):
    rows = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = op8_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows)
    for r in got:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", rows[r.page_id].html, re.S)
        assert r.text == article(inner[1]) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        (f"<body>{NAV}<main><h1>Title</h1><p>{P}</p><p>Sh is.</p><p>{P}</p></main>{ASIDE}{FOOT}</body>", f"Title {P} Sh is. {P}"),
        (f"<body>{NAV}<div id=content><div class=post><h2>T</h2><p>{P}<p>{P} <i>in</i>line</div></div>{ASIDE}{FOOT}", f"T {P} {P} inline"),
        (f'<body><header><a href=/>Home</a> A header with words</header><div><p>{P}</p><p>{P}</p><p>x</p><p>{P}</p></div><form><p>{P}</p><input name=q></form>{FOOT}', f"{P} {P} x {P}"),
        (f'<article><p>{P}</p><div class="advert">Buy now {P}</div><p>{P}</p><section id="comments"><p>{P} reader</p></section></article>', f"{P} {P}"),
        (f'<body><div class="cookie-notice"><p>{P} cookies</p></div><article><h1>A &amp; B</h1><p>caf&eacute; &#8212; &lt;b&gt; &nbsp; x{P}</p></article></body>', f"A & B café — <b> x{P}"),
        (f"<article><p>{P}</p><article class=comment><p>{P} reader</p></article><p>end</p></article>", f"{P} end"),
        (f"<article><ul><li>One<li>Two <b>bold</b>ly</ul><table><tr><td>a<td>b<tr><td>c</table><p>{P}</article>", f"One Two boldly a b c {P}"),
        (f"<article><p>{P}<script>if (a < b) '</p>'</script> more<style>p>a{{}}</style><br>next <!-- <p>no</p> -->line</p></article>", f"{P} more next line"),
        (f"<article><p>{P} <a href='/x?a>b'>a link</a>, and <img alt='>'>more</p><p>{P} cut <a hre", f"{P} a link, and more {P} cut"),
        (f'<div class="layout with-sidebar"><div class=sidebar><p>{P} aside</p></div><div data-note="a hidden b" class=post><p>{P}</p><p>{P}</p></div></div>', f"{P} {P}"),
        (f'<article><p>{P}</p></article><div class="comments"><p>{P} one</p><p>{P} two</p><p>{P} three</p></div>', P),
        (f'<body><div hidden><p>{P}</p></div><div role="dialog"><p>{P}</p></div><section><p>{P} x</p><p>{P} y</p></section></body>', f"{P} x {P} y"),
        (f'<div class="page has-sidebar"><div class=sidebar><p>{P} {P} {P}</p></div><main><p>{P}</p></main></div>', P),
        (f'<div class="ad"><p>{P}</p></div><article><p>Short.</p></article>', "Short."),
        ("<p>only text", "only text"), ("just text &lt; here", "just text < here"), ("", ""), ("<html><body></body></html>", ""), ("<nav>menu</nav>", ""), ("<!-- never closed <p>x</p>", ""), ("<p>a < b and 1<2</p>", "a < b and 1<2"), ("<P CLASS='x'>Upper</P>", "Upper"),
    ],
)
def test_known_pages(markup, text):
    assert main_text(markup) == text


class Plain(HTMLParser):
    """A tree of well-formed markup, and its densities by the formula, node by node from the top."""

    def __init__(self, markup):
        super().__init__()
        self.root = self.at = {"tag": "html", "up": None, "kids": []}
        self.nodes = [self.root]
        self.feed(markup)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.at["kids"].append(tag)
            return
        node = {"tag": tag, "up": self.at, "kids": []}
        self.at["kids"].append(node)
        self.nodes.append(node)
        self.at = node

    def handle_endtag(self, tag):
        self.at = self.at["up"]

    def handle_data(self, data):
        self.at["kids"].append(len(" ".join(data.split())))

    def counts(self, node, linked=False):
        """Characters, tags, characters in links, links."""
        up = node
        while up and not linked:
            linked, up = up["tag"] == "a", up["up"]
        c = t = lc = lt = 0
        for kid in node["kids"]:
            if isinstance(kid, int):
                c, lc = c + kid, lc + kid * linked
            elif isinstance(kid, str):
                t += 1
            else:
                below = self.counts(kid, linked)
                c, t, lc, lt = c + below[0], t + below[1] + 1, lc + below[2], lt + below[3] + (kid["tag"] == "a")
        return c, t, lc, lt

    def densities(self):
        body = self.counts(next(x for x in self.nodes if x["tag"] == "body"))
        out = []
        for node in self.nodes:
            c, t, lc, lt = self.counts(node)
            t = max(t, 1)
            base = math.log(c / max(c - lc, 1) * lc + body[2] / max(body[0], 1) * c + math.e)
            out.append(c / t * max(math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / base, 0.0) if c else 0.0)
        return out


def random_markup(rng, depth=0):
    tag = rng.choice(["div", "section", "span", "a", "b", "em"] if depth else ["div"])
    inner = "".join(rng.choice([lambda: f" w{rng.randrange(99)} " * rng.randrange(12), lambda: "<br>", lambda: random_markup(rng, depth + 1)])() for _ in range(rng.randrange(1, 6))) if depth < 5 else "leaf"
    return f"<{tag}>{inner}</{tag}>"


def test_densities_equal_the_formula():
    rng = random.Random(11)
    for _ in range(200):
        markup = "<body>" + "".join(random_markup(rng) for _ in range(3)) + "</body>"
        page, plain = Page(markup), Plain(markup)
        assert page.tag == [x["tag"] for x in plain.nodes]
        assert page.densities() == pytest.approx(plain.densities())


def test_density_decides(monkeypatch):
    pages = [noisy(k) for k in range(40)]
    found = [main_text(m) for m, _ in pages]
    assert found == [t for _, t in pages]
    for flat in (0.0, 1.0):
        with monkeypatch.context() as m:
            m.setattr(Page, "densities", lambda self, flat=flat: [flat] * len(self.tag))
            assert all(main_text(x) != t for x, t in pages)


def noisy(k):
    """A page without a telling name: stray boxes, links, and text in a box of its own."""
    rng = random.Random(k)
    words = lambda n: " ".join(f"word{rng.randrange(999)}" for _ in range(n))
    stray = lambda: f"<div><a href=/{rng.randrange(9)}>{words(2)}</a> {words(rng.randrange(1, 3))}</div>"
    paragraphs = [words(rng.randrange(40, 80)) for _ in range(rng.randrange(3, 7))]
    text = "".join(f"<p>{p}</p>" for p in paragraphs)
    before, after = "".join(stray() for _ in range(rng.randrange(1, 4))), "".join(stray() for _ in range(rng.randrange(1, 4)))
    return f"<body><div class=x1>{before}</div><div class=x2>{text}</div><div class=x3>{after}</div></body>", " ".join(paragraphs)


def word_f1(got, want):
    got, want = Counter(got.split()), Counter(want.split())
    return 2 * (got & want).total() / (got.total() + want.total()) if got or want else 1.0


def test_pages_without_a_marked_article(spark):
    rows = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    scores = [word_f1(main_text(re.sub(r"(</?)article\b", r"\1div", h)), main_text(h)) for h in rows]
    assert len(scores) >= 100 and sum(scores) / len(scores) >= 0.98
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    assert main_text(f"<div><h1>Title here</h1><p>{words(20)}</p><p>{words(60)}</p><p>{words(15)}</p></div>") == f"Title here {words(20)} {words(60)} {words(15)}"
    assert main_text(f"<body><div><h2>T</h2><p>{words(9)}</p><blockquote>{words(5)}</blockquote><p>{words(90)}</p><ul><li>a<li>b</ul></div></body>") == f"T {words(9)} {words(5)} {words(90)} a b"


ITEMS = "".join(f'<a href="/{k}">Item {k}</a> ' for k in range(8))


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        (f'<body><table><tr><td class="c1">{ITEMS}</td><td class="c2"><h1>T</h1><p>{P}</p><p>Sh.</p><p>{P}</p></td><td class="c3"><a href=/l>Anmelden</a> <a href=/m>Mehr</a></td></tr></table></body>', f"T {P} Sh. {P}"),
        (f'<body><div class="c1"><a href=/l>Anmelden</a> <a href=/m>Mehr</a></div><h1>T</h1><p>{P}</p><p>x</p><p>{P}</p><div class="c3">Konto <a href=/k>hier</a></div></body>', f"T {P} x {P}"),
        (f'<body><div class="c1">{ITEMS}</div><div class=c5><h1>T</h1><p>{P}</p><p>{P}</p><p>{P}</p></div><div class="c3"><a href=/l>Anmelden</a></div><div class=c4>Konto</div></body>', f"T {P} {P} {P}"),
        (f'<body><main><div class=c1><a href=/l>Anmelden</a> Konto</div><h1>T</h1><article><p>{P}</p><p>Sh.</p></article><div class=c2><a href=/m>Mehr</a> dazu</div></main></body>', f"T {P} Sh."),
        (f'<body><main><article><p>{P}</p><p>{P}</p><p>{P}</p></article><article><a href=/1>Another one</a> soon</article></main></body>', f"{P} {P} {P}"),
        (f'<body><div id=w><div class="c1">{ITEMS}</div><p>{P}</p><p>{P} <a href=/x>link</a> <b>bo</b>ld</p><p>End.</p><div class="c3"><a href=/l>Anmelden</a></div></div></body>', f"{P} {P} link bold End."),
    ],
)
def test_noise_without_a_listed_word_goes(markup, text):
    assert main_text(markup) == text


SOURCES = '<ul>' + "".join(f'<li><a href="/{k}">Source {k}</a></li>' for k in range(4)) + "</ul>"
SOURCE_TEXT = " ".join(f"Source {k}" for k in range(4))


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        (f"<article><p>{P}</p><p><a href=/1>One</a> <a href=/2>two</a> <a href=/3>three</a></p><h2>Sources</h2>{SOURCES}</article>", f"{P} One two three Sources {SOURCE_TEXT}"),
        (f"<body><main><table><tr><td><a href=/1>A</a><td><a href=/2>B</a><td><a href=/3>C</a></table><p>{P}</p></main></body>", f"A B C {P}"),
        (f"<body>{NAV}<div class=c1><p>{P}</p><p>{P}</p>{SOURCES}</div><div class=c2>Konto</div></body>", f"{P} {P} {SOURCE_TEXT}"),
        (f'<body><article class="post comments-open"><p>{P}</p></article></body>', P),
        (f'<body><div id=page class="no-comments"><h1>T</h1><p>{P}</p><p>{P}</p></div></body>', f"T {P} {P}"),
        (f'<body><div class="comment-layout"><article><p>{P}</p></article><div class=comments><article class=comment><p>{P} reader</p></article></div></div></body>', P),
        (f'<body><article class="post reply"><p>{P}</p><article class="reply"><p>{P} reader</p><p>{P} reader</p></article></article></body>', P),
        (f"<body><div class=c1><p>{P}</p><p>{P}</p></div><div class=comments><p>{P} a</p><p>{P} b</p><p>{P} c</p></div></body>", f"{P} {P}"),
    ],
)
def test_the_article_loses_nothing_to_links_or_names(markup, text):
    assert main_text(markup) == text


def test_deep_long_and_broken_pages():
    assert main_text("<div>" * 30000 + "deep" + "</div>" * 10) == "deep"
    long = " ".join(f"word{k}" for k in range(200000))
    assert main_text(f"<article><p>{long}</p></article>") == long
    rng = random.Random(3)
    parts = ["<p", ">", "</p>", "<a href=\"", "'", "\"", "<!--", "-->", "<script>", "</script", "&amp", ";", "text ", "<td>", "<table>", "</table>", "<", "/", "<li>", "</div>", "<article>", "</article>"]
    for _ in range(3000):
        assert isinstance(main_text("".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))), str)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "clash"), (None, "u", f"<p>{P}", None), (2, "v", "", None), (2, "v", "", None)], "page_id bigint, url string, html string, text string")
    got = sorted(map(str, (tuple(r) for r in extract(df).collect())))
    assert got == sorted(map(str, [(1, None, "", 0), (None, "u", P, len(P)), (2, "v", "", 0), (2, "v", "", 0)]))
    assert extract(df.limit(0)).collect() == []
