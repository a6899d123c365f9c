"""HTML extraction and WARC archives."""

import gzip
import hashlib
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidepool.llm import html_text, warc
from tidepool.llm.html_text import main_text


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header class="site"><a href="/">Home</a></header><nav><ul><li><a>One</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side text that is long enough to count as a line of text, were it not aside.</p></div>
    <article><h1>Head &amp; line</h1><p><b>First  <i>par</i>t.<br><p>Caf&eacute; &lt;b&gt; 3 &lt; 4<!-- x --></p><div class="ad">Buy</div><form><p>Mail</p><input></form><blockquote>Quote</blockquote><ul><li>Item</li></ul><p>End</article>
    <section class="comments"><p>Reader says a lot of things here, at great length, again and again, for no reason at all.</p></section><footer>&copy; x</footer></body></html>"""
    assert main_text(page) == "Head & line\nFirst part.\nCafé <b> 3 < 4\nQuote\nItem\nEnd"


def test_surge_and_dive_without_an_article():
    body = "".join(f"<p>{'Sentence number %d of the text proper. ' % i * 4}</p>" for i in range(4))
    page = f"<body><div><a>Menu one</a></div><div><a>Menu two</a></div><div>{body}</div><div><a>Next</a></div><div><a>Top</a></div><div><a>Last</a></div><div>Imprint</div></body>"
    got = main_text(page)
    assert got.startswith("Sentence number 0") and got.count("\n") == 3 and "Menu" not in got and "Imprint" not in got


@pytest.mark.parametrize("wrapper", ["div class='content-sidebar-wrap'", "div class='has-sidebar'", "div class='no-sidebar layout'", "section id='with-comments'", "div class='page widget'", "form action='/x'"])
def test_wrappers_do_not_blank_the_page(wrapper):
    text = "\n".join(f"Sentence {i} of the text proper, which is long enough to surge by itself or with what follows it." for i in range(3))
    body, name = "".join(f"<p>{x}</p>" for x in text.split("\n")), wrapper.split()[0]
    for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>"):
        page = f"<body><nav>Menu</nav><{wrapper}>{inner}<div class='sidebar-left'><p>Side</p></div><div class='cookie-notice'>We use cookies</div></{name}><footer>Foot</footer></body>"
        assert main_text(page) == text


def test_comments_and_teasers_stay_out():
    post, long = "<div><p>A short post of one line that is still long enough for a window to surge, as it has a hundred characters.</p></div>", "<p>Reader says many things at length.</p>" * 30
    for side in (f"<section class='comments'>{long}</section>", f"<section id='comments'><article>{long}</article></section>", "<div class='related'><article><p>Teaser</p></article></div>"):
        assert main_text(f"<body>{post}{side}</body>").startswith("A short post")
        assert main_text(f"<body>{post}{side}</body>").count("\n") == 0


def test_text_resumes_after_an_advert():
    first = "The text proper begins with a paragraph that is long enough to surge, having over eighty-six characters."
    page = f"<body><div><p>{first}</p>{'<div class=ad>Buy</div>' * 4}<p>The end.</p></div><div>Imprint</div></body>"
    assert main_text(page) == f"{first}\nThe end."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="layout has-sidebar"><article><p>The text.</p></article><div class="sidebar">Side</div></div>', "The text."),
        ('<article><p>One two.</p><p class="advert">Buy</p><ul><li>a<li class="share">Share</ul><p>End <span class="advert">Buy <b>now</b></span> here</p></article>', "One two.\na\nEnd here"),
        ('<article><p>One.<p hidden>no<div style="display: none">no <p>no</p></div><p aria-hidden="true">no</p><b hidden>no</b><p>Two</p></article>', "One.\nTwo"),
        ('<article><table><tr><td class="nav">Menu<td>Cell</table></article>', "Cell"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p></article>", "Let x=2 be."),
        ("<article><h1>Title</h1><p>Text.</p><p><a href=x>The report</a></p></article>", "Title\nText.\nThe report"),
        ("<main><h1>Title</h1><article><p>Text.</p></article></main>", "Title\nText."),
    ],
)
def test_attributes_of_all_elements(page, text):
    assert main_text(f"<body><nav><a>Menu</a></nav>{page}<footer>Foot</footer></body>") == text


LONG = "A paragraph of the text proper, which has about a hundred characters, so that it makes a window surge."


def test_window_sums_decide_inside_articles():
    menu = "".join(f"<li><a href={i}>Link number {i}, which may well be as long as any other line of the page</a></li>" for i in range(5))
    assert main_text(f"<article><h1>T</h1><p>{LONG}</p><ul>{menu}</ul></article>") == f"T\n{LONG}", "a window of links alone is a dive"
    assert main_text(f"<article><ul>{menu}</ul><p>Lead</p><p>{LONG}</p></article>") == f"Lead\n{LONG}", "text reaches back to the dive before the surge"
    assert main_text(f"<article><p>{LONG}</p><ul>{menu}</ul><p>End</p></article>") == f"{LONG}\nEnd", "text resumes in its article"
    assert main_text(f"<main><article><p>{LONG}</p></article><ul>{menu}</ul><article><p>Teaser</p></article></main>") == LONG, "no surge, no text"
    assert main_text(f"<article><p>Teaser</p></article><div>{f'<p>{LONG}</p>' * 3}</div>") == "\n".join([LONG] * 3), "text outside counts if it is more"


class _Blocks(HTMLParser):
    """Lines of well-formed pages of div, p, a, nav and article: [text, outside links, set aside, in article, parent]."""

    def __init__(self):
        super().__init__()
        self.stack, self.lines, self.number = [("body", 0, False, False)], [], 0
        self.text = self.plain = ""

    def cut(self):
        text, plain = " ".join(self.text.split()), " ".join(self.plain.split())
        if text:
            _, _, aside, article = self.stack[-1]
            parent = next(n for name, n, _, _ in reversed(self.stack) if name != "p")
            self.lines.append([text, 0 if aside else len(plain), aside, article, parent])
        self.text = self.plain = ""

    def handle_starttag(self, tag, attrs):
        if tag != "a":
            self.cut()
        self.number += tag != "a"
        _, _, aside, article = self.stack[-1]
        self.stack.append((tag, self.number, aside or tag == "nav", article or tag == "article"))

    def handle_endtag(self, tag):
        if tag != "a":
            self.cut()
        self.stack.pop()

    def handle_data(self, data):
        self.text += data
        if self.stack[-1][0] != "a":
            self.plain += data


def _by_definition(page, window=3, surge=86):
    b = _Blocks()
    b.feed(page)
    b.cut()
    groups = [[i for i, x in enumerate(b.lines) if x[3] == a] for a in (True, False)]
    after = lambda g, k: sum(b.lines[i][1] for i in g[k : k + window])
    level = min(surge, max((after(g, k) for g in groups for k in range(len(g))), default=0))
    kept = set()
    for g, inside in zip(groups, (True, False), strict=True):
        for k in range(len(g)):
            if not level or not b.lines[g[k]][1] or after(g, k) < level:
                continue
            end = next((e for e in range(k, len(g)) if after(g, e) == 0 and not (inside and len(g) - e < window)), len(g))
            begin = k
            while inside and begin and any(b.lines[i][1] for i in g[max(begin - window, 0) : begin]):
                begin -= 1
            kept |= set(g[begin:end])
    homes = {(x[3], x[3] or x[4]) for i, x in enumerate(b.lines) if i in kept and x[1]}
    kept |= {i for i, x in enumerate(b.lines) if x[1] and (x[3], x[3] or x[4]) in homes}
    size = lambda inside: sum(x[1] for i, x in enumerate(b.lines) if i in kept and x[3] == inside)
    if size(True) and size(True) >= size(False):
        kept = {i for i in kept if b.lines[i][3]}
    return "\n".join(x[0] for i, x in enumerate(b.lines) if i in kept and not x[2])


_words = st.integers(1, 120).map(lambda n: ("word " * 30)[:n].strip() or "w")
_leaf = st.tuples(_words, st.sampled_from(["p", "p", "link", "nav", "mixed"])).map(
    lambda x: {"p": f"<p>{x[0]}</p>", "link": f"<p><a>{x[0]}</a></p>", "nav": f"<nav><p>{x[0]}</p></nav>", "mixed": f"<p>{x[0]} <a>more</a> end</p>"}[x[1]]
)
_part = st.lists(_leaf, max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["div", "div", "section"]), _part), max_size=4), st.one_of(st.none(), _part), st.integers(0, 4))
def test_kept_lines_by_definition(divs, article, at):
    parts = [f"<{tag}>{x}</{tag}>" for tag, x in divs]
    if article is not None:
        parts.insert(min(at, len(parts)), f"<article>{article}</article>")
    page = "".join(parts)
    assert main_text(page) == _by_definition(page)


def test_window_sums():
    assert html_text.window_sums(np.array([1, 2, 3, 4]), 3).tolist() == [6, 9, 7, 4]


def test_whole_operator(spark):
    page = f"<article><p>{LONG} &eacute;</p></article>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<article>" + "<p>w é</p>" * 20000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as _id", "4 as _html")
    got = sorted(html_text.extract_main_text(pages).collect(), key=str)
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got if r.page_id) == sorted((i, u, main_text(h), len(main_text(h))) for i, u, h in rows if i)
    assert sum(r.page_id is None and r.text == "" for r in got) == 1 and len(got) == 5
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<div><nav>x</nav>") == ""
    assert main_text("<article><p>cut <b>off &am") == "cut off &am"
    assert main_text("<article><p>cut off</p><p cla") == "cut off"
    assert main_text('<article><p class="a>b">x</p><p title=\'unclosed>y</p></article>') == "x\ny"
    assert main_text("<article>" + "<p>w</p>" * 5000).count("w") == 5000


def test_archives_round_trip(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" + "x" * 1500
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3\r\nX: y", big), (3, "http://a/3", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", "y" * 999), (8, "u", "y" * 999), (None, "u", big), (9, "u", "z" * 1000), (10, "u", "z" * 1000)]
    rows += [(20 + i, "u", "x" * 1200 + end) for i, end in enumerate(("\r\n", "\r", "\r\n\r\n", "\n", "\r\n\r", "\r\r\n\r\n"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as refers_to", "2 as payload_digest", "'x' as _body")
    path = f"file://{tmp_path}/warc"
    got = warc.archive_pages(pages, path, records_per_archive=2, date="2024-02-03T04:05:06Z").collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [h or "" for i, _, h in rows if i == r.page_id]
        assert r.payload_bytes == len(texts[0].encode()) and r.payload_digest == hashlib.sha1(texts[0].encode()).hexdigest()
        expected = {1: 3, 2: 3, 9: 10}.get(r.page_id)
        assert (r.record_type, r.refers_to) == (("revisit", expected) if expected else ("response", None))
    payloads = warc.read_warc(spark, path).filter("record_type = 'response' and page_id = 3").first().payload
    assert bytes(payloads).decode() == big
    text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("*.gz")).decode()
    assert text.count("WARC-Date: 2024-02-03T04:05:06Z\r\n") == len(rows) and text.count("WARC-Refers-To-Target-URI: ") == 3


def test_one_id_with_two_payloads(spark):
    a, b = "a" * 1500, "b" * 2500
    pages = spark.createDataFrame([(1, "u", a), (3, "u", a), (3, "u", b), (2, "u", b)], "page_id long, url string, html string")
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()}
    assert got == {(1, 1500, "revisit", 3), (2, 2500, "revisit", 3), (3, 1500, "response", None), (3, 2500, "response", None)}


def test_a_hot_payload(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, repeat('h', 1200), concat(id, repeat('x', 1200))) as html")
    got = warc.archive_pages(pages).groupBy("record_type", "refers_to").count().collect()
    assert {(r.record_type, r.refers_to, r["count"]) for r in got} == {("revisit", 2997, 999), ("response", None, 2001)}


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_records_of_any_cut():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\na\r\n\r\n\r\nbc\r\n\r\n"
    assert [p for _, p in warc.records_of((one + one).split(b"\r\n\r\n")[:-1])] == [b"a\r\n\r\n\r\nbc"[:9]] * 2
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records_of([b"WARC/1.1\r\nContent-Length: 99", b"x"]))
