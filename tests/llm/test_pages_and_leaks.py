import re
import time
from unittest import mock

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from axonlake.llm import decontaminate, html_extract, url_filter

from . import data


# ---- URL rules ----------------------------------------------------------------------------------------------------------------------


def plain_glob(glob, text):
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return re.fullmatch(out, text, re.S) is not None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab/.*", min_size=1, max_size=30), min_size=1, max_size=9), st.lists(st.text("ab/.", max_size=12), min_size=1, max_size=8))
def test_automaton_matches_regular_expressions(globs, texts):
    for few in (0, 3, 64):  # side by side, both, one by one
        with mock.patch.object(url_filter, "FEW", few):
            got = url_filter.GlobAutomaton(globs).match([t.encode() for t in texts])
        assert got.tolist() == [[plain_glob(g, t) for g in globs] for t in texts]


def test_long_urls_are_matched_as_short_ones():
    globs = ["*.net/**", "a*b", "**/end", "x**y/*z", "n" * 70 + "**q"]
    auto = url_filter.GlobAutomaton(globs)
    middle = "ab/" * 200_000
    texts = [f"h.net/{middle}", f"a{middle}b", f"a{'c' * 300_000}b", f"{middle}end", f"x{middle}y/{'c' * 99}z", "n" * 70 + middle + "q", "n" * 69 + middle + "q", ""] + [f"h.net/{i}" for i in range(200)]
    began = time.monotonic()
    got = auto.match([t.encode() for t in texts])
    assert time.monotonic() - began < 20  # seconds for 3 MB of urls; 34 microseconds a character before
    assert got.tolist() == [[plain_glob(g, t) for g in globs] for t in texts]
    alone = [auto.match([t.encode()])[0] for t in texts]
    assert (np.stack(alone) == got).all()


def test_url_rules(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no-scheme.net/x": ("", "", None, "allow"),
        "http://A.Net/x": ("a.net", "/x", "net/", "block"), "http://net/": ("net", "/", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"), "http://xnet.com/": ("xnet.com", "/", None, "allow"),
        "https://m.example.net/en/1?x=/": ("m.example.net", "/en/1", "example.net/en/", "allow"), "https://m.example.net/de/1": ("m.example.net", "/de/1", "net/", "block"),
        "http://example.com/de/#a": ("example.com", "/de/", "example.com/de/", "block"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://a.org/fr/b": ("a.org", "/fr/b", "org/fr/", "allow"), "http://a.com/x.net/en/": ("a.com", "/x.net/en/", None, "allow"), "http://spam-farm.example.org/en/": ("spam-farm.example.org", "/en/", None, "block"),
        "x://y://Z.NET/q": ("y:", "//Z.NET/q", None, "allow"), "http://a.com/" + "p/" * 50_000: ("a.com", "/" + "p/" * 50_000, None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "r", "v", "h") for i, u in enumerate(cases)], "page_id long, url string, rule string, verdict string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


# ---- HTML ---------------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script></head><body class="home">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu one</a><li><a>Menu two</a></ul></nav><div class="cookie-notice">We use cookies on this page</div>
<article><h1>Title &amp; more</h1><p><b>First <i>bold</i> words here are many and long<br><p>Second&nbsp;paragraph with   spaces
and a line, caf&eacute; &#8212; ok.</p><div class="ad">Buy now cheap things today and every day</div><ul><li>Point one is here<li>Point two is there</ul>
<form><input name=q>Search this<button>Go</button></form><p>Last words of the article stand here.</p><section id="comments"><p>I think this is wrong, said a reader at length.</p></section></article>
<aside><p>Related stories and some more words</p></aside><footer>&copy; site</footer></body></html>"""
TEXT = "Title & more\nFirst bold words here are many and long\nSecond paragraph with spaces and a line, café — ok.\nPoint one is here\nPoint two is there\nLast words of the article stand here."


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<<<>>> < p <b"), (5, "u", "plain words only"), (6, "u", PAGE), (7, "u", "<p>" + "word " * 100_000)], "page_id long, url string, html string")
    pages = pages.withColumnsRenamed({}).selectExpr("*", "'x' as text", "7 as n_chars")
    for weights in ({}, html_extract.learn_weights(pages)):
        got = {r.page_id: r for r in html_extract.extract_text(pages, weights).collect()}
        assert got[1].text == got[6].text == TEXT
        assert got[2].text == got[3].text == "" and got[2].n_chars == 0
        assert got[5].text == "plain words only" and got[7].n_chars == 499_999
        assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.learn_weights(pages.limit(0)) == {}
    assert html_extract.extract_text(pages.limit(0), {}).count() == 0


STONE = "<p>" + "stone water river light house " * 8 + "</p>"


def body(inner):
    return f"<html><body><nav><a href=x>home</a></nav>{inner}<footer>foot words here</footer></body></html>"


@pytest.mark.parametrize("inner, text", [
    ('<div class="article-header"><h1>Big headline here</h1></div>' + STONE, "Big headline here\nS"),
    ("<h1>T</h1>" + STONE + '<p class="legal">legal words stay</p>' + STONE, "T\nS\nlegal words stay\nS"),
    ("<h1>T</h1>" + STONE + '<h2 class="social">Social policy</h2>' + STONE, "T\nS\nSocial policy\nS"),
    ("<h1>T</h1><p>x <math><mi>a</mi>=b</math> y</p>" + STONE, "T\nx a=b y\nS"),
    ("<h1>T</h1>" + STONE + "<p><b title=x'y>bold</b> after</p>" + STONE, "T\nS\nbold after\nS"),
    ("<h1>T</h1>" + STONE + '<div class="ad-banner">buy now cheap</div>' + STONE, "T\nS\nS"),
    ("<h1>T</h1>" + STONE + '<div class="comments"><p>nice post really good</p></div>', "T\nS"),
    ("<h1>T</h1>" + STONE + "<aside>related</aside>" + STONE + "<form><p>sign up now</p></form>", "T\nS\nS"),
    ("<h1>T a</h1><p>3 < 4 and a &lt; b &amp;c</p>" + STONE, "T a\n3 < 4 and a < b &c\nS"),
])
def test_what_stays_and_goes_without_a_named_article(inner, text):
    assert html_extract.extract(body(inner), {}).replace(("stone water river light house " * 8).strip(), "S") == text


def test_weights_decide(spark):
    """Class tokens that no prior knows are learned from pages that name their article, and decide on pages that do not."""
    box = '<div class="zugabe">' + "extra words of no use " * 4 + "</div>"
    rows = [(i, body(box + f"<article><h1>Title {i}</h1>{STONE}</article>" + box)) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    learned, fresh = html_extract.learn_weights(pages), body(STONE + box + STONE)
    assert learned["class zugabe"] == -3.0 and "tag article" not in learned
    assert "extra" not in html_extract.extract(fresh, learned) and "extra" in html_extract.extract(fresh, {})
    flat = {k: 1.0 if k.startswith("word") else 0.0 for k in learned} | {k: 0.0 for k in html_extract.PRIORS}
    assert "extra" in html_extract.extract(fresh, flat) and "foot" in html_extract.extract(fresh, flat)


@pytest.mark.parametrize("unit", ["<a '", "<b>x", "<a href='x", "<!--", "<script", "<p><b>", '<div class="ad">', "</b", "<"])
def test_time_is_linear_in_markup(unit):
    import time

    took = []
    for k in (20_000, 80_000):
        began = time.process_time()
        html_extract.extract(unit * k, {})
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


@pytest.mark.parametrize("body, text", [
    ("<main><p>One two three four.</p><p>Five six.</p></main><div id=sidebar><p>no no no no no no</p></div>", "One two three four.\nFive six."),
    ("<div class=content><h2>Head of it</h2><p>Some words in a text.</p></div><div class='share-buttons'><p>Share this with friends now</p></div>", "Head of it\nSome words in a text."),
    ("<article><p>A &lt;b&gt; c</p><table><tr><td>x y</td><td>z w</td></tr></table></article>", "A <b> c\nx y\nz w"),
])
def test_extraction_of_other_layouts(body, text):
    assert html_extract.extract(f"<html><body><nav><a>Home page</a></nav>{body}<footer>f g h</footer></body></html>", {}) == text


# ---- decontamination ------------------------------------------------------------------------------------------------------------------


def brute(docs, items, share=0.8):
    out = set()
    for d, t in docs:
        dw = decontaminate.words_of(t)
        for i, x in items:
            iw = decontaminate.words_of(x)
            w = min(5, len(iw))
            if w:
                a, b = decontaminate.shingle_set(iw, w), decontaminate.shingle_set(dw, w)
                if len(a & b) * 10 >= len(a) * round(share * 10):
                    out.add((str(d), str(i), len(a & b), len(a)))
    return out


def test_containment_matches_brute_force(spark):
    items = [(i, data.prose("en", 12 + 3 * i, 100 + i)) for i in range(12)] + [(50, None), (51, ""), (52, "only three words"), (53, data.prose("en", 40, 900)), (53, data.prose("de", 9, 3)), (None, "no id here but words enough to match")]
    extra = []
    for n, (i, t) in enumerate(items):
        w = (t or "").split()
        extra.append((300 + n, data.prose("de", 400, n) + " " + (t or "").upper().replace(" ", "  \n") + " " + data.prose("de", 300, n + 1), "de"))
        extra.append((400 + n, " ".join(w[: len(w) * 9 // 10]), "en"))
        extra.append((500 + n, " ".join(w[: len(w) // 2]) + " interrupted by this " + " ".join(w[len(w) // 2 :]), "en"))
    docs = data.documents(spark, extra)
    table = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, id string")
    for block in (100_000, 4):
        got = {(str(r.doc_id), str(r.item_id), r.n_shared, r.n_item) for r in decontaminate.find_contained_items(docs, table, block_items=block).collect()}
        assert got == brute([(r.doc_id, r.text) for r in docs.collect()], items)
        assert {(str(300 + n), str(i)) for n, (i, t) in enumerate(items) if t} <= {x[:2] for x in got}
    assert decontaminate.find_contained_items(data.empty(spark), table).count() == 0
    assert decontaminate.find_contained_items(docs, table.limit(0)).count() == 0
