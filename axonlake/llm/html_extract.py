"""Main text of web pages by a maximum-scoring contiguous run of words and tags.

A page is a sequence of words and tags. A word scores by what it stands in: its innermost block element, whether it is inside a link, and
the marks of the elements around it; tags score below zero. One linear scan finds the contiguous run with the highest sum; its words, put
into blocks by the block-level tags, are the text.

Marks are the names of sectioning elements and the class, id and role tokens of containers. An element whose marks speak against it
strongly enough (`COLLAPSE`) stands in the sequence as one negative tag, so that the best run may pass over an advert inside the article.
Paragraphs, headings, list items and inline elements carry no marks, and an element that holds the page's first-level heading, an
`article` or a `main` element never collapses, unless its name alone (navigation, footers, forms) condemns it.

Weights are learned from labelled pages: those whose own markup names the article (`article`, `main` or their roles). A word counts as
inside if it stands in the named element, as outside if not. The name of that element is the label and never a feature: extraction does not
look at `article` or `main` to find words. Marks come first (log-odds of inside against outside over all words under the mark), then kinds
of words and tags from what the marks leave. Priors are pseudo-counts, which counts outweigh: what HTML says of sectioning elements, and
class tokens that usually mark adverts, comments and the like. Words under such a prior inside a labelled article are not counted, as the
label says nothing about them.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

#: Element kinds of HTML.
RAW = frozenset("script style noscript template textarea title iframe svg object select canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SECTIONING = frozenset("nav aside footer header form menu dialog head".split())
CONTAINER = SECTIONING | frozenset("div section ul ol dl table fieldset center details figure".split())
NAMED = frozenset(("article", "main"))

#: Priors as (words inside, words outside), before any page is seen.
NEUTRAL = (20, 20)
PRIORS = {f"tag {t}": (1, 1000) for t in SECTIONING - {"header"}} | {"tag header": (10, 40)} | {
    f"class {c}": (1, 60)
    for c in "ad ads adv advert advertisement advertising banner promo sponsored sidebar navbar breadcrumb breadcrumbs cookie cookies consent notice notices newsletter subscribe share sharing related comment comments disqus pagination popup modal".split()
}
#: Parts of class tokens that name content: a compound token with one of them has no prior.
CONTENT_PARTS = frozenset("article body content entry main post story text title".split())
COLLAPSE, LIMIT = -2.5, 3.0

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


class _Scanner:
    """Markup of a page in order, each character looked at a bounded number of times: what is not found once is not looked for again."""

    def __init__(self, page: str):
        self.page, self.last = page, {}

    def find(self, what: str, at: int) -> int:
        if self.last.get(what, at) < 0:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.last[what] = -1
        return found

    def tag_end(self, at: int) -> int:
        """Position after the > of the tag that starts at at; quotes count where they follow an equals sign. -1 if it never ends."""
        page, end = self.page, self.find(">", at)
        if end < 0:
            return -1
        if page.find('"', at, end) < 0 and page.find("'", at, end) < 0:
            return end + 1
        while True:
            equals = page.find("=", at, end)
            if equals < 0:
                return end + 1
            at = equals + 1
            while at < len(page) and page[at] in " \t\r\n\f":
                at += 1
            if page[at : at + 1] in ('"', "'") and (close := self.find(page[at], at + 1)) >= 0:
                at = close + 1
                if at > end and (end := self.find(">", at)) < 0:
                    return -1

    def tokens(self):
        """("text", text), ("open", name, attributes), ("close", name), ("raw", name) for elements without markup inside."""
        page, at = self.page, 0
        while at < len(page):
            lt = self.find("<", at)
            if lt < 0:
                yield "text", page[at:]
                return
            nxt = page[lt + 1 : lt + 2]
            name = _NAME.match(page, lt + 1 + (nxt == "/"))
            if not name and nxt not in ("!", "?", "/"):
                yield "text", page[at : lt + 1]  # a plain less-than sign
                at = lt + 1
                continue
            if lt > at:
                yield "text", page[at:lt]
            if not name:
                if page.startswith("<!--", lt):
                    end, size = self.find("-->", lt + 4), 3
                elif page.startswith("<![CDATA[", lt):
                    end, size = self.find("]]>", lt + 9), 3
                else:
                    end, size = self.find(">", lt + 1), 1
                at = len(page) if end < 0 else end + size
                continue
            end = self.tag_end(name.end())
            if end < 0:  # a tag that never ends is dropped, as browsers do
                return
            low = name[0].lower()
            if nxt == "/":
                yield "close", low
            elif low in RAW:
                close = self._raw_end(low, end)
                yield "raw", low
                at = close
                continue
            else:
                yield "open", low, page[name.end() : end - 1]
            at = end

    def _raw_end(self, name: str, at: int) -> int:
        key = "</" + name
        if self.last.get(key, at) < 0:
            return len(self.page)
        m = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(self.page, at)
        if m is None:
            self.last[key] = -1
            return len(self.page)
        return m.end()


def _mark_of(token: str) -> str:
    """The part of a compound token (ad-banner, cookie_notice) that has a prior, or the token itself."""
    parts = re.split(r"[-_]+", token)
    return token if CONTENT_PARTS & set(parts) else next((x for x in parts if f"class {x}" in PRIORS), token)


def _marks(name: str, attrs: str) -> tuple[list[str], bool, bool]:
    """(marks of a container, hidden, named as the article by its role or property)."""
    marks, hidden, named = [f"tag {name}"] if name in SECTIONING else [], False, name in NAMED
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("hidden", "aria-hidden"):
                hidden |= key == "hidden" or value == "true"
            elif key == "itemprop":
                named |= value == "articlebody"
            else:
                named |= key == "role" and value in NAMED
                if name in CONTAINER:
                    for token in value.split():
                        marks.append(f"class {_mark_of(token)}")
    return marks, hidden, named


class _Open:
    """An open element."""

    __slots__ = ("name", "block", "links", "named", "marks", "worst", "at", "words", "heading", "own")

    def __init__(self, name, above, named, marks, worst, at, words):
        self.name, self.at, self.words, self.own, self.marks, self.heading = name, at, words, worst, marks, False
        self.block = name if name in BLOCK else above.block if above else "body"
        self.links = (above.links if above else 0) + (name == "a")
        self.named = named or (above.named if above else False)
        self.worst = min(worst, above.worst if above else 0.0)


def sequence(page: str, weights: dict[str, float] | None) -> list[tuple]:
    """The page as ("text", kind, worst mark, text, inside the named article, marks), ("tag", name, is_block) and ("skip", name, is_block).
    Without weights, for learning, nothing collapses and every text lists its marks."""
    out: list[tuple] = []
    stack: list[_Open] = []
    count: Counter = Counter()
    words = 0

    def pop() -> None:
        top = stack.pop()
        count[top.name] -= 1
        if top.own <= COLLAPSE and (not top.heading or top.name in SECTIONING) and top.name not in NAMED:
            del out[top.at :]
            out.append(("skip", top.name, top.name in BLOCK))
        elif stack:
            stack[-1].heading |= top.heading or top.name in NAMED

    for token in _Scanner(page).tokens():
        kind, name = token[0], token[1]
        if kind == "text":
            top = stack[-1] if stack else None
            if name.strip():
                words += len(name.split())
            out.append(("text", f"word {top.block if top else 'body'} {'link' if top and top.links else 'plain'}", top.worst if top else 0.0, name, top.named if top else False, tuple(m for e in stack for m in e.marks) if weights is None else ()))
        elif kind == "raw":
            out.append(("skip", name, False))
        elif kind == "close":
            if count[name]:
                while stack[-1].name != name:
                    pop()
                pop()
            out.append(("tag", name, name in BLOCK))
        else:
            if name in BLOCK and count["p"]:  # a paragraph ends where a block begins
                while stack[-1].name != "p":
                    pop()
                pop()
            if name == "li" and stack and stack[-1].name == "li":
                pop()
            out.append(("tag", name, name in BLOCK))
            if name not in VOID:
                marks, hidden, named = _marks(name, token[2])
                own = 0.0 if weights is None else -LIMIT if hidden else min((_weight(weights, m) for m in marks), default=0.0)
                stack.append(_Open(name, stack[-1] if stack else None, named, marks, min(own, 0.0), len(out), words))
                stack[-1].heading = name == "h1"
                count[name] += 1
    while stack:  # elements that never end collapse only if most of the page lies elsewhere
        if 2 * (words - stack[-1].words) > words:
            stack[-1].own = 0.0
        pop()
    return out


def _odds(inside: float, outside: float) -> float:
    return max(-LIMIT, min(LIMIT, math.log(inside / outside)))


def _weight(weights: dict[str, float], name: str) -> float:
    """Learned weight, or what the priors say."""
    if name in weights:
        return weights[name]
    if name.startswith("word"):
        return -0.5 if name.endswith(" link") else 1.0
    if name.startswith(("tag ", "class ")):
        return _odds(*PRIORS.get(name, NEUTRAL))
    return -0.3


def count_kinds(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(kind, marks, inside, outside): words of labelled pages by their kind and the marks around them, inside and outside the named article."""

    def run(batches):
        n = {True: Counter(), False: Counter()}
        for b in batches:
            for page in b.column(0):
                texts = [x for x in sequence(page.as_py() or "", None) if x[0] == "text" and x[3].strip()]
                if any(x[4] for x in texts):
                    for _, kind, _, text, inside, marks in texts:
                        if not (inside and any(m in PRIORS for m in marks)):
                            n[inside][kind, tuple(sorted({m for m in marks if not any(c.isdigit() for c in m)}))] += len(text.split())
        keys = sorted({*n[True], *n[False]})
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([list(m) for _, m in keys], pa.list_(pa.string())), pa.array([n[True][k] for k in keys], pa.int64()), pa.array([n[False][k] for k in keys], pa.int64())],
            ["kind", "marks", "inside", "outside"],
        )

    return pages.select(html_col).mapInArrow(run, "kind string, marks array<string>, inside long, outside long").groupBy("kind", "marks").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = 20_000) -> dict[str, float]:
    """Weights by mark and kind of word, from at most about fit_pages pages, drawn by a hash of the id (the documented bound of the fit).
    Without labelled pages the priors stand."""
    total, grain = pages.count(), 1_000_000
    drawn = pages.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(31)), F.lit(grain)) < min(grain, -(-grain * fit_pages // max(1, total))))
    return weights_of([(r["kind"], r["marks"], r["inside"], r["outside"]) for r in count_kinds(drawn, html_col).collect()])


def weights_of(rows: list[tuple]) -> dict[str, float]:
    """Weights from rows of count_kinds: log-odds of marks, then of the kinds of words that elements of bad marks leave."""
    marks: dict[str, list] = {}
    for _, around, inside, outside in rows:
        for m in around:
            got = marks.setdefault(m, list(PRIORS.get(m, NEUTRAL)))
            got[0] += inside
            got[1] += outside
    out = {m: _odds(*x) for m, x in marks.items()}
    kinds: dict[str, list] = {}
    for kind, around, inside, outside in rows:
        if min((out[m] for m in around), default=0.0) > COLLAPSE:  # what is left of a page once marked elements have collapsed
            share = 1 / (1 + math.exp(-_weight({}, kind)))
            got = kinds.setdefault(kind, [50 * share, 50 * (1 - share)])
            got[0] += inside
            got[1] += outside
    return out | {k: _odds(*x) for k, x in kinds.items()}


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Text of the best run: blocks joined by line feeds, white space inside a block as one space; empty if no run scores above zero."""
    seq = sequence(page or "", weights)
    best, start, total, span = 0.0, 0, 0.0, (0, 0)
    decoded: dict[int, str] = {}
    for i, x in enumerate(seq):
        if x[0] == "text":
            decoded[i] = text = html_lib.unescape(x[3]) if "&" in x[3] else x[3]
            w = (_weight(weights, x[1]) + x[2]) * len(text.split())
        else:
            w = _weight(weights, x[0])
        total += w
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    blocks, now = [], []
    for i in range(*span):
        if i in decoded:
            now.append(decoded[i])
        elif seq[i][2]:
            blocks.append("".join(now))
            now = []
        elif seq[i][1] == "br":
            now.append(" ")
    blocks.append("".join(now))
    return "\n".join(b for x in blocks if (b := _SPACE.sub(" ", x).strip()))


def extract_text(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """pages with text and n_chars added, in place of columns of those names. Null and empty pages have an empty text."""
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]

    @F.pandas_udf("string")
    def run(pages_):
        return pd.Series([extract(p, weights) for p in pages_], dtype=object)

    return pages.withColumn("__t", run(html_col)).select(*kept, F.col("__t").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    """Every page: page_id, url, text, n_chars. Null and empty pages have an empty text; repeated rows are rows of their own."""
    pages = read_table(spark, sf_dir, "pages")
    return extract_text(pages, learn_weights(pages)).select("page_id", "url", "text", "n_chars")


QUERIES = {"op5_html_text": op5_html_text}
ORACLE: dict[str, str] = {}
