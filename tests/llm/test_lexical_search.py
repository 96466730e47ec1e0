import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from axonlake.llm import lexical_search
from axonlake.llm.lexical_search import NormBuckets

from . import data

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_search(docs, items, k=10):
    """docs: (doc_id, text) rows, items: (item_id, text) rows; sorted (item_id, rank, doc_id, score) rows."""
    counts = [Counter(terms_of(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms_of(text))}
        found = []
        for (i, _), c in zip(docs, counts):
            if c:
                m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
                score = sum(w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, w in weights.items())
                if score > 0:
                    found.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def items(spark):
    rows = [(1, "The STONE house, river 7"), (2, None), (3, ""), (4, "unheard-of wordings"), (5, "stein licht straße Straße STRASSE"), (5, "stein"), (None, "river river"), (6, " ... "), (7, "aaa " + data.prose("en", 50, 3))]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "item_id long, text string, term string, score int, rank int"), rows


@pytest.mark.parametrize("sizes", [{}, {"run_docs": 7, "bucket": 3, "spare": 0.9}, {"bucket": 1, "spare": 0, "most_items": 2}, {"run_docs": 1, "spare": 99, "most_bytes": 1}], ids=["default", "small", "blocks", "single"])
def test_against_brute_force(spark, sizes):
    docs = data.documents(spark, [(i, data.prose("en", 12, i % 5) + " Straße 7" * (i % 3), "en") for i in range(200, 260)]).repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    table, asked = items(spark)
    got = lexical_search.ranked_search(docs, table, k=4, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(rows, asked, 4)


def test_empty_tables(spark):
    table, _ = items(spark)
    docs = data.documents(spark)
    assert lexical_search.ranked_search(data.empty(spark), table).count() == 0
    assert lexical_search.ranked_search(docs, table.limit(0)).count() == 0
    assert lexical_search.ranked_search(docs.select("doc_id", docs.text.substr(0, 0).alias("text")), table).count() == 0


def test_long_texts_are_counted_whole(monkeypatch):
    monkeypatch.setattr(lexical_search, "STRETCH", 50)
    text = "Ab cd-EF straße " * 200 + "x" * 500 + " end"
    assert lexical_search.term_counts(text.encode()) == Counter(t.encode() for t in terms_of(text))


def test_bounds_leave_out_most_documents_but_no_result():
    r = np.random.RandomState(0)
    n, v, size = 4000, 300, 20
    terms = np.concatenate([np.sort(r.choice(v, size, replace=False, p=np.arange(v, 0, -1) / (v * (v + 1) / 2))) for _ in range(n)])
    tfs = r.geometric(0.5, n * size)
    df = np.bincount(terms, minlength=v)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    asked = [np.sort(r.choice(v, 8, replace=False)) for _ in range(12)]
    lengths = np.bincount(np.repeat(np.arange(n), size), weights=tfs).astype(np.int64)
    search = NormBuckets(asked, weights, n, int(tfs.sum()), 10, n, 100, 0.5)
    search.feed(np.arange(n), np.zeros(n, bool), lengths, np.full(n, size), terms, tfs)
    search.flush()
    m = np.repeat(10 + (90 * lengths * n) // int(tfs.sum()), size)
    impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))
    for q, t in enumerate(asked):
        score = np.bincount(np.repeat(np.arange(n), size), weights=np.where(np.isin(terms, t), impact, 0), minlength=n).astype(np.int64)
        best = np.lexsort((np.arange(n), -score))[:10]
        assert search.best[q][2].tolist() == best.tolist() and search.best[q][0].tolist() == score[best].tolist()
    assert search.scored < 0.25 * n * len(asked)
