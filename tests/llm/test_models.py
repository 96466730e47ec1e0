import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonlake.llm import hmm_lm, langid, toxicity
from axonlake.llm.common import crc_mod

from . import data


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def plain_likelihood(seq, m):
    a = m.start * m.emit[seq[0]]
    total = math.log10(a.sum())
    a = a / a.sum()
    for x in seq[1:]:
        a = (a @ m.step) * m.emit[x]
        total += math.log10(a.sum())
        a = a / a.sum()
    return total


def random_model(k, s, seed):
    r = np.random.RandomState(seed)
    emit = r.rand(s, k)
    step = r.rand(k, k)
    return hmm_lm.Model(np.full(k, 1 / k), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def test_forward_and_counts_match_plain_recursions():
    m, r = random_model(3, 20, 1), np.random.RandomState(2)
    seqs = [r.randint(0, 20, n).astype(np.uint32) for n in (1, 7, 1, 30, 2, 400)]
    assert np.allclose(hmm_lm.forward(seqs, m), [plain_likelihood(s, m) for s in seqs])
    ll, first, moved, emitted = hmm_lm.expected_counts(seqs, m)
    assert np.allclose(ll, hmm_lm.forward(seqs, m), rtol=1e-4)
    want_first, want_moved, want_emit = np.zeros(3), np.zeros((3, 3)), np.zeros((20, 3))
    for s in seqs:  # unscaled sums over all pairs of states, by forward and backward vectors with renormalisation
        n = len(s)
        al, be = np.zeros((n, 3)), np.ones((n, 3))
        al[0] = m.start * m.emit[s[0]]
        al[0] /= al[0].sum()
        for t in range(1, n):
            al[t] = (al[t - 1] @ m.step) * m.emit[s[t]]
            al[t] /= al[t].sum()
        for t in range(n - 2, -1, -1):
            be[t] = m.step @ (m.emit[s[t + 1]] * be[t + 1])
            be[t] /= be[t].sum()
        g = al * be
        g /= g.sum(1, keepdims=True)
        want_first += g[0]
        np.add.at(want_emit, s, g)
        for t in range(n - 1):
            x = al[t][:, None] * m.step * (m.emit[s[t + 1]] * be[t + 1])[None]
            want_moved += x / x.sum()
    assert np.allclose(first, want_first, rtol=1e-3) and np.allclose(moved, want_moved, rtol=1e-3, atol=1e-3) and np.allclose(emitted, want_emit, rtol=1e-3, atol=1e-3)


@pytest.mark.parametrize("share", [1e-6, 0.02])
def test_scores_match_brute_force_counts(spark, share):
    docs = data.documents(spark).coalesce(3)
    cfg = hmm_lm.Settings(states=2, iterations=2, symbol_share=0.05, table_share=share, suffix_classes=16)
    got = hmm_lm.score_texts(docs, crc_mod(F.col("doc_id"), 10) != 0, cfg).collect()
    rows = docs.select("doc_id", "text").collect()
    learn = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    counts = Counter(w for r in rows if learn(r.doc_id) for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        w = tokens(r.text)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((str(r.doc_id), not learn(r.doc_id), len(w), sum(counts[x] > 0 for x in w), n, round(base, 5)))
    assert sorted((str(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 5)) for g in got) == sorted(want)
    assert sum(g.score for g in got) > sum(g.base_score for g in got)
    want = Counter((str(r.doc_id), round(s, 1)) for r, s in zip(rows, plain_scores([(tokens(r.text), learn(r.doc_id)) for r in rows], cfg)))
    near = lambda a, b: abs(a - b) < 2e-3 * abs(b) + 0.01
    scores = sorted((str(g.doc_id), g.score) for g in got)
    assert all(i == j and near(a, b) for (i, a), (j, b) in zip(scores, sorted(want.elements())) if abs(b) > 50)


def plain_scores(texts, cfg):
    """The model from its definition, one text and one step at a time."""
    counts = Counter(w for ws, known in texts if known for w in ws)
    n = sum(counts.values())
    own = [b""] + sorted((w for w, c in counts.items() if w and c >= math.ceil(cfg.symbol_share * n)), key=lambda w: (-counts[w], w))
    cls = lambda w: zlib.crc32(w[-3:]) % cfg.suffix_classes
    size, once = np.zeros(cfg.suffix_classes), np.zeros(cfg.suffix_classes)
    for w, c in counts.items():
        if w not in own:
            size[cls(w)] += c
            once[cls(w)] += c == 1
    total = size + once + 0.5
    symbol = lambda w: own.index(w) if w in own else len(own) + cls(w)
    inside = lambda w: 0.0 if w in own else math.log10((counts[w] or once[cls(w)] + 0.5) / total[cls(w)])
    share = np.concatenate([[max(counts[w], 0.5) for w in own], total])
    share /= share.sum()
    k = cfg.states
    emit = share[:, None] * np.exp(0.7 * np.random.RandomState(cfg.seed).normal(size=(len(share), k)))
    m = hmm_lm.Model(np.full(k, 1 / k), np.full((k, k), 0.1 / k) + 0.9 * np.eye(k), emit / emit.sum(axis=0))
    seqs = [[symbol(w) for w in ws] for ws, _ in texts]
    for _ in range(cfg.iterations):
        first, moved, emitted = np.full(k, 0.1), np.full((k, k), 0.1), cfg.prior_tokens * np.repeat(share[:, None], k, axis=1)
        for seq, (_, known) in zip(seqs, texts):
            if not known:
                continue
            al, be, t_ = np.zeros((len(seq), k)), np.ones((len(seq), k)), len(seq)
            for t in range(t_):
                al[t] = (al[t - 1] @ m.step if t else m.start) * m.emit[seq[t]]
                al[t] /= al[t].sum()
            for t in range(t_ - 2, -1, -1):
                be[t] = m.step @ (m.emit[seq[t + 1]] * be[t + 1])
                be[t] /= be[t].sum()
                x = al[t][:, None] * m.step * (m.emit[seq[t + 1]] * be[t + 1])[None]
                moved += x / x.sum()
            g = al * be
            g /= g.sum(1, keepdims=True)
            first += g[0]
            np.add.at(emitted, seq, g)
        m = hmm_lm.Model(first / first.sum(), moved / moved.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0))
    return [plain_likelihood(seq, m) + sum(map(inside, ws)) for seq, (ws, _) in zip(seqs, texts)]


def test_model_is_a_distribution_over_words(spark):
    """One-word texts: the probabilities of all known words and the classes' unseen words add up to the mass of two-token texts."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa bb cc", "aa bb", "aa dd", "aa"])], "doc_id long, text string")
    probe = spark.createDataFrame([(10 + i, t) for i, t in enumerate(["aa", "bb", "cc", "dd"])], "doc_id long, text string")
    cfg = hmm_lm.Settings(states=1, iterations=1, symbol_share=0.2, table_share=0.1, suffix_classes=1, prior_tokens=0.0)
    got = {r.doc_id: 10**r.score for r in hmm_lm.score_texts(docs.unionByName(probe), F.col("doc_id") < 10, cfg).collect()}
    # with one state a text's probability is a product of word shares; of the share outside symbols, unseen words take their part
    total = sum(got[10 + i] for i in range(4)) / got[10]
    assert 1 < total < 4 and got[10] > got[11] > got[12]


def test_nothing_to_learn_from(spark):
    docs = data.documents(spark).limit(5)
    got = hmm_lm.score_texts(docs, F.lit(False), hmm_lm.Settings(states=2, suffix_classes=8)).collect()
    assert len(got) == 5 and all(g.base_score == 0 and g.n_known == 0 and g.train_tokens == 0 for g in got)
    assert hmm_lm.score_texts(data.empty(spark), F.lit(True)).count() == 0


def test_language_model(spark):
    docs = data.documents(spark)
    model = langid.train_language_model(docs.filter(langid.learning_rows()))
    assert model.languages == ["de", "en"]
    got = langid.predict_language(docs, model)
    assert set(got.columns) == set(docs.columns) | {"lang_pred", "score", "rejected"}
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in model.languages and 0 <= r.score <= 1
    fresh = spark.createDataFrame([(i, data.prose(lang, 25, 5000 + i), lang) for i in range(60) for lang in ("en", "de")], "doc_id long, text string, lang string")
    assert langid.predict_language(fresh, model).filter("lang = lang_pred and not rejected").count() == 120
    none = langid.train_language_model(data.empty(spark))
    assert langid.predict_language(docs, none).filter("lang_pred <> 'und'").count() == 0


SYLLABLES = {"en": "the an on re ed st ing ou at en is wh ly ment com ble ness for all with".split(), "de": "sch ei ch ie un ge ten ver ö ü ss er kei lich zu auf ä be ung ste".split()}


def invented(lang, n, seed):
    r = np.random.RandomState(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang], r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def wide_model():
    rows = [(invented(lang, 120, 10 * i + len(lang)), lang) for i in range(150) for lang in ("en", "de")]
    return langid.fit([t for t, _ in rows], [lang for _, lang in rows])


def test_rejection_of_foreign_text(wide_model):
    assert min(wide_model.known.sum(axis=1)) > langid.KNOWN_ENOUGH
    for seed in range(40):
        for lang in ("en", "de"):
            got = wide_model.judge(invented(lang, 30, 9000 + seed))
            assert got[0] == lang and not got[2]
    gibberish = "".join(sorted(invented("en", 60, 1).replace(" ", "")))
    for text in ["これは日本語の文章です。今日は天気がいいですね。", "qwx zzkq pffr xkcd vvjq wwzx", "привет как дела сегодня", gibberish, "glpvq wrtz xxkcd bvvnm qjjz"]:
        lang, score, rejected = wide_model.judge(text)
        assert rejected and lang in ("de", "en") and 0 <= score < 1, text


@pytest.mark.parametrize("text", ["one on the line", "qwx zzkq pffr xkcd vvjq wwzx", "schei ungeten verlich", "the zzkq is all"])
def test_repeating_a_text_keeps_its_verdict(wide_model, text):
    assert wide_model.judge(text)[::2] == wide_model.judge(" ".join([text] * 10))[::2] == wide_model.judge("\n".join([text] * 3000))[::2]


def test_little_knowledge_rejects_nothing_as_strange():
    rows = [(data.prose(lang, 40, i), lang) for i in range(40) for lang in ("en", "de")]
    small = langid.fit([t for t, _ in rows], [lang for _, lang in rows])
    assert max(small.known.sum(axis=1)) < langid.KNOWN_ENOUGH
    assert not small.judge("no id at all here")[2] and not small.is_strange(0, 100, 100)


def test_averaged_embeddings_against_a_plain_version(wide_model):
    """The score is the softmax of the mean of the table's rows at all n-grams, computed here one n-gram at a time."""
    for text in [invented("de", 20, 3), invented("en", 20, 4), "ü"]:
        raw, total, n = text.encode(), np.zeros(2), 0
        for size in langid.ORDERS:
            for at in range(len(raw) - size + 1):
                total += wide_model.table[langid.byte_ngram_hashes(raw[at : at + size], size, wide_model.bits)[0]]
                n += 1
        z = (total / max(1, n) + wide_model.bias) / wide_model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score, _ = wide_model.judge(text)
        assert lang == wide_model.languages[p.argmax()] and (abs(score - p.max()) < 1e-6 or score < p.max())


def test_toxicity(spark):
    bad = ["you stupid moron", "pathetic worthless trash", "what an idiot clown"]
    rows = [(i, data.prose("en", 20, i) + " " + (bad[i % 3] if i % 4 == 0 else "fine day") + " " + data.prose("en", 20, i + 1), int(i % 4 == 0)) for i in range(300)]
    docs = data.documents(spark, [(1000 + i, t, "en") for i, t, _ in rows])
    labels = spark.createDataFrame([(1000 + i, 1, y) for i, _, y in rows] + [(5, 1, None), (None, 0, 1), (1001, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    known = toxicity.labelled_texts(docs.filter(toxicity.learning_rows()), labels)
    model = toxicity.train_toxicity_model(known, bits=16)
    got = toxicity.score_toxicity(docs, model)
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    held = got.filter((F.col("doc_id") >= 1000) & ~toxicity.learning_rows()).select("doc_id", "score").collect()
    assert len(held) > 50
    right = sum((r.score >= 0.7) == ((r.doc_id - 1000) % 4 == 0) for r in held)
    assert right >= 0.95 * len(held)
    empty = toxicity.train_toxicity_model(toxicity.labelled_texts(data.empty(spark), labels), bits=10)
    assert {r.score for r in toxicity.score_toxicity(docs.limit(3), empty).collect()} == {0.5}


def test_toxic_words_of_a_rare_class_keep_their_weight(spark):
    """Seven toxic texts among 2,007: their word is in less than half a percent of all texts, and only in toxic ones."""
    rows = [(i, data.prose("en", 12, i), 0) for i in range(2000)] + [(2000 + i, f"{data.prose('en', 12, 2000 + i)} bocoos {data.prose('en', 12, 3000 + i)}", 1) for i in range(7)]
    known = spark.createDataFrame(rows, "id long, text string, toxic int")
    model = toxicity.train_toxicity_model(known, bits=18, fit_rows=1_000_000)
    assert model.weight[toxicity._distinct("bocoos", 18)].sum() > 0
    fresh = spark.createDataFrame([(i, f"{data.prose('en', 12, 7000 + i)} {w} {data.prose('en', 12, 8000 + i)}", w) for i in range(20) for w in ("bocoos", "fine")], "id long, text string, w string")
    got = toxicity.score_toxicity(fresh, model).groupBy("w").agg(F.min("score").alias("least"), F.max("score").alias("most")).collect()
    by = {r.w: r for r in got}
    assert by["bocoos"].least > by["fine"].most
