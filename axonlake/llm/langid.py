"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent.

A text is the mean of the embeddings of its hashed byte n-grams; a linear layer over the mean gives the languages. Once trained, the
product of both matrices is one table (buckets x languages), so a prediction is a gather and a mean over the whole text.

Rejection is calibrated on rows left out of training, in two ways. The softmax only compares the languages with each other, so its
probability, scaled by a fitted temperature, rejects what lies between them. Whether a text is of any of them is told by its subwords:
distinct three-character sequences that the training rows of the predicted language did not contain. Each counts once however often the text
repeats it, so a text and its repeats get one verdict. What counts as foreign is taken from left-out rows with all letters shuffled, which
keep the language's letters but not their order: a text is rejected if its share of unknown sequences is above nearly all of theirs by a
margin of `deviations` standard deviations for its number of distinct sequences. Rows of the other learned languages are no measure
of it: their shares are below those of plain text of the language beyond the training vocabulary, and telling the learned languages
apart is the softmax's work. A language of which fewer than KNOWN_ENOUGH sequences are known rejects nothing in this way: so little says
too little about what else belongs to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_ngram_hashes, crc_mod, read_table

ORDERS, STRETCH, KNOWN_BITS, KNOWN_ENOUGH = (3, 4), 1 << 20, 20, 500
SMOOTHING = 0.01  # share of the calibration's targets that is spread over all languages
_letter = regex.compile(r"\p{L}").search
_not_letters = re.compile(r"[\W\d_]+").sub


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    bits: int
    temperature: float
    reject_below: float
    known: np.ndarray  # languages x KNOWN_BITS buckets: whether a training row has such a sequence
    strange: np.ndarray  # of each language: share of unknown sequences that is still normal

    def unknown_shares(self, text: str, language: int) -> tuple[int, int]:
        """(distinct sequences of the text, those unknown in the language); the text is taken in stretches."""
        seen = np.empty(0, np.uint32)
        for h in _sequences(text):
            seen = np.union1d(seen, h)
        return len(seen), len(seen) - int(np.count_nonzero(self.known[language][seen]))

    def is_strange(self, language: int, n: int, missing: int, deviations: float = 2.0) -> bool:
        if np.count_nonzero(self.known[language]) < KNOWN_ENOUGH:
            return False
        normal = self.strange[language]
        return missing > n * normal + deviations * (n * normal * (1 - normal)) ** 0.5

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether it is rejected) of one text."""
        if text is None or not self.languages or not _letter(text):
            return "und", 0.0, True
        total, n = np.zeros(len(self.languages)), 0
        for h in _features(text, self.bits):
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        p = _softmax((total / max(1, n) + self.bias) / self.temperature)
        best = int(p.argmax())
        n, missing = self.unknown_shares(text, best)
        strange = self.is_strange(best, n, missing)
        return self.languages[best], float(p[best]) * (1 - missing / n if strange else 1), bool(strange or p[best] < self.reject_below)


def _features(text: str, bits: int):
    data = text.lower().encode("utf-8", "surrogatepass")
    for at in range(0, max(1, len(data)), STRETCH):
        for n in ORDERS:
            yield byte_ngram_hashes(data[at : at + STRETCH + n - 1], n, bits)


def _sequences(text: str):
    """Hashed three-character sequences; white space and anything but letters count as one space."""
    text = " " + _not_letters(" ", text.lower()) + " "
    for at in range(0, len(text), STRETCH):
        a = np.frombuffer(text[at : at + STRETCH + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        h = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))
        yield (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - KNOWN_BITS)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], bits: int = 16, dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Train on a bounded sample. Every fifth row is left out of training and used for calibration."""
    languages = sorted(set(labels))
    k, rng = len(languages), np.random.RandomState(seed)
    if k == 0:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32), np.zeros(0, np.float32), bits, 1.0, 0.5, np.zeros((0, 1 << KNOWN_BITS), bool), np.zeros(0))
    rows = []
    for t in texts:
        h = np.concatenate(list(_features(t, bits)))
        at, n = np.unique(h, return_counts=True)
        rows.append((at, (n / max(1, n.sum())).astype(np.float32)))
    y = np.array([languages.index(x) for x in labels])
    held = np.arange(len(rows)) % 5 == 4
    emb, out, bias = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32), rng.normal(0, 0.1, (dim, k)).astype(np.float32), np.zeros(k, np.float32)
    train = np.flatnonzero(~held)
    for epoch in range(epochs):
        for step, i in enumerate(rng.permutation(train)):
            lr = rate * (1 - (epoch + step / len(train)) / epochs) + 0.01
            at, share = rows[i]
            x = share @ emb[at]
            g = _softmax(x @ out + bias)
            g[y[i]] -= 1
            back = out @ g
            out -= lr * np.outer(x, g)
            bias -= 0.1 * lr * g
            emb[at] -= lr * 20 * np.outer(share, back)
    table = emb @ out
    logits = np.array([share @ table[at] + bias for at, share in rows])
    seen = held if held.any() else ~held
    best = min((0.25, 0.5, 0.75, 1, 1.5, 2, 3, 4), key=lambda t: _smoothed_loss(logits[seen] / t, y[seen]))
    conf = _softmax(logits[seen] / best).max(axis=1)
    known = np.zeros((k, 1 << KNOWN_BITS), bool)
    for i in train:
        for h in _sequences(texts[i]):
            known[y[i]][h] = True
    m = LanguageModel(languages, table.astype(np.float32), bias, bits, float(best), float(min(0.5, np.quantile(conf, 0.001))), known, np.ones(k))
    left_out = np.flatnonzero(seen) if held.any() else ()
    mixed = {i: "".join(rng.permutation(list(texts[i]))) for i in left_out}

    def shares(language: int, some: list[str]) -> list[float]:
        return [missing / n for n, missing in (m.unknown_shares(t, language) for t in some) if n >= 50]

    for j in range(k):
        own, shuffled = (shares(j, [t[i] for i in left_out if y[i] == j]) for t in (texts, mixed))
        if own:
            m.strange[j] = max(np.quantile(own, 0.999), np.quantile(shuffled, 0.01))
    return m


def _smoothed_loss(logits: np.ndarray, y: np.ndarray) -> float:
    """Mean log loss against targets that leave SMOOTHING to all languages alike, so that few clear rows do not make the model too sure."""
    logs = np.log(_softmax(logits) + 1e-12)
    return float(-((1 - SMOOTHING) * logs[np.arange(len(y)), y] + SMOOTHING * logs.mean(axis=1)).mean())


def train_language_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 1000, **options) -> LanguageModel:
    """Fit on at most about rows_per_language rows of each language, drawn by a hash of the id; rows without language, or without a letter in
    the text, are left out. The draw is the documented bound of the fit; everything else covers all rows."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    counts = {r["l"]: r["n"] for r in labelled.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([], [], **options)
    grain = 1_000_000
    cut = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(grain, -(-grain * rows_per_language // n)))))
    drawn = rows.filter(F.pmod(F.xxhash64(F.col("i"), F.lit(17)), F.lit(grain)) < cut[F.col("l")])
    got = sorted({(r["l"], r["t"]) for r in drawn.select("l", "t").collect()})
    order = np.random.RandomState(3).permutation(len(got))
    return fit([got[i][1] for i in order], [got[i][0] for i in order], **options)


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected added, in place of columns of those names. The score is the calibrated probability, times
    the share of known sequences where a text is rejected for unknown ones.

    Null and empty texts and texts without a letter are `und` with score 0, and rejected; so is everything if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(texts):
        import pandas as pd

        out = [shared.value.judge(t) for t in texts]
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return docs.select(*kept, judge(text_col).alias("__l")).select(*kept, "__l.*")


def learning_rows(id_col: str = "doc_id") -> Column:
    return crc_mod(F.col(id_col), 5) != 0


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, lang_pred, score, rejected. Null and empty texts and texts without a letter are und with score 0 and
    rejected; ties go to the language first in alphabetical order; repeated rows are rows of their own."""
    docs = read_table(spark, sf_dir, "documents")
    model = train_language_model(docs.filter(learning_rows()))
    out = predict_language(docs.select("doc_id", "text", (~learning_rows()).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE: dict[str, str] = {}
