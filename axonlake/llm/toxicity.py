"""Toxicity: a linear classifier over hashed character n-grams, their presence scaled by naive Bayes log-count ratios.

Log-count ratios r come from all labelled rows for learning: each task counts, for each hashed n-gram, the toxic and the clean texts
that contain it, and Spark adds the counts. A logistic regression over x = r * presence is then fitted on a bounded sample of those
rows, and scaled by the scores that rows get from models which have not seen them, neither in the ratios nor in the fit. A score is the
logistic of the sum of w * r over the distinct n-grams of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, drop_staged, ngram_hashes, read_table, stage_table

ORDERS, STRETCH, FOLDS = (4, 5, 6, 7), 1 << 20, 3


@dataclass
class ToxicityModel:
    weight: np.ndarray  # w * r by bucket
    bias: float
    bits: int


def _distinct(text: str, bits: int, keep: np.ndarray | None = None) -> np.ndarray:
    """Buckets of the n-grams of a text, each once; only those where keep is true."""
    units, parts = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), "<u4"), []
    for at in range(0, len(units), STRETCH):
        for n in ORDERS:
            h = ngram_hashes(units[at : at + STRETCH + n - 1], n, bits)
            parts.append(h if keep is None else h[keep[h]])
    return np.unique(np.concatenate(parts))


def count_ngrams(labelled: DataFrame, bits: int) -> DataFrame:
    """(bucket, toxic, clean): texts of each class with an n-gram of the bucket, from columns text and toxic; bucket -1 counts the texts."""

    def run(batches):
        n = np.zeros((2, 1 << bits), np.int32)
        rows = [0, 0]
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                n[y][_distinct(t.as_py() or "", bits)] += 1
                rows[y] += 1
        at = np.flatnonzero(n.any(axis=0)).astype(np.int32)
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[1][part], pa.int64()), pa.array(n[0][part], pa.int64())], ["bucket", "toxic", "clean"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([rows[1]], pa.int64()), pa.array([rows[0]], pa.int64())], ["bucket", "toxic", "clean"])

    return labelled.select("text", F.col("toxic").cast("int")).mapInArrow(run, "bucket int, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, epochs: int = 12, rate: float = 0.3, decay: float = 1e-2, seed: int = 5) -> tuple[np.ndarray, float]:
    """AdaGrad over sparse rows of present buckets with value r[bucket]; returns w and bias."""
    w, square, bias = np.zeros(len(r), np.float64), np.full(len(r), 1e-6), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    bias_square, rng = 1e-6, np.random.RandomState(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            x = r[at]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + bias, -30, 30)))
            g = (p - y[i]) * x + decay * w[at]
            square[at] += g * g
            w[at] -= rate * g / np.sqrt(square[at]) / np.sqrt(max(1, len(at)))
            bias_square += (p - y[i]) ** 2
            bias -= rate * (p - y[i]) / np.sqrt(bias_square)
    return w, bias


def log_ratios(toxic: np.ndarray, clean: np.ndarray, rows: tuple[int, int], least_texts: int, least_ratio: float) -> np.ndarray:
    """Log-count ratios of n-grams in so many toxic and clean texts of rows = (toxic, clean) texts; 0 below either floor."""
    r = np.log((toxic + 1) / (rows[0] + 2)) - np.log((clean + 1) / (rows[1] + 2))
    return np.where((toxic + clean >= least_texts) & (np.abs(r) >= least_ratio), r, 0)


def fit_scale(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the logistic of a * s + b with Platt's smoothed targets; (1, 0) where s does not rank toxic texts higher."""
    n = y.sum()
    want, z = np.where(y > 0, (n + 1) / (n + 2), 1 / (len(y) - n + 2)), np.stack([s, np.ones(len(s))])
    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ z, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))) @ z.T + 1e-6 * np.eye(2), z @ (p - want))
        at = at - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return (float(at[0]), float(at[1])) if np.isfinite(at).all() and at[0] > 0 else (1.0, 0.0)


#: Settings among which cross-validation chooses: least size of a ratio, decay of the regression.
SETTINGS = ((1.0, 1e-2), (1.8, 1e-2), (1.8, 1e-3))


def train_toxicity_model(labelled: DataFrame, bits: int = 20, least_texts: int = 5, settings: tuple = SETTINGS, fit_rows: int = 8000) -> ToxicityModel:
    """Fit on columns (id, text, toxic 0/1). Ratios count every row; the regression uses at most about fit_rows rows, drawn by a hash of
    the id (the documented bound of the fit). N-grams in fewer than least_texts texts, however many texts there are, or with a ratio below
    the least in size, weigh nothing. Of the settings the one with the least log loss on rows left out is taken, by cross-validation over
    rows given here alone. Without rows of both classes every score is the share of toxic rows (one half without rows)."""
    counts = stage_table(count_ngrams(labelled, bits), "toxicity-counts")
    total = counts.filter("bucket < 0").first()
    toxic, clean = (total["toxic"], total["clean"]) if total else (0, 0)
    ratio = F.ln((F.col("toxic") + 1) / F.lit(toxic + 2)) - F.ln((F.col("clean") + 1) / F.lit(clean + 2))
    least = min(x for x, _ in settings)
    got = counts.filter((F.col("bucket") >= 0) & (F.col("toxic") + F.col("clean") >= least_texts) & (F.abs(ratio) >= least)).toPandas()  # at most 2**bits rows
    drop_staged(counts)
    if not toxic or not clean:
        return ToxicityModel(np.zeros(1 << bits, np.float32), float(np.log((toxic + 1) / (clean + 1))), bits)
    n = np.zeros((2, 1 << bits), np.int64)
    n[1][got.bucket.to_numpy()], n[0][got.bucket.to_numpy()] = got.toxic.to_numpy(), got.clean.to_numpy()
    keep = labelled.sparkSession.sparkContext.broadcast(log_ratios(n[1], n[0], (toxic, clean), least_texts, least) != 0)
    grain = 1_000_000

    def run(batches):
        for b in batches:
            rows = [_distinct(t.as_py() or "", bits, keep.value).astype("<u4").tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column(1), b.column(2)], ["at", "toxic", "fold"])

    drawn = labelled.filter(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(grain)) < min(grain, -(-grain * fit_rows // (toxic + clean))))
    fold = F.pmod(F.xxhash64("text", F.lit(29)), F.lit(FOLDS)).cast("int")  # copies of a text share a fold
    sample = drawn.select("text", F.col("toxic").cast("int"), fold.alias("fold")).mapInArrow(run, "at binary, toxic int, fold int").collect()
    sample.sort(key=lambda x: (bytes(x["at"]), x["toxic"], x["fold"]))
    rows, y, folds = [np.frombuffer(x["at"], "<u4") for x in sample], np.array([x["toxic"] for x in sample], float), np.array([x["fold"] for x in sample])
    chosen, scale = settings[0], (1.0, 0.0)
    if 0 < y.sum() < len(y):
        tried = [(*cross_validate(rows, y, folds, n, (toxic, clean), least_texts, *x), x) for x in settings]
        _, scale, chosen = min(tried, key=lambda t: t[0])
    r = log_ratios(n[1], n[0], (toxic, clean), least_texts, chosen[0])
    w, bias = fit_logistic([at[r[at] != 0] for at in rows], y, r, decay=chosen[1])
    a, b = scale
    return ToxicityModel((a * w * r).astype(np.float32), a * bias + b, bits)


def cross_validate(rows: list, y: np.ndarray, folds: np.ndarray, n: np.ndarray, texts: tuple[int, int], least_texts: int, least_ratio: float, decay: float):
    """(log loss, scale) of the scores that rows get from models which have seen them neither in the ratios nor in the fit."""
    s = np.zeros(len(y))
    for k in range(FOLDS):
        out, seen = np.flatnonzero(folds == k), np.flatnonzero(folds != k)
        m = n.copy()
        for i in out:
            m[int(y[i])][rows[i]] -= 1
        left = log_ratios(m[1], m[0], (texts[0] - int(y[out].sum()), texts[1] - int((1 - y[out]).sum())), least_texts, least_ratio)
        v, c = fit_logistic([rows[i][left[rows[i]] != 0] for i in seen], y[seen], left, decay=decay)
        weight = v * left
        s[out] = [weight[rows[i]].sum() + c for i in out]
    a, b = fit_scale(s, y)
    p = np.clip(1 / (1 + np.exp(-np.clip(a * s + b, -30, 30))), 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), (a, b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) added, in place of a column of that name. Null and empty texts have the score of no n-gram at all."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]

    @F.pandas_udf("double")
    def judge(texts):
        import pandas as pd

        m = shared.value
        keep = m.weight != 0
        s = np.array([m.weight[_distinct(t or "", m.bits, keep)].sum(dtype=np.float64) for t in texts]) + m.bias
        return pd.Series(1 / (1 + np.exp(-np.clip(s, -30, 30))))

    return docs.select(*kept, judge(text_col).alias("score"))


def learning_rows(id_col: str = "doc_id") -> Column:
    return crc_mod(F.col(id_col), 3) != 1


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, toxic) of documents with a toxic label; of several labels of a document the highest counts. Labels grow with the
    documents, so they are never broadcast."""
    marks = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return docs.join(marks.hint("merge"), "doc_id").select(F.col("doc_id").alias("id"), "text", "toxic")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted. Null and empty texts have the score of no n-gram at all; a null doc_id counts as
    empty text in the split; repeated rows are rows of their own; of several labels of a document the highest counts."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(learning_rows())
    known = stage_table(labelled_texts(docs.filter(learning_rows()), labels), "toxicity-rows")
    model = train_toxicity_model(known)
    drop_staged(known)
    out = score_toxicity(docs.withColumn("held_out", ~learning_rows()), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE: dict[str, str] = {}
