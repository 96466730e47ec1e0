"""Hidden Markov language model over words.

Latent states are trained by Baum-Welch: every iteration each task runs the scaled forward and backward recursions over its documents and
adds up expected transition and emission counts; Spark adds the counts of all tasks, and the next model comes from the sums. A document's
likelihood is exact: the scaled forward recursion over all its words and the end.

Emissions. States emit symbols. A word that makes up at least `symbol_share` of the training tokens is a symbol of its own; of the others,
words with the same last three bytes (hashed to `suffix_classes`) are one symbol, inside which a word has its share of the class count and
a word never seen in training the share of the class's words seen once. So parameters number at most (1/symbol_share + suffix_classes)
times the states at any corpus size, while every word keeps its own count: rarer words than `table_share` are looked up by a join on the
word, not by a broadcast table.

Scale: word counts are summed in the tasks before the shuffle; rare words are joined on the word, which is rare in what was learned but may
be common elsewhere (another language), and then adaptive execution splits it; symbols of all documents are written once to the shared folder and each iteration streams them.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, only_result, read_table, stage_table, text_bytes

END = b""  # no word is empty
SUFFIX = 3


@dataclass(frozen=True)
class Settings:
    states: int = 8
    iterations: int = 4
    symbol_share: float = 1e-5
    table_share: float = 1e-6
    suffix_classes: int = 4096
    prior_tokens: float = 1000.0
    group_tokens: int = 1_000_000
    seed: int = 11


@dataclass
class Model:
    start: np.ndarray  # K
    step: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K


def tokens_of(text) -> list[bytes]:
    words = text_bytes(text).lower().split()
    words.append(END)
    return words


def count_words(texts: DataFrame, flush_at: int = 200_000) -> DataFrame:
    """(word, c) over the tokens of column text; the end counts as the empty word."""

    def run(batches):
        held = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for t in b.column(0):
                held.update(tokens_of(t.as_py()))
                if len(held) >= flush_at:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class _Codes(dict):
    """Word to its row in the table; other words to -1 - suffix class."""

    classes = 1

    def __missing__(self, word):
        return -1 - zlib.crc32(word[-SUFFIX:]) % self.classes


@dataclass
class Lexicon:
    words: list[bytes]  # of the table, the symbols first
    counts: np.ndarray
    symbols: int
    classes: int
    base: np.ndarray  # log10 of the base probability
    inside: np.ndarray  # log10 of the share in the symbol
    symbol: np.ndarray

    def codes(self) -> _Codes:
        out = _Codes(zip(self.words, range(len(self.words))))
        out.classes = self.classes
        return out


_CODES: dict[int, _Codes] = {}


def forward(seqs: list[np.ndarray], m: Model) -> np.ndarray:
    """Log10 likelihood of each sequence of symbols, by the scaled forward recursion; all sequences of a group step together."""
    return _sweep(seqs, m, False)[0]


def expected_counts(seqs: list[np.ndarray], m: Model):
    """(log10 likelihoods, start counts, transition counts, emission counts) of a group of sequences."""
    return _sweep(seqs, m, True)


def _sweep(seqs, m: Model, count: bool):
    kind = np.float32 if count else np.float64
    step, emit, start = m.step.astype(kind), m.emit.astype(kind), m.start.astype(kind)
    length = np.array([len(s) for s in seqs])
    order = np.argsort(-length, kind="stable")
    length = length[order]
    flat = np.concatenate([seqs[i] for i in order])
    begin = np.cumsum(length) - length
    active = np.searchsorted(-length, -np.arange(length[0]), "left")  # sequences longer than t
    at = np.concatenate([[0], np.cumsum(active)])
    loglik = np.zeros(len(seqs))
    if count:
        alpha, sym, scale = np.empty((len(flat), len(start)), kind), np.empty(len(flat), flat.dtype), np.empty(len(flat), kind)
    a = start
    for t, n in enumerate(active):
        x = flat[begin[:n] + t]
        a = (a[:n] @ step if t else np.broadcast_to(start, (n, len(start)))) * emit[x]
        c = a.sum(axis=1)
        a /= c[:, None]
        loglik[:n] += np.log10(c)
        if count:
            alpha[at[t] : at[t + 1]], sym[at[t] : at[t + 1]], scale[at[t] : at[t + 1]] = a, x, c
    out = np.empty(len(seqs))
    out[order] = loglik
    if not count:
        return (out,)
    moved = np.zeros_like(step, np.float64)
    later, n_later = None, 0
    for t in range(len(active) - 1, -1, -1):
        lo, hi = at[t], at[t + 1]
        beta = np.ones((hi - lo, len(start)), kind)
        if n_later:
            moved += alpha[lo : lo + n_later].T @ later
            beta[:n_later] = later @ step.T
        later = emit[sym[lo:hi]] * beta
        later /= scale[lo:hi, None]
        alpha[lo:hi] *= beta
        n_later = hi - lo
    emitted = np.stack([np.bincount(sym, weights=alpha[:, k], minlength=len(emit)) for k in range(len(start))], axis=1)
    return out, alpha[: active[0]].sum(axis=0, dtype=np.float64), moved * step, emitted


def _groups(batches, column: int, size: int):
    """(record batch rows, sequences) in groups of about size tokens, long sequences together."""
    rows, seqs, total = [], [], 0
    for b in batches:
        for i, s in enumerate(b.column(column)):
            seqs.append(np.frombuffer(s.as_buffer(), "<u4"))
            rows.append((b, i))
            total += len(seqs[-1])
        if total >= 4 * size:
            yield from _cut(rows, seqs, size)
            rows, seqs, total = [], [], 0
    if seqs:
        yield from _cut(rows, seqs, size)


def _cut(rows, seqs, size):
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    part, total = [], 0
    for i in order:
        part.append(i)
        total += len(seqs[i])
        if total >= size:
            yield [rows[j] for j in part], [seqs[j] for j in part]
            part, total = [], 0
    if part:
        yield [rows[j] for j in part], [seqs[j] for j in part]


def train(symbols: DataFrame, share: np.ndarray, cfg: Settings) -> Model:
    """Baum-Welch over column sym of all rows. share: each symbol's share of the training tokens."""
    sc, k, s, rng = symbols.sparkSession.sparkContext, cfg.states, len(share), np.random.RandomState(cfg.seed)
    emit = share[:, None] * np.exp(0.7 * rng.normal(size=(s, k)))
    m = Model(np.full(k, 1 / k), np.full((k, k), 0.1 / k) + 0.9 * np.eye(k), emit / emit.sum(axis=0))
    names = [f"c{i}" for i in range(k)]
    for _ in range(cfg.iterations):
        shared = sc.broadcast(m)

        def run(batches, shared=shared):
            now, totals = shared.value, None
            for _, seqs in _groups(batches, 0, cfg.group_tokens):
                got = expected_counts(seqs, now)[1:]
                totals = got if totals is None else [a + b for a, b in zip(totals, got)]
            if totals is not None:
                first, moved, emitted = totals
                seen = np.flatnonzero(emitted.any(axis=1))
                rows = np.concatenate([first[None], moved, emitted[seen]])
                keys = np.concatenate([[-1], np.arange(-2, -2 - k, -1), seen]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(k))], ["key", *names])

        sums = symbols.select("sym").mapInArrow(run, "key int, " + ", ".join(f"{c} double" for c in names)).groupBy("key").agg(*(F.sum(c).alias(c) for c in names))
        got = sums.toPandas()  # at most the model's size
        shared.unpersist()
        keys, values = got["key"].to_numpy(), got[names].to_numpy()
        first, moved, emitted = np.full(k, 0.1), np.full((k, k), 0.1), cfg.prior_tokens * np.repeat(share[:, None], k, axis=1)
        for key, v in zip(keys[keys < 0], values[keys < 0]):
            if key == -1:
                first += v
            else:
                moved[-2 - key] += v
        emitted[keys[keys >= 0]] += values[keys >= 0]
        m = Model(first / first.sum(), moved / moved.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0))
    return m


def score_texts(docs: DataFrame, learn: Column, cfg: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; the model learns from rows where `learn` is true.

    Tokens: A-Z lower-cased, words between white space, then one end; null and empty texts have the end alone. Rows that repeat an id are
    scored each. With nothing to learn from, base_score is 0 and the model is uniform over its symbols.
    """
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = stage_table(count_words(rows.filter("learn")), "hmm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    lex, class_rows, share = _lexicon(counts, n, v, cfg)
    shared = sc.broadcast(lex)

    def encode(batches):
        from pyspark import TaskContext

        x = shared.value
        if id(x) not in _CODES:
            _CODES.clear()
            _CODES[id(x)] = x.codes()
        code_of, uid = _CODES[id(x)].__getitem__, TaskContext.get().partitionId() << 40
        known = x.counts > 0
        for b in batches:
            out = [[] for _ in range(7)]
            for t in b.column(1):
                words = tokens_of(t.as_py())
                codes = np.fromiter(map(code_of, words), np.int32, len(words))
                rare = np.flatnonzero(codes < 0)
                sym = np.where(codes >= 0, x.symbol[np.maximum(codes, 0)], x.symbols - 1 - codes).astype("<u4")
                table = codes[codes >= 0]
                few = Counter([words[i] for i in rare])
                for o, value in zip(out, (len(words), int(known[table].sum()), float(x.base[table].sum()), float(x.inside[table].sum()), sym.tobytes(), list(few.keys()), list(few.values()))):
                    o.append(value)
            k = b.num_rows
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(np.arange(uid, uid + k)), *(pa.array(o, kd) for o, kd in zip(out, kinds))],
                ["id", "learn", "uid", "n_tokens", "n_known", "base", "inside", "sym", "words", "times"],
            )
            uid += k

    schema = f"id {kind}, learn boolean, uid long, n_tokens long, n_known long, base double, inside double, sym binary, words array<binary>, times array<int>"
    coded = stage_table(rows.mapInArrow(encode, schema), "hmm-symbols")
    model = train(coded.filter("learn"), share, cfg) if n else Model(np.full(cfg.states, 1 / cfg.states), np.full((cfg.states,) * 2, 1 / cfg.states), np.repeat(share[:, None], cfg.states, axis=1))

    rare = coded.select("uid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("uid", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rare = rare.join(counts.filter(F.col("c") < _least(n, cfg.table_share)), "word", "left").select("uid", "times", F.coalesce("c", F.lit(0)).alias("c"), suffix_class(F.col("word"), cfg).alias("cls"))
    classes = docs.sparkSession.createDataFrame(class_rows, "cls long, total double, unseen double")  # at most suffix_classes rows
    rare = rare.join(F.broadcast(classes), "cls")
    share_in = F.when(F.col("c") > 0, F.col("c")).otherwise(F.col("unseen")) / F.col("total")
    rare = rare.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.1) / (n + 0.1 * (v + 1)))).alias("base_"),
        F.sum(F.col("times") * F.log10(share_in)).alias("inside_"),
    )
    fitted = sc.broadcast(model)

    def score(batches):
        for got, seqs in _groups(batches, 0, cfg.group_tokens):
            ll, parts = forward(seqs, fitted.value), {}
            for j, (b, i) in enumerate(got):  # the rows' other columns go on in the same batch
                parts.setdefault(id(b), (b, [], []))[1].append(i)
                parts[id(b)][2].append(j)
            for b, rows_, order in parts.values():
                own = b.take(pa.array(rows_, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns[1:], pa.array(ll[order])], [*own.schema.names[1:], "path"])

    kept = ["id", "learn", "uid", "n_tokens", "n_known", "base", "inside"]
    scored = coded.select("sym", *kept).mapInArrow(score, f"id {kind}, learn boolean, uid long, n_tokens long, n_known long, base double, inside double, path double")
    out = scored.join(rare, "uid", "left")
    zero = F.lit(0.0)
    out = out.select(
        F.col("id").alias(id_col), (~F.col("learn")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known_", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_", zero)).alias("base_score"), (F.col("path") + F.col("inside") + F.coalesce("inside_", zero)).alias("score"),
    )
    return only_result(out, "hmm-scores", counts, coded)


def suffix_class(word: Column, cfg: Settings) -> Column:
    return F.crc32(F.substring(word, -SUFFIX, SUFFIX)) % F.lit(cfg.suffix_classes)


def _least(n: int, share: float) -> int:
    """Least count that makes the share of n tokens."""
    return max(1, math.ceil(share * n))


def _lexicon(counts: DataFrame, n: int, v: int, cfg: Settings):
    """Table of the more frequent words (at most 1/table_share), suffix classes, and the share of each symbol."""
    table = counts.filter(F.col("c") >= _least(n, cfg.table_share)).collect()
    table = sorted(((bytes(r["word"]), r["c"]) for r in table), key=lambda p: (-p[1], p[0]))
    end = counts.filter(F.octet_length("word") == 0).first()
    end = end["c"] if end else 0
    table = [(END, end), *(p for p in table if p[0] != END)]
    least = _least(n, cfg.symbol_share)
    symbols = 1 + sum(c >= least for _, c in table[1:])
    rest = counts.filter((F.col("c") < least) & (F.octet_length("word") > 0))
    got = rest.groupBy(suffix_class(F.col("word"), cfg).alias("cls")).agg(F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()
    size, once = np.zeros(cfg.suffix_classes), np.zeros(cfg.suffix_classes)
    for r in got:
        size[r["cls"]], once[r["cls"]] = r["c"], r["once"]
    unseen = once + 0.5
    total = size + unseen
    c = np.array([p[1] for p in table], np.float64)
    cls = np.array([zlib.crc32(w[-SUFFIX:]) % cfg.suffix_classes for w, _ in table])
    own = np.arange(len(table)) < symbols
    inside = np.where(own, 0.0, np.log10(np.maximum(c, 1e-300) / total[cls]))
    base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    lex = Lexicon([w for w, _ in table], c, symbols, cfg.suffix_classes, base, inside, np.where(own, np.arange(len(table)), symbols + cls))
    share = np.concatenate([np.maximum(c[:symbols], 0.5), total])
    return lex, [(i, float(total[i]), float(unseen[i])) for i in range(cfg.suffix_classes)], share / share.sum()


def op1_hmm_score(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null and empty texts are one end; a null doc_id
    counts as empty text in the split; repeated rows are rows of their own."""
    return score_texts(read_table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) != 0)


QUERIES = {"op1_hmm_score": op1_hmm_score}
ORACLE: dict[str, str] = {}
