"""Ranked lexical search with LEMP-style norm buckets.

The impact vector of a document holds, for each term that an item of the block asks for, the term's weight times its saturated frequency: the
integer that the term adds to the score. An item is a vector of ones, so a score is an inner product and Cauchy-Schwarz bounds it by the
document's length times the root of the item's number of terms.

A task takes its documents in runs of bounded size, orders each run by length, longest first, and cuts it into buckets. Each item keeps its k
best documents so far; the last of them is the item's threshold. Per bucket:

* length: items whose bound at the bucket's greatest length is below their threshold are done with the bucket;
* coordinates: an item's lightest terms whose greatest coordinates in the bucket add up to `spare` of the threshold or less are set aside. The
  others are added up from the bucket's posting lists; what those set aside can add is bounded by their greatest coordinates and by
  Cauchy-Schwarz on the rest of the document's length, and documents whose bound is below the threshold go;
* survivors are scored exactly in 64-bit integers.

The bounds are taken a little high against rounding, and equal scores survive, so results are exact. Tasks pass on k rows for each item, which
two windows reduce, the first within groups of tasks. Items are a stated query set: they go to the tasks in blocks of bounded
size (ITEMS, ITEM_BYTES), with one pass over the texts for each block. Document frequencies, N and L are counted over all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, only_result, read_table, stage_table, text_bytes

#: Digits, letters and everything beyond ASCII; as bytes of UTF-8 the same as in characters.
TERMS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
STRETCH = 1 << 20
ITEMS, ITEM_BYTES = 20_000, 16 << 20
RUN_DOCS, RUN_TERMS, BUCKET, SPARE = 1 << 16, 1 << 22, 1024, 0.5
ROOM = 1 + 1e-9


def term_counts(data: bytes) -> Counter:
    """Occurrences of each term; long texts are taken in stretches that end between terms."""
    if len(data) <= STRETCH:
        return Counter(TERMS.findall(data.lower()))
    out, at = Counter(), 0
    outside = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
    while at < len(data):
        end = outside.search(data, at + STRETCH)
        to = end.start() if end else len(data)
        out.update(TERMS.findall(data[at:to].lower()))
        at = to
    return out


def item_blocks(items: DataFrame, item_col: str, text_col: str, most_items: int, most_bytes: int):
    """Blocks of (item_id, distinct terms); a block ends at most_items items or most_bytes bytes of text."""
    block, size = [], 0
    for row in items.select(F.col(item_col).cast("long"), text_col).toLocalIterator():
        data = text_bytes(row[1])
        if terms := sorted(term_counts(data)):
            block.append((row[0], terms))
            size += len(data)
        if len(block) >= most_items or size >= most_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) per row: its number of terms with repeats, and the vocabulary's terms in it with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for b in batches:
            n, terms, tfs, ends = [], [], [], [0]
            for t in b.column(1):
                counts = term_counts(text_bytes(t.as_py()))
                n.append(sum(counts.values()))
                for term in known.keys() & counts.keys():
                    terms.append(known[term])
                    tfs.append(counts[term])
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, n long, terms array<int>, tfs array<long>")


class NormBuckets:
    """The k best documents of each item among those fed so far."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int, run_docs: int, bucket: int, spare: float):
        self.weights, self.n_docs, self.n_terms, self.k, self.run_docs, self.bucket = weights, n_docs, n_terms, k, run_docs, bucket
        self.items = [t[np.argsort(-weights[t], kind="stable")] for t in items]  # heaviest terms first
        self.spare, self.roots = spare, np.sqrt([float(len(t)) for t in items])
        self.least = np.ones(len(items))  # scores below are of no use
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))] * len(items)
        self.held: list[tuple] = []
        self.held_docs = self.held_terms = self.compared = self.scored = 0

    def feed(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, size: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Documents (id, whether it is null, number of terms, length of the vector) with their vectors in a row."""
        m = 10 + (90 * n * self.n_docs) // max(1, self.n_terms)
        impact = self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, size)))
        use = impact > 0
        doc = np.repeat(np.arange(len(ids)), size)[use]
        self.held.append((ids, null, np.bincount(doc, minlength=len(ids)), terms[use], impact[use]))
        self.held_docs += len(ids)
        self.held_terms += len(doc)
        if self.held_docs >= self.run_docs or self.held_terms >= RUN_TERMS:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        ids, null, size, terms, impact = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.held_docs, self.held_terms = [], 0, 0
        starts = np.cumsum(size) - size
        square = np.bincount(np.repeat(np.arange(len(size)), size), weights=impact.astype(float) ** 2, minlength=len(size))
        order = np.argsort(-square, kind="stable")
        order = order[square[order] > 0]
        for at in range(0, len(order), self.bucket):
            rows = order[at : at + self.bucket]
            if not self._bucket(ids[rows], null[rows], square[rows], size[rows], *_gather(starts[rows], size[rows], terms, impact)):
                break  # shorter documents are of no use to any item

    def _bucket(self, ids, null, square, size, terms, impact) -> bool:
        """Search one bucket for every item; False if its greatest length rules out all of them."""
        open_items = np.flatnonzero(self.roots * math.sqrt(square[0]) * ROOM >= self.least)
        if not len(open_items):
            return False
        doc, starts = np.repeat(np.arange(len(ids)), size), np.cumsum(size) - size
        by_term = np.argsort(terms, kind="stable")
        bounds = np.searchsorted(terms[by_term], np.arange(len(self.weights) + 1))
        post_doc, post_impact = doc[by_term], impact[by_term]
        greatest = np.zeros(len(self.weights), np.int64)
        full = np.flatnonzero(np.diff(bounds))
        greatest[full] = np.maximum.reduceat(post_impact, bounds[full])
        wanted = np.zeros(len(self.weights), bool)
        for q in open_items:
            aside = np.cumsum(greatest[self.items[q]][::-1])
            cut = len(aside) - int(np.searchsorted(aside, self.spare * self.least[q], side="right"))
            head, rest = self.items[q][:cut], self.items[q][cut:]
            at, to = bounds[head], bounds[head + 1]
            hits, _ = _gather(at, to - at, np.arange(len(terms)), terms)
            sums = np.bincount(post_doc[hits], weights=post_impact[hits], minlength=len(ids))
            squares = np.bincount(post_doc[hits], weights=post_impact[hits].astype(float) ** 2, minlength=len(ids))
            more = np.sqrt(np.maximum(square * ROOM - squares, 0) * len(rest))
            found = np.flatnonzero((sums + np.minimum(more, float(greatest[rest].sum()))) * ROOM >= self.least[q])
            self.compared += len(ids)
            if len(found):
                wanted[self.items[q]] = True
                own, value = _gather(starts[found], size[found], terms, impact)
                score = np.zeros(len(found), np.int64)
                np.add.at(score, np.repeat(np.arange(len(found)), size[found]), np.where(wanted[own], value, 0))
                wanted[self.items[q]] = False
                self.scored += len(found)
                good = score >= self.least[q]
                self._keep(q, score[good], null[found[good]], ids[found[good]])
        return True

    def _keep(self, q: int, score, null, ids) -> None:
        score, null, ids = (np.concatenate(x) for x in zip(self.best[q], (score, null, ids)))
        top = np.lexsort((ids, null, -score))[: self.k]
        self.best[q] = (score[top], null[top], ids[top])
        if len(top) == self.k:
            self.least[q] = max(1, score[top[-1]])


def _gather(starts, size, *flat):
    """The stretches [start, start + size) of each flat array, one after the other."""
    index = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return [x[index] for x in flat]


def _search_block(docs: DataFrame, block: list, k: int, id_col: str, text_col: str, run_docs: int, bucket: int, spare: float) -> DataFrame:
    """(item, item_id, doc_id, score): k rows of each item, or all above 0, from each task, reduced within groups of tasks."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    vectors = stage_table(term_vectors(docs, vocabulary, id_col, text_col), "term-vectors")
    n_docs, n_terms = vectors.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row of each term of the block at most
        df[row["t"]] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    items = [np.array([vocabulary[t] for t in terms], np.int64) for _, terms in block]
    shared = docs.sparkSession.sparkContext.broadcast((items, [i for i, _ in block], weights))

    def run(batches):
        items, names, weights = shared.value
        search = NormBuckets(items, weights, n_docs, n_terms, k, run_docs, bucket, spare)
        for b in batches:
            ids, terms, tfs = b.column(0), b.column(2), b.column(3)
            null = np.array(ids.is_null())
            size = np.diff(terms.offsets.to_numpy())
            search.feed(ids.fill_null(0).to_numpy(zero_copy_only=False), null, b.column(1).to_numpy(), size, terms.flatten().to_numpy(), tfs.flatten().to_numpy())
        search.flush()
        for q, (score, null, ids) in enumerate(search.best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(score), pa.int64()), pa.array([names[q]] * len(score), pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(score, pa.int64())], ["item", "item_id", "doc_id", "score"])

    found = vectors.mapInArrow(run, "item long, item_id long, doc_id long, score long").withColumn("salt", F.spark_partition_id() % 64)
    first = Window.partitionBy("item", "salt").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = stage_table(found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("item", "item_id", "doc_id", "score"), "search-found")
    drop_staged(vectors)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  most_items: int = ITEMS, most_bytes: int = ITEM_BYTES, run_docs: int = RUN_DOCS, bucket: int = BUCKET, spare: float = SPARE) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item with a score above 0; equal scores by ascending doc_id.

    Null and empty texts have no terms: such an item has no rows and such a document none either. Every row is an item or a document of its own, so
    rows that repeat an id have their own ranks; a null doc_id ranks last among equal scores. Ids are integers; other columns are
    ignored. The result does not depend on block, run and bucket sizes, nor on spare.
    """
    if min(k, run_docs, bucket, most_items) < 1 or spare < 0:
        raise ValueError("k, run_docs, bucket and most_items must be at least 1 and spare at least 0")
    out = None
    used = []
    final = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for block in item_blocks(items, item_col, item_text, most_items, most_bytes):
        found = _search_block(docs, block, k, id_col, text_col, run_docs, bucket, spare)
        used.append(found)
        ranked = found.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return only_result(out, "search", *used)


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item: item_id, rank, doc_id, score. Nulls, ties and repeated rows as in ranked_search."""
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
QUERIES = {"op11_lexical_search": op11_lexical_search}
ORACLE: dict[str, str] = {
    "op11_lexical_search": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS terms FROM documents
        ), items AS (
            SELECT i, item_id, unnest(list_distinct(terms)) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_SQL_TERMS} AS terms FROM benchmark)
        ), totals AS (
            SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0
        ), postings AS (
            SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
            WHERE term IN (SELECT term FROM items) GROUP BY r, doc_id, n, term
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term, n_docs
        ), impacts AS (
            SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS x
            FROM postings JOIN weights USING (term), totals
        ), scores AS (
            SELECT i, item_id, r, doc_id, sum(x)::BIGINT AS score FROM items JOIN impacts USING (term) GROUP BY i, item_id, r, doc_id
        )
        SELECT item_id, rank::INTEGER AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
    """
}
