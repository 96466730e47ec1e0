"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A document that holds at least the share t of an item's n shingles misses at most n - ceil(t n) of them, so it holds one of the item's
n - ceil(t n) + 1 least shingle hashes: these are the item's signature. Documents are parted by size, the number of their shingles in powers
of two. For each part, the items that its largest document could contain make up one table of signatures, with the greatest hash in it as
the part's threshold; the signature of a document is all its shingle hashes up to the threshold of its part (a bottom sketch whose
share of the hash range is fixed by the items, so that it grows with the document). Items that the part's documents are too small for are
never looked up, and no contained item can be missed however much longer the document is - signatures of a fixed length would miss
some, since the Jaccard similarity of a short item and a long text is close to zero. Candidates are verified on exact shingles.

Scale: items are a stated query set, taken in blocks bounded by items and bytes; a block is broadcast and documents are scanned once for
it, with no shuffle, so no document, copy group or popular passage gathers anywhere. Of several blocks one is held at a time.
"""

from __future__ import annotations

import string
import zlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_staged, read_table, stage_table

_SPACES = bytes(range(0x21)) + string.punctuation.encode() + b"\x7f"
_TABLE = bytes.maketrans(_SPACES, b" " * len(_SPACES))
SEED = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation, control characters and spaces separate."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash of every run of width words, made of the words' checksums."""
    crc = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    m = len(words) - width + 1
    h = np.zeros(max(0, m), np.uint64)
    for i in range(width if m > 0 else 0):
        h = (h ^ crc[i : i + m]) * SEED
        h ^= h >> np.uint64(29)
    return h


def shingle_set(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


class ItemBlock:
    """Signatures and shingles of a block of items, by shingle width and size part of documents."""

    def __init__(self, items: list[tuple], width: int, share: float):
        self.share = share
        self.shingles: list[tuple] = []  # (item, shingles)
        signatures: dict[int, list] = defaultdict(list)  # by shingle width: (shingles needed, least hashes, item)
        for item, text in items:
            words = words_of(text)
            w = min(width, len(words))
            if w:
                own = shingle_set(words, w)
                need = self.need(len(own))
                least = np.unique(shingle_hashes(words, w))[: len(own) - need + 1]
                signatures[w].append((need, least, len(self.shingles)))
                self.shingles.append((item, own))
        self.parts = {w: self._parts(found) for w, found in signatures.items()}

    @staticmethod
    def _parts(found: list) -> list:
        """Table j is for documents of 2**(j-1) to 2**j - 1 shingles, the last one for all larger ones too: (threshold, filter, hashes, items)."""
        out, largest = [], max(need for need, _, _ in found)
        for j in range(largest.bit_length() + 1):
            fits = [(h, i) for need, least, i in found if need < 1 << j for h in least.tolist()]
            fits.sort()
            keys, seen = np.array([h for h, _ in fits], np.uint64), np.zeros(1 << 20, bool)
            seen[keys >> np.uint64(44)] = True
            out.append((keys[-1] if fits else np.uint64(0), seen, keys, np.array([i for _, i in fits], np.int64)))
        return out

    def need(self, n: int) -> int:
        """Shingles of n that make the share; whole numbers, so 0.8 of 30 is 24."""
        return max(1, -(-n * round(self.share * 10**6) // 10**6))

    def matches(self, text: str | None) -> list[tuple]:
        """(item, shared, size) of the items contained."""
        words, out = words_of(text), []
        for w, parts in self.parts.items():
            h = shingle_hashes(words, w)
            threshold, seen, keys, owner = parts[min(len(h).bit_length(), len(parts) - 1)]
            h = h[h <= threshold]
            h = np.unique(h[seen[h >> np.uint64(44)]])
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            found = {int(i) for a, b in zip(lo, hi) for i in owner[a:b]}
            own = shingle_set(words, w) if found else set()
            for i in sorted(found):
                item, wanted = self.shingles[i]
                shared = len(wanted & own)
                if shared >= self.need(len(wanted)):
                    out.append((item, shared, len(wanted)))
        return out


def _blocks(items: DataFrame, item_col: str, text_col: str, width: int, share: float, block_items: int, block_bytes: int):
    """ItemBlocks of at most so many items and about so many bytes of text; one empty block for an empty table."""
    block, size = [], 0
    for r in items.select(item_col, text_col).orderBy(item_col, text_col).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "")
        if len(block) == block_items or size >= block_bytes:
            yield ItemBlock(block, width, share)
            block, size = [], 0
    yield ItemBlock(block, width, share)


def find_contained_items(docs: DataFrame, items: DataFrame, share: float = 0.8, width: int = 5, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_items: int = 100_000, block_bytes: int = 1 << 25) -> DataFrame:
    """(id, item, n_shared, n_item, containment) for every document that holds at least the share of an item's distinct shingles.

    An item of fewer than `width` words has one shingle, all its words; items without words, and null or empty texts, match nothing. Items
    that repeat an id are separate items; documents that repeat an id are separate rows.
    """
    sc = docs.sparkSession.sparkContext
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, n_shared long, n_item long"
    arrow = to_arrow_type(items.schema[item_col].dataType)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(shared):
        def run(batches):
            m = shared.value
            for b in batches:
                at, rows = [], []
                for i, t in enumerate(b.column(1)):
                    if got := m.matches(t.as_py()):
                        at += [i] * len(got)
                        rows += got
                item, n, size = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(item, arrow), pa.array(n, pa.int64()), pa.array(size, pa.int64())], ["id", "item", "n_shared", "n_item"])

        return texts.mapInArrow(run, schema)

    blocks = _blocks(items, item_col, text_col, width, share, block_items, block_bytes)
    found, shared = [], sc.broadcast(next(blocks))
    for block in blocks:  # more than one: what each finds is written before the next is made
        found.append(stage_table(scan(shared), "leaks"))
        shared.unpersist()
        shared = sc.broadcast(block)
    found.append(scan(shared))
    out = reduce(DataFrame.unionByName, found).withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.8, width: int = 5, item_col: str = "item_id", text_col: str = "text", block_items: int = 100_000, block_bytes: int = 1 << 25) -> DataFrame:
    """docs without the rows that contain an item, as find_contained_items has it; columns as they were. Rows are judged one by one by their
    own text, whatever their ids: repeated and null ids are harmless, and no join is needed."""
    sc = docs.sparkSession.sparkContext

    def clean(shared):
        @F.pandas_udf("boolean")
        def judge(texts):
            return texts.map(lambda t: not shared.value.matches(t)).astype(bool)

        return judge(F.coalesce(F.col(text_col), F.lit("")))

    blocks = _blocks(items, item_col, text_col, width, share, block_items, block_bytes)
    left, staged, shared = docs, None, sc.broadcast(next(blocks))
    for block in blocks:
        left = stage_table(left.filter(clean(shared)), "clean")
        if staged is not None:
            drop_staged(staged)
        staged = left
        shared.unpersist()
        shared = sc.broadcast(block)
    return left.filter(clean(shared))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains: doc_id, item_id, n_shared, n_item, containment. Null and empty texts
    contain nothing; an item of fewer than five words must occur as a whole; repeated rows are rows of their own."""
    return find_contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(lower(text), '[^\x00-\x20!-/:-@\[-`{-~\x7f]+')"
ORACLE = {
    "op4_decontaminate": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d)),
        bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM b)),
        n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
        m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared * 10 >= n_item * 8
        UNION ALL
        SELECT doc_id, item_id, 1, 1, 1.0 FROM d JOIN b ON len(b.w) BETWEEN 1 AND 4
          AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ')
    """
}
QUERIES = {"op4_decontaminate": op4_decontaminate}
