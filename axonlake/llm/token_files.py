"""Token ids in wavelet-matrix shard files.

A shard holds the ids of consecutive documents. Bit-plane k stores bit k (highest first) of every id, in the order that the planes
above leave: ids whose bit is 0 move to the front, stably. With a count of ones per block of 512 positions, each plane answers rank
and select, so one file gives access to any token, counts of a token in any range and the position of its j-th occurrence without
being decoded. A shard file is one binary value in a Parquet data set (any store that Spark reads and writes), with the shard's first
document, number of ids and order beside it; Parquet compresses it.

Layout of a shard, little-endian: b"AXWM", version u16, bit planes u16, documents u32, ids u64; document ids i64 each (validity u8
each), ends of documents u64 each; then per plane: zeros u64, the plane's bits (eight to a byte, first position lowest) padded to
eight bytes, ones before each block u32 each.
"""

from __future__ import annotations

import gc
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import LONGEST_KEPT, PLAIN_MARKS, Encoder, Vocabulary, _broadcast, _byte_chars, default_tokenizer, text_blocks
from .common import read_table, shared_dir

BLOCK = 512
HEAD = struct.Struct("<4sHHIQ")


class WaveletMatrix:
    """Bit planes with rank and select over a sequence of unsigned integers below 2**bits."""

    def __init__(self, n: int, planes: list[tuple[int, np.ndarray, np.ndarray]]):
        self.n, self.planes, self.bits = n, planes, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        nxt, planes = np.empty_like(a), []
        for k in range(bits - 1, -1, -1):
            one = (a & a.dtype.type(1 << k)).astype(bool)
            packed = np.zeros(-(-len(a) // 64) * 8, np.uint8)
            packed[: -(-len(a) // 8)] = np.packbits(one, bitorder="little")
            zeros = len(a) - int(np.count_nonzero(one))
            planes.append((zeros, packed, _ones_before(packed)))
            if k:
                np.compress(one, a, out=nxt[zeros:])
                np.compress(np.logical_not(one, out=one), a, out=nxt[:zeros])
                a, nxt = nxt, a
        return cls(len(ids), planes)

    def _rank1(self, plane, i: int) -> int:
        _, packed, before = plane
        b = i // BLOCK
        whole = packed[b * 64 : i // 8]
        tail = int(packed[i // 8]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(before[b]) + int(np.bitwise_count(whole).sum()) + tail.bit_count()

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in self.planes:
            bit = int(plane[1][i // 8]) >> (i % 8) & 1
            ones = self._rank1(plane, i)
            value = value << 1 | bit
            i = plane[0] + ones if bit else i - ones
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for k, plane in enumerate(self.planes):
            a, b = self._rank1(plane, lo), self._rank1(plane, hi)
            lo, hi = (plane[0] + a, plane[0] + b) if value >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count_ranges(self, value: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Occurrences of value in each of the ranges lo to hi - 1, all ranks of a plane at once."""
        at = np.stack([lo, hi]).astype(np.int64)
        if value >> self.bits or value < 0 or not self.n:
            return np.zeros(len(lo), np.int64)
        for k, (zeros, packed, before) in enumerate(self.planes):
            cut = np.minimum(at, self.n)
            words = np.concatenate([packed, np.zeros(64, np.uint8)]).view("<u8")
            block = cut // BLOCK
            inside = words[(block * 8)[..., None].clip(max=len(words) - 8) + np.arange(8)]
            bits = (cut - block * BLOCK)[..., None] - 64 * np.arange(8)
            mask = np.where(bits >= 64, ~np.uint64(0), (np.uint64(1) << bits.clip(0, 63).astype(np.uint64)) - np.uint64(1))
            ones = before[block].astype(np.int64) + np.bitwise_count(inside & mask).sum(axis=-1, dtype=np.int64)
            at = zeros + ones if value >> (self.bits - 1 - k) & 1 else at - ones
        return at[1] - at[0]

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of value at positions lo to hi - 1."""
        if value >> self.bits or value < 0:
            return 0
        lo, hi = self._range(value, lo, self.n if hi is None else hi)
        return hi - lo

    def select(self, value: int, j: int) -> int:
        """Position of the j-th occurrence of value, from 0."""
        if not 0 <= j < self.count(value):
            raise IndexError(j)
        i = self._range(value, 0, self.n)[0] + j
        for k in range(self.bits - 1, -1, -1):
            plane = self.planes[k]
            one = value >> (self.bits - 1 - k) & 1
            i = self._select_bit(plane, one, i - plane[0] if one else i)
        return i

    def _select_bit(self, plane, one: int, j: int) -> int:
        _, packed, before = plane
        ahead = before if one else np.arange(len(before), dtype=np.int64) * BLOCK - before
        b = int(np.searchsorted(ahead, j, "right")) - 1
        bits = np.unpackbits(packed[b * 64 : (b + 1) * 64], bitorder="little")
        return b * BLOCK + int(np.flatnonzero(bits == one)[j - int(ahead[b])])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, j) for j in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        a = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k, (zeros, packed, _) in enumerate(reversed(self.planes)):
            one = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            out = np.empty_like(a)
            out[~one] = a[:zeros]
            out[one] = a[zeros:] | a.dtype.type(1 << k)
            a = out
        return a


def _ones_before(packed: np.ndarray) -> np.ndarray:
    words = np.bitwise_count(packed.view(np.uint64)).astype(np.int64)
    blocks = np.add.reduceat(words, np.arange(0, len(words), BLOCK // 64)) if len(words) else words
    return np.concatenate([[0], np.cumsum(blocks)]).astype(np.uint32)


def pack_shard(doc_ids: list, ids: list[np.ndarray], bits: int) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    wm = WaveletMatrix.build(flat, bits)
    parts = [HEAD.pack(b"AXWM", 1, bits, len(doc_ids), len(flat)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes()]
    parts.append(np.cumsum([len(x) for x in ids]).astype("<u8").tobytes())
    for zeros, packed, before in wm.planes:
        parts += [struct.pack("<Q", zeros), packed.tobytes(), before.astype("<u4").tobytes()]
    return b"".join(parts)


def open_shard(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """(document ids, end of each document, wavelet matrix) of a shard file; the planes are views of data."""
    magic, version, bits, docs, n = HEAD.unpack_from(data)
    if magic != b"AXWM" or version != 1:
        raise ValueError("not a shard file")
    at = HEAD.size

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    names, valid, ends = take("<i8", docs), take(np.uint8, docs), take("<u8", docs)
    planes = []
    for _ in range(bits):
        zeros = int(take("<u8", 1)[0])
        size = -(-n // 64) * 8
        planes.append((zeros, take(np.uint8, size), take("<u4", -(-size // 64) + 1)))
    return [int(d) if v else None for d, v in zip(names, valid)], ends.astype(np.int64), WaveletMatrix(n, planes)


#: Where a single space or line feed need not begin a piece of its own: after other white space.
LOOSE, LOOSE_LINE = r"[\t-\r\x1c-\x20\x{85}\p{Z}] | \n", r"[\t-\r\x1c-\x1f\x{85}\p{Z}]\n"


class LibraryEncoder(Encoder):
    """Ids by the tokenizers library's model; remembered as in Encoder.

    encode_column() takes a column apart in Arrow: a piece begins before every single space, and before and after every single line feed,
    so texts are words between such marks, and the ids of a stretch of texts are gathered from those of its distinct words. Pieces that are
    new in a stretch go to the model many at a time, parted by a byte that takes part in no merge, so that nothing can merge across it.
    """

    STRETCH, CALL = 1 << 23, 128  # bytes of text taken apart at a time; pieces in a call

    def __init__(self, source: str, cache: int = 800_000):
        from tokenizers import Tokenizer

        super().__init__(Vocabulary(source), cache=cache)
        self.model = Tokenizer.from_str(source).model
        self.chars = np.array([ord(c) for c, _ in sorted(_byte_chars().items(), key=lambda x: x[1])], "<u2")
        merged = {x for pair in self.v.rank for i in pair for x in self.v.bytes[i]}
        self.between = next((chr(x) for x in range(0x20) if x not in merged), None)

    def _model_ids(self, text: str) -> np.ndarray:
        mapped = self.chars[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes().decode("utf-16-le")
        return np.array([t.id for t in self.model.tokenize(mapped)], "<u4")

    def _piece(self, piece: str) -> bytes:
        return self._model_ids(piece).tobytes()

    def _many(self, words: list[str], before: str = "") -> list[bytes]:
        """Ids of each word with `before` in front, each of which is one piece, by the model."""
        one, out = self.between, []
        if one is None or max(map(len, words), default=0) > LONGEST_KEPT or any(one in w for w in (" ".join(words),)):
            few = {w for w in words if one is not None and one not in w and len(w) <= LONGEST_KEPT}
            known = dict(zip(few, self._many(list(few), before)))
            return [known[w] if w in few else self._piece(before + w) for w in words]
        for at in range(0, len(words), self.CALL):
            ids = self._model_ids(before + (one + before).join(words[at : at + self.CALL]))
            cuts = 4 * np.flatnonzero(ids == self.v.byte_id[ord(one)])
            data = ids.tobytes()
            out += map(data.__getitem__, map(slice, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(data)]))
        return out

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words that self.words does not hold. A space stands before a word, unless it begins with one, which then stands for itself:
        a line feed and what follows it. A word with a mark after it takes the ids of the word and those of the mark."""
        words, pieces, out = self.words, self.pieces, {}
        if words.old:
            out = {w: ids for w, ids in zip(new, map(words.old.get, new)) if ids is not None}
            new = [w for w in new if w not in out]
        plain = [w for w in new if w.isalpha()]
        rest = [w for w in new if not w.isalpha()]
        marked = [w for w in rest if w[-1:] in PLAIN_MARKS and w[:-1].isalpha()]
        split = {w: self.find(w[1:] if w[:1] == " " else " " + w) for w in rest if not (w[-1:] in PLAIN_MARKS and w[:-1].isalpha())}
        need = {w[:-1] for w in marked}.union(p[1:] for ps in split.values() for p in ps if p[0] == " ")
        have = {w: ids for w in need if (ids := words.get(w)) is not None or (ids := words.old.get(w)) is not None}
        plain = list(need.difference(have).union(plain))
        have.update(zip(plain, self._many(plain, " ")))
        own = {p for ps in split.values() for p in ps if p[0] != " "}
        bare = {p: ids for p in own if (ids := pieces.get(p)) is not None or (ids := pieces.old.get(p)) is not None}
        fresh = list(own.difference(bare))
        bare.update(zip(fresh, self._many(fresh)))
        self._keep(pieces, bare)
        mark = {m: pieces[m] for m in PLAIN_MARKS}
        have.update([(w, have[w[:-1]] + mark[w[-1]]) for w in marked])
        have.update([(w, b"".join([have[p[1:]] if p[0] == " " else bare[p] for p in ps])) for w, ps in split.items()])
        have |= out
        self._keep(words, have)
        return have

    @staticmethod
    def _keep(cache, items: dict[str, bytes]) -> None:
        if len(cache) + len(items) > cache.limit:
            cache.old = dict(cache)
            cache.clear()
        cache.update(items if max(map(len, items), default=0) <= LONGEST_KEPT else {k: v for k, v in items.items() if len(k) <= LONGEST_KEPT})

    def _stretch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.or_(pc.match_substring_regex(texts, LOOSE), pc.greater(pc.binary_length(texts), self.STRETCH))
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        kept = pc.if_else(odd, "", texts)
        kept = pc.if_else(pc.match_substring_regex(kept, LOOSE_LINE), kept, pc.replace_substring(kept, "\n", " \n"))
        lists = pc.split_pattern(kept, " ")
        coded = lists.flatten().dictionary_encode()
        begins = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()  # a text without words is one empty word
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        ids = [self._run(w) for w in words.take(coded.indices.take(pa.array(begins))).to_pylist()]  # no space before these
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            ids[i] = b"".join([*map(self.feed, text_blocks(texts[i])), self.finish()])
        code[begins] = len(words)
        used = np.zeros(len(words) + 1, bool)
        used[code] = True
        code = (np.cumsum(used) + len(ids) - 1)[code]
        code[begins] = np.arange(len(ids))
        words = words.filter(pa.array(used[:-1]))
        lines = np.flatnonzero(pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)).tolist()
        words = words.to_numpy(zero_copy_only=False).tolist()
        for i in lines:
            words[i] = " " + words[i]
        got = list(map(self.words.get, words))
        if new := [w for w, x in zip(words, got) if x is None]:
            learned = self._learn(new)
            got = [learned[w] if x is None else x for w, x in zip(words, got)]
        ids += got
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, n = np.frombuffer(b"".join(ids), "<u4"), sizes[code]
        at = np.repeat((np.cumsum(sizes) - sizes)[code] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return flat[at], np.add.reduceat(n, begins)

    def encode_column(self, texts: pa.Array):
        """(ids, number of ids of each text) of stretches of a column of texts; null is empty."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        gc.disable()  # the library's token objects by the million would set off collections that find nothing
        try:
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + self.STRETCH, "right")))
                yield self._stretch(texts[at:end])
                at = end
        finally:
            gc.enable()

    def documents(self, names: pa.Array, texts: pa.Array, end_id: int):
        """(name, ids and the end id) of every row."""
        small, at = np.uint16 if max(len(self.v.bytes) - 1, end_id) < 1 << 16 else np.uint32, 0
        for flat, sizes in self.encode_column(texts):
            ends = np.cumsum(sizes)
            flat, ends = np.insert(flat.astype(small), ends, end_id), ends + np.arange(1, len(ends) + 1)
            yield from zip(names[at : at + len(ends)].to_pylist(), np.split(flat, ends[:-1]), strict=True)
            at += len(ends)


_LIBRARY: dict[str, LibraryEncoder] = {}


def _library(source: str) -> LibraryEncoder:
    """One in each Python worker for each vocabulary."""
    if source not in _LIBRARY:
        _LIBRARY[source] = LibraryEncoder(source)
    return _LIBRARY[source]


def write_token_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 2_000_000) -> None:
    """Encode docs in ascending id order and write shard files of at least shard_ids ids, but for the last of each partition, to path.

    Columns: part, seq (order of shards), n_ids, payload. Null and empty texts consist of the end id; a null id sorts first; rows
    that repeat an id follow each other in an order that depends on their text alone, and may lie in several shards. A document is never
    split. Ids must be whole numbers.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be a column of whole numbers")
    spark = docs.sparkSession
    source = _broadcast(spark, tokenizer)

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        enc = _library(source.value)
        bits = max(len(enc.v.bytes) - 1, end_id).bit_length()
        held, ids, size = [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([pack_shard(held, ids, bits)], pa.binary())], ["part", "seq", "n_ids", "payload"])

        for b in batches:
            for d, x in enc.documents(b.column(0), b.column(1), end_id):
                held.append(d)
                ids.append(x)
                size += len(x)
                if size >= shard_ids:
                    yield flush()
                    held, ids, size, seq = [], [], 0, seq + 1
        if held:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"), F.monotonically_increasing_id().alias("salt"))
    rows = rows.repartitionByRange(n, "id", "h", "salt").sortWithinPartitions("id", "h", "text").select("id", "text")  # the salt splits rows that repeat id and text
    rows.mapInArrow(run, "part int, seq int, n_ids long, payload binary").write.option("compression", "zstd").parquet(path)


def read_token_shards(spark: SparkSession, path: str, with_ids: bool = True, end_id: int = 2) -> DataFrame:
    """One row per document of the shard files at path: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, n_end (how often
    end_id occurs in it, by rank on the bit planes) and, unless with_ids is false, ids (little-endian u32, binary). The checksum is taken
    where a shard is decoded, so without ids only small rows move on."""
    files = spark.read.parquet(path)
    sizes = files.select("part", "seq", "n_ids")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard of millions of ids
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_part"))  # one row per part that was written
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_part").over(across), F.lit(0)).alias("before_part"))
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("before_part") + F.col("inside")).alias("before"))

    names_ = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32", "n_end"] + ["ids"] * with_ids

    def run(batches):
        for b in batches:
            for part, seq, payload in zip(*(b.column(i) for i in range(3))):
                names, ends, wm = open_shard(payload.as_py())
                ids, begins = wm.decode().astype("<u4"), np.concatenate([[0], ends[:-1]])
                n_end = wm.count_ranges(end_id, begins, ends)
                for at in range(0, len(names), 1000):
                    lo, hi = begins[at : at + 1000], ends[at : at + 1000]
                    values = [ids[i:j].tobytes() for i, j in zip(lo, hi)]
                    k = len(lo)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.as_py()] * k, pa.int32()), pa.array([seq.as_py()] * k, pa.int32()), pa.array(names[at : at + 1000], pa.int64()), pa.array(lo, pa.int64()), pa.array(hi - lo, pa.int64()), pa.array([zlib.crc32(v) for v in values], pa.int64()), pa.array(n_end[at : at + 1000], pa.int64()), *([pa.array(values, pa.binary())] if with_ids else [])],
                        names_,
                    )

    schema = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long, n_end long" + ", ids binary" * with_ids
    rows = files.select("part", "seq", "payload").mapInArrow(run, schema)
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "n_end", *["ids"] * with_ids)


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document, from the files read back: doc_id, start, n_tokens, ids_crc32, n_end. Null and empty texts are one end id; a null
    doc_id comes first; repeated rows are rows of their own; an empty table gives an empty result."""
    path = f"{shared_dir(spark)}/axonlake-token-shards-{uuid.uuid4().hex}"
    write_token_shards(read_table(spark, sf_dir, "documents"), default_tokenizer(), path)
    return read_token_shards(spark, path, with_ids=False)


QUERIES = {"op2_token_files": op2_token_files}
ORACLE: dict[str, str] = {}
