"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Many words are encoded at once in flat numpy arrays: one symbol per character, the rank of each symbol's pair with its right neighbour, and
segment bounds. A round takes each segment's least pair rank (a segmented minimum), merges the leftmost pair of that rank in every segment
simultaneously, compacts the arrays and looks up the ranks of the pairs that are new. Segments without a pair leave. Words that a
worker has met are remembered in a bounded cache that only the rounds fill.

Where words may be cut: every merge makes a piece of the vocabulary, so no merge joins two characters that are nowhere neighbours inside a
piece. Texts are cut before a run of spaces if no piece holds a space after another character, and at characters that stand in no piece
with a neighbour; within words, segments are cut at all other such pairs of characters. Encoding is therefore exact for any block size.

Several pairs of one rank in a segment merge in the same round only if that rank is `safe`: nothing that holds its piece ranks the same or
before it, so that the merges one after another would give the same. At other ranks (runs of spaces share one score) the leftmost pair alone
merges, and a segment with many such pairs is swept from left to right up to that rank.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

SPACE = "▁"
#: A symbol is a piece's id, or the vocabulary's size plus the code point of a character that is no piece; symbols fit in SYMBOL_BITS.
SYMBOL_BITS = 21
SYMBOL_MASK = (1 << SYMBOL_BITS) - 1
NO_PAIR = np.iinfo(np.int64).max
MANY, CACHE_WORDS, LONG_WORD, FLUSH_CHARS = 64, 500_000, 256, 1 << 21

codecs.register_error("axonlake-bytewise", lambda e: ("�" * (e.end - e.start), e.end))


class PairTable:
    """Open addressing over (left symbol, right symbol) keys; looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_PAIR, np.int64)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[at[todo]] < 0
            cell, first = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[cell], self.values[cell] = keys[placed], values[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = (at[todo] + (self.keys[at[todo]] >= 0)) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, or NO_PAIR."""
        key = (left.astype(np.int64) << SYMBOL_BITS) | right
        at = self._home(key)
        out, there = self.values[at], self.keys[at]
        left_over = np.flatnonzero((there != key) & (there >= 0))
        out[there != key] = NO_PAIR
        while len(left_over):
            at[left_over] = (at[left_over] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[left_over]]
            hit = there == key[left_over]
            out[left_over[hit]] = self.values[at[left_over[hit]]]
            left_over = left_over[~hit & (there >= 0)]
        return out


class PieceModel:
    """Pieces, ranks and word boundaries of a SentencePiece BPE model without normalisation rules."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        if sp.normalize("a  Ａ") != f"{SPACE}a{SPACE * 2}Ａ" or sp.normalize(""):
            raise ValueError("only models that prefix a space and change nothing else are supported")
        self.size, self.bos, self.eos = sp.get_piece_size(), sp.bos_id(), sp.eos_id()
        every = range(self.size)
        control = [sp.is_control(i) for i in every]
        byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in every if sp.is_byte(i)}
        if len(byte) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.pieces = {sp.id_to_piece(i): i for i in every if not (control[i] or sp.is_byte(i) or sp.is_unknown(i))}
        self.byte_ids = np.array([byte[b] for b in range(256)], np.int32)
        self.surface = [b"" if control[i] else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in every]
        for b, i in byte.items():
            self.surface[i] = bytes([b])
        self.spaced = {i for p, i in self.pieces.items() if p.startswith(SPACE)}
        self.shown = {i for i in every if not control[i]}
        self.symbol = (np.arange(0x110000) + self.size).astype(np.int32)
        for p, i in self.pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self._pairs(sp)
        self._cuts()

    def _symbol_of(self, part: str) -> int | None:
        return self.pieces.get(part, self.size + ord(part) if len(part) == 1 else None)

    def _pairs(self, sp) -> None:
        """The pairs that make a piece, with its rank (by falling score, equal scores sharing one) above its symbol; and the safe ranks."""
        rank = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in self.pieces.values()}, reverse=True))}
        ranks = {i: rank[sp.get_score(i)] for i in self.pieces.values()}
        keys, values, self.safe = [], [], np.ones(len(rank) + 1, bool)
        for p, i in self.pieces.items():
            for at in range(1, len(p)):
                left, right = self._symbol_of(p[:at]), self._symbol_of(p[at:])
                if left is None or right is None:
                    continue
                keys.append((left << SYMBOL_BITS) | right)
                values.append((ranks[i] << SYMBOL_BITS) | i)
                for part in (left, right):
                    if part in ranks and ranks[i] <= ranks[part]:
                        self.safe[ranks[part]] = False
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int64))
        self.pair_of = dict(zip(keys, values))

    def _cuts(self) -> None:
        """Neighbours inside pieces, and the pattern of words that follows from them."""
        near = {(p[k], p[k + 1]) for p in self.pieces for k in range(len(p) - 1)}
        self.neighbours = PairTable(np.array([(int(self.symbol[ord(a)]) << SYMBOL_BITS) | int(self.symbol[ord(b)]) for a, b in near], np.int64), np.zeros(len(near), np.int64))
        joined = {c for pair in near for c in pair}
        alone = re.escape("".join(c for c in map(chr, range(128)) if c not in joined and c != SPACE))
        if any(b == SPACE and a != SPACE for a, b in near):
            self.words, self.word_starts = re.compile(".+", re.DOTALL).findall, None
        else:
            self.words = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + f"|[{alone}]" * bool(alone)).findall
            self.word_starts = re.compile(f"(?<=[^{SPACE}]){SPACE}")

    def blocks(self, text: str | None, size: int = FLUSH_CHARS):
        """The normalised text in blocks of about `size` characters, cut between words."""
        if not text:
            return
        text, at = SPACE + text.replace(" ", SPACE), 0
        while at < len(text):
            found = self.word_starts.search(text, at + size) if self.word_starts and at + size < len(text) else None
            to = found.start() if found else len(text)
            yield text[at:to]
            at = to

    def _sweep(self, symbols: list[int], level: int) -> dict[int, int]:
        """Merge the pairs of one segment of rank `level` or before, least rank and then leftmost first; {index: symbol} of what is left."""
        n = len(symbols)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            value = self.pair_of.get((symbols[i] << SYMBOL_BITS) | symbols[j]) if j < n else None
            if value is not None and value >> SYMBOL_BITS <= level:
                heapq.heappush(queue, (value >> SYMBOL_BITS, i, symbols[i], symbols[j]))

        for i in range(n):
            push(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # merged meanwhile
            symbols[i], symbols[j], right[i] = self.pair_of[(a << SYMBOL_BITS) | b] & SYMBOL_MASK, -1, right[j]
            if right[i] < n:
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return {i: s for i, s in enumerate(symbols) if s >= 0}

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        n_chars = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
        total = len(sym)
        final, pos = np.full(total, -1, np.int32), np.arange(total)
        cut = np.zeros(total + 1, bool)
        cut[np.concatenate(([0], np.cumsum(n_chars)))] = True
        inner = np.flatnonzero(~cut[1:total])  # a character and its right neighbour, in one word
        cut[inner[self.neighbours.find(sym[inner], sym[inner + 1]) == NO_PAIR] + 1] = True
        bounds = np.flatnonzero(cut)
        starts, size = bounds[:-1], np.diff(bounds)
        value = np.full(total, NO_PAIR)
        inner = np.flatnonzero(~cut[1:total])
        value[inner] = self.pairs.find(sym[inner], sym[inner + 1])
        while len(starts):
            least = np.minimum.reduceat(value, starts)
            alive = least < NO_PAIR
            if not alive.all():
                stay = np.repeat(alive, size)
                final[pos[~stay]] = sym[~stay]
                sym, pos, value, size, least = sym[stay], pos[stay], value[stay], size[alive], least[alive]
                starts = np.cumsum(size) - size
                if not len(starts):
                    break
            level = least >> SYMBOL_BITS
            segment = np.repeat(np.arange(len(size)), size)
            hit = np.flatnonzero(value >> SYMBOL_BITS == level[segment])
            of, order = segment[hit], np.arange(len(hit))
            opens = np.concatenate(([True], np.diff(hit) != 1))
            even = (order - np.maximum.accumulate(np.where(opens, order, 0))) % 2 == 0  # in a run of overlapping pairs, every other one
            leftmost = np.concatenate(([True], np.diff(of) != 0))
            safe, fresh = self.safe[level][of], []
            gone, crowd = np.zeros(len(sym), bool), ()
            if not safe.all():
                crowd = np.flatnonzero((np.bincount(of, minlength=len(size)) > MANY) & ~self.safe[level])
                if len(crowd):
                    leftmost &= ~np.isin(of, crowd)
            merged = hit[np.where(safe, even, leftmost)]
            sym[merged] = value[merged] & SYMBOL_MASK
            gone[merged + 1] = True
            for k in crowd:
                a, b = starts[k], starts[k] + size[k]
                kept = self._sweep(sym[a:b].tolist(), int(level[k]))
                at = np.fromiter(kept, np.int64, len(kept)) + a
                gone[a:b] = True
                gone[at], sym[at] = False, np.fromiter(kept.values(), np.int32, len(kept))
                fresh.append(at)
            size = size - np.bincount(segment[gone], minlength=len(size))
            shift = np.cumsum(gone)
            fresh = np.concatenate([merged, *fresh])
            fresh -= shift[fresh]
            stay = ~gone
            sym, pos, value = sym[stay], pos[stay], value[stay]
            starts = np.cumsum(size) - size
            first, last = np.zeros(len(sym), bool), np.zeros(len(sym), bool)
            first[starts], last[starts + size - 1] = True, True
            value[fresh[last[fresh]]] = NO_PAIR
            again = np.concatenate((fresh[~last[fresh]], fresh[~first[fresh]] - 1))
            value[again] = self.pairs.find(sym[again], sym[again + 1])
        return self._fall_back(final, n_chars)

    def _fall_back(self, final: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids, characters that are no piece to the ids of their UTF-8 bytes."""
        word = np.repeat(np.arange(len(n_chars)), n_chars)[final >= 0]
        sym = final[final >= 0]
        if (odd := np.flatnonzero(sym >= self.size)).size:
            spelt = [self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in (sym[odd] - self.size).tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(x) for x in spelt]
            at = np.repeat(np.isin(np.arange(len(sym)), odd, assume_unique=True), times)
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            sym[at] = np.concatenate(spelt)
        return sym.astype("<u4"), np.bincount(word, minlength=len(n_chars))


class PieceEncoder:
    """Encodes blocks of normalised text; words of up to LONG_WORD characters are remembered until there are CACHE_WORDS."""

    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}

    def encode_blocks(self, blocks: list[str]) -> list[bytes]:
        """The ids of each block as little-endian unsigned 32-bit integers."""
        split = [self.model.words(b) for b in blocks]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = list(set().union(*split).difference(self.known))
        if new:
            ids, n = self.model.merge(new)
            raw, ends = ids.tobytes(), (4 * np.cumsum(n)).tolist()
            self.known.update(zip(new, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        if max(map(len, new), default=0) > LONG_WORD:
            self.known = {w: x for w, x in self.known.items() if len(w) <= LONG_WORD}
        return out

    def encode(self, text: str | None, block: int = FLUSH_CHARS) -> bytes:
        """Ids of one text, without begin and end ids."""
        return b"".join(x for b in self.model.blocks(text, block) for x in self.encode_blocks([b]))


class PieceDecoder:
    """Ids to the bytes of the text; the space that encoding prefixed is taken off the first piece."""

    def __init__(self, model: PieceModel):
        self.model, self.begun = model, False

    def feed(self, ids) -> bytes:
        out = b"".join(map(self.model.surface.__getitem__, ids))
        if not self.begun and (first := next((i for i in ids if i in self.model.shown), None)) is not None:
            self.begun = True
            return out[1:] if first in self.model.spaced else out
        return out

    @classmethod
    def text(cls, model: PieceModel, ids) -> str:
        """The text of all ids; bytes that are no UTF-8 become one replacement character each."""
        return cls(model).feed(ids).decode("utf-8", "axonlake-bytewise")


_LOADED: dict[bytes, PieceEncoder] = {}


def shared_encoder(proto: bytes) -> PieceEncoder:
    """Parsed once in each Python worker."""
    key = hashlib.sha256(proto).digest()
    if key not in _LOADED:
        _LOADED[key] = PieceEncoder(PieceModel(proto))
    return _LOADED[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _broadcast(spark, path: str):
    """The model file, of a fixed size of under a MB, once for each executor."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(texts, enc: PieceEncoder, block: int):
    """(row, ids of a block) of all texts in order; blocks of several rows go through the merge rounds together."""
    held, chars = [], 0
    for row, text in enumerate(texts):
        for b in enc.model.blocks(text, block):
            held.append((row, b))
            chars += len(b)
            if chars >= FLUSH_CHARS:
                yield from zip((r for r, _ in held), enc.encode_blocks([b for _, b in held]))
                held, chars = [], 0
    yield from zip((r for r, _ in held), enc.encode_blocks([b for _, b in held]))


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ends: bool = True) -> DataFrame:
    """(id, ids) with ids as array<int>, between the begin and the end id if `ends`. Null and empty texts have no ids of their own."""
    source = _broadcast(docs.sparkSession, model)

    def run(batches):
        enc = shared_encoder(source.value)
        for b in batches:
            parts = [[np.array([enc.model.bos] * ends, "<u4").tobytes()] for _ in range(b.num_rows)]
            for row, ids in _encoded((t.as_py() for t in b.column(1)), enc, FLUSH_CHARS):
                parts[row].append(ids)
            flat = [b"".join([*p, np.array([enc.model.eos] * ends, "<u4").tobytes()]) for p in parts]
            offsets = np.cumsum([0, *(len(x) // 4 for x in flat)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(flat), "<i4")))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids); null ids give an empty text, begin and end ids nothing."""
    source = _broadcast(encoded.sparkSession, model)

    def run(batches):
        m = shared_encoder(source.value).model
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([PieceDecoder.text(m, x.as_py() or ()) for x in b.column(1)], pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 18) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded with begin and end ids and decoded in one pass, a block at a time.

    Null and empty texts have the begin and end ids only, and decode to nothing. Rows that repeat an id are rows of their own; an empty table
    gives an empty result; other columns are ignored.
    """
    source = _broadcast(docs.sparkSession, model)

    def run(batches):
        enc = shared_encoder(source.value)
        m = enc.model
        bos, eos = np.array([m.bos], "<u4").tobytes(), np.array([m.eos], "<u4").tobytes()
        for b in batches:
            rows = [[2, hashlib.sha256(bos), hashlib.sha256(), PieceDecoder(m)] for _ in range(b.num_rows)]
            for row, ids in _encoded((t.as_py() for t in b.column(1)), enc, block):
                state = rows[row]
                state[0] += len(ids) // 4
                state[1].update(ids)
                state[2].update(state[3].feed(memoryview(ids).cast("I")))
            for state in rows:
                state[1].update(eos)
            cols = [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1].hexdigest() for x in rows], pa.string()), pa.array([x[2].hexdigest() for x in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have the begin and end ids only; repeated rows are rows
    of their own."""
    return round_trip(read_table(spark, sf_dir, "documents"), default_model())


QUERIES = {"op13_sentencepiece": op13_sentencepiece}
ORACLE: dict[str, str] = {}
