"""Byte-level BPE as a streaming transducer with bounded lookahead, and the inverse state machine.

Step. A token sequence is the encoding of its bytes exactly if each adjacent pair is the encoding of its own. So of all tokens that end
where a byte was read, just one forms a fitting pair with the token that ends where it begins, and that is the last token of the encoding
of everything read so far. The transducer keeps this token for every position held; a byte costs a few lookups.

Emission. Whatever follows, the token across the end of what was read begins at a position from which the rest is the start of some token,
or at the end itself. The encodings up to those positions are known; the tokens that they all share are stable, are emitted, and their
bytes dropped. How long that can take is bounded: text to the right can change a merge only through a chain of competing merges, each of
lower priority than the one before and overlapping it on the left. `sufficient_lookahead` bounds the bytes that such a chain can span: for
each merge in rank order, its own bytes up to the overlap plus the longest chain of earlier merges that starts with the overlap. Tokens
that end so many bytes before the end are stable in any case, so the transducer holds a constant number of bytes however long a piece
without white space is. The end of a piece (a unit of the pre-tokenizer) settles all of it.

Texts are read in blocks; what a block leaves open (an unfinished word, a run of letters, a possible special token) is carried into the
next one, so neither the text nor its ids are held whole. Tokens of recent words are kept in a bounded cache, which the transducer fills.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import json
import re
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

#: Fixed value: the pre-tokenizer's pattern. White space is spelt as the Unicode property, which is what the library matches.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _byte_chars() -> dict[str, int]:
    """The printable stand-in for each byte in vocabulary files: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Merges, byte strings and special tokens of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only a plain byte-level BPE tokenizer is supported")
        chars = _byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        self.bytes = [b""] * (max(max(model["vocab"].values()), *(t["id"] for t in spec["added_tokens"]), 0) + 1)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in model["vocab"].items():
            self.bytes[i] = s.encode() if s in self.special else raw(s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.byte_id = [0] * 256
        for c, b in chars.items():
            self.byte_id[b] = model["vocab"][c]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        for a, b in pairs:
            self.rank[model["vocab"][a], model["vocab"][b]] = len(self.merged)
            self.merged.append(model["vocab"][a + b])
        self.longest = max(map(len, self.bytes))
        self.id_of = {b: i for i, b in enumerate(self.bytes) if b and b.decode("utf-8", "replace") not in self.special}
        self.ending: dict[bytes, int] = {}  # longest token that ends with these four bytes
        for b in self.id_of:
            if len(b) > 3:
                self.ending[b[-4:]] = max(self.ending.get(b[-4:], 0), len(b))
        self.fits = _Cache(self._fits, 300_000)

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens are the encoding of their bytes; (-1, token) asks it of one token."""
        ids = [x for x in pair if x >= 0]
        return merge_ids([self.byte_id[x] for i in ids for x in self.bytes[i]], self.rank, self.merged) == ids

    @cached_property
    def lookahead(self) -> int:
        return sufficient_lookahead(self.bytes[a] + self.bytes[b] for a, b in self.rank)

    @cached_property
    def starts(self) -> set[bytes]:
        """Proper beginnings of tokens."""
        return {b[:i] for b in self.id_of for i in range(1, len(b))}


def sufficient_lookahead(merged) -> int:
    """Bytes to the right of a token that settle it, from the merged strings in rank order."""
    longest: dict[bytes, int] = {}  # prefix of an earlier merge: bytes that a chain starting with it can span
    most = 0
    for s in merged:
        span = max([len(s), *(i + longest[s[i:]] for i in range(len(s)) if s[i:] in longest)])
        most = max(most, span)
        for i in range(1, len(s) + 1):
            if longest.get(s[:i], 0) < span:
                longest[s[:i]] = span
    return most


def merge_ids(ids: list[int], rank: dict, merged: list[int]) -> list[int]:
    """Apply merges by rank, leftmost first, until none fits."""
    if len(ids) > 48:
        return _merge_long(ids, rank, merged)
    none = len(merged)
    ranks = [rank.get(p, none) for p in zip(ids, ids[1:])]
    while ranks:
        r = min(ranks)
        if r == none:
            break
        i = ranks.index(r)
        ids[i : i + 2] = [merged[r]]
        del ranks[i]
        if i:
            ranks[i - 1] = rank.get((ids[i - 1], ids[i]), none)
        if i < len(ranks):
            ranks[i] = rank.get((ids[i], ids[i + 1]), none)
    return ids


def _merge_long(ids: list[int], rank: dict, merged: list[int]) -> list[int]:
    n = len(ids)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := rank.get(p)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j < 0 or rank.get((ids[i], ids[j])) != r:
            continue
        ids[i], ids[j] = merged[r], -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
            if (s := rank.get((ids[i], ids[after[j]]))) is not None:
                heapq.heappush(heap, (s, i))
        if before[i] >= 0 and (s := rank.get((ids[before[i]], ids[i]))) is not None:
            heapq.heappush(heap, (s, before[i]))
    return [x for x in ids if x >= 0]


class _Cache(dict):
    """Filled on demand. When full its entries become the old generation, from which those still in use come back; long keys are not kept."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST_KEPT:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: Longer words and pieces are not remembered in caches; they are encoded alike.
LONGEST_KEPT = 64


class PieceTransducer:
    """Bytes of one piece in, tokens out: feed() returns the tokens that became stable, finish() the rest."""

    EVERY, PREFIX = 64, 24

    def __init__(self, vocab: Vocabulary, memo: dict | None = None):
        self.v, self.memo = vocab, {} if memo is None else memo  # memo: last token by bytes from the start of a piece
        self.held, self.last = b"", [-1]  # last[i]: token that ends after i of the bytes held; last[0]: the last one emitted

    def _read(self, data: bytes) -> None:
        held = self.held = self.held + data
        last, memo = self.last, self.memo
        get, fits, ending = self.v.id_of.get, self.v.fits, self.v.ending
        i, n, known = len(last), len(held), min(len(held), self.PREFIX) if last[0] < 0 else 0
        while i <= known and (t := memo.get(held[:i])) is not None:
            last.append(t)
            i += 1
        while i <= n:
            at = i - ending.get(held[i - 4 : i], 3) if i > 3 else 0
            if at < 0:
                at = 0
            while (t := get(held[at:i])) is None or not fits[last[at], t]:
                at += 1
            last.append(t)
            if i <= known:
                memo[held[:i]] = t
            i += 1
        if len(memo) > 300_000:
            memo.clear()

    def _path(self, end: int, begin: int = 0) -> list[int]:
        out = []
        while end > begin:
            out.append(self.last[end])
            end -= len(self.v.bytes[out[-1]])
        return out[::-1]

    def _settle(self) -> list[int]:
        """Tokens that every continuation shares; their bytes are dropped."""
        n, last, size = len(self.held), self.last, self.v.bytes
        open_ = {n} | {q for q in range(max(0, n - self.v.longest), n) if self.held[q:] in self.v.starts}
        while len(open_) > 1:
            q = max(open_)
            open_.remove(q)
            open_.add(q - len(size[last[q]]))
        cut = open_.pop()
        if n > 2 * self.v.longest + self.EVERY and n - cut > self.v.lookahead + self.v.longest:
            raise AssertionError("a token stayed open beyond the lookahead")
        out = self._path(cut)
        if cut:
            self.held, self.last = self.held[cut:], last[cut:]
        return out

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.EVERY):
            self._read(data[at : at + self.EVERY])
            if len(self.held) >= 2 * self.EVERY:
                out += self._settle()
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.held))
        self.held, self.last = b"", [-1]
        return out


PLAIN_MARKS = frozenset(",.;:!?")
#: How a run that a block cuts goes on, by the kind of its last character.
_KINDS = [(regex.compile(p).match, regex.compile(p + "*").match) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}", r"[^\p{White_Space}\p{L}\p{N}]")]
SPACE_RUN = _KINDS[2][1]
LOOSE_SPACE, WORD_STARTS = re.compile(r"\s ").search, regex.compile(r"(?<=\P{White_Space})(?= )").split


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers in bytes: feed() blocks of a text, then finish()."""

    RUN = 1024  # a run of one piece that is longer is handed to the transducer as it comes

    def __init__(self, vocab: Vocabulary, cache: int = 300_000):
        self.v = vocab
        find = regex.compile(PIECES)
        self.find, self.each = find.findall, find.finditer
        self.pieces = _Cache(self._piece, cache // 2)
        self.words = _Cache(self._word, cache)
        self.memo: dict[bytes, int] = {}
        self.special = sorted(vocab.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.rest, self.run, self.more = "", None, None  # text not settled; transducer and continuation of an open piece

    def transducer(self):
        return PieceTransducer(self.v, self.memo)

    def _piece(self, piece: str) -> bytes:
        step = self.transducer()
        return array("I", step.feed(piece.encode("utf-8", "surrogatepass")) + step.finish()).tobytes()

    def _word(self, word: str) -> bytes:
        """A space and word. Letters are one piece with the space before them, and a mark of PLAIN_MARKS after them is a piece of its own."""
        if word.isalpha():
            return self._piece(" " + word)
        if word[-1:] in PLAIN_MARKS and word[:-1].isalpha():
            return self.pieces[" " + word[:-1]] + self.pieces[word[-1]]
        return self._run(" " + word)

    def _run(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def _plain(self, text: str) -> bytes:
        """Ids of a stretch between two ends of pieces. A piece starts before every space that follows something else than white space, so
        the words between such spaces are independent."""
        if LOOSE_SPACE(text) is None:
            first, *rest = text.split(" ")
            return self._run(first) + b"".join(map(self.words.__getitem__, rest))
        return b"".join(self._run(x) if x[:1] != " " or " " in x[1:] else self.words[x[1:]] for x in WORD_STARTS(text))

    def _go_on(self, text: str, last: bool) -> tuple[bytes, int]:
        """Feed an open piece; (ids, characters used). The last character of a run of white space may belong to the next piece, so it waits."""
        end = self.more(text).end()
        over = end < len(text) or last
        if self.more is SPACE_RUN and not (last and end == len(text)):
            end -= 1
        data = text[:end].encode("utf-8", "surrogatepass")
        ids = self.run.feed(data) + (self.run.finish() if over else [])
        if over:
            self.run = None
        return array("I", ids).tobytes(), end

    def _settled(self, text: str, last: bool) -> tuple[bytes, int]:
        """Ids of what is settled at the start of text and the number of its characters. last: a piece ends where text does."""
        out, at = b"", 0
        if self.run is not None:
            out, at = self._go_on(text, last)
            if self.run is not None:
                return out, at
        if last:
            return out + self._plain(text[at:]), len(text)
        p = text.rfind(" ", at + 1)  # a single space after something else begins a piece
        while p > at and text[p - 1].isspace():
            p = text.rfind(" ", at + 1, p)
        if p > at:
            return out + self._plain(text[at:p]), p
        if len(text) - at < 2 * self.RUN:
            return out, at
        for m in self.each(text, at):
            if m.start() > len(text) - 3:  # may be the beginning of a short form such as 're
                break
            if m.end() < len(text):
                out += self.pieces[m[0]]
                at = m.end()
                continue
            if m.end() - m.start() >= self.RUN:
                self.run, self.more = self.transducer(), next(more for one, more in _KINDS if one(text[-1]))
                end = len(text) - (self.more is SPACE_RUN)
                out += array("I", self.run.feed(text[at:end].encode("utf-8", "surrogatepass"))).tobytes()
                at = end
            break
        return out, at

    def feed(self, block: str, last: bool = False) -> bytes:
        """Ids that block settles. Special tokens stand for themselves wherever they occur."""
        text, parts = self.rest + block, []
        longest = len(self.special[0]) if self.special else 1
        if self.cut is not None and any(s in text for s in self.special):
            while (m := self.cut.search(text)) and (last or m.start() + longest <= len(text)):
                parts += [self._settled(text[: m.start()], True)[0], np.array([self.v.special[m[0]]], "<u4").tobytes()]
                text = text[m.end() :]
        ready = text if last else text[: max(0, len(text) - longest + 1)]
        ids, used = self._settled(ready, last)
        self.rest = text[used:]
        return b"".join((*parts, ids))

    def finish(self) -> bytes:
        return self.feed("", True)

    def encode(self, text: str) -> bytes:
        """Ids of one whole text."""
        return self.feed(text, True)


def text_blocks(value, size: int = 1 << 16):
    """Blocks of a text in an Arrow column, decoded from its buffer as they are asked for; none for null."""
    data = value.as_buffer()
    if data is None:
        return
    data, at = memoryview(data), 0
    while at < len(data):
        text, used = codecs.utf_8_decode(data[at : at + size], "surrogatepass", at + size >= len(data))
        at += used
        yield text


class Decoder:
    """Ids to text, incrementally: feed() returns the text that is complete; bytes of an unfinished character wait."""

    def __init__(self, vocab: Vocabulary):
        self.table, self.state = vocab.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        table = self.table
        return self.state.decode(b"".join([table[i] for i in ids]))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


_LOADED: dict[str, Vocabulary] = {}
_ENCODERS: dict[str, Encoder] = {}


def vocabulary(source: str) -> Vocabulary:
    """Parsed once in each Python worker."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(source)
    return _LOADED[key]


def shared_encoder(source: str) -> Encoder:
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary(source))
    return _ENCODERS[key]


def tokenizer_source(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _broadcast(spark, path: str):
    """The vocabulary file, of a fixed size of a few MB, once for each executor."""
    return spark.sparkContext.broadcast(tokenizer_source(path))


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as array<int>. Null and empty texts have no ids; special tokens in a text become their ids."""
    source = _broadcast(docs.sparkSession, tokenizer)

    def run(batches):
        enc = shared_encoder(source.value)
        for b in batches:
            ids = [enc.encode(t.as_py() or "") for t in b.column(1)]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids); null ids give an empty text."""
    source = _broadcast(encoded.sparkSession, tokenizer)

    def run(batches):
        dec = Decoder(vocabulary(source.value))
        for b in batches:
            texts = [dec.feed(x.as_py() or ()) + dec.finish() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(blocks, enc: Encoder, dec: Decoder) -> tuple[int, str, str]:
    """(number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them) of the blocks of one text; memory does not grow with it."""
    count, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

    def take(ids: bytes) -> None:
        nonlocal count
        count += len(ids) // 4
        of_ids.update(ids)
        of_text.update(dec.feed(memoryview(ids).cast("I")).encode("utf-8", "surrogatepass"))

    for block in blocks:
        take(enc.feed(block))
    take(enc.finish())
    of_text.update(dec.finish().encode())
    return count, of_ids.hexdigest(), of_text.hexdigest()


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 16) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded in one pass, `block` bytes at a time.

    Null and empty texts have no tokens and the digests of nothing. Rows that repeat an id are rows of their own; an empty table gives an
    empty result; other columns are ignored.
    """
    source = _broadcast(docs.sparkSession, tokenizer)

    def run(batches):
        enc, dec = shared_encoder(source.value), Decoder(vocabulary(source.value))
        gc.freeze()  # the vocabulary's many objects stay, so collections need not look at them
        for b in batches:
            got = [round_trip_digests(text_blocks(t, block), enc, dec) for t in b.column(1)]
            count, of_ids, of_text = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have no tokens; repeated rows are rows of their own."""
    return round_trip(read_table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op8_bpe": op8_bpe}
ORACLE: dict[str, str] = {}
