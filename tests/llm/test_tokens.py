import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from axonlake.llm import bpe, token_files

from . import data

PATH = bpe.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
VOCAB = bpe.vocabulary(bpe.tokenizer_source(PATH))
ENCODER = bpe.Encoder(VOCAB, cache=50)  # small, so that generations change
ALPHABET = st.sampled_from([" ", "  ", "\n", "\t", "a", "the", "'s", "'ll", "12", ".", "!!", "\u00a0", "\u3000", "é", "中", "\x1c", "\x85", "<|endoftext|>", "😀", "ing", "½", "²", "\r\n", "-", "_", "Ǆ"])


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=25).map("".join))
def test_encoder_and_decoder_match_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(ENCODER, text) == want
    dec, out = bpe.Decoder(VOCAB), ""
    for i in want:  # one id at a time: characters are split over tokens
        out += dec.feed([i])
    assert out + dec.finish() == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_decoding_any_ids(seq):
    dec = bpe.Decoder(VOCAB)
    assert dec.feed(seq) + dec.finish() == LIBRARY.decode(seq, skip_special_tokens=False)


@pytest.mark.parametrize("piece", ["a" * 20_000, "ab" * 9_000, "the" * 7_000, "=" * 9_001, "1234567890" * 900, "thousandsofwordswithoutspace" * 400])
def test_transducer_on_long_pieces(piece):
    want = LIBRARY.encode(piece, add_special_tokens=False).ids
    step, out, emitted_early = bpe.PieceTransducer(VOCAB), [], 0
    for at in range(0, len(piece), 777):
        out += step.feed(piece[at : at + 777].encode())
        emitted_early += bool(out)
        assert len(step.held) <= 2 * step.EVERY
    assert emitted_early and out + step.finish() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(ALPHABET, max_size=40).map("".join), st.integers(1, 9), st.sampled_from([2, 30, 1024]))
def test_blocks_of_any_size_give_the_same_ids(text, size, run):
    enc = bpe.Encoder(VOCAB, cache=50)
    enc.RUN = run
    got = b"".join([*(enc.feed(text[i : i + size]) for i in range(0, len(text), size)), enc.finish()])
    assert np.frombuffer(got, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", ["the river thnd, stone\n", "ab"])
def test_memory_is_flat_on_long_texts(unit):
    """A text of 2 blocks and then one of 16: what is held while it runs does not grow."""
    import tracemalloc

    enc, dec, block = bpe.Encoder(VOCAB), bpe.Decoder(VOCAB), unit * (16384 // len(unit))
    bpe.round_trip_digests([block] * 2, enc, dec)
    peaks = []
    for times in (2, 16):
        tracemalloc.start()
        bpe.round_trip_digests((block for _ in range(times)), enc, dec)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] + 50_000


def column_ids(enc, texts):
    out = []
    for flat, sizes in enc.encode_column(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    return out


@pytest.mark.parametrize("stretch, cache", [(30, 40), (1 << 20, 800_000)])
def test_columns_of_texts_match_the_library(stretch, cache):
    """Line feeds, special tokens, long words and texts beyond a stretch; small caches and stretches, so that generations change."""
    rng, enc = random.Random(stretch), token_files.LibraryEncoder(bpe.tokenizer_source(PATH), cache)
    enc.STRETCH = stretch
    parts = [" ", " ", " ", "\n", "\n", "  ", "\n\n", " \n", "\n ", "\t", "\r\n", "\u00a0", "\u3000", "\x1c", "\x85", "\x00", "\x01", "a", "the", "Ing", "'s", "12", ".", ",", "!!", "é", "中", "<|endoftext|>", "😀", "x" * 70]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(1500)] + [None, "", "\n", "\n\nfoo bar\n", "b" * 3000, "of the\n" * 20]
    assert column_ids(enc, texts) == [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert column_ids(enc, []) == []
    rows = list(enc.documents(pa.array(range(len(texts))), pa.array(texts), 2))  # every row keeps its name, whatever the stretches
    assert [n for n, _ in rows] == list(range(len(texts)))
    assert [x.tolist() for _, x in rows] == [e.ids + [2] for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_known_words_beside_line_feeds_are_not_encoded_anew(monkeypatch):
    """Every pair of 30 words with a mark and a line feed between them: 900 stretches without a space, no word of which is new."""
    enc, words = token_files.LibraryEncoder(bpe.tokenizer_source(PATH)), [a + b for a in "thnd rele oust wher inga".split() for b in "abcdef"]
    column_ids(enc, ["x " + " ".join(words) + "".join(f"\n{w}" for w in words)])
    calls, model_ids = [], enc._model_ids
    monkeypatch.setattr(enc, "_model_ids", lambda text: calls.append(text) or model_ids(text))
    texts = [f"x {a}.\n{b}" for a in words for b in words]
    assert column_ids(enc, texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert set(calls) <= {*token_files.PLAIN_MARKS, "x"}


def test_lookahead_is_a_constant_of_the_merge_list():
    assert VOCAB.lookahead == 3229
    assert bpe.sufficient_lookahead([]) == 0
    assert bpe.sufficient_lookahead([b"bc", b"ab"]) == 3  # ab competes with bc one byte to its right


def test_round_trip_over_awkward_documents(spark):
    docs = data.documents(spark)
    got = bpe.round_trip(docs, PATH, block=1000).collect()
    want = []
    for r in docs.collect():
        e = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert bpe.round_trip(data.empty(spark), PATH).count() == 0
    back = bpe.decode_ids(bpe.encode_texts(docs, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=1200), st.data())
def test_wavelet_matrix(values, draw):
    a = np.array(values, np.uint32)
    names, ends, wm = token_files.open_shard(token_files.pack_shard([7, None], [a[: len(a) // 3], a[len(a) // 3 :]], 17))
    assert names == [7, None] and list(ends) == [len(a) // 3, len(a)]
    assert (wm.decode() == a).all()
    if len(a):
        i = draw.draw(st.integers(0, len(a) - 1))
        assert wm.access(i) == a[i]
        v = int(a[i])
        assert wm.occurrences(v) == np.flatnonzero(a == v).tolist()
        assert wm.count(v, 0, i) == (a[:i] == v).sum()
        assert wm.count_ranges(v, np.array([0, i, 0]), np.array([i, len(a), len(a)])).tolist() == [(a[:i] == v).sum(), (a[i:] == v).sum(), (a == v).sum()]
    assert wm.count(99_999) == int((a == 99_999).sum())


def test_shard_files(spark, tmp_path):
    docs = data.documents(spark)
    path = f"file://{tmp_path}/shards"
    token_files.write_token_shards(docs, PATH, path, shard_ids=500)
    got = token_files.read_token_shards(spark, path).collect()
    start = 0
    rows = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in docs.collect())
    got = sorted(got, key=lambda r: r.start)
    assert len(got) == len(rows)
    for g, (i, t) in zip(got, rows):
        want = np.array(LIBRARY.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert (-1 if g.doc_id is None else g.doc_id, g.start, g.n_tokens) == (i, start, len(want) // 4)
        assert zlib.crc32(g.ids) == zlib.crc32(want) and g.n_end == np.frombuffer(want, "<u4").tolist().count(2)
        start += g.n_tokens
    with pytest.raises(ValueError):
        token_files.write_token_shards(docs, PATH, path + "t", id_col="id")
    token_files.write_token_shards(data.empty(spark), PATH, path + "0")
    assert token_files.read_token_shards(spark, path + "0").count() == 0
