import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from axonlake.llm import pieces

from . import data


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def encoder():
    with open(pieces.default_model(), "rb") as f:
        return pieces.shared_encoder(f.read())


def ids(encoder, text, block=1 << 20):
    return np.frombuffer(encoder.encode(text, block), "<u4").tolist()


def test_ids_equal_the_library_for_any_block_size(encoder, library):
    r = random.Random(5)
    parts = ["a", "b", "e", "the", " ", "  ", "    ", "\n", "\t", "1", "é", "ß", "日本", "梦", "ａ", "😀", "▁", "\x00", "Brow", "Leg", "<s>", "<0x41>", " of"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.choice([0, 1, 3, 12, 80])))
        got = ids(encoder, text, r.choice([1, 5, 50, 1 << 20]))
        assert got == library.encode(text)
        assert pieces.PieceDecoder.text(encoder.model, got) == library.decode(got)


@pytest.mark.parametrize("text", [" " * 30_000, "a" * 60_000, "Brow" * 10_000, "日本語の文章を分かち書きせずに" * 2_000, "x" * 9_000 + " " * 9_000], ids=["spaces", "letters", "unsafe ranks", "no spaces", "both"])
def test_long_texts(encoder, library, text):
    assert ids(encoder, text) == ids(encoder, text, 1000) == library.encode(text)


def test_decoding_of_any_ids(encoder, library):
    r = random.Random(6)
    for _ in range(1500):
        got = [r.randrange(32000) if r.random() < 0.5 else r.randrange(259) for _ in range(r.randrange(12))]
        assert pieces.PieceDecoder.text(encoder.model, got) == library.decode(got)


def test_words_that_are_forgotten_are_encoded_again(encoder, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    small = pieces.PieceEncoder(encoder.model)
    for text in ["one two three four five", "five four six", "x" * 1000 + " one"] * 2:
        assert ids(small, text) == library.encode(text)
        assert not any(len(w) > pieces.LONG_WORD for w in small.known)


def test_every_row_with_nulls_long_texts_and_clashing_columns(spark, library):
    docs = data.documents(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(docs, pieces.default_model(), block=1000).collect()), key=str)
    want = []
    for i, text in rows:
        x = library.encode(text, add_bos=True, add_eos=True)
        want.append((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert pieces.round_trip(data.empty(spark), pieces.default_model()).count() == 0


def test_texts_come_back(spark):
    docs = data.documents(spark)
    encoded = pieces.encode_texts(docs, pieces.default_model())
    back = pieces.decode_ids(encoded, pieces.default_model())
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    assert encoded.filter("ids[0] <> 1 or element_at(ids, -1) <> 2").count() == 0
    bare = pieces.encode_texts(docs, pieces.default_model(), ends=False)
    assert bare.filter("doc_id in (100, 101, 102) and size(ids) > 0").count() == 0


def test_models_that_change_texts_are_refused():
    with pytest.raises(RuntimeError):
        pieces.PieceModel(b"no model")
