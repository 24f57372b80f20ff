import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from feescope.llm import token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\t \n  b  ", "it's we'll 's", "x" * 5000, "été ñ 中文 字   b",
    "12 34  5", "<|endoftext|> a", "a <|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endoftext|>y z", "<|endoftext|", "a<|endoftext |> b", "Ġ Ġa", "　 a  b", "of%%% the&&& ,.- \r\n z", "\x1c a\x85 b", "word " * 3000,
]


@pytest.fixture(scope="module")
def library():
    return lambda text: LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    encoder = token_store.Encoder(PATH)
    for _ in range(2):
        got = encoder.encode([t or "" for t in TEXTS])
        assert [np.frombuffer(g, np.int32).tolist() for g in got] == [library(t) for t in TEXTS]


def test_small_cache_is_refilled(library):
    encoder = token_store.Encoder(PATH, cache_words=3)
    got = encoder.encode(["a b c d e f g", "b z y x"])
    assert [np.frombuffer(g, np.int32).tolist() for g in got] == [library("a b c d e f g"), library("b z y x")]


def test_words_are_encoded_once_and_stay_without_objects(library):
    """Before, a cached word was a Python string, a bytes object and an entry of a dictionary, looked up one by one."""
    encoder, asked = token_store.Encoder(PATH), []
    real = encoder._library
    encoder._library = lambda texts: asked.extend(texts) or real(texts)
    text = "one two, three. one\ntwo three four.. two"
    for _ in range(2):
        asked.clear()
        assert np.frombuffer(encoder.encode([text])[0], np.int32).tolist() == library(text)
    assert sorted(asked) == [",", ".", "..", "one"]  # tails and the first word; all others are known
    assert sorted(encoder._cache.to_pylist()) == ["\ntwo", "four", "one", "three", "two"]
    assert encoder._ids.flat.nbytes + encoder._cache.nbytes < 200


def test_the_words_used_most_stay_in_a_full_cache(library):
    encoder = token_store.Encoder(PATH, cache_words=4)
    for text in ("a often often", "b often rare", "c often one two"):
        assert np.frombuffer(encoder.encode([text])[0], np.int32).tolist() == library(text)
    encoder.encode(["d three four five"])
    assert encoder.encode([]) == []
    assert "often" in encoder._cache.to_pylist() and len(encoder._cache) <= 4


def test_rows_are_encoded_together_whatever_their_batches(monkeypatch):
    rows = pa.record_batch([pa.array(range(2500)), pa.array(["ab cd"] * 2499 + [None])], ["doc_id", "text"])
    sizes = lambda: [len(ids) for ids, _ in token_store._gathered([rows.slice(0, 1200), rows.slice(1200), rows.slice(0, 0)])]
    assert sizes() == [2500]
    monkeypatch.setattr(token_store, "_TOGETHER", 1)
    assert sizes() == [1000, 200, 1000, 300]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t ab.,$'s1é中​́"), max_size=40))
def test_any_text(text):
    got = token_store._encoder(PATH).encode([text])[0]
    assert np.frombuffer(got, np.int32).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_round_trip(docs, library):
    rows = [(50 - i, t) for i, t in enumerate(TEXTS)] + [(7, "one"), (7, "one"), (7, "two words"), (None, "no id")]
    found = token_store.token_digests(docs(rows), PATH).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    expected = {(i, zlib.crc32(np.array([*library(t), 0], "<u4").tobytes())): len(library(t)) + 1 for i, t in rows}
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == expected[r.doc_id, r.ids_crc32]
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_selective_read(spark, docs, tmp_path):
    path = str(tmp_path / "tokens")
    token_store.write_tokens(docs([(i, f"text {i}") for i in range(100)]), path, PATH)
    one = token_store.read_tokens(spark, path).filter("doc_id = 40").select("doc_id", "n_tokens")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,40)" in plan and "tokens:array" not in plan
    assert one.count() == 1


def test_empty(docs):
    assert token_store.token_digests(docs([]), PATH).count() == 0
