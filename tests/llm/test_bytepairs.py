"""Byte-level BPE against the merging library."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from spanlight.llm import bytepairs


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    return np.frombuffer(bytepairs.codec().encode(text), "<u4").tolist()


ODD = ["", " ", "\n", "  \n\t x", "a" * 5000, "ab" * 3000, "=" * 777 + "-" * 900, "the" * 500, "éè" * 400, "\U0001f600" * 50, "x y z", "<|endoftext|> it's we'LL 12345678901", "\x00\x1f\x7f", "ĠĠ Ċ", "0" * 1000]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, text):
    assert ids_of(text) == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abehnrst ", max_size=120) | st.text(alphabet="aA \n'lé1", max_size=80))
def test_any_text(library, text):
    found = bytepairs.codec().encode(text)
    assert np.frombuffer(found, "<u4").tolist() == library.encode_ordinary(text)
    assert bytepairs.codec().decode(found) == text.encode()


def test_pieces_longer_than_a_span_and_texts_of_many_pieces(library, monkeypatch):
    monkeypatch.setattr(bytepairs, "SPAN", 7)
    monkeypatch.setattr(bytepairs, "PIECES", 5)
    made = bytepairs.BytePairs(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in ["anti" * 300 + "zzzzation" * 50, "some words, and more of them 12 34", "ü" * 99]:
        assert np.frombuffer(made.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_memories_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bytepairs, "KEPT", 3)
    monkeypatch.setattr(bytepairs, "KEPT_PAIRS", 3)
    made = bytepairs.BytePairs(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "Unbelievable thoughts wander through uncountable valleys antidisestablishmentarianism"
    assert np.frombuffer(made.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert len(made.pieces) <= 3 and len(made.pairs) <= 3


def test_ranks_without_merges_fall_back(tmp_path):
    """A token that no merge can make is still taken where it is the whole piece, as the library does."""
    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"xyz"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(ranks)))
    made = bytepairs.BytePairs(str(path), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("few", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(ranks)}, special_tokens={})
    for text in ["xyz", "xyzab", "abxyz", "aab", "ba"]:
        assert np.frombuffer(made.encode(text), "<u4").tolist() == own.encode_ordinary(text)


def test_columns(spark, library):
    docs = spark.createDataFrame([(1, "one text", 5), (1, "one text", 5), (2, None, None), (None, "", 1), (3, "wörd " * 30000, 2)], "doc_id bigint, text string, ids int")
    made = bytepairs.encode(docs)
    assert made.columns == ["doc_id", "text", "ids", "_ids"]
    back = bytepairs.decode(made, "_ids").collect()
    assert sorted(len(r["bytes"]) for r in back) == sorted(len((r.text or "").encode()) for r in docs.collect())
    assert all(bytes(r["bytes"]).decode() == (r.text or "") for r in back)
    assert bytepairs.encode(docs.limit(0)).count() == 0 and bytepairs.digests(docs.limit(0)).count() == 0
    for r in bytepairs.digests(docs).collect():
        text = {1: "one text", 3: "wörd " * 30000}.get(r.doc_id, "")
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bytepairs.decode(spark.createDataFrame([(None,)], "ids binary")).first()["bytes"] is None


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = bytepairs.op12_backtracking_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
