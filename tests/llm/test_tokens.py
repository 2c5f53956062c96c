"""Token counts, packing and SentencePiece against the libraries."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import packing, sentencepieces, token_counts

ODD = st.text(alphabet=st.sampled_from(list("abst re'vlldm \n\t12é中　\xa0!?.▁😀<|>")), max_size=80)


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.fixture(scope="module")
def byte_bpe():
    return tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(ODD, min_size=1, max_size=20))
def test_counts_of_any_text(texts, byte_bpe):
    want = [len(e.ids) for e in byte_bpe.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(pa.array(texts), public_tokenizers.path("byte_bpe_50k.json")).tolist() == want


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(ODD, min_size=1, max_size=20))
def test_pieces_of_any_text(texts, pieces):
    model = sentencepieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    ids, counts = model.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in pieces.encode(t)]
    assert model.decode(ids.astype(np.int64), counts) == [pieces.decode(pieces.encode(t)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.integers(0, 31999) | st.integers(0, 260), max_size=20))
def test_decode_any_ids(ids, pieces):
    model = sentencepieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    assert model.decode(np.array(ids, np.int64), np.array([len(ids)])) == [pieces.decode(ids)]


def test_machine_by_chunks():
    step, mark = token_counts.pretoken_machine()
    symbols = np.random.default_rng(3).integers(0, 12, 1000).astype(np.uint8)
    state, want = 0, []
    for s in symbols.tolist():
        want.append(mark[s * 12 + state])
        state = step[s * 12 + state]
    for chunk in (1, 7, 64, 2000):
        assert token_counts.run_machine(symbols, step, mark, chunk=chunk).tolist() == want


def test_counts(docs, no_docs, small_docs, byte_bpe):
    want = sorted(((i, len((t or "").encode()), len(byte_bpe.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in small_docs), key=str)
    assert sorted((tuple(r) for r in token_counts.count_tokens(docs).collect()), key=str) == want
    assert token_counts.count_tokens(no_docs).count() == 0


def test_sentencepieces(docs, no_docs, small_docs, pieces):
    want = {(i, tuple(pieces.encode(t or ""))): pieces.decode(pieces.encode(t or "")) for i, t, _ in small_docs}
    back = sentencepieces.decode(sentencepieces.encode(docs))
    assert {(r.doc_id, tuple(r.ids)): r.decoded for r in back.collect()} == want
    assert sentencepieces.decode(sentencepieces.encode(no_docs)).count() == 0


def test_cut():
    counts = np.array([1, 2047, 2048, 5000])
    doc, start, length = packing.cut(counts, 2048)
    for d, n in enumerate(counts.tolist()):
        own = doc == d
        assert length[own].sum() == n and (start[own] == np.cumsum(length[own]) - length[own]).all()
    assert all(x & (x - 1) == 0 and x <= 2048 for x in length.tolist())


def test_packing(docs, no_docs, small_docs):
    words = tokenizer("word_bpe_49k.json")
    found = packing.digests(docs).collect()
    assert len({r.sequence_id for r in found}) == len(found) and all(r.offset == 0 for r in found)
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    texts = {i: t for i, t, _ in small_docs}
    assert set(by_doc) == set(texts)
    for i, rows in by_doc.items():
        ids = [*words.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    lengths = {}
    for r in found:
        lengths.setdefault(r.length, []).append(r.sequence_id // 12)
    assert all(sorted(n) == list(range(len(n))) for n in lengths.values())
    assert packing.digests(no_docs).count() == 0
    assert packing.pack(docs).where("length(ids) <> 4 * length").count() == 0
