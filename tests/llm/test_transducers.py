"""Compiled machines against plain merging, the library and each other."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import merges, sentencepieces
from leadloom.llm.common import Remembered

LETTERS = "abcd"


def machine(seed, size=30, keep=merges.KEEP):
    """A vocabulary of random merges."""
    rng = random.Random(seed)
    pieces, ranks = list(LETTERS), {}
    while len(ranks) < size:
        a, b = rng.choice(pieces), rng.choice(pieces)
        if (a, b) not in ranks and len(a + b) < 12:
            ranks[a, b] = len(ranks)
            if a + b not in pieces:
                pieces.append(a + b)
    return merges.MergeTransducer({p: i for i, p in enumerate(pieces)}, lambda a, b: ranks.get((a, b)), keep)


def flat(units):
    return np.array([ord(c) for u in units for c in u], np.int64), np.array([len(u) for u in units], np.int64)


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 40), units=st.lists(st.text(alphabet=LETTERS + "e", min_size=1, max_size=40), min_size=1, max_size=12), keep=st.sampled_from([5, 10_000]))
def test_paths_and_counts(seed, units, keep):
    m = machine(seed, keep=keep)
    for _ in range(2):  # the second time from compiled states, or from the old generation
        want = [[m.pieces[p] if p in m.pieces else ~ord(p) for p in m.merge(u)[0]] for u in units]
        ids, counts = m.paths(*flat(units))
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
        assert m.counts(*flat(units)).tolist() == counts.tolist()


def test_long_units():
    """Units far longer than those that the machine reads, alone and among short ones, against plain merging."""
    m = machine(7)
    rng = random.Random(1)
    units = ["ab" * 2000, "ab", "".join(rng.choice(LETTERS) for _ in range(3000)), "a" * 1999, "abcdé" * 9, "é" * 40, "d" * merges.LONG, "d" * (merges.LONG + 1), *["".join(rng.choice(LETTERS + "e") for _ in range(rng.randrange(20, 90))) for _ in range(200)]]
    want = [[m.pieces[p] if p in m.pieces else ~ord(p) for p in m.merge(u)[0]] for u in units]
    ids, counts = m.paths(*flat(units))
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want] == m.counts(*flat(units)).tolist()


def test_unbroken_runs_make_few_states():
    """Runs of letters, of one letter and of CJK, as the library encodes them; states and time don't follow them."""
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    from leadloom.llm import token_counts

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choice(letters) for _ in range(60_000)), "a" * 50_000, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(20_000)), "0123456789abcdef" * 2000, " ".join("".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(300)), "the of and " * 50]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    machine = token_counts.counter(path).machine
    token_counts.count_texts(pa.array(texts[-1:]), path)
    states = len(machine.young.keys)
    began = time.process_time()
    got = token_counts.count_texts(pa.array(texts), path).tolist()
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert time.process_time() - began < 10 and len(machine.young.keys) < states + 12_000  # the words of hexadecimal digits are short
    model = sentencepieces.Model(public_tokenizers.path("piece_bpe_32k.model"))
    spm = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    flat_ids, sizes = model.encode(pa.array(texts))
    assert flat_ids.tolist() == [i for ids in spm.encode(texts) for i in ids] and sizes.tolist() == [len(ids) for ids in spm.encode(texts)]


def test_arcs():
    rng = np.random.default_rng(5)
    arcs = merges.Arcs(8)
    keys = rng.permutation(5000).astype(np.int64) * 7
    for part in np.array_split(keys, 40):
        arcs.add(part, part + 1)
    assert (arcs.find(keys) == keys + 1).all() and (arcs.find(keys + 1) == -1).all()


def test_generations():
    made = []

    def compute(keys):
        made.extend(keys)
        return np.array([len(k) for k in keys]), np.ones(len(keys), np.int64)

    kept = Remembered(3, np.int64, compute)
    for keys in (["a", "bb"], ["a", "ccc"], ["dddd", "a"], ["e", "a"], ["bb", "a"]):
        flat_, lengths = kept.take(keys, np.arange(len(keys)))
        assert flat_.tolist() == [len(k) for k in keys] and lengths.tolist() == [1] * len(keys)
    assert made == ["a", "bb", "ccc", "dddd", "e", "bb"]  # the common one is made once, one not met in a whole generation again


# --- handmade models for the library -----------------------------------------


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_file(path, kind, pieces, byte_pieces, prefix=1, collapse=0, charsmap=b""):
    """A model of ``pieces`` (text and score), with byte pieces or without."""
    message = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)])
    if byte_pieces:
        message += b"".join(field(1, field(1, b"<0x%02X>" % b) + field(2, 0.0) + field(3, 6)) for b in range(256))
    message += b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in pieces)
    message += field(2, field(3, kind) + field(35, int(byte_pieces)))
    message += field(3, field(1, b"own") + field(2, charsmap) + field(3, prefix) + field(4, collapse))
    path.write_bytes(message)
    return str(path)


def scored(seed, user=False):
    rng = random.Random(seed)
    found = {c: -8 - rng.random() for c in "abcé▁"}
    while len(found) < 60:
        piece = ("▁" if rng.random() < 0.4 else "") + "".join(rng.choice("abcé中") for _ in range(rng.randrange(1, 6)))
        found.setdefault(piece, -rng.uniform(1, 12))
    out = [(p, np.float32(s).item(), 1) for p, s in found.items()]
    return [*out, ("abca", 0.0, 4)] if user else out


TEXTS = st.text(alphabet=st.sampled_from(list("aabbccé中 xß\n　ﬁＡ①")), max_size=40)
NFKC = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()


def charsmap():
    for number, value in sentencepieces._fields(NFKC):
        if number == 3:
            return dict(sentencepieces._fields(value))[2]


@pytest.mark.parametrize("byte_pieces", [True, False])
@pytest.mark.parametrize(("prefix", "collapse", "mapped", "user"), [(1, 0, False, False), (1, 1, False, False), (0, 1, True, False), (1, 1, True, False), (1, 0, False, True)])
def test_unigram_models(tmp_path, byte_pieces, prefix, collapse, mapped, user):
    path = model_file(tmp_path / "m.model", 1, scored(byte_pieces + 2 * prefix, user), byte_pieces, prefix, collapse, charsmap() if mapped else b"")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.Model(path)

    @settings(max_examples=80, deadline=None)
    @given(texts=st.lists(TEXTS, min_size=1, max_size=6))
    def check(texts):
        ids, counts = own.encode(pa.array(texts))
        assert np.split(ids, np.cumsum(counts)[:-1]) and [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t) for t in texts]
        assert own.decode(ids.astype(np.int64), counts) == [library.decode(library.encode(t)) for t in texts]

    check()


def test_character_map():
    found = sentencepieces.character_map(charsmap())
    normalise = sentencepieces.Normaliser(charsmap(), prefix=False, collapse=True)
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, remove_extra_whitespaces=True, escape_whitespaces=True)
    assert len(found) > 1000 and found["ﬁ"] == "fi"
    texts = ["ﬁ ﬂ Ａｂｃ", "①②  x​\ty ", "é é", "ガﾊﾟ", "", "   ", *sorted(found)[:3000:7]]
    assert normalise(pa.array(texts)).to_pylist() == [library.normalize(t) for t in texts]


def test_models_left_out(tmp_path):
    with pytest.raises(ValueError):
        sentencepieces.Model(model_file(tmp_path / "a.model", 3, scored(1), True))
    with pytest.raises(ValueError):
        sentencepieces.Model(model_file(tmp_path / "b.model", 2, scored(1, user=True), True))
