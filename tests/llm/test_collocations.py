"""Mined phrases against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leadloom.llm import collocations as M


def brute(rows, least, top=2000, cover=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3, 4):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = [p for p, a in f.items() if len(p) > 2 and a >= least]
    gone = {(p[0], *p[o : o + m]) for p in found for m in range(2, len(p) - 1) for o in range(1, len(p) - m + 1) if 100 * f[p] >= cover * f[p[0], *p[o : o + m]]}
    out = {}
    for p in found:
        if p not in gone:
            cuts = [(2_000_000 * f[p] // (f[p[: k + 1]] + f[p[0], *p[k + 1 :]]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            out.setdefault(p[0], []).append((-score, -f[p], " ".join(p[1:]).encode(), f[p[: k + 1]], f[p[0], *p[k + 1 :]]))
    return sorted((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top], 1))


def rows(seed=1, n=250):
    rng = random.Random(seed)
    words = "A b C d É é ñ x1 the of x-y %".split()
    out = [(rng.choice(["en", "en", "fr", None, ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\xa0"]) for _ in range(rng.randrange(60)))) for _ in range(n)]
    return out + [("de", None), ("en", ""), ("fr", " \t.,"), ("en", "aa " * 500), ("xx", "New York City Hall! " * 40), ("xx", "new york " * 9)] * 2


def collected(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("wave", [M.WAVE, 40])
def test_against_brute_force(spark, monkeypatch, wave):
    """With small waves the candidates are counted in several passes."""
    given = rows()
    docs = spark.createDataFrame([(lang, text, "x", 1) for lang, text in given], "lang string, text string, phrase string, n int").repartition(5)
    monkeypatch.setattr(M, "WAVE", wave)
    assert collected(M.collocations(docs, least=12)) == brute(given, 12)
    assert collected(M.collocations(docs, least=12, top=3, cover=100)) == brute(given, 12, 3, 100)


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["ab", "c", "De"]) + rng.choice([" ", " ", ". "]) for _ in range(4000))
    monkeypatch.setattr(M, "SLICE_BYTES", 500)
    parts = list(M.parts_of(iter([pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])])))
    whole = M.Words(pa.array(["en"]), pa.array([text]))
    assert len(parts) > 10 and sum(len(p.at) for p in parts) == len(whole.at) and sum(p.joined.sum() for p in parts) == whole.joined.sum()
    assert np.concatenate([p.hashes[0] for p in parts]).tolist() == whole.hashes[0].tolist()
    assert len(list(M.parts_of(iter([pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["x" * 2000])], ["lang", "text"])])))) == 1


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 4, n).astype(np.uint64)
        a[: n // 2] = a[n // 2 : 2 * (n // 2)]  # one half of a key alone doesn't tell
        b[: n // 2] = b[n // 2 : 2 * (n // 2)] + np.uint64(7)
        made = M.PerfectHash(a, b)
        assert sorted(made.slots(a, b).tolist()) == list(range(n))
        assert (made.slots(a, b + np.uint64(100)) == -1).all() and (made.slots(a + np.uint64(1), b) == -1).all()


@pytest.mark.parametrize("most", [None, 20])
@pytest.mark.parametrize("size", [8, 1 << 17])
def test_saturating_sums(spark, most, size):
    """A bucket filled in many tasks, each below the threshold, counts."""
    rng, dtype = np.random.default_rng(1), np.uint8 if most else np.int64
    arrays = [np.where(rng.random(3 * size) < 16 / size, rng.integers(0, 7, 3 * size), 0).astype(dtype) for _ in range(30)]
    rows = [(b, d) for x in arrays for b, d in zip(*M.pack(x, size, 5).to_pydict().values(), strict=True)]
    summed = M.tree_sum(spark.createDataFrame(rows, "block int, data binary").repartition(9), M.BLOCKS * size, dtype, most)
    got, want = M.collected(summed, M.BLOCKS * size, dtype), sum(x.astype(np.int64) for x in arrays)
    assert (got[5 * size : 8 * size] == (np.minimum(want, most) if most else want)).all() and got.sum(dtype=np.int64) == got[5 * size : 8 * size].sum(dtype=np.int64)


def test_exact_scores_beyond_64_bits(spark):
    big = 10**15
    df = spark.createDataFrame([([big + 1, big, 0, 0, big - 1, 0, 0, 0, 0, 0], 2)], "f array<long>, k int")
    got = df.select(M._best_cut(2, df.f[M.PARTS.index((0, 2))]).alias("c")).first().c
    assert (got.score, got.l, got.r) == (2_000_000 * (big - 1) // (2 * big + 1), big + 1, big)


def test_empty_and_rare(spark):
    docs = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert M.collocations(docs).count() == 0 and M.collocations(docs.limit(0)).count() == 0


def test_a_phrase_is_named_by_one_task(spark, monkeypatch):
    """Not by each that meets it; and no array is read with a job for each of its parts."""
    rng = random.Random(5)
    docs = spark.createDataFrame([("en", " ".join(rng.choice("abcdefgh") for _ in range(200))) for _ in range(64)], "lang string, text string").repartition(8)
    kind, given = type(docs), []
    made = kind.mapInArrow

    def spied(self, func, schema, *args, **options):
        out = made(self, func, schema, *args, **options)
        if schema == "lang string, phrase string":
            given.append(out)
        return out

    def one_by_one(*_):
        raise AssertionError("a job for each partition")

    monkeypatch.setattr(kind, "mapInArrow", spied)
    monkeypatch.setattr(kind, "toLocalIterator", one_by_one)
    assert M.collocations(docs, least=20).count() > 0
    assert given[0].count() < 1.5 * given[0].distinct().count()


@pytest.mark.parametrize(("named", "wave"), [("false", M.WAVE), ("phrase < 'b'", 40)])
def test_phrases_that_no_task_names(spark, monkeypatch, named, wave):
    """They are counted by their texts."""
    given = rows(3)
    docs = spark.createDataFrame(given, "lang string, text string").repartition(5)
    find = M.find_candidates
    monkeypatch.setattr(M, "WAVE", wave)
    monkeypatch.setattr(M, "find_candidates", lambda *args: find(*args).where(named))
    assert collected(M.collocations(docs, least=12)) == brute(given, 12)


def test_each_bucket_has_one_owner():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 256, 3 * M.UNPACKED + 5).astype(np.uint8)
    owners = rng.integers(0, 3, int(np.unpackbits(bits).sum())).astype(np.uint16)
    own = [M.owned(bits, owners, task) for task in range(4)]
    assert (sum(np.unpackbits(x) for x in own) == np.unpackbits(bits)).all() and not own[3].any()
    assert [int(np.unpackbits(x).sum()) for x in own] == np.bincount(owners, minlength=4).tolist()
