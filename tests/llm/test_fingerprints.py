"""Fingerprints against sets of shingles, and the order of the rows against sorting them."""

import hashlib
import random

import pyarrow as pa
import pytest

from leadloom.llm import fingerprints as P


def shingles(text, n=5):
    words = text.split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_estimates():
    """Estimates of contained and shared shingles lie near the exact figures; those of short texts are exact."""
    rng = random.Random(5)
    for n in (3, 30, 60, 2000, 9000):
        for share in (0.0, 0.3, 0.75, 1.0):
            a = prose(rng, n)
            k = int(n * share)
            b = " ".join(a.split()[:k]) + " " + prose(rng, n - k)
            x, y = shingles(a), shingles(b)
            near, jaccard = P.likeness(P.sketch(pa.array([a])), P.sketch(pa.array([b])))
            assert abs(near[0] - len(x & y) / min(len(x), len(y))) <= (0.0 if n <= 64 else 0.08)
            assert abs(jaccard[0] - len(x & y) / len(x | y)) <= (0.0 if n <= 64 else 0.08)
    long = prose(rng, 40_000)  # a part of a far longer text
    assert abs(P.likeness(P.sketch(pa.array([" ".join(long.split()[100:1100])])), P.sketch(pa.array([long])))[0][0] - 1) < 0.01


def test_sketches_merge_and_read_back():
    """Hashes depend on the shingles alone: the union of overlapping parts is the sketch of the whole."""
    rng = random.Random(6)
    words = prose(rng, 3000).split()
    whole = P.sketch(pa.array([" ".join(words)]))
    parts = P.sketch(pa.array([" ".join(words[:1500]), " ".join(words[1496:])]))
    assert set(parts.flat.tolist()) == set(whole.flat.tolist()) and whole.shifts[0] == P.SHIFT
    assert 0.2 < len(whole.flat) / len(shingles(" ".join(words))) < 0.3
    back = P.read_sketches([whole.text(0), parts.text(1), "0:"])
    assert back.flat.tolist() == [*whole.flat.tolist(), *parts.flat[parts.starts[1] :].tolist()] and back.starts[-1] == back.starts[-2]
    assert [P.sketch(pa.array([t])).text(0) for t in ("", " \n", None)] == ["0:"] * 3
    assert P.likeness(back, back)[0].tolist() == [1.0, 1.0, 1.0]


@pytest.mark.parametrize("tasks", [1, 3, 50])
def test_rows(spark, docs, small_docs, tasks):
    """Every row, in any number of sorted partitions, against a plain loop."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {r.doc_id: r for r in P.fingerprints(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = sorted(((i, t or "") for i, t, _ in small_docs), key=lambda r: -1 if r[0] is None else r[0])
    assert len(found) == len(rows)
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        share = len(text) // 4
        changed = text[: len(text) - share] + following[:share]
        got = found[i]
        a, b, c = (P.sketch(pa.array([t])) for t in (text, changed, following))
        assert (got.n_chars, got.edited_sha256, got.fingerprint, got.edited_fingerprint) == (len(text), hashlib.sha256(changed.encode()).hexdigest(), a.text(0), b.text(0))
        assert (got.near_edited, got.jaccard_edited) == tuple(x[0] for x in P.likeness(a, b)) and (got.near_next, got.jaccard_next) == tuple(x[0] for x in P.likeness(a, c))
        assert got.n_hashes == len(a.flat)


def test_one_row_repeated_rows_and_none(spark):
    one = spark.createDataFrame([(3, "a b c d e f g h")], "doc_id long, text string")
    row = P.fingerprints(one).collect()
    assert len(row) == 1 and row[0].near_next == 1.0 and row[0].edited_sha256 == hashlib.sha256(b"a b c d e f a b").hexdigest()
    many = spark.createDataFrame([(3, "a b c d e f g h")] * 40 + [(3, None)] * 40, "doc_id long, text string")
    assert P.fingerprints(many).count() == 80
    assert P.fingerprints(one.limit(0)).count() == 0
