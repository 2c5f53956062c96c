"""Shared ids, large groups and lowered bounds, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import embedding_dedup, near_dedup, substring_dedup
from leadloom.llm.cells import deal_apart, gather
from leadloom.llm.components import components, spanning

from test_dedup import roots, shingle_set


def sentence(rng, n):
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"z{rng.randrange(10_000)}"
    return " ".join(out)


def brute(rows, width):
    """Component of every row by all pairs; rows that share an id are linked."""
    sets = [shingle_set(t, width) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and (rows[i][0] == rows[j][0] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))]
    found = roots(range(len(rows)), links)
    least = {}
    for k, root in found.items():
        least[root] = min(least.get(root, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], len(sets[k]), least[root]) for k, root in found.items())


def test_ids_shared_by_unlike_texts(spark):
    rng = random.Random(3)
    a, b = sentence(rng, 120), sentence(rng, 120)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, changed(rng, a, 1)), (3, changed(rng, b, 1)), (9, " ".join(sentence(rng, 50))), (1, ""), (9, "")]
    got = near_dedup.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    want = brute(rows, 5)
    assert sorted(map(tuple, got)) == want and {(3, 116, 1), (2, 116, 1)} <= set(want)


def test_ids_shared_by_unlike_vectors(spark):
    a, b, c = np.eye(3).tolist()
    near_b = [0.05, 1.0, 0.0]
    rows = [(5, a), (5, b), (2, a), (3, near_b), (8, c), (8, None)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted([(5, 1, 2, False), (5, 1, 2, False), (2, 1, 2, True), (3, 1, 2, False), (8, 0, 8, True), (8, 0, 8, True)])


def test_tables_follow_the_rows():
    assert embedding_dedup.plan_tables(1_000_000, 0.95) == (12, 24)
    bits, tables = embedding_dedup.plan_tables(10**9, 0.95)
    assert bits == 22 and 10**9 / 2**bits < 256
    assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables >= embedding_dedup.RECALL


@pytest.mark.parametrize("block", [4, 16])
def test_large_regions(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup.near_links, "__defaults__", (block,))
    rng = random.Random(5)
    rows = []
    for base, step in ((sentence(rng, 200), 2), (sentence(rng, 200), 5)):
        rows += [(len(rows) + i, changed(rng, base, i % step + 1)) for i in range(30)]
    drift = sentence(rng, 200)  # each a little further from the first
    for i in range(20):
        drift[10 * i] = f"d{i}"
        rows.append((1000 - i, " ".join(drift)))
    for i in range(40):  # plausible, but not similar enough to most of the others
        rows.append((2000 + i, changed(rng, drift, 6)))
    got = near_dedup.near_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows, 5)


def test_rows_dealt_grow_with_the_group(spark):
    """5,000 members in one region: nearly all in one fragment, and some of none."""
    members = spark.range(5000).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("region"), F.when(F.col("id") < 20, F.col("id")).otherwise(20).alias("part"))
    dealt = deal_apart(members, "region", "part", "node", 256)
    assert dealt.count() <= 5000 + 20 * 21
    cells = [[tuple(r) for r in dealt.where(F.col("cell") == c.cell).select("node", "side", "part").collect()] for c in dealt.select("cell").distinct().collect()]
    met = {tuple(sorted((x[0], y[0]))) for rows in cells for i, x in enumerate(rows) for y in rows[:i] if x[2] != y[2] and (x[1] < 0 or x[1] != y[1])}
    assert met == {(i, j) for i in range(20) for j in range(i + 1, 5000)}


def test_spanning_forest(spark):
    rng = np.random.default_rng(6)
    links = [tuple(x) for x in rng.integers(0, 60, (90, 2)).tolist()] + [(100, i) for i in range(101, 130)]
    df = spark.createDataFrame(links, "a long, b long")
    labels, forest = spanning(df)
    tree = [(r.a, r.b) for r in forest.collect()]
    nodes = {n for x in links if x[0] != x[1] for n in x}
    assert {r.node: r.component for r in labels.collect()} == roots(nodes, [x for x in links if x[0] != x[1]])
    assert set(tree) <= {(max(x), min(x)) for x in links} and len(tree) == len(nodes) - len(set(roots(nodes, links).values()) - {a for a, b in links if a == b and a not in nodes})
    assert {r.node: r.component for r in components(forest).collect()} == {r.node: r.component for r in labels.collect()}


def test_anchors_of_many_words():
    rng = np.random.default_rng(7)
    key = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    key[1000:1400] = key[3000:3400]
    key[2000:2010] = key[2000]
    upper = key >> np.uint64(24)
    want = [i + int(np.argmin(upper[i : i + 43])) for i in range(len(key) - 42)]
    for step in (1, 7, 100, 4000, 10_000):
        assert substring_dedup.leftmost_least(key, 43, step).tolist() == want
    with pytest.raises(ValueError):
        substring_dedup.leftmost_least(key, 43, 1 << 24)


def test_equal_ends_of_unlike_length_share_anchors():
    import pyarrow as pa

    rng = random.Random(9)
    passage = " ".join(sentence(rng, 400))
    old = substring_dedup.leftmost_least.__defaults__
    substring_dedup.leftmost_least.__defaults__ = (64,)
    try:
        words = substring_dedup.Words(pa.array([" ".join(sentence(rng, 3000)) + " " + passage, passage]), 50)
    finally:
        substring_dedup.leftmost_least.__defaults__ = old
    alone = set(words.anchor[words.row == 1].tolist())
    assert alone <= set(words.anchor[words.row == 0].tolist())


@pytest.mark.parametrize("hot_from", [3, 128])
def test_hot_passage(spark, hot_from):
    """A passage in many texts, whole and in parts, with other words around it each time."""
    from test_dedup import window_dedup

    rng = random.Random(4)
    passage = sentence(rng, 75)
    rows = []
    for i in range(40):
        low, high = rng.choice([(0, 75), (0, 75), (5, 75), (0, 60), (30, 75)])
        rows.append((100 - i, " ".join([*sentence(rng, 20), *passage[low:high], *sentence(rng, 15), *(passage[:52] if i % 4 == 0 else [])])))
    rows += [(3, " ".join(passage)), (None, " ".join(passage)), (5, None)]
    verdicts, _ = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot_from=hot_from)
    got = sorted((tuple(r) for r in verdicts.select("id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == sorted((w[:4] for w in window_dedup(rows, 50)), key=str)
