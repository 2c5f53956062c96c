"""Line, embedding, substring and near-document dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import embedding_dedup, line_dedup, near_dedup, substring_dedup
from leadloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [tuple(x) for x in rng.integers(200, 300, (60, 2)).tolist()] + [(7, 7), (7, 8)]
    df = spark.createDataFrame(links, "a long, b long")
    want = roots({n for link in links for n in link}, links)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and all(a == b or a in got for a, b in links)
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [512, 3])
def test_embeddings(spark, monkeypatch, block):
    deal = embedding_dedup.deal
    monkeypatch.setattr(embedding_dedup, "deal", lambda df, keys, member: deal(df, keys, member, block))
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 16))
    vectors = [(base[i % 6] + 0.02 * rng.standard_normal(16)).tolist() for i in range(60)] + [(7 * base[0]).tolist()] * 3 + rng.standard_normal((40, 16)).tolist()
    rows = [(i * 2, v) for i, v in enumerate(vectors)]
    odd = [(1001, None), (1003, []), (1005, [0.0] * 16), (1007, [float("nan")] * 16), (1009, [None] * 16), (1011, [1.0, 2.0]), (1013, [1.0, 2.0]), (None, vectors[0]), (1015, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<double>, rep string, links int")
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    links = [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    want = {i: (int(near[k].sum()) - 1, c) for k, (i, c) in enumerate(roots([r[0] for r in rows], links).items())}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    assert {i: got[i][:2] for i in want} == want
    assert all(got[i][2] == (got[i][1] == i) for i in want)
    assert got[1011] == (1, 1011, True) and got[1013] == (1, 1011, False) and got[None] == (0, None, False)
    assert all(got[i] == (0, i, True) for i in (1001, 1003, 1005, 1007, 1009, 1015))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def shingle_set(text, width):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or (frozenset([tuple(words)]) if words else frozenset())


@pytest.mark.parametrize("width", [4, 5])
def test_near_documents(docs, no_docs, small_docs, width):
    sets = {i: shingle_set(t, width) for i, t, _ in small_docs if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links
    want = {i: (len(sets[i]), c, c == i) for i, c in roots(ids, links).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_documents(docs, width).collect()}
    lone = got.pop(None)
    assert lone[2] is False and got == want
    assert near_dedup.near_documents(no_docs).count() == 0


def test_similarity_estimate():
    rng = np.random.default_rng(8)
    for shared in (0.5, 0.8, 0.95):
        n = 2000
        common = rng.integers(0, 1 << 63, int(n * shared), dtype=np.uint64)
        sets = [np.sort(np.concatenate([common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64)])) for _ in range(2)]
        m = 2048
        regs = near_dedup.registers(np.concatenate(sets), np.array([n, n]), m)
        x, y = regs.astype(int)
        e = near_dedup.likelihood_similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), m, np.array([n * 1.0]), np.array([n * 1.0]))[0]
        assert abs(e - len(common) / (2 * n - len(common))) < 0.06
    both = near_dedup.registers(np.concatenate([sets[0], sets[1]]), np.array([2 * n]), m)[0]
    assert (both == np.maximum(*regs)).all()  # sketches merge


def window_dedup(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window", [50, 12])
def test_substrings(docs, no_docs, small_docs, window):
    want = window_dedup([r[:2] for r in small_docs], window)
    assert any(w[2] for w in want)
    verdicts, _ = substring_dedup.repeats(docs, window)
    assert sorted((tuple(r) for r in verdicts.select("id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == sorted((w[:4] for w in want), key=str)
    texts = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup.dedup_substrings(docs, window).collect()}
    given = {r[0]: r[1] for r in small_docs}
    for i, _, removed, _, kept in want:
        assert texts[i] == ((kept, removed) if removed else (given[i], 0))
    assert substring_dedup.dedup_substrings(no_docs).count() == 0


def test_repeated_ids_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT_BLOCK", 2)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[:40], f"x{i % 9}", *base[40:], f"y{i}"] if i % 2 else [f"z{i}", *base])) for i in range(24)]
    rows += [(5, " ".join(base)), (5, " ".join(base)), (7, None)]
    want = window_dedup(rows, 50)
    verdicts, _ = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in verdicts.select("id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == sorted((w[:4] for w in want), key=str)


def test_automaton():
    rng = np.random.default_rng(1)
    automaton = substring_dedup.SuffixAutomaton()
    texts = [rng.choice(list("ab"), rng.integers(1, 30)).tolist() for _ in range(6)]
    for t in texts:
        automaton.add(t)
    held = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(20):
        q = rng.choice(list("abc"), 25).tolist()
        want = [max((n for n in range(1, i + 2) if tuple(q[i + 1 - n : i + 1]) in held), default=0) for i in range(len(q))]
        assert automaton.statistics(q) == want


def test_lines(docs, no_docs, small_docs):
    sites = {}
    for _, t, s in small_docs:
        for line in (t or "").split("\n"):
            key = re.sub(r"^[\x00-\x20]+|[\x00-\x20]+$", "", line)
            if key and s is not None:
                sites.setdefault(key, set()).add(s)
    bad = {k for k, s in sites.items() if len(s) >= 3}
    assert bad
    want = []
    for i, t, _ in small_docs:
        lines = [] if t is None else t.split("\n")
        left = [x for x in lines if re.sub(r"^[\x00-\x20]+|[\x00-\x20]+$", "", x) not in bad]
        want.append((i, len(lines), len(lines) - len(left), None if t is None else "\n".join(left)))
    got = line_dedup.dedup_lines(docs, 3).select("doc_id", "n_lines", "n_removed", "text")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_plan_is_native(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_line_threshold_is_exact(spark):
    rows = [(i, f"line {k}", f"site{i}") for k in range(5, 15) for i in range(k)]
    kept = {r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 10).where(F.col("n_removed") == 0).collect()}
    assert kept == {f"line {k}" for k in range(5, 10)}
