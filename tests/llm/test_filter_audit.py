"""The audit of filters against counting row by row."""

import itertools
import random
import re

import pytest

from leadloom.llm import filter_audit as A


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    checks = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]
    return {"ABCD"[i] for i, c in enumerate(checks) if c}


def brute(rows, labels):
    seen = []
    for i, text, lang in rows:
        found = fails(text or "")
        if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows):
            found.add("E")
        seen.append((i, lang or "", found))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    out = {}
    for part in {p for _, p, _ in seen}:
        own = [(i, f) for i, p, f in seen if p == part]
        total = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                here = [x for x in left if letter in x[1]]
                failing = sum(letter in f for _, f in own)
                left = [x for x in left if letter not in x[1]]
                total[letter] += len(here)
                steps.append((("".join(order), step), letter, (len(left), len(here), failing - len(here), sum(f == {letter} for _, f in own), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here))))
        out |= {(part, *k): (*v, total[letter]) for k, letter, v in steps}
    return out


def rows(seed=3):
    rng = random.Random(seed)
    words = "ea TH on in at er #x Or is ne".split()
    texts = [" ".join(rng.choice(words) + str(rng.randrange(900)) for _ in range(rng.choice([3, 99, 100, 140]))) for _ in range(25)]
    texts += ["same words " * 60, "UPPER CASE", "", None, "\n\t ", "café " * 3, "x" * 40_000]
    out = [(i * 2 % 83, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(160)]
    return out + [(500 + i // 3, texts[0], "en") for i in range(90)] + [(None, texts[0], "en"), (None, None, None), (0, texts[0], "fr"), (0, texts[0], "fr")]


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_against_brute_force(spark, tasks):
    """With many tasks a text goes on over several sorted partitions."""
    given = rows()
    labels = [(i, i % 2, i % 3 == 0 and 1 or None) for i in range(0, 600, 2)] + [(4, 0, 1), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in given], "doc_id long, text string, lang string, part string, mask int").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = A.audit(A.failure_masks(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(found) == len(got) and got == brute(given, labels)


def test_texts_under_one_fingerprint():
    """Different texts that share a fingerprint are told apart by the texts."""
    import pyarrow as pa

    def batch(found):
        ids, texts = zip(*found, strict=True)
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(["en"] * n), pa.array(texts), pa.array([5] * n), pa.array([0] * n, pa.int32())], ["doc_id", "part", "text", "_fp", "mask"])

    got = [tuple(r.values()) for b in A._mark(iter([batch([(1, "a"), (4, "a"), (4, "a")]), batch([(7, "a"), (2, "b"), (2, "b"), (3, "b")])])) for r in b.to_pylist()]
    assert sorted(got, key=str) == sorted([(4, "en", 16, 1, None), (4, "en", 16, 1, None), (7, "en", 16, 1, None), (3, "en", 16, 1, None), (1, "en", 0, 1, "a"), (2, "en", 0, 2, "b")], key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert A.audit(A.failure_masks(docs), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
