"""The pipeline, stage by stage and as a whole, against brute force; empty and odd inputs."""

import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import roots, shingle_set, window_dedup
from test_groups import changed, sentence

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline

from leadloom.llm import quality_rules

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    passage = sentence(rng, 70)
    out = []
    for i in range(70):
        words = sentence(rng, 60 + i % 50)
        if i % 6 == 0:
            words[20:20] = passage
        text = " ".join(words)
        if i % 9 == 4:
            text = changed(rng, out[-2][1].split(" "), 1)
        if i % 10 == 7:
            text = out[-3][1]
        if i % 2:
            text += "\nCommon line.\n" + " ".join(sentence(rng, 3))
        if i % 3 == 2 and i % 10 != 7:
            text = re.sub(r"(w\d+) (w\d+)", r"\1### \2", text)
        out.append((i * 2, text, "en", f"site{i % 25}", len(text)))
    return [*out, (501, None, "en", "a", None), (502, "", None, "b", 0), (None, "no id " + " ".join(sentence(rng, 40)), "en", None, 5), (None, "no id " + " ".join(passage), "en", "c", 5), (503, "few words", "en", "d", 9), out[3], out[3], (503, "x" * 4000 + " " + " ".join(sentence(rng, 60)), "en", "e", 1)]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if "###" in text else 1, 0) for i, text, *_ in rows[:70]] + [(4, 1, 0), (None, 0, 0), (8, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def by_lines(rows, least=10):
    def key(line):
        return re.sub(r"^[\x00-\x20]+|[\x00-\x20]+$", "", line)

    sites = {}
    for _, text, _, site, _ in rows:
        for line in (text or "").split("\n"):
            if key(line) and site is not None:
                sites.setdefault(key(line), set()).add(site)
    bad = {k for k, s in sites.items() if len(s) >= least}
    out = []
    for i, text, lang, site, n in rows:
        left = None if text is None else "\n".join(x for x in text.split("\n") if key(x) not in bad)
        out.append((i, left, lang, site, n if left == text else len(left)))
    return out


def by_copies(rows):
    sets = [shingle_set(r[1], 5) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and (rows[i][0] == rows[j][0] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))]
    found = roots(range(len(rows)), links)
    least = {}
    for k, root in found.items():
        if rows[k][0] is not None:
            least[root] = min(least.get(root, rows[k][0]), rows[k][0])
    gone = {rows[k][0] for k, root in found.items() if rows[k][0] is not None and rows[k][0] != least[root]}
    return [r for r in rows if r[0] is None or r[0] not in gone]


def by_windows(rows):
    out = []
    for (i, text, lang, site, n), (_, _, removed, _, kept) in zip(rows, window_dedup([r[:2] for r in rows], 50), strict=True):
        out.append((i, kept, lang, site, len(kept)) if removed else (i, text, lang, site, n))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_stages(spark, rows, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near dedup", "substring dedup", "packing"]
    kept = stages["quality rules"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    judged = quality_rules.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert order(kept.collect()) == order(judged.where("kept").select(*docs.columns).collect()) and 30 < kept.count() < len(rows)
    assert judged.where("not kept and not base_failed").count() > 0  # the rules have an effect of their own
    now = [tuple(r) for r in kept.collect()]
    for name, brute in (("line dedup", by_lines), ("near dedup", by_copies), ("substring dedup", by_windows)):
        docs = spark.createDataFrame(now, COLUMNS)
        got = stages[name](spark, docs, sf_dir)
        assert got.columns == first.columns
        want = brute(now)
        assert order(got.collect()) == order(want) and want != now, name
        now = want
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["packing"](spark, spark.createDataFrame(now, COLUMNS), sf_dir)
    want = []
    for i, text, *_ in now:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, len(ids), zlib.crc32(ids[: 1 << (len(ids).bit_length() - 1)].tobytes()) if len(ids) < 4096 else None))
    firsts = pieces.where("start = 0").select("doc_id", "doc_tokens", "ids_crc32").collect()
    assert order((r.doc_id, r.doc_tokens, r.ids_crc32) for r in firsts) == order(want)
    whole = corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert order(whole.collect()) == order(pieces.select(*whole.columns).collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_further_columns_pass(spark, sf_dir):
    """Columns named like those that operators make pass all stages but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clashing = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("kept", "quality", "id", "tk", "n_removed", "n_words", "component_id", "row", "n_lines", "region", "node")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, clashing, sf_dir), stage(spark, docs, sf_dir)
        assert got.columns == clashing.columns, name
        assert order(got.select(*docs.columns).collect()) == order(want.collect()), name
        further = [c for c in clashing.columns if c not in docs.columns]
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in got.collect() for c in further)
