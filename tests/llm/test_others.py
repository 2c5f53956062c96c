"""HTML text, sharding, quality rules and the pipeline."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import html_text, packing, quality_rules, sharding
from leadloom.llm.common import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF_DIR = "/root/testdata/sf0.001"

PAGES = [
    ("<p>a <b>b</b>\n c<p>d", "a b c\n\nd"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
    ("<table><tr><th>Name<th>Qty<tr><td>Pie<td>3<tr><td colspan=2>wide</table>", "Name  Qty\nPie   3\nwide"),
    ("<table><tr><td rowspan=2>tall<td>1<tr><td>2</table>", "tall  1\n      2"),
    ("<div hidden>x</div><div style='display: none'>y</div><script>if(a<b)</script><style>p{}</style>z", "z"),
    ("<pre>\n a  b\n  c</pre>", " a  b\n  c"),
    ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
    ("<head><title>t</title></head><body>&lt;b&gt; &amp; &eacute;", "<b> & é"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<select><option>a<option>b</select><details><summary>s</summary>x</details>", "a\nb\ns"),
    ("x < y <!-- c --> z <a href='>'>q</a>", "x < y z q"),
    ("", ""),
    (None, None),
]


@pytest.mark.parametrize("markup, text", PAGES)
def test_html(markup, text):
    assert html_text.visible_text(markup) == text


def test_html_keeps_every_visible_word():
    words = [f"w{i}" for i in range(400)]
    tags = ["p", "div", "li", "ul", "td", "tr", "table", "b", "ol", "dl", "dd", "span", "h1"]
    rng = np.random.default_rng(6)
    for _ in range(30):
        parts = [f"<{'/' if rng.random() < 0.4 else ''}{tags[rng.integers(len(tags))]}>{w} " for w in words]
        assert {w for w in html_text.visible_text("".join(parts)).split() if w[0] == "w"} == set(words)


def test_html_depth():
    assert html_text.visible_text("<div>" * 50_000 + "x") == "x"


def test_html_table(spark):
    df = spark.createDataFrame([(i, m, "x") for i, (m, _) in enumerate(PAGES)], "page_id long, html string, text string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert html_text.extract(df.limit(0)).columns == ["page_id", "text"] and html_text.extract(df.limit(0)).count() == 0


def test_sharding(docs, no_docs, spark):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    few = {r.doc_id: r.shard for r in sharding.shard(ids, "doc_id", [1.0] * 16).collect()}
    more = {r.doc_id: r.shard for r in sharding.shard(ids, "doc_id", [1.0] * 17).collect()}
    moved = [i for i in few if few[i] != more[i]]
    assert all(more[i] == 16 for i in moved) and 100 < len(moved) < 260
    weighted = [r.shard for r in sharding.shard(ids, "doc_id", [1.0, 3.0, 0.0]).collect()]
    assert 0.2 < weighted.count(0) / 3000 < 0.3 and 2 not in weighted
    rows = sharding.shard(docs.union(docs), "doc_id", [1.0] * 4).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 2 * docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(no_docs, "doc_id", [1.0]).count() == 0


def test_sharding_query(spark):
    texts = {r.doc_id: r.text for r in read_table(spark, SF_DIR, "documents").collect()}
    rows = sharding.op8_sharding(spark, SF_DIR).collect()
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key") and r.grown_shard in (r.shard, 16)
    assert len(rows) == len(texts)


def counts_of(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def test_counts(docs, no_docs, small_docs):
    odd = docs.sparkSession.createDataFrame([(900, "a b c d e f a b c d e f a b c d e", "s"), (901, "x\nx\n\n y\nx", "s")], "doc_id long, text string, source string")
    both = docs.select("doc_id", "text", "source", "quality").unionByName(odd, allowMissingColumns=True)
    texts = small_docs + [tuple(r) for r in odd.collect()]
    got = [(r.doc_id, *[r.quality[c] for c in quality_rules.COUNTS[:5]]) for r in quality_rules.add_counts(both).collect()]
    assert sorted(got, key=str) == sorted(((i, *counts_of(t)) for i, t, _ in texts), key=str)
    assert quality_rules.add_counts(no_docs).count() == 0


def test_learned_rules_reject_junk_only():
    rng = np.random.default_rng(9)
    names = quality_rules.FEATURES
    x = rng.random((3000, len(names)))
    bad = (x[:, 0] > 0.9) | ((x[:, 3] > 0.8) & (x[:, 5] < 0.3))
    rules = quality_rules.learn(x, bad, names)
    fresh = rng.random((3000, len(names)))
    want = (fresh[:, 0] > 0.9) | ((fresh[:, 3] > 0.8) & (fresh[:, 5] < 0.3))
    got = np.logical_or.reduce([r.holds(fresh, names) for r in rules])
    assert (got & ~want).sum() < 30 and (got & want).sum() > 0.8 * want.sum()
    assert quality_rules.learn(x, np.zeros(len(x), bool), names) == []


def test_verdict_is_the_list(spark):
    rules = [quality_rules.Rule((quality_rules.Condition("symbol_share", True, 0.5), quality_rules.Condition("log_words", False, 2.0)), 1.0, 9)]
    df = spark.createDataFrame([(1, (3, 10, 9, 0, 0, 1, 0, 0, 0)), (2, (30, 100, 9, 0, 0, 1, 0, 0, 0))], "i int, q struct<" + ",".join(f"{c}:long" for c in quality_rules.COUNTS) + ">")
    assert [r.k for r in df.select(quality_rules.verdict(rules, F.col("q")).alias("k"), "i").orderBy("i").collect()] == [False, True]


def test_quality_without_labels(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judged = quality_rules.judge(docs, labels)
    assert judged.where("kept = base_failed").count() == 0 and judged.count() == docs.count()


def test_pipeline_stage_by_stage(spark):
    docs = read_table(spark, SF_DIR, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "substring dedup", "packing"]
    kept = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF_DIR).cache()
        assert kept.columns == columns
        assert kept.where("n_chars <> length(text)").count() == 0, name
        sizes.append(kept.count())
    assert sizes[0] > sizes[1] >= sizes[3] > 0 and sizes[1] == sizes[2] and sizes[3] == sizes[4]
    clean = read_table(spark, SF_DIR, "labels").where("quality = 1").select("doc_id")
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    lost = clean.join(docs.where(words >= 10), "doc_id").join(quality_rules.judge(docs, read_table(spark, SF_DIR, "labels")).where("kept or base_failed"), "doc_id", "left_anti")
    assert lost.count() == 0
    packed = {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert set(packed) == {r.doc_id for r in kept.select("doc_id").collect()}
    tokenized = {r.doc_id: r.doc_tokens for r in packing.digests(kept).collect()}
    assert packed == tokenized
