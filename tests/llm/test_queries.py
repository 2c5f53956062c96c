"""Queries without SQL over the small tables, against a second computation (those with SQL: tests/test_oracle.py)."""

import os

import duckdb
import numpy as np
import pytest

from leadloom.llm import registry

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


BASE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS k FROM docs, LATERAL (SELECT unnest(range(1, len(words) - 3)) AS i) r
), twice AS (SELECT doc_id, k FROM windows GROUP BY ALL HAVING count(*) > 1
), covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM windows JOIN twice USING (doc_id, k)) GROUP BY doc_id
), lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(words) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(words) AS base_failed
FROM docs LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)
"""


def test_quality_rules(spark, duck):
    """All columns but the verdict by SQL; the verdict by applying the learned rules row by row."""
    from leadloom.llm import quality_rules as Q
    from leadloom.llm.common import read_table

    got = registry.QUERIES["op9_quality_rules"](spark, SF_DIR)
    columns = [c for c in got.columns if c != "kept"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, duck.execute(f"SELECT {', '.join(columns)} FROM ({BASE})").fetchall()))
    docs = read_table(spark, SF_DIR, "documents")
    rules = Q.learn_rules(Q.add_counts(docs.select("doc_id", "text")), Q.chosen_labels(read_table(spark, SF_DIR, "labels")))
    assert rules
    texts = docs.select("doc_id", "text").toPandas()
    import pyarrow as pa

    counts = Q.count_features(pa.array(texts["text"]))
    words, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
    shares = {"symbol_share": counts["n_symbols"] / chars, "dup_line_share": counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1), "repeat_share": counts["n_repeat_words"] / words, "capital_share": counts["n_capitals"] / chars, "mark_share": counts["n_marks"] / chars, "bare_share": counts["n_bare_words"] / words, "mean_chars": counts["word_chars"] / words, "log_words": np.log(1.0 + counts["n_words"])}
    want = {}
    for k, doc in enumerate(texts["doc_id"].tolist()):
        rejected = counts["n_words"][k] < 10 or 100 * counts["n_repeat_words"][k] > 20 * counts["n_words"][k]
        for rule in rules:
            rejected = rejected or all((shares[c.feature][k] >= c.threshold) == c.above for c in rule.conditions)
        want[doc] = not rejected
    assert {r.doc_id: r.kept for r in got.collect()} == want
    labels = {r.doc_id: r.quality for r in read_table(spark, SF_DIR, "labels").collect()}
    kept = [labels[d] for d, k in want.items() if k and d in labels]
    gone = [labels[d] for d, k in want.items() if not k and d in labels]
    assert np.mean(kept) > np.mean(gone)


def test_packing_fills_sequences(spark):
    rows = registry.QUERIES["op6_packing"](spark, SF_DIR).toPandas()
    for _, doc in rows.groupby("doc_id"):
        doc = doc.sort_values("start")
        assert doc["start"].tolist() == [0, *np.cumsum(doc["length"])[:-1]] and doc["length"].sum() == doc["doc_tokens"].iloc[0]
    assert ((rows["length"] & (rows["length"] - 1)) == 0).all() and rows["sequence_id"].is_unique and (rows["offset"] == 0).all()


def test_tokens_as_the_libraries(spark):
    """The token queries over the given documents, row by row against the libraries."""
    import zlib

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from leadloom.llm.common import read_table

    texts = {r.doc_id: r.text or "" for r in read_table(spark, SF_DIR, "documents").select("doc_id", "text").collect()}
    ids, strings = list(texts), list(texts.values())
    byte_bpe, word_bpe = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    counts = dict(zip(ids, (len(e.ids) for e in byte_bpe.encode_batch(strings, add_special_tokens=False)), strict=True))
    rows = registry.QUERIES["op7_token_counts"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {i: (len(texts[i].encode()), n, n > 512) for i, n in counts.items()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: r for r in registry.QUERIES["op4_sentencepieces"](spark, SF_DIR).collect()}
    for i, want in zip(ids, library.encode(strings), strict=True):
        back = library.decode(want).encode()
        assert (found[i].ids, found[i].n_ids, found[i].decoded_bytes, found[i].decoded_crc32) == (want, len(want), len(back), zlib.crc32(back))
    tokens = {i: np.array([*e.ids, 1], "<u4") for i, e in zip(ids, word_bpe.encode_batch(strings, add_special_tokens=False), strict=True)}
    for r in registry.QUERIES["op6_packing"](spark, SF_DIR).collect():
        assert r.doc_tokens == len(tokens[r.doc_id]) and r.ids_crc32 == zlib.crc32(tokens[r.doc_id][r.start : r.start + r.length].tobytes())


def test_hot_key_is_split(spark, monkeypatch):
    from pyspark.sql import functions as F

    from leadloom.llm import common, sharding

    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    df = df.unionByName(spark.range(500).select(F.lit(None).cast("long").alias("k"), F.lit(1).cast("long").alias("x")))
    monkeypatch.setattr(common.sequence_number, "__defaults__", (None, 100))
    out = sharding.shard(df, "k", [1.0, 2.0, 1.0]).toPandas()
    assert len(out) == 5500 and (out.groupby("k", dropna=False)["shard"].nunique() == 1).all()
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
