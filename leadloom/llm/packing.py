"""Packing by power-of-two pieces: no sequence crosses a document and none needs padding.

A document of n tokens is cut into pieces of the capacity and then into pieces
by the binary digits of what is left.  Every piece has a power of two as its
length and is a sequence of its own; sequences of one length form a bucket,
from which batches of equal shape are taken.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, byte_letters, encode_words, materialize, ranges, read_table, sequence_number, slices, split_words, starts_of

#: Words of a generation whose ids a worker keeps.
KEEP = 250_000
#: Words that are encoded in one call, and runs of marks whose ids a worker keeps.
BATCH, MARKS = 4096, 10_000
#: Letters of Latin-1 between marks of ASCII, without those of contractions and special strings.
_PLAIN = re.compile(r"([!-&(-/:;=?@\[-`{}~]*)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:;=?@\[-`{}~]*)")


def _splits_as_known(path: str) -> bool:
    """Whether the file's chain before the model is the one that ``WordIds`` takes a short way through."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [p["type"] for p in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": known}
        and splits[0]["invert"]
        and not splits[1]["add_prefix_space"]
        and all("<" in t["content"] for t in spec["added_tokens"])
    )


class WordIds:
    """Token ids of words, for tokenizers that drop white space: words are encoded apart and remembered.

    Most words are letters with marks around them.  For those the file's chain
    (normal form, lower case, split, bytes to letters) is known to give just
    these parts, so they go to the merge model directly, at a quarter of the
    time; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = _splits_as_known(path)
        self.letters = dict(enumerate(byte_letters()))
        self.marks: dict[str, list[int]] = {"": []}
        self.words = Remembered(KEEP, np.uint32, self._fresh)

    def _part(self, part: str) -> list[int]:
        return [t.id for t in self.model.tokenize(part)]

    def _mark(self, marks: str) -> list[int]:
        found = self.marks.get(marks)
        if found is None:
            found = self._part(marks)
            if len(self.marks) < MARKS:
                self.marks[marks] = found
        return found

    def _fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, flat, and the number of each word's."""
        found: list[list[int] | None] = []
        rest: list[str] = []
        for word in words:
            m = _PLAIN.fullmatch(word) if self.plain else None
            if m is None:
                rest.append(word)
                found.append(None)
                continue
            before, stem, after = m.groups()
            stem = stem.lower()
            if not stem.isascii():
                stem = stem.encode().decode("latin-1").translate(self.letters)
            ids = self._part(stem)
            found.append([*self._mark(before), *ids, *self._mark(after)] if before or after else ids)
        others = iter([e.ids for at in range(0, len(rest), BATCH) for e in self.tokenizer.encode_batch_fast(rest[at : at + BATCH], add_special_tokens=False)])
        found = [next(others) if f is None else f for f in found]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number of each text's."""
        flat, words = split_words(texts)
        codes, distinct = encode_words(flat)
        ids, lengths = self.words.take(distinct.to_pylist(), codes)
        return ids, np.diff(starts_of(lengths)[starts_of(words)])


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, start and length of the pieces of documents of ``counts`` tokens, in order."""
    top = capacity.bit_length() - 1
    full = counts >> top
    doc, start = [np.repeat(np.arange(len(counts)), full)], [ranges(np.zeros(len(counts), np.int64), full) << top]
    length = [np.full(int(full.sum()), capacity, np.int64)]
    for bit in range(top):
        has = np.flatnonzero(counts >> bit & 1)
        doc.append(has)
        start.append(counts[has] >> (bit + 1) << (bit + 1))
        length.append(np.full(len(has), 1 << bit, np.int64))
    doc, start, length = map(np.concatenate, (doc, start, length))
    order = np.lexsort((start, doc))
    return doc[order], start[order], length[order]


def pieces(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Cut documents into pieces: id, ``start``, ``length``, ``doc_tokens`` and ``ids``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit values.
    The tokenizer file must drop white space (its words are encoded apart);
    ``end_id`` closes each document, so a null or empty text is one piece of one
    token.  Repeated rows give repeated pieces, a null id stays null, other
    columns are left aside, an empty table gives an empty one.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("the capacity must be a power of two")
    path = path or public_tokenizers.path("word_bpe_49k.json")
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                ids, counts = word_ids(path).encode(part.column("text"))
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype("<u4")
                counts = counts + 1
                doc, start, length = cut(counts, capacity)
                offsets = (starts_of(length) * 4).astype(np.int32)
                blob = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(counts[doc]), blob], ["id", "start", "length", "doc_tokens", "ids"])
        word_ids(path).words.clear()  # the worker lives on with other work

    kind = dict(narrow.dtypes)["id"]
    return narrow.mapInArrow(work, f"id {kind}, start long, length long, doc_tokens long, ids binary").withColumnRenamed("id", id_column)


def number_sequences(cut_pieces: DataFrame, capacity: int = 2048, id_column: str = "doc_id") -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset`` (0: a piece fills its sequence).

    Sequences of one length form a bucket; ``sequence_id`` is the gapless number
    in the bucket times the number of buckets, plus the bucket (log2 of length).
    The input is read twice, so give it a stored table.
    """
    buckets = capacity.bit_length()
    numbered = sequence_number(cut_pieces, ["length"], [id_column, "start"], "_n")
    bucket = F.log2("length").cast("long")
    return numbered.select("*", (F.col("_n") * buckets + bucket).alias("sequence_id"), F.lit(0).cast(T.LongType()).alias("offset")).drop("_n")


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Packed sequences with their ids: ``pieces`` and ``number_sequences`` in turn."""
    return number_sequences(materialize(pieces(docs, path, end_id, capacity), "pieces"), capacity)


def digests(docs: DataFrame) -> DataFrame:
    """The packing of ``docs`` with a checksum in place of the ids, which then don't cross a shuffle."""
    cut_pieces = pieces(docs).withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
    return number_sequences(materialize(cut_pieces, "piece-digests")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
