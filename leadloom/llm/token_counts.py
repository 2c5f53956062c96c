"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers make the count.  The first reads character classes
and marks where a pre-token starts; it is small, so a chunk of text is summed up
by its map from entry state to exit state, and the maps of all chunks compose by
a parallel prefix scan before one vectorized pass emits the marks.  The second
(``merges.MergeTransducer``) reads the bytes of a pre-token; its transitions are
annotated with the change of the number of tokens, and a chunk's map from entry
state to (exit state, count) composes with the next.  The scan of the first gives
the second its entries: every pre-token starts in the start state, so all of them
are counted apart, and each distinct one of a slice once.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_letters, code_points, flat_bytes, read_table, slices
from .merges import MergeTransducer

#: Characters that one chunk map sums up.
CHUNK = 64

# Classes of characters.
END, SPACE, WHITE, QUOTE, SINGLE, R, V, L, E, LETTER, NUMBER, OTHER = range(12)
# States: what has been read of the current pre-token.
START, IN_L, IN_N, IN_O, SPACE1, SPACES, WHITE1, WHITES, Q, Q_RV, Q_L, DONE = range(12)
#: White space beyond ASCII (Unicode property White_Space).
_WHITE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[[9, 10, 11, 12, 13, *_WHITE]] = WHITE
    table[32], table[39] = SPACE, QUOTE
    for c, k in (("s", SINGLE), ("t", SINGLE), ("m", SINGLE), ("d", SINGLE), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[ord(c)] = k
    return table


@lru_cache(1)
def pretoken_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by ``class * 12 + state``; marks: 1 a pre-token starts here, 2 one started a character ago."""
    step, mark = np.zeros(144, np.uint8), np.zeros(144, np.uint8)
    letters = {SINGLE, R, V, L, E, LETTER}

    def fresh(c: int) -> int:
        if c in letters:
            return IN_L
        return {END: START, SPACE: SPACE1, WHITE: WHITE1, QUOTE: Q, NUMBER: IN_N, OTHER: IN_O}[c]

    def go(c: int, s: int) -> tuple[int, int]:
        if c == END:
            return START, 1 | (2 if s == Q_RV or s == Q_L else 0)
        if s in (SPACE1, SPACES, WHITE1, WHITES):
            if c == SPACE:
                return SPACES, 0
            if c == WHITE:
                return WHITES, 0
            tail = 2 if s in (SPACES, WHITES) else 0  # the run gives up its last character
            if s in (SPACE1, SPACES):  # which joins what follows
                return (IN_O if c == QUOTE else fresh(c)), tail
            return fresh(c), tail | 1
        if s == IN_L and c in letters or s == IN_N and c == NUMBER:
            return s, 0
        if s == IN_O and c in (OTHER, QUOTE):
            return IN_O, 0
        if s == Q:
            if c == SINGLE:
                return DONE, 0
            if c in (R, V):
                return Q_RV, 0
            if c == L:
                return Q_L, 0
            if c in (OTHER, QUOTE):
                return IN_O, 0
        if s == Q_RV and c == E or s == Q_L and c == L:
            return DONE, 0
        if s in (Q_RV, Q_L):  # no contraction: the quote stands alone and a word began after it
            return (IN_L, 2) if c in letters else (fresh(c), 3)
        return fresh(c), 1

    for c in range(12):
        for s in range(12):
            step[c * 12 + s], mark[c * 12 + s] = go(c, s)
    return step, mark


def run_machine(symbols: np.ndarray, step: np.ndarray, mark: np.ndarray, states: int = 12, chunk: int = CHUNK) -> np.ndarray:
    """Marks that the machine emits on ``symbols``, by chunk maps and a prefix scan over them."""
    n = -(-len(symbols) // chunk)
    padded = np.zeros(n * chunk, np.int16)
    padded[: len(symbols)] = symbols
    columns = np.ascontiguousarray(padded.reshape(n, chunk).T) * states
    maps = np.tile(np.arange(states, dtype=np.uint8), (n, 1))
    for column in columns:
        maps = step[column[:, None] + maps]
    entry = np.zeros(n, np.uint8)  # the start state is 0
    width = 1
    scan = maps
    while width < n:  # scan[i] becomes the map of chunks 0..i
        scan = np.concatenate([scan[:width], np.take_along_axis(scan[width:], scan[:-width], 1)])
        width *= 2
    entry[1:] = scan[:-1, 0]
    out, state = np.zeros((chunk, n), np.uint8), entry
    for i, column in enumerate(columns):
        at = column + state
        out[i], state = mark[at], step[at]
    return out.T.reshape(-1)[: len(symbols)]


def pretokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of all texts, flat, and the index of the text of each."""
    data, offsets = flat_bytes(texts)
    cps, lead = code_points(data)
    ends = np.searchsorted(lead, offsets[1:])  # characters up to the end of each text
    symbols = np.insert(_classes()[cps], ends, END)
    place = np.insert(lead, ends, offsets[1:])
    row = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])) + 1)
    marks = run_machine(symbols, *pretoken_machine())
    start = (marks & 1).astype(bool)
    start[:-1] |= (marks[1:] & 2).astype(bool)
    at = np.flatnonzero(start)
    real = symbols[at] != END
    begin, end = place[at], np.append(place[at[1:]], len(data))
    flat = pa.StringArray.from_buffers(int(real.sum()), pa.py_buffer(np.append(begin[real], end[real][-1:] if real.any() else [0]).astype(np.int32)), pa.py_buffer(data))
    return flat, row[at][real]


class Counter:
    """Tokens of a pre-token by the vocabulary file of a byte-level byte-pair tokenizer; bytes stand as Latin-1 letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        to_byte = {ord(letter): b for b, letter in enumerate(byte_letters())}
        ranks = {(a.translate(to_byte), b.translate(to_byte)): i for i, (a, b) in enumerate(spec["model"]["merges"])}
        vocabulary = {piece.translate(to_byte): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.machine = MergeTransducer(vocabulary, lambda a, b: ranks.get((a, b)))

    def counts(self, distinct: pa.Array) -> np.ndarray:
        data, offsets = flat_bytes(distinct)
        return self.machine.counts(data, np.diff(offsets))


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_texts(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text; special strings inside a text count as one token each."""
    machine = counter(path)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    total = np.zeros(len(texts), np.int64)
    row = np.arange(len(texts))
    for special in machine.special:  # the text between special strings is tokenized by itself
        lists = pc.split_pattern(texts, special)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        np.add.at(total, row, n - 1)
        row, texts = np.repeat(row, n), lists.flatten()
    flat, of = pretokens(texts)
    if len(flat):
        coded = flat.dictionary_encode()
        each = machine.counts(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        total += np.bincount(row[of], each, len(total)).astype(np.int64)
    return total


def count_tokens(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text.

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated
    rows each get a row; other columns are left aside, whatever their names; an
    empty table gives an empty one.  ``path`` names the vocabulary file, which
    must be readable on the executors.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), sizes, pa.array(count_texts(part.column("text"), path), pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = dict(narrow.dtypes)["id"]
    return narrow.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_column)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(read_table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
