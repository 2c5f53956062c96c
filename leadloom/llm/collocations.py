"""Phrase collocation mining: phrases that hold together, by exact counts over the whole corpus.

A phrase can only be frequent if all parts of it are.  For each length, from one
word up, tasks count hashed phrases whose parts may be frequent into a sketch of
saturating counters; a phrase whose bucket stays below the threshold is no
candidate, and one that reaches it always is.  A bucket belongs to the task that
filled it most, and that task alone names its phrases.  These get slots by a
minimal perfect hash with their keys stored, tasks count the slots in arrays,
arrays are summed as a tree, and the counts of a phrase and of both sides of its
cuts are read by slot.  Candidates that aren't stored (nearly all rare ones that
share a bucket) are counted by their texts in the same pass, so none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SHORT_SLICE_BYTES as SLICE_BYTES
from .common import encode_words, flat_bytes, materialize, mix64, partitions, ranges, read_table, slices

#: Words of the longest phrase.
LONGEST = 4
#: Bounds of the counters of a sketch, as powers of two; between them one counter stands for BYTES bytes of text.
LEAST_BITS, MOST_BITS, BYTES = 16, 27, 48
#: Candidates that one minimal perfect hash holds; more are counted in further passes.
WAVE = 1 << 21
#: Keys that a task remembers, so that it gives few candidates twice.
TOLD = 1 << 20
#: Bytes of bits that are unpacked at a time.
UNPACKED = 1 << 16
#: Blocks that an array of counts crosses a shuffle in.
BLOCKS = 512
#: Rows of a block that one task of the first level of a tree sums.
FAN = 64
#: Parts of a phrase as (first word, number of words); all with their last word inside it count.
PARTS = [(o, m) for m in range(1, LONGEST + 1) for o in range(LONGEST + 1 - m)]
#: Odd factors of the two halves of a key.
_FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_WHITE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_WHITE[[32, 9]] = True
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_INSIDE, _GAP = ~(_WHITE | _BREAK), np.array([32], np.uint8)
#: The first bytes of 16, by their number, as two words of bits.
_HEADS = np.array([[255] * n + [0] * (16 - n) for n in range(17)], np.uint8).view("<u8").astype(np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of texts: two hashes of each, whether the next one follows in the same piece, and its row."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        # a line feed ends a piece, so it may stand between texts as well
        one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pc.fill_null(texts.cast(pa.string()), "")), "\n")
        self.data = _LOWER.take(flat_bytes(one)[0])
        inside = _INSIDE.take(np.concatenate([_GAP, self.data, _GAP]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.at, self.ends = turns[::2], turns[1::2]
        self.rows = np.searchsorted(np.cumsum(pc.binary_length(pc.fill_null(texts, "")).to_numpy(zero_copy_only=False).astype(np.int64) + 1), self.at, "right")
        self.joined = np.ones(max(0, len(self.at) - 1), bool)
        after = np.searchsorted(self.at, np.flatnonzero(_BREAK.take(self.data)))
        self.joined[after[(after > 0) & (after < len(self.at))] - 1] = False
        self.langs = langs
        self.hashes = hash_words(self.data, self.at, self.ends)
        lang_codes, known = encode_words(langs)
        self.start = tuple(h[lang_codes[self.rows]] for h in hash_strings(known.to_pylist()))

    def texts(self, places: np.ndarray, k: int) -> pa.Array:
        """Phrases of ``k`` words that begin at ``places``, joined by single spaces."""
        flat = ranges(places, np.full(len(places), k))
        lengths = self.ends[flat] - self.at[flat]
        words = pa.StringArray.from_buffers(len(flat), pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.py_buffer(self.data[ranges(self.at[flat], lengths)]))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k, dtype=np.int32)), words), " ")


def hash_words(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word: of up to 16 bytes by its bytes and its length, of a longer one by the hash of all."""
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(16, np.uint8)]), 16)[at]
    lengths = ends - at
    low, high = (windows.view("<u8").astype(np.uint64) & _HEADS[np.minimum(lengths, 16)]).T if len(at) else np.zeros((2, 0), np.uint64)
    sizes = lengths.astype(np.uint64)
    a, b = mix64(low ^ mix64(high + sizes)), mix64(high * _FACTORS[0] + mix64(low * _FACTORS[1] + sizes))
    if len(long := np.flatnonzero(lengths > 16)):
        a[long], b[long] = hash_strings([data[at[i] : ends[i]].tobytes() for i in long.tolist()])
    return a, b


def hash_strings(strings: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in strings), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def extended(keys: np.ndarray, words: np.ndarray, half: int) -> np.ndarray:
    """A half of the keys of phrases (a language stands for the empty one) with one more word."""
    return mix64(keys * _FACTORS[half] + words)


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of a MB of text at a time; a longer text is cut where pieces end."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            langs, texts = part.column("lang"), part.column("text")
            if part.num_rows == 1 and texts[0].is_valid and pc.binary_length(texts)[0].as_py() > 2 * SLICE_BYTES:
                data, _ = flat_bytes(texts)
                ends = np.flatnonzero(_BREAK[data])
                cuts = np.unique(ends[np.searchsorted(ends, np.arange(SLICE_BYTES, len(data), SLICE_BYTES)).clip(max=len(ends) - 1)]) if len(ends) else []
                for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
                    yield Words(langs, pa.array([data[a:b].tobytes().decode()]))
            else:
                yield Words(langs, texts)


def _set(bits: np.ndarray, width: int, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    at = keys & np.uint64(width - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


def phrases(words: Words, width: int, bits: list[np.ndarray], longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the places and keys of the phrases both of whose parts may be frequent, by ``bits`` of the shorter ones."""
    n = len(words.at)
    halves = [extended(words.start[h], words.hashes[h], h) for h in (0, 1)]
    at = np.arange(n)
    for k in range(1, longest + 1):
        if k > 1:
            passed = np.zeros(n + 1, bool)
            passed[at] = _set(bits[k - 2], width, halves[0][at])
            at = at[passed[at] & passed[at + 1]]
            at = at[words.joined[at + k - 2]] if len(at) else at
            for h in (0, 1):
                longer = np.zeros(n, np.uint64)
                longer[at] = extended(halves[h][at], words.hashes[h][at + k - 1], h)
                halves[h] = longer
        yield k, at, halves[0][at], halves[1][at]


def pack(array: np.ndarray, size: int, first: int = 0) -> pa.RecordBatch:
    """The blocks, from the ``first`` on, of an array that aren't all 0: the number, the places and the values of what isn't."""
    at = np.flatnonzero(array)
    cuts = np.searchsorted(at, np.arange(0, len(array) + 1, size))
    full = np.flatnonzero(np.diff(cuts))
    parts = [at[cuts[b] : cuts[b + 1]] for b in full]
    data = [np.uint32(len(p)).tobytes() + (p - b * size).astype(_place(size)).tobytes() + array[p].tobytes() for b, p in zip(full, parts, strict=True)]
    full = full + first
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(data, pa.binary())], ["block", "data"])


def _place(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def unpack(data: bytes, size: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    n, wide = int(np.frombuffer(data, np.uint32, 1)[0]), np.dtype(_place(size)).itemsize
    return np.frombuffer(data, _place(size), n, 4).astype(np.int64), np.frombuffer(data[4 + n * wide :], dtype, n)


def tree_sum(blocks: DataFrame, length: int, dtype: type, most: int | None = None) -> DataFrame:
    """Packed ``blocks`` (block, data) of arrays of that length with one row per block, their sum, up to ``most``; two levels."""
    size = length // BLOCKS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = -1, np.zeros(size, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            if block >= 0:
                yield pack(total.astype(dtype), size, block)

        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if b != block:
                    yield from out()
                    block, total = b, np.zeros(size, np.int64)
                at, n = unpack(data, size, dtype)
                total[at] += n
                if most is not None:
                    np.minimum(total, most, out=total)
        yield from out()

    lots = F.spark_partition_id() % F.lit(max(1, -(-partitions(blocks.sparkSession) // FAN)))
    first = blocks.withColumn("lot", lots).repartition("block", "lot").sortWithinPartitions("block", "lot").select("block", "data")
    return first.mapInArrow(add, "block int, data binary").repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, data binary")


def collected(summed: DataFrame, length: int, dtype: type) -> np.ndarray:
    """The summed blocks as one array; callers bound its length."""
    out, size = np.zeros(length, dtype), length // BLOCKS
    table = summed.toArrow()  # all partitions at once
    for block, data in zip(table["block"].to_pylist(), table["data"].to_pylist(), strict=True):
        at, n = unpack(data, size, dtype)
        out[block * size + at] = n
    return out


def this_task() -> int:
    """The number of the running task in 16 bits; beyond 65,536 tasks some share theirs, and what is owned by it."""
    return TaskContext.get().partitionId() & 0xFFFF


def sketch_bits(docs: DataFrame, width: int, known: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the buckets that phrases one word longer than ``known`` reaches fill ``least`` times or more, at most 2 ** MOST_BITS of them, and the tasks that own those, in their order."""
    k, most, size = len(known) + 1, min(least, 255), width // BLOCKS
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(width, np.uint8)
        for words in parts_of(batches):
            *_, (_, _, keys, _) = phrases(words, width, shared.value, k)
            at = (keys & np.uint64(width - 1)).astype(np.int64)
            at, n = np.unique(at[filled[at] < most], return_counts=True)  # most phrases are common ones, whose buckets are full already
            filled[at] = np.minimum(filled[at] + np.minimum(n, most), most)
        blocks = pack(filled, size)
        yield pa.RecordBatch.from_arrays([*blocks.columns, pa.array(np.full(blocks.num_rows, this_task(), np.int32))], ["block", "data", "task"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = -1, np.zeros(size, np.uint16)
        best, owner = np.zeros(size, np.uint16), np.zeros(size, np.uint16)

        def out() -> Iterator[pa.RecordBatch]:
            if len(full := np.flatnonzero(total >= most)):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= most).tobytes()]), pa.array([owner[full].tobytes()])], ["block", "bits", "owners"])

        for batch in batches:
            for b, data, task in zip(*(batch.column(c).to_pylist() for c in ("block", "data", "task")), strict=True):
                if b != block:
                    yield from out()
                    block = b
                    for x in (total, best, owner):
                        x[:] = 0
                at, n = unpack(data, size, np.uint8)
                total[at] = np.minimum(total[at] + n, most)
                rank = n.astype(np.uint16) << 8 | (at * 151 + task * 37).astype(np.uint16) & 255  # of tasks that filled it as much, any
                better = rank > best[at]
                best[at[better]], owner[at[better]] = rank[better], task
        yield from out()

    counted = docs.mapInArrow(count, "block int, data binary, task int").repartition("block").sortWithinPartitions("block")
    table = counted.mapInArrow(judge, "block int, bits binary, owners binary").toArrow().sort_by("block")
    bits = np.zeros(width // 8, np.uint8)
    for block, data in zip(table["block"].to_pylist(), table["bits"].to_pylist(), strict=True):
        bits[block * size // 8 : (block + 1) * size // 8] = np.frombuffer(data, np.uint8)
    return bits, np.frombuffer(b"".join(table["owners"].to_pylist()), np.uint16)


def owned(bits: np.ndarray, owners: np.ndarray, task: int) -> np.ndarray:
    """Of the ``bits`` that are set those whose owner is ``task``."""
    out, first = np.zeros_like(bits), 0
    for c in range(0, len(bits), UNPACKED):
        part = np.unpackbits(bits[c : c + UNPACKED])
        at = np.flatnonzero(part)
        part[at] = owners[first : first + len(at)] == task
        first += len(at)
        out[c : c + UNPACKED] = np.packbits(part)
    return out


class PerfectHash:
    """A minimal perfect hash with stored keys: n keys of two halves have the slots 0 to n - 1.

    Keys that are alone in their place of a table take it; the others go on to
    the next, smaller table.  A key's slot is the number of places taken before
    it; whatever else is looked up meets a different stored key.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, room: float = 1.5):
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        taken = 0
        while len(a):
            places = self._places(a, b, len(self.tables), max(64, int(room * len(a))))
            alone = np.bincount(places, minlength=max(64, int(room * len(a)))) == 1
            ranks = (np.cumsum(alone) - 1 + taken).astype(np.int32)
            settled = alone[places]
            slots = ranks[places[settled]]
            self.a[slots], self.b[slots] = a[settled], b[settled]
            taken += len(slots)
            self.tables.append((alone, ranks))
            a, b = a[~settled], b[~settled]

    @staticmethod
    def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(a + b * np.uint64(2 * level + 1) + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if it isn't one of those stored."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (alone, ranks) in enumerate(self.tables):
            places = self._places(a[left], b[left], level, len(alone))
            hit = alone[places]
            out[left[hit]] = ranks[places[hit]]
            left = left[~hit]
        found = out >= 0
        found[found] = (self.a[out[found]] == a[found]) & (self.b[out[found]] == b[found])
        return np.where(found, out, -1)


def find_candidates(docs: DataFrame, width: int, bits: list[np.ndarray], owners: list[np.ndarray]) -> DataFrame:
    """``lang``, ``phrase``, its number of words ``k`` and its key, ``a`` and ``b``, of what the owner of each bucket has in it, once each, as a table.

    That is nearly all that is frequent; where it isn't (two frequent phrases in a
    bucket, or rows that another task gets in another pass), ``count_slots`` finds the rest.
    """
    shared = docs.sparkSession.sparkContext.broadcast((bits, owners))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(TOLD, np.uint64)  # keys that this task has given lately, each in its place
        own = [owned(b, o, this_task()) for b, o in zip(*shared.value, strict=True)]
        for words in parts_of(batches):
            for k, at, a, _ in phrases(words, width, shared.value[0]):
                stays = np.flatnonzero(_set(own[k - 1], width, a))
                stays = stays[told[(a[stays] >> np.uint64(32)) & np.uint64(TOLD - 1)] != a[stays]]
                a, first = np.unique(a[stays], return_index=True)
                places = at[stays][first]
                told[(a >> np.uint64(32)) & np.uint64(TOLD - 1)] = a
                yield pa.RecordBatch.from_arrays([words.langs.take(pa.array(words.rows[places])), words.texts(places, k)], ["lang", "phrase"])

    return materialize(with_keys(docs.mapInArrow(emit, "lang string, phrase string").distinct()), "phrase-candidates")


def with_keys(rows: DataFrame) -> DataFrame:
    """``rows`` (lang, phrase and others) with the number of words ``k`` and the halves of the key, ``a`` and ``b``."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = Parts(batch)
            a, b = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            for k in range(1, LONGEST + 1):
                there = np.flatnonzero(parts.sizes == k)
                a[there], b[there] = parts.keys(there, 0, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts.sizes.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], [*batch.schema.names, "k", "a", "b"])

    return rows.mapInArrow(keyed, ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), "k int", "a long", "b long"]))


class Parts:
    """The words of phrases (lang, phrase), for the keys of their parts."""

    def __init__(self, batch: pa.RecordBatch):
        lists = pc.split_pattern(batch.column("phrase"), " ")
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1].astype(np.int64)
        data, offsets = flat_bytes(lists.flatten())
        self.words, self.langs = hash_words(data, offsets[:-1], offsets[1:]), hash_strings(batch.column("lang").to_pylist())

    def keys(self, rows: np.ndarray, first: int, n: int) -> list[np.ndarray]:
        """Both halves of the keys of ``n`` words of these rows, from their word ``first`` on."""
        return [reduce(lambda x, s, h=h: extended(x, self.words[h][self.firsts[rows] + first + s], h), range(n), self.langs[h][rows]) for h in (0, 1)]


def count_slots(docs: DataFrame, width: int, bits: Broadcast, hashed: Broadcast, wave: int, waves: int) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """How often each phrase of a perfect hash occurs, by slot; the candidates of that wave that it doesn't hold (lang, phrase, n), any number of rows each; and the words of each language."""
    n = len(hashed.value.a)
    room = max(1, -(-n // BLOCKS)) * BLOCKS
    columns = {"block": pa.int32(), "data": pa.binary(), "lang": pa.string(), "phrase": pa.string(), "n": pa.int64()}

    def row(**of: pa.Array) -> pa.RecordBatch:
        size = len(next(iter(of.values())))
        return pa.RecordBatch.from_arrays([of[c].cast(t) if c in of else pa.nulls(size, t) for c, t in columns.items()], list(columns))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, of_lang = np.zeros(room, np.int64), {}
        for words in parts_of(batches):
            codes, langs = encode_words(words.langs)
            for lang, m in zip(langs.to_pylist(), np.bincount(codes[words.rows], minlength=len(langs)).tolist(), strict=True):
                of_lang[lang] = of_lang.get(lang, 0) + m
            for k, at, a, b in phrases(words, width, bits.value):
                stays = _set(bits.value[k - 1], width, a) & (wave_of(b, waves) == wave)
                at, a, b = at[stays], a[stays], b[stays]
                slots = hashed.value.slots(a, b)
                counts += np.bincount(slots[slots >= 0], minlength=room)
                if len(other := np.flatnonzero(slots < 0)):
                    _, first, m = np.unique(np.column_stack([a[other], b[other]]), axis=0, return_index=True, return_counts=True)
                    places = at[other[first]]
                    yield row(lang=words.langs.take(pa.array(words.rows[places])), phrase=words.texts(places, k), n=pa.array(m))
        blocks = pack(counts, room // BLOCKS)
        yield row(block=blocks.column("block"), data=blocks.column("data"))
        yield row(lang=pa.array(list(of_lang), pa.string()), n=pa.array(list(of_lang.values()), pa.int64()))

    counted = materialize(docs.mapInArrow(count, "block int, data binary, lang string, phrase string, n long"), "phrase-counts")
    summed = tree_sum(counted.where("block is not null").select("block", "data"), room, np.int64)
    of_langs = counted.where("block is null and phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    return collected(summed, room, np.int64)[:n], counted.where("phrase is not null").select("lang", "phrase", "n"), of_langs


def wave_of(b: np.ndarray, waves: int) -> np.ndarray:
    """The pass that a key is counted in."""
    return (b >> np.uint64(1)) % np.uint64(waves) if waves > 1 else np.zeros(len(b), np.uint64)


def read_parts(rows: DataFrame, counted: list[tuple[Broadcast, Broadcast]]) -> DataFrame:
    """``rows`` (lang, phrase, k) with the counts ``f`` of their parts, in the order of PARTS, by the perfect hashes and their counts by slot."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = Parts(batch)
            total = np.zeros((batch.num_rows, len(PARTS)), np.int64)
            for p, (o, m) in enumerate(PARTS):
                there = np.flatnonzero(o + m <= parts.sizes)
                keys = parts.keys(there, o, m)
                for hashed, counts in counted:
                    slots = hashed.value.slots(*keys)
                    stored = slots >= 0
                    total[there[stored], p] = counts.value[slots[stored]]
            f = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), len(PARTS)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "phrase", "k")), f], ["lang", "phrase", "k", "f"])

    return rows.mapInArrow(read, "lang string, phrase string, k int, f array<long>")


def count_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame] | None:
    """All phrases (lang, phrase, k, f) that occur ``least`` times or more, with the counts ``f`` of their parts, and the words of each language; None without candidates.

    ``docs`` has lang and text, neither of them null.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = 1 << min(MOST_BITS, max(LEAST_BITS, (size // BYTES).bit_length()))
    bits: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for _ in range(LONGEST):
        b, o = sketch_bits(docs, width, bits, least)
        bits.append(b)
        owners.append(o)
    if not bits[1].any():
        return None
    found = find_candidates(docs, width, bits, owners)
    share = spark.sparkContext.broadcast
    shared, waves = share(bits), max(1, -(-found.count() // WAVE))
    counted, others, totals = [], [], None
    for wave in range(waves):
        keys = _wave(found, wave, waves)
        hashed = share(PerfectHash(keys["a"], keys["b"]))
        counts, other, of_langs = count_slots(docs, width, shared, hashed, wave, waves)
        totals = of_langs if totals is None else totals
        counted.append((hashed, share(counts)))
        others.append(other)
    other = reduce(DataFrame.unionByName, others).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    late = materialize(with_keys(other), "phrases-late")
    more = -(-late.count() // WAVE)
    for wave in range(more):
        keys = _wave(late, wave, more)
        made = PerfectHash(keys["a"], keys["b"])
        counts = np.zeros(len(made.a), np.int64)
        counts[made.slots(keys["a"], keys["b"])] = keys["n"]
        counted.append((share(made), share(counts)))
    rows = read_parts(found.unionByName(late.drop("n")).where("k > 1").select("lang", "phrase", "k"), counted)
    own = F.element_at(F.array(*[F.col("f")[PARTS.index((0, k))] for k in range(1, LONGEST + 1)]), F.col("k"))
    return materialize(rows.where(own >= least), "phrases"), totals


def _wave(rows: DataFrame, wave: int, waves: int) -> dict[str, np.ndarray]:
    """The keys, and the counts if there are any, of the ``rows`` of a wave; about WAVE at most."""
    table = rows.where(F.shiftrightunsigned("b", 1) % waves == wave).drop("lang", "phrase", "k").toArrow()
    return {c: table[c].to_numpy().view(np.int64 if c == "n" else np.uint64) for c in table.column_names}


def _best_cut(k: int, a: Column) -> Column:
    """The cut of a phrase of ``k`` words with the lowest score, of equal ones the first, as a struct of score, cut, l and r."""
    cuts = []
    for c in range(1, k):
        l, r = F.col("f")[PARTS.index((0, c))], F.col("f")[PARTS.index((c, k - c))]
        score = F.floor(a.cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)") / (l.cast("decimal(20,0)") + r.cast("decimal(20,0)")))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(c).alias("cut"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """For each language its ``top`` phrases of two to four words that occur ``least`` times or more: lang, rank, phrase, a, l, r, n and score.

    A phrase goes if a longer one that holds it occurs ``cover`` percent as often
    or more.  Null texts count as empty, null languages as ``und``; repeated rows
    count as often as they come; further columns don't matter, whatever their
    names; without candidates the result is empty.
    """
    texts = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    counted = count_phrases(texts, least)
    if counted is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    rows, totals = counted
    sizes = range(2, LONGEST + 1)

    def by_size(of: Callable[[int], Column]) -> Column:
        out = F.when(F.col("k") == 2, of(2))
        for k in sizes[1:]:
            out = out.when(F.col("k") == k, of(k))
        return out

    own = {k: F.col("f")[PARTS.index((0, k))] for k in sizes}
    scored = rows.select("lang", "phrase", "k", by_size(lambda k: own[k]).alias("a"), by_size(lambda k: _best_cut(k, own[k])).alias("cut"))
    words = F.split("phrase", " ")

    def shorter(k: int) -> Column:
        return F.array(*[F.array_join(F.slice(words, o + 1, m), " ") for m in range(2, k) for o in range(k - m + 1)])

    inside = scored.where("k > 2").select("lang", F.explode(by_size(lambda k: shorter(k) if k > 2 else F.array().cast("array<string>"))).alias("phrase"), F.col("a").alias("longer"))
    covering = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = scored.join(covering, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * cover))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = free.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))).alias("lot"))
    # the first of each lot, so that the last window has lots x top rows of a language at most
    leading = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).where(F.col("rank") <= top)
    ranked = leading.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, k::INT AS k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM worded, range(1, 5) s(k)
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), halves AS (
  SELECT c.*, cut, array_to_string(w[:cut], ' ') AS first_words, array_to_string(w[cut + 1:], ' ') AS rest FROM candidates c, range(1, 4) s(cut) WHERE cut < k
), cuts AS (
  SELECT h.lang, h.k, h.phrase, h.a, cut, x.a AS l, y.a AS r, (2000000::HUGEINT * h.a // (x.a + y.a))::BIGINT AS score
  FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = h.first_words JOIN f y ON y.lang = h.lang AND y.phrase = h.rest
), best AS MATERIALIZED (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_parts AS (
  SELECT DISTINCT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM candidates, range(2, 4) s(m), range(1, 4) t(i) WHERE m < k AND i + m - 1 <= k
), covered AS (
  SELECT DISTINCT b.lang, b.phrase FROM best b JOIN inner_parts p ON b.lang = p.lang AND b.phrase = p.phrase WHERE 100::HUGEINT * p.a >= 80::HUGEINT * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM best b LEFT JOIN covered c ON b.lang = c.lang AND b.phrase = c.phrase WHERE c.phrase IS NULL
) JOIN totals USING (lang) WHERE rank <= 2000
"""
