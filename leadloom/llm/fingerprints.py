"""Document fingerprints: every shingle hash below a fixed fraction of the hash range.

Which hashes stay depends on their values alone, so sketches of parts merge by
union, and what two sketches share estimates what their texts share, however
unequal they are in length.  A fixed fraction may leave a short text nothing, so
texts of few shingles keep all; two sketches are compared below the smaller of
their thresholds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encode_words, mix64, partitions, ranges, read_table, slices, split_words, starts_of

#: Words of a shingle.
WORDS = 5
#: The fraction of the hashes that stay is 2 ** -SHIFT.
SHIFT = 2
#: Texts of up to so many different shingles keep all of them.
FEW = 64
#: Bits of a hash.
BITS = 32


@dataclass
class Sketches:
    """Sketches of several texts: hashes in order, one text after the other."""

    shifts: np.ndarray
    flat: np.ndarray
    starts: np.ndarray

    def take(self, at: np.ndarray) -> Sketches:
        lengths = np.diff(self.starts)[at]
        return Sketches(self.shifts[at], self.flat[ranges(self.starts[at], lengths)], starts_of(lengths))

    def text(self, i: int) -> str:
        """The shift and the hashes, sorted, little-endian, in Base64."""
        return f"{self.shifts[i]}:{base64.b64encode(self.flat[self.starts[i] : self.starts[i + 1]].astype('<u4').tobytes()).decode()}"


def sketch(texts: pa.Array, words: int = WORDS, shift: int = SHIFT, few: int = FEW) -> Sketches:
    """Sketches of whole texts; a text of fewer words has its whole sequence as its one shingle, a null none."""
    flat, counts = split_words(texts)
    codes, distinct = encode_words(flat)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[codes]
    rows, starts = np.repeat(np.arange(len(counts)), counts), starts_of(counts)
    mixed = np.zeros(len(hashes), np.uint64)
    length = np.minimum(counts, words)[rows]
    for step in range(words):
        at = np.arange(len(hashes)) + step
        fits = np.flatnonzero((step < length) & (at < starts[rows + 1]))
        mixed[fits] = mix64(mixed[fits] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[fits]] + np.uint64(1))
    whole = np.arange(len(hashes)) + length <= starts[rows + 1]
    keys = np.unique(rows[whole].astype(np.uint64) << np.uint64(BITS) | mixed[whole] >> np.uint64(64 - BITS))
    of = (keys >> np.uint64(BITS)).astype(np.int64)
    shifts = np.where(np.bincount(of, minlength=len(counts)) > few, shift, 0)
    kept = keys[(keys & np.uint64((1 << BITS) - 1)) < (np.uint64(1 << BITS) >> shifts.astype(np.uint64))[of]]
    return Sketches(shifts, (kept & np.uint64((1 << BITS) - 1)).astype(np.uint32), starts_of(np.bincount((kept >> np.uint64(BITS)).astype(np.int64), minlength=len(counts))))


def read_sketches(fingerprints: list[str]) -> Sketches:
    """Sketches from their texts."""
    parts = [f.split(":") for f in fingerprints]
    hashes = [np.frombuffer(base64.b64decode(h), "<u4") for _, h in parts]
    return Sketches(np.array([int(s) for s, _ in parts]), np.concatenate([np.zeros(0, np.uint32), *hashes]).astype(np.uint32), starts_of(np.array([len(h) for h in hashes], np.int64)))


def likeness(a: Sketches, b: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """For each i the containment of the smaller of ``a[i]`` and ``b[i]`` in the larger, and their Jaccard similarity, as estimates.

    Two texts without shingles are alike (1); with one of them, or with no hash
    below the smaller threshold on one side, the estimate is 0.
    """
    n = len(a.shifts)
    least = (np.uint64(1 << BITS) >> np.maximum(a.shifts, b.shifts).astype(np.uint64))

    def below(s: Sketches) -> tuple[np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(n), np.diff(s.starts))
        stays = s.flat < least[of]
        return of[stays].astype(np.uint64) << np.uint64(BITS) | s.flat[stays], np.bincount(of[stays], minlength=n)

    (ka, na), (kb, nb) = below(a), below(b)
    both = np.bincount((np.intersect1d(ka, kb, assume_unique=True) >> np.uint64(BITS)).astype(np.int64), minlength=n)
    none = (np.diff(a.starts) == 0) & (np.diff(b.starts) == 0)
    return np.where(none, 1.0, both / np.maximum(np.minimum(na, nb), 1)), np.where(none, 1.0, both / np.maximum(na + nb - both, 1))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many code points (or all) of the text that follows it."""
    share = len(text) // 4
    return text[: len(text) - share] + following[:share]


_FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "jaccard_edited", "jaccard_next", "n_hashes"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double, n_hashes long"


def _rows(rows: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
    """Result rows of the rows ``at``, each of which is followed by the next one."""
    every = sketch(rows.column("text"))
    own, of_next = every.take(at), every.take(at + 1)
    ids, texts, following = rows.column("doc_id").take(pa.array(at)), rows.column("text").take(pa.array(at)), rows.column("text").take(pa.array(at + 1))
    changed = pa.array([edited(t, f) for t, f in zip(texts.to_pylist(), following.to_pylist(), strict=True)], pa.string())
    of_changed = sketch(changed)
    near_edited, jaccard_edited = likeness(own, of_changed)
    near_next, jaccard_next = likeness(own, of_next)
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in changed.to_pylist()]
    n = len(texts)
    columns = [ids, pc.utf8_length(texts).cast(pa.int64()), pa.array(digests, pa.string()), pa.array([own.text(i) for i in range(n)], pa.string()), pa.array([of_changed.text(i) for i in range(n)], pa.string())]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(x) for x in (near_edited, near_next, jaccard_edited, jaccard_next)], pa.array(np.diff(own.starts))], _FIELDS)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows of a sorted partition: each row is followed by the next one; guests only follow."""
    waiting: pa.RecordBatch | None = None
    for whole in batches:
        for part in slices(whole, "text"):
            rows = part if waiting is None else pa.concat_batches([waiting, part])
            if rows.num_rows > 1:
                yield _rows(rows, np.flatnonzero(~rows.column("guest").to_numpy(zero_copy_only=False)[:-1]))
            waiting = rows.slice(rows.num_rows - 1)


#: Parts of the order for each task of a shuffle, so that tasks get about as many rows.
PARTS = 4
#: Bounds between two that are looked at first.
STRIDE = 100


def dealt(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``part``, a range of ``key`` (columns without nulls), and ``guest``.

    The first row of each part comes a second time, as a guest of the part before;
    that of the first part is a guest of the last one.  Part bounds, a few for each task,
    are taken from a sort of the keys alone.
    """
    n = PARTS * partitions(rows.sparkSession)
    first = rows.select(*key).repartitionByRange(n, *key).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*key)).alias("k"))
    bounds = sorted(tuple(r.k) for r in first.collect())  # one row for each part
    if not bounds:
        return rows.withColumns({"part": F.lit(0), "guest": F.lit(False)})

    def keys(found: list[tuple]) -> Column:
        return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{c}', bigint('{v}')" for c, v in zip(key, b, strict=True)) + ")" for b in found) + ")")

    own = F.struct(*[F.col(c).cast("long").alias(c) for c in key])
    all_of_them, some = keys(bounds), keys(bounds[::STRIDE])
    block = F.size(F.filter(some, lambda b: b <= own)) - 1
    part = block * STRIDE + F.size(F.filter(F.slice(all_of_them, block * STRIDE + 1, STRIDE), lambda b: b <= own)) - 1
    placed = rows.withColumn("_part", part)
    before = F.pmod(F.col("_part") - 1, F.lit(len(bounds)))
    guest = F.struct(before.alias("part"), F.lit(True).alias("guest"))
    home = F.struct(F.col("_part").alias("part"), F.lit(False).alias("guest"))
    places = F.when(F.element_at(all_of_them, F.col("_part") + 1) == own, F.array(home, guest)).otherwise(F.array(home))
    return placed.select(*rows.columns, F.inline(places))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike these and the next texts are.

    Rows follow one another by id, nulls first; rows that share an id follow a
    hash of their texts, and all rows stay.  The last row is followed by the
    first, a single row by itself.  A null text counts as empty, and texts without
    words have an empty fingerprint.  Ids are whole numbers.  Further columns
    don't matter, whatever their names; an empty table gives an empty one.

    Texts cross one shuffle, by ranges of the order.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    number = F.col(id_column).cast("long")
    keyed = docs.select(number.alias("doc_id"), text.alias("text"), number.isNotNull().cast("long").alias("_known"), F.coalesce(number, F.lit(0)).alias("_id"), F.xxhash64(text).alias("_h"))
    key = ["_known", "_id", "_h"]
    ordered = dealt(keyed, key).repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "guest", *key)
    return ordered.select("doc_id", "text", "guest").mapInArrow(_stream, _SCHEMA)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
