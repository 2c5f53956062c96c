"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.sources.shared import fresh_folder

#: Bytes of text that one Python worker turns into arrays at a time.
SLICE_BYTES = 2_500_000
#: The same where each word takes several wide arrays.
SHORT_SLICE_BYTES = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files survive lost executors, and what is read again is read by column.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a sub-group that are numbered in one task without a further split.
HOT = 2_000_000


def sequence_number(df: DataFrame, group: list[str], order: list[str], out: str, sub: Callable[[int], Column] | None = None, hot: int = HOT) -> DataFrame:
    """Add ``out``: a gapless number from 0 within ``group``, with no group in one task.

    Rows of a group are spread over sub-groups by a hash of ``order``, or by
    ``sub``, which gets their number (a power of two); a small table of sub-group
    sizes gives each its first number, and a window numbers the rows inside.  The
    table has at most groups x 4,096 rows, so it is broadcast; callers have few
    groups (shards, length buckets).  A sub-group of more than ``hot`` rows (one
    key may hold a third of all) is split further by a hash of all columns, so
    only rows that are equal in every column stay together.  Rows that are equal
    in all of ``order`` get different numbers, in any order.
    """
    spread = 1 << min(12, max(3, (2 * partitions(df.sparkSession) - 1).bit_length()))
    chosen = F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(spread)) if sub is None else sub(spread)
    keyed = df.withColumns({"_sub": chosen.cast("int"), "_fine": F.lit(0)})
    keys = [*group, "_sub", "_fine"]
    sizes = materialize(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    crowded = sizes.where(F.col("_n") > hot)
    if not crowded.isEmpty():
        split = crowded.select(*group, "_sub", F.ceil(F.col("_n") / hot).cast("int").alias("_splits"))
        joined = keyed.join(F.broadcast(split), and_all(keyed[c].eqNullSafe(split[c]) for c in (*group, "_sub")), "left")
        fine = F.when(F.col("_splits").isNotNull(), F.pmod(F.xxhash64(*[keyed[c] for c in df.columns]), F.col("_splits"))).otherwise(0).cast("int")
        keyed = joined.select(*[keyed[c] for c in (*df.columns, "_sub")], fine.alias("_fine"))
        sizes = materialize(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    before = Window.partitionBy(*group).orderBy("_sub", "_fine").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    numbered = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    # at most groups x spread rows and those of the splits
    joined = numbered.join(F.broadcast(first), and_all(numbered[c].eqNullSafe(first[c]) for c in keys))
    return joined.select(*[numbered[c] for c in df.columns], (F.col("_first") + F.col("_rank") - 1).alias(out))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that each part holds about ``limit`` bytes of ``column``; no row is split."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, flat, and the number of words of each text (null: none)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        rows = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(rows[full], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(full))
    return flat, counts


def encode_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Exact integer codes of the words and the distinct words they stand for."""
    if not len(words):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of strings without nulls, one after the other, and where each begins (and the last ends)."""
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the place of the first byte of each."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead].astype(np.int32)
    if len(lead) == len(data):
        return first, lead
    tail = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
    two, three, four = (first >= 0xC0) & (first < 0xE0), (first >= 0xE0) & (first < 0xF0), first >= 0xF0
    out = first.copy()
    at = lead[two]
    out[two] = (first[two] & 0x1F) << 6 | tail[at + 1]
    at = lead[three]
    out[three] = (first[three] & 0x0F) << 12 | tail[at + 1] << 6 | tail[at + 2]
    at = lead[four]
    out[four] = (first[four] & 0x07) << 18 | tail[at + 1] << 12 | tail[at + 2] << 6 | tail[at + 3]
    return out, lead


class Generation:
    """Integer sequences of strings, one after the other in one array."""

    def __init__(self, dtype: type):
        self.at: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, dtype), np.zeros(1, np.int64)

    def add(self, keys: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.at.update(zip(keys, range(len(self.at), len(self.at) + len(keys)), strict=True))
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences at ``at``, flat, and their lengths."""
        lengths = self.starts[at + 1] - self.starts[at]
        return self.flat[ranges(self.starts[at], lengths)], lengths


class Remembered:
    """Integer sequences of strings, computed by ``compute`` when first met.

    Two generations bound the memory: what is met goes to the young one; when
    that holds ``keep`` strings it becomes the old one, whose strings move back
    if they are met again and go if not.  So the many strings that are met once
    don't push out the common ones.
    """

    def __init__(self, keep: int, dtype: type, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.keep, self.dtype, self.compute = keep, dtype, compute
        self.clear()

    def clear(self) -> None:
        self.young, self.old = Generation(self.dtype), Generation(self.dtype)

    def take(self, keys: list[str], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of ``keys[i]`` for the i of ``of``, flat, and their lengths; ``keys`` are distinct."""
        if len(self.young.at) >= self.keep:
            self.young, self.old = Generation(self.dtype), self.young
        at = self.young.at
        if lacking := [k for k in keys if k not in at]:
            old = self.old.at
            if again := [k for k in lacking if k in old]:
                self.young.add(again, *self.old.take(np.fromiter((old[k] for k in again), np.int64, len(again))))
            if new := [k for k in lacking if k not in old]:
                self.young.add(new, *self.compute(new))
        return self.young.take(np.fromiter((at[k] for k in keys), np.int64, len(keys))[of])


def and_all(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
