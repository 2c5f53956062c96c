"""Comparing all members of a bucket with one another, however large the bucket.

A bucket of up to ``BLOCK`` members is one cell.  A larger one is dealt into
blocks by a hash, and each pair of blocks is a cell: every pair of members meets
in just one cell, no cell has more than about two blocks of rows, and the cells
of one bucket go to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

#: Members of a bucket that are compared in one cell.
BLOCK = 256
#: Rows that one task compares, about.
TASK_ROWS = 10_000


def deal(rows: DataFrame, keys: list[str], member: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``cell`` (number within the bucket of ``keys``) and ``side``.

    In a cell of one block all pairs count and ``side`` is -1; in a cell of two
    blocks it is the member's block, and the pairs across count.
    """
    large = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_blocks")), "large-buckets")
    if large.isEmpty():
        return rows.withColumns({"cell": F.lit(0).cast("long"), "side": F.lit(-1)})
    joined = rows.join(large, keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    sided = joined.withColumn("side", F.pmod(F.xxhash64(member, F.lit(11)), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    pairs = sided.select("*", other)
    low, high = F.least("side", "_other"), F.greatest("side", "_other")
    celled = pairs.withColumn("cell", (low.cast("long") * F.col("_blocks") + high).cast("long"))
    return celled.withColumn("side", F.when(F.col("side") == F.col("_other"), -1).otherwise(F.col("side"))).drop("_blocks", "_other")


def deal_apart(rows: DataFrame, key: str, part: str, member: str, block: int = BLOCK) -> DataFrame:
    """``deal`` where members of one part (a long, -1: none) need not meet one another.

    A part of more than a block has blocks of its own, which form no cells among
    themselves; all others share blocks.  So a bucket that is one large part and
    few others gives about as many rows as it has members.
    """
    sizes = materialize(rows.groupBy(key, part).agg(F.count(F.lit(1)).alias("_n")), "part-sizes")
    large = sizes.where((F.col("_n") > block) & (F.col(part) >= 0)).select(key, part, F.col(part).alias("_kind"), "_n")
    others = sizes.join(large.select(key, part), [key, part], "left_anti").groupBy(key).agg(F.sum("_n").alias("_n")).select(key, F.lit(-1).cast("long").alias("_kind"), "_n")
    blocks = large.select(key, "_kind", "_n").unionByName(others).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    of_bucket = Window.partitionBy(key)
    before = of_bucket.orderBy("_kind").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select(key, "_kind", "_blocks", F.coalesce(F.sum("_blocks").over(before), F.lit(0)).cast("int").alias("_first"), F.sum("_blocks").over(of_bucket).cast("int").alias("_all"))
    placed = materialize(placed.where("_all > 1"), "part-blocks")
    if placed.isEmpty():
        return rows.withColumns({"cell": F.lit(0).cast("long"), "side": F.lit(-1)})
    kinds = placed.where("_kind >= 0").select(key, F.col("_kind").alias(part), "_kind")
    joined = rows.join(kinds, [key, part], "left").withColumn("_kind", F.coalesce("_kind", F.lit(-1).cast("long"))).join(placed, [key, "_kind"], "left")
    own = F.coalesce(F.col("_first") + F.pmod(F.xxhash64(member, F.lit(11)), F.col("_blocks")).cast("int"), F.lit(0))
    met = F.filter(F.sequence(F.lit(0), F.coalesce("_all", F.lit(1)) - 1), lambda x: F.col("_first").isNull() | (F.col("_kind") < 0) | (x < F.col("_first")) | (x >= F.col("_first") + F.col("_blocks")))
    pairs = joined.withColumn("side", own).select("*", F.explode(met).alias("_other"))
    cell = F.least("side", "_other").cast("long") * F.coalesce("_all", F.lit(1)) + F.greatest("side", "_other")
    sided = F.when(F.col("side") == F.col("_other"), -1).otherwise(F.col("side"))
    return pairs.withColumns({"cell": cell.cast("long"), "side": sided}).select(*rows.columns, "cell", "side")


def gather(cells: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Rows of a cell side by side in one partition.

    Comparing takes longer than rows of that size would let one think, so with
    ``rows``, about how many there are, the number of tasks follows it.
    """
    tasks = [max(partitions(cells.sparkSession), rows // TASK_ROWS)] if rows is not None else []
    return cells.repartition(*tasks, *keys, "cell").sortWithinPartitions(*keys, "cell")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal integer keys, of two rows and more, from sorted batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        if rest:
            last = rest[-1].slice(rest[-1].num_rows - 1)
            changed[0] = any(last.column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys)
        else:
            changed[0] = False
        cuts = np.flatnonzero(changed).tolist()
        bounds = [0, *cuts] if not cuts or cuts[0] else cuts
        if cuts and cuts[0] == 0 and rest:
            yield from _whole(rest)
            rest = []
        bounds.append(batch.num_rows)
        for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if i == len(bounds) - 2:
                rest.append(batch.slice(a, b - a))
            elif rest:
                rest.append(batch.slice(a, b - a))
                yield from _whole(rest)
                rest = []
            elif b - a > 1:
                yield batch.slice(a, b - a)
    yield from _whole(rest)


def _whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if sum(p.num_rows for p in parts) > 1:
        yield parts[0] if len(parts) == 1 else pa.concat_batches(parts)
