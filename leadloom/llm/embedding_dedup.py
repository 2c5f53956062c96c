"""Near-duplicate vectors by random-hyperplane hashing.

Vectors that are equal component by component form a class, compared once.  The
signs of a class's products with random hyperplanes give its bucket in each of
several tables.  Only the classes' numbers and signs are dealt to buckets; buckets
of one go, and so do members that differ from all others of their bucket in more
signs than a pair at the threshold ever does (five standard errors).  The vectors
join what is left, where members are compared by exact cosine in double
precision, a pair in the first table only that brings it together.  Links are counted where they are found, and only a spanning part of
each cell's links leaves it, for the distributed connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import deal, gather, groups
from .common import materialize, read_table
from .components import components

#: Probability that a pair at the threshold meets in a table, and members of a bucket that unlike vectors may make.
RECALL, FILL = 0.9996, 256
#: Standard errors of the number of unlike signs by which a pair may exceed that of a pair at the threshold.
MARGIN = 5.0
#: Signs of a table at least and at most.
LEAST_BITS, MOST_BITS = 12, 40
SEED = 17


def plan_tables(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Signs of a table and number of tables for so many vectors.

    Signs grow with the logarithm of the rows, so buckets stay as they are; the
    tables make up for it.  A pair at cosine c shares a sign with probability
    1 - arccos(c) / pi: 12 signs and 24 tables at 0.95 and up to a million rows.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, rows) / FILL))))
    together = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(together, 1 - 1e-12))))


def most_unlike(threshold: float, signs: int) -> float:
    """Unlike signs of a pair at the threshold, with the margin; by the normal tail 3e-7 of such pairs have more."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    return signs * p + MARGIN * math.sqrt(signs * p * (1 - p))


@lru_cache(64)
def planes(dimensions: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimensions]).standard_normal((dimensions, bits * tables))


def sign_bits(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    return x @ planes(x.shape[1], bits, tables) >= 0


def signatures(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each row of signs in each table."""
    return signs.reshape(len(signs), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def packed(signs: np.ndarray) -> np.ndarray:
    """Rows of signs as 64-bit words."""
    bytes_ = np.packbits(signs, axis=1)
    return np.ascontiguousarray(np.pad(bytes_, ((0, 0), (0, -bytes_.shape[1] % 8)))).view(np.uint64)


def with_partner(codes: np.ndarray, side: np.ndarray, most: float) -> np.ndarray:
    """Members of a cell that differ from another in ``most`` signs or fewer."""
    found = np.zeros(len(codes), bool)
    for at in range(0, len(codes), 64):
        unlike = np.bitwise_count(codes[at : at + 64, None, :] ^ codes[None, :, :]).sum(2, dtype=np.int64)
        near = unlike <= most
        near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        if side[0] >= 0:
            near &= side[at : at + 64, None] != side[None, :]
        found[at : at + 64] |= near.any(1)
        found |= near.any(0)
    return found


def union_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n can reach by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def compare(group: pa.RecordBatch, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of a cell's members with links, the links that each has here and the smallest node reached."""
    nodes, side, copies = (group.column(c).to_numpy(zero_copy_only=False) for c in ("node", "side", "copies"))
    table = group.column("slot")[0].as_py()
    order = np.argsort(nodes, kind="stable")
    nodes, side, copies = nodes[order], side[order], copies[order]
    take = pa.array(order)
    x = np.frombuffer(b"".join(group.column("vector").take(take).to_pylist()), "<f8").reshape(len(nodes), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    buckets = np.frombuffer(b"".join(group.column("signs").take(take).to_pylist()), "<i8").reshape(len(nodes), -1)[:, :table]
    links, roots = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for at in range(0, len(nodes), 64):
        near = x[at : at + 64] @ x.T >= threshold
        near &= np.arange(len(nodes))[None, :] > np.arange(at, at + len(near))[:, None]
        if side[0] >= 0:
            near &= side[at : at + 64, None] != side[None, :]
        rows, others = np.nonzero(near)
        for k in range(0, len(rows), 20_000):
            a, b = rows[k : k + 20_000] + at, others[k : k + 20_000]
            if table:
                new = ~(buckets[a] == buckets[b]).any(1)
                a, b = a[new], b[new]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            if (roots[a] != roots[b]).any():
                roots = union_roots(len(nodes), np.concatenate([np.arange(len(nodes)), a]), np.concatenate([roots, b]))
    has = np.flatnonzero(links)
    return nodes[has], links[has], nodes[roots[has]]


def hash_vectors(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """node, copies, the vector as doubles, ``signs``: its bucket in each table, and ``code``: all signs, the three as bytes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                arrays = [np.array(x, "<f8") for x in part.column("v").to_pylist()]
                by_size: dict[int, list[int]] = {}
                for i, x in enumerate(arrays):
                    by_size.setdefault(len(x), []).append(i)
                for size, members in by_size.items():
                    x = np.stack([arrays[i] for i in members])
                    own = sign_bits(x / np.abs(x).max(1, keepdims=True), bits, tables)
                    pick = pa.array(members)
                    blobs, signs, codes = ([row.tobytes() for row in m] for m in (x, signatures(own, bits, tables).astype("<i8"), packed(own).astype("<u8")))
                    yield pa.RecordBatch.from_arrays([part.column("node").take(pick), part.column("copies").take(pick), pa.array([size] * len(members), pa.int32()), *[pa.array(c, pa.binary()) for c in (blobs, signs, codes)]], ["node", "copies", "size", "vector", "signs", "code"])

    return classes.mapInArrow(hashed, "node long, copies long, size int, vector binary, signs binary, code binary")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, bits: int | None = None, tables: int | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per input row: the id, ``n_links``, ``component_id`` and ``kept``.

    ``n_links`` counts the other rows at cosine ``threshold`` or more, copies
    included; ``component_id`` is the smallest id reachable by links.  Vectors
    that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do rows with a null id (component null, not kept).  Vectors of
    different lengths don't link.  Rows with sound vectors that share an id are one
    node of the components, whatever their vectors; each has its own ``n_links``.
    Other columns are left aside; an empty table gives an empty one.  Signs and
    tables follow the number of distinct vectors (``plan_tables``) unless given.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    sound = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.transform(v, lambda x: x + F.lit(0.0))))  # no -0.0
    found = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(found.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    planned = plan_tables(classes.count(), threshold)
    bits, tables = bits or planned[0], tables or planned[1]
    hashed = materialize(hash_vectors(classes, bits, tables), "vector-signs")
    keys = ["slot", "bucket"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            signs = np.frombuffer(b"".join(batch.column("signs").to_pylist()), "<i8")
            buckets = signs * np.int64(1 << 20) + np.repeat(np.minimum(batch.column("size").to_numpy(), (1 << 20) - 1), tables)
            pick = pa.array(np.repeat(np.arange(n), tables))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(buckets), batch.column("node").take(pick), batch.column("code").take(pick)], ["slot", "bucket", "node", "code"])

    places = hashed.select("node", "size", "signs", "code").mapInArrow(spread, "slot int, bucket long, node long, code binary")
    several = places.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    dealt = deal(materialize(places.join(several, keys, "left_semi"), "vector-buckets"), keys, "node")
    most = most_unlike(threshold, bits * tables)

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, [*keys, "cell"]):
            codes = np.frombuffer(b"".join(group.column("code").to_pylist()), "<u8").reshape(group.num_rows, -1)
            has = with_partner(codes, group.column("side").to_numpy(zero_copy_only=False), most)
            if has.any():
                yield group.select(["slot", "bucket", "node", "cell", "side"]).filter(pa.array(has))

    near = gather(dealt, keys).mapInArrow(partnered, "slot int, bucket long, node long, cell long, side int")
    suspects = materialize(near, "vector-cells")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, [*keys, "cell"]):
            nodes, links, roots = compare(group, threshold)
            if len(nodes):
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(roots)], ["node", "links", "root"])

    cells = gather(suspects.join(hashed, "node"), keys, suspects.count())
    linked = materialize(cells.mapInArrow(compared, "node long, links long, root long"), "vector-links")
    degrees = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(linked.select("node", "root").unionByName(_shared_ids(rows, classes)))
    told = classes.join(degrees, "node", "left").join(roots, "node", "left").select("v", "copies", "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("root"))
    told = materialize(told, "vector-roots")
    lowest = told.groupBy("root").agg(F.min("rep").alias("component"))
    told = materialize(told.join(lowest, "root"), "vector-told")  # a plain scan, so that a hot vector's join can be split
    out = rows.join(told, "v", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    sound = rows.where("v is not null")
    digest = F.xxhash64("v")
    shared = materialize(sound.groupBy("id").agg(F.min(digest).alias("_a"), F.max(digest).alias("_b")).where("_a <> _b").select("id"), "shared-ids")
    if shared.isEmpty():
        return rows.sparkSession.createDataFrame([], "node long, root long")
    of_id = sound.join(shared, "id", "left_semi").join(classes.select("v", "node"), "v").select("id", "node").distinct()
    first = of_id.groupBy("id").agg(F.min("node").alias("root"))
    return of_id.join(first, "id").select("node", "root")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


#: Every pair is compared here; near-duplicates have cosines far from the threshold on both sides.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(low.b, v.vec_id)) AS component_id,
  v.vec_id <= coalesce(low.b, v.vec_id) AS kept
FROM v LEFT JOIN low ON low.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
