"""Near-duplicate documents by SetSketch registers.

The registers of a document's shingle set are exponentially spaced truncated
minima: register values of two sets are equal with a probability close to their
Jaccard similarity, and the sketch of a union is the register-wise maximum.
Bands of register values make buckets; members of a bucket are compared by the
joint likelihood of their registers given both set sizes; what that leaves is
verified on the full sets.

Documents with equal sets are one node, a class.  The pairs that the registers
leave are reduced to a spanning part in each bucket, whose components are
regions.  In a large region the pairs of a spanning forest are verified first,
one pair for each node; what they link is a fragment.  Then the documents of a
region meet, block by block, with their full sets, but for those of one
fragment, and a pair is verified unless verified links already connect it.  So a
large group of near copies gives about as many rows as it has documents.  Bands
and likelihood cut together lose a pair at similarity 0.8 with probability 5e-5,
if no other links connect it; at 0.85 with 7e-7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import deal, deal_apart, gather, groups
from .common import SHORT_SLICE_BYTES, encode_words, materialize, mix64, read_table, slices, split_words, starts_of
from .components import components, spanning
from .embedding_dedup import union_roots

#: Base of the registers' spacing; truncation at 65,534.
BASE, TOP = 1.02, 65534
#: Bands of registers: at similarity 0.8 a pair shares one of 25 bands of 5 with probability 1 - 5e-5, at 0.3 with 0.06.
BANDS, ROWS = 25, 5
#: Standard errors of the estimate by which a pair may lie below the threshold and still be verified: by the normal tail a pair at the threshold falls lower with probability 3e-7.
MARGIN = 5.0
#: Documents of a region that meet in one block.
REGION_BLOCK = 128


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and their number.

    Letters A-Z count as lower case.  A text of fewer words than ``width`` has
    its whole word sequence as its one shingle; one without words has none.
    """
    words, counts = split_words(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    codes, distinct = encode_words(words)
    hashes = pd.util.hash_array(np.array(distinct.to_pylist(), object), categorize=False) if len(distinct) else np.zeros(0, np.uint64)
    h = hashes[codes]
    starts = starts_of(counts)
    n = len(h)
    row = np.repeat(np.arange(len(counts)), counts)
    out, of = [], []
    if n >= width:
        key = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
        inside = row[: n - width + 1] == row[width - 1 :]
        out.append(key[inside])
        of.append(row[: n - width + 1][inside])
    for short in range(1, width):
        rows = np.flatnonzero(counts == short)
        if len(rows):
            key = np.full(len(rows), short, np.uint64)
            for i in range(short):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + h[starts[rows] + i])
            out.append(key)
            of.append(rows)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    key, row = np.concatenate(out), np.concatenate(of)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[first], np.bincount(row[first], minlength=len(counts)).astype(np.int64)


def registers(keys: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers of each set (0 for empty sets).

    Register j of a set is floor(1 - log_b x) for the smallest of its elements'
    exponential variables x; the variable is monotone in a hash, so the minimum
    is taken over hashes and transformed once.
    """
    full = np.flatnonzero(counts)
    out = np.zeros((len(counts), m), np.uint16)
    if not len(full):
        return out
    at = starts_of(counts)[full]
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 1 << 62, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 1 << 62, m, dtype=np.uint64)
    low = np.empty((m, len(full)), np.uint64)
    for j in range(m):
        low[j] = np.minimum.reduceat(keys * factors[j] + terms[j], at)
    u = (low.T.astype(np.float64) + 0.5) * 2.0**-64
    x = -np.log1p(-u)
    out[full] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)) + 1000, 1, TOP).astype(np.uint16)
    return out


def likelihood_rises(j: np.ndarray | float, higher: np.ndarray, lower: np.ndarray, m: int, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether the likelihood of the counts of higher, lower and equal registers grows at the similarity ``j``.

    Its derivative falls in the similarity, so the likeliest one lies above ``j`` exactly if it does.
    """
    share_a, share_b = n_a / (n_a + n_b), n_b / (n_a + n_b)
    equal = m - higher - lower
    c = (BASE - 1) / BASE
    scale = np.log(BASE)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 1e-12) * c) / scale

    def slope(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return -by * c / (1 - np.maximum(x, 1e-12) * c) / scale

    up, down = p(share_a - share_b * j), p(share_b - share_a * j)
    d_up, d_down = slope(share_a - share_b * j, share_b), slope(share_b - share_a * j, share_a)
    return higher * d_up / up + lower * d_down / down - equal * (d_up + d_down) / np.maximum(1 - up - down, 1e-12) > 0


def likelihood_similarity(higher: np.ndarray, lower: np.ndarray, m: int, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity that makes the counts of higher, lower and equal registers likeliest, given the set sizes."""
    lo, hi = np.zeros(len(higher)), np.minimum(n_a / n_b, n_b / n_a)
    for _ in range(24):
        j = (lo + hi) / 2
        rising = likelihood_rises(j, higher, lower, m, n_a, n_b)
        lo, hi = np.where(rising, j, lo), np.where(rising, hi, j)
    return (lo + hi) / 2


def equal_registers(regs: np.ndarray, part: slice) -> np.ndarray:
    """Number of equal registers of the rows of ``part`` with all rows."""
    if len(regs) <= 48:
        return (regs[part, None, :] == regs[None, :, :]).sum(2)
    out = np.zeros((len(range(*part.indices(len(regs)))), len(regs)), np.int16)
    for r in np.ascontiguousarray(regs.T):
        out += r[part, None] == r[None, :]
    return out


class Sketched:
    """Members of a cell with their registers and set sizes."""

    def __init__(self, group: pa.RecordBatch, m: int, threshold: float):
        self.ids = group.column("node").to_numpy(zero_copy_only=False)
        self.regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), "<u2").reshape(len(self.ids), m)
        self.size = group.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
        self.side = group.column("side").to_numpy(zero_copy_only=False)
        self.part = group.column("part").to_numpy(zero_copy_only=False) if "part" in group.schema.names else np.full(len(self.ids), -1)
        self.m, self.threshold = m, threshold
        self.two = bool(self.side[0] >= 0)
        self.least = threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / m)

    def near(self, label: np.ndarray, step: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs with different labels whose estimate reaches the threshold less the margin, by blocks.

        Those with the most equal registers come first.  Labels may change between blocks.
        """
        n = len(self.ids)
        for at in range(0, n, step):
            part = slice(at, min(n, at + step))
            equal = equal_registers(self.regs, part)
            near = equal >= 0.9 * self.least * self.m
            near &= np.arange(n)[None, :] > np.arange(part.start, part.stop)[:, None]
            near &= np.minimum(self.size[part, None], self.size[None, :]) >= self.threshold * np.maximum(self.size[part, None], self.size[None, :])
            near &= label[part, None] != label[None, :]
            if self.two:
                near &= self.side[part, None] != self.side[None, :]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            order = np.argsort(-equal[a, b], kind="stable")
            a, b = a[order] + at, b[order]
            likely = np.concatenate([self.likely(a[k : k + 20_000], b[k : k + 20_000]) for k in range(0, len(a), 20_000)])
            if likely.any():
                yield a[likely], b[likely]

    def likely(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the likeliest similarity of pairs reaches the least one that is verified."""
        x, y = self.regs[a], self.regs[b]
        return likelihood_rises(self.least, (x > y).sum(1), (x < y).sum(1), self.m, self.size[a], self.size[b])

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that the registers leave, as few as connect what all of them connect, likely ones first."""
        label = np.arange(len(self.ids))
        out_a, out_b = [label[:0]], [label[:0]]
        for a, b in self.near(label):
            while len(a):
                first = np.full(len(label), len(a))  # of each tree, the likeliest pair that leads out of it
                place = np.arange(len(a))
                np.minimum.at(first, label[a], place)
                np.minimum.at(first, label[b], place)
                pick = np.unique(first[first < len(a)])
                out_a.append(a[pick])
                out_b.append(b[pick])
                label[:] = union_roots(len(label), label[a[pick]], label[b[pick]])[label]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
        return np.concatenate(out_a), np.concatenate(out_b)

    def verified(self, keys: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that full sets confirm, but for pairs that such links connect already."""
        label = self.fragments()
        out_a, out_b = [], []
        for a, b in self.near(label):
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                if label[i] != label[j] and similar(keys[i], keys[j], percent):
                    low, high = sorted((label[i], label[j]))
                    label[label == high] = low
                    out_a.append(i)
                    out_b.append(j)
        return np.array(out_a, np.int64), np.array(out_b, np.int64)


    def fragments(self) -> np.ndarray:
        """The first position of each member's fragment (-1: of none)."""
        part = self.part
        label = np.arange(len(part))
        has = np.flatnonzero(part >= 0)
        if len(has):
            _, first, which = np.unique(part[has], return_index=True, return_inverse=True)
            label[has] = has[first][which]
        return label


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sorted sets have a Jaccard similarity of ``percent`` ten-thousandths or more."""
    if len(x) > len(y):
        x, y = y, x
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 10_000 * common >= percent * (len(x) + len(y) - common)


_EXPLODED = ["band", "bucket"]


def _digests(keys: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """128 bits that stand for each set."""
    row = np.repeat(np.arange(len(counts)), counts)
    d1, d2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
    np.add.at(d1, row, mix64(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    np.add.at(d2, row, mix64(keys + np.uint64(0x5BD1E995)))
    return [pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))]


def sketches(docs: DataFrame, width: int, m: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n (set size), a 128-bit digest of the set and its registers."""
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SHORT_SLICE_BYTES):
                keys, counts = shingles(part.column("text"), width)
                regs = registers(keys, counts, m)
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * m), len(counts), [None, pa.py_buffer(regs.astype("<u2"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts), *_digests(keys, counts), blob], ["id", "n", "d1", "d2", "regs"])

    return narrow.mapInArrow(work, "id long, n long, d1 long, d2 long, regs binary")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``id``, ``n`` and digest of the set, and ``keys``, its sorted shingle hashes as little-endian 64-bit values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SHORT_SLICE_BYTES):
                keys, counts = shingles(part.column("text"), width)
                at = starts_of(counts) * 8
                blob = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(keys.astype("<u8"))])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts), *_digests(keys, counts), blob], ["id", "n", "d1", "d2", "keys"])

    return docs.mapInArrow(work, "id long, n long, d1 long, d2 long, keys binary")


def suspect_pairs(nodes: DataFrame, m: int, bands: int, rows: int, threshold: float) -> DataFrame:
    """Pairs (``a``, ``b``) of nodes that share a band and a likely similarity; of each bucket a spanning part."""
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    banded = nodes.select("node", "regs", band).select("node", "band", F.xxhash64(F.expr(f"substring(regs, band * {2 * rows} + 1, {2 * rows})")).alias("bucket"))
    shared = materialize(banded.groupBy(*_EXPLODED).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shared-buckets")
    total = shared.agg(F.sum("_n")).first()[0] or 0
    suspects = banded.join(shared.select(*_EXPLODED), _EXPLODED, "left_semi").join(nodes, "node")

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, [*_EXPLODED, "cell"]):
            cell = Sketched(group, m, threshold)
            a, b = cell.forest()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(cell.ids[a]), pa.array(cell.ids[b])], ["a", "b"])

    return gather(deal(suspects, _EXPLODED, "node"), _EXPLODED, total).mapInArrow(plausible, "a long, b long")


def verify_pairs(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    keyed = pairs.join(members.select(F.col("node").alias("a"), F.col("keys").alias("ka")), "a").join(members.select(F.col("node").alias("b"), F.col("keys").alias("kb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent) for x, y in zip(batch.column("ka"), batch.column("kb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return keyed.select("a", "b", "ka", "kb").mapInArrow(check, "a long, b long")


def near_links(nodes: DataFrame, members_of: Callable[[DataFrame], DataFrame], m: int, bands: int, rows: int, threshold: float, block: int = REGION_BLOCK) -> DataFrame:
    """Verified links between nodes (``node``, ``n``, ``regs``), as many as connect what all links connect.

    ``members_of`` adds ``keys``, ``n`` and ``regs`` to a table of nodes and regions.
    """
    regions, forest = spanning(materialize(suspect_pairs(nodes, m, bands, rows, threshold), "near-pairs"))
    regions = regions.select("node", F.col("component").alias("region"))
    members = materialize(members_of(regions), "region-members")
    percent = round(threshold * 10_000)
    large = materialize(regions.groupBy("region").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select("region"), "large-regions")
    parted, links = members.withColumn("part", F.lit(-1).cast("long")), []
    if not large.isEmpty():
        tree = forest.join(regions.withColumnRenamed("node", "a").join(large, "region", "left_semi"), "a").select("a", "b")
        sure = materialize(verify_pairs(tree, members, percent), "forest-links")
        links.append(sure)
        fragments = components(sure).withColumnRenamed("component", "part")
        found = regions.join(large, "region", "left_semi").join(fragments, "node", "left").select("node", "region", F.coalesce("part", "node").alias("part"))
        found = materialize(found, "fragments")
        whole = found.groupBy("region").agg(F.min("part").alias("_a"), F.max("part").alias("_b")).where("_a = _b").select("region")
        parts = found.select("node", "part")
        parted = members.join(materialize(whole, "whole-regions"), "region", "left_anti").join(parts, "node", "left").withColumn("part", F.coalesce("part", F.lit(-1).cast("long")))

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["region", "cell"]):
            cell = Sketched(group, m, threshold)
            a, b = cell.verified([np.frombuffer(k.as_buffer(), "<u8") for k in group.column("keys")], percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(cell.ids[a]), pa.array(cell.ids[b])], ["a", "b"])

    dealt = gather(deal_apart(parted, "region", "part", "node", block), ["region"], members.count())
    links.append(materialize(dealt.mapInArrow(confirmed, "a long, b long"), "near-links"))
    return links[0] if len(links) == 1 else links[0].unionByName(links[1])


def near_documents(docs: DataFrame, width: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked at a Jaccard similarity of ``threshold`` or more of their
    shingle sets of ``width`` words; ``component_id`` is the smallest id reachable
    and ``kept`` marks the document that has it.  Null, empty and wordless texts
    have no shingles and link with nothing; rows with a null id link with nothing
    and have a null component, not kept.  Rows with shingles that share an id are
    linked, whatever their texts.  Other columns are left aside; an empty table
    gives an empty one.
    """
    m = bands * rows
    sketched = materialize(sketches(docs, width, m, id_column, text_column), "sketches")
    sound = sketched.where("n > 0 and id is not null")
    # equal sets are one class and one node; its number is its place in the stored table
    found = sound.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.first("regs").alias("regs"))
    classes = materialize(found.withColumn("node", F.monotonically_increasing_id()), "set-classes")

    def members_of(regions: DataFrame) -> DataFrame:
        wanted = materialize(regions.join(classes, "node"), "region-nodes")
        # a narrow table, so that it is broadcast if it is small; texts then don't cross a shuffle
        reps = materialize(wanted.select(F.col("rep").alias("id")).distinct(), "region-reps")
        texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).join(reps, "id", "left_semi")
        sets = shingle_sets(texts, width).join(wanted, ["n", "d1", "d2"])
        return sets.groupBy("node").agg(F.first("region").alias("region"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("keys").alias("keys"))

    links = near_links(classes.select("node", "n", "regs"), members_of, m, bands, rows, threshold)
    linked = components(links.unionByName(_shared_ids(sound, classes)))
    told = materialize(classes.select("n", "d1", "d2", "node", "rep").join(linked, "node", "left").select("n", "d1", "d2", "rep", F.coalesce("component", "node").alias("root")), "near-roots")
    lowest = told.groupBy("root").agg(F.min("rep").alias("component"))
    told = materialize(told.join(lowest, "root").select("n", "d1", "d2", "component"), "near-told")
    out = sketched.select("id", "n", "d1", "d2").join(told, ["n", "d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _shared_ids(sound: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    digest = F.struct("n", "d1", "d2")
    shared = materialize(sound.groupBy("id").agg(F.min(digest).alias("_a"), F.max(digest).alias("_b")).where("_a <> _b").select("id"), "shared-ids")
    if shared.isEmpty():
        return sound.sparkSession.createDataFrame([], "a long, b long")
    of_id = sound.join(shared, "id", "left_semi").select("id", "n", "d1", "d2").distinct().join(classes, ["n", "d1", "d2"]).select("id", "node")
    first = of_id.groupBy("id").agg(F.min("node").alias("b"))
    return of_id.join(first, "id").select(F.col("node").alias("a"), "b")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(read_table(spark, sf_dir, "documents"), width=4)


#: Every pair of documents that share a shingle is compared here.
ORACLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS s FROM docs
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id, d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""
