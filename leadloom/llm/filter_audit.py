"""Filter interaction audit: what each of five filters removes, in every order of applying them.

Rows are range-sorted by text fingerprint, full text and id, so that an exact
copy lies behind the row that it copies; each row is compared with its
predecessor.  The failures of a row make a mask of five bits.  Counts per mask
are additive, and each of the 120 orders is read off them.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Filters in the order of their bits.
FILTERS = "ABCDE"
#: Bit of the filter of exact copies.
COPY = 16
_LAST = np.iinfo(np.int64).max


def failures(text: Column) -> Column:
    """Bits of the filters that look at one text: few words, few distinct words, capitals, symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    checks = [F.size(words) < 100, 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
    mask = F.lit(0)
    for bit, check in enumerate(checks):
        mask = mask + F.when(check, F.lit(1 << bit)).otherwise(F.lit(0))
    return mask


class Copies:
    """Marks rows, sorted by fingerprint, text and id, that have an equal text with a smaller id before them.

    Only the first and the last fingerprint of a sorted partition can go on in
    another one; the first rows of their texts come out with the text in
    ``edge``, once for each part and mask, and are settled afterwards.
    """

    def __init__(self) -> None:
        self.first: int | None = None  # fingerprint that the partition begins with
        self.fingerprint: int | None = None  # of the rows that wait for the next fingerprint
        self.held: dict[str, list] = {}  # their texts: smallest id and counts by part and mask
        self.before: int | None = None  # fingerprint of the row before
        self.text: str | None = None  # its text
        self.least = _LAST  # smallest id of that text here

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prints = batch.column("_fp").to_numpy()
        texts, ids = batch.column("text"), batch.column("doc_id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(ids, _LAST).to_numpy()
        n = batch.num_rows
        if self.first is None:
            self.first = int(prints[0])
        begins = np.ones(n, bool)
        begins[1:] = prints[1:] != prints[:-1]
        near = np.flatnonzero(~begins)  # texts are compared under one fingerprint only
        begins[near] = ~pc.equal(texts.take(pa.array(near)), texts.take(pa.array(near - 1))).to_numpy(zero_copy_only=False)
        goes_on = self.before == int(prints[0]) and self.text == texts[0].as_py()
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, n))
        least = np.minimum.reduceat(np.where(known, ids, _LAST), starts)
        if goes_on:
            least[0] = min(least[0], self.least)
        least_of_row = np.repeat(least, lengths)
        copy = known & (ids > least_of_row)
        edge = known & ~copy & ((prints == self.first) | (prints == prints[-1]))
        masks = batch.column("mask").to_numpy() + np.where(copy, COPY, 0)
        yield self._rows(batch.column("doc_id"), batch.column("part"), masks, np.ones(n, np.int64), keep=~edge)
        at = np.flatnonzero(edge)
        if len(at):
            run = np.repeat(np.arange(len(starts)), lengths)[at]
            counted = pd.DataFrame({"run": run, "part": batch.column("part").take(pa.array(at)).to_pylist(), "mask": masks[at]}).groupby(["run", "part", "mask"], sort=True).size()
            for (r, part, mask), count in counted.items():
                where = int(starts[r])
                if int(prints[where]) != self.fingerprint:
                    yield from self.settle()
                    self.fingerprint = int(prints[where])
                held = self.held.setdefault(texts[where].as_py(), [int(least[r]), {}])
                held[1][part, int(mask)] = held[1].get((part, int(mask)), 0) + int(count)
        if int(prints[-1]) != self.fingerprint:
            yield from self.settle()
            self.fingerprint = int(prints[-1])
        self.before, self.text, self.least = int(prints[-1]), texts[n - 1].as_py(), int(least[-1])

    def settle(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Rows that waited; with their text if another partition may hold it too."""
        rows = [(least, part, mask, count, text) for text, (least, counts) in self.held.items() for (part, mask), count in counts.items()]
        self.held = {}
        if rows:
            ids, parts, masks, counts, texts = zip(*rows, strict=True)
            open_end = last or self.fingerprint == self.first
            yield self._rows(pa.array(ids, pa.int64()), pa.array(parts, pa.string()), np.array(masks), np.array(counts), edge=texts if open_end else None)

    @staticmethod
    def _rows(ids: pa.Array, parts: pa.Array, masks: np.ndarray, counts: np.ndarray, keep: np.ndarray | None = None, edge: tuple | None = None) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([ids, parts, pa.array(masks.astype(np.int32)), pa.array(counts.astype(np.int64)), pa.array(edge or [None] * len(masks), pa.string())], ["doc_id", "part", "mask", "n", "edge"])
        return out if keep is None else out.filter(pa.array(keep))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = Copies()
    for batch in batches:
        if batch.num_rows:
            yield from state.add(batch)
    yield from state.settle(last=True)


def failure_masks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """``doc_id``, ``part``, ``mask`` and ``n``, the number of such rows, of all rows of ``docs``.

    A null text counts as empty, a null part as the empty string.  A row without
    an id is nobody's copy and no one is its copy; rows that share an id and a
    text are no copies of one another.  Ids are whole numbers.  Further columns
    don't matter, whatever their names; an empty table gives an empty one.

    The range is cut by fingerprint and id, so a text that a third of all rows
    share is spread over many tasks, and no text is gathered to find the cuts.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("_fp"))
    ordered = rows.repartitionByRange("_fp", "doc_id").sortWithinPartitions("_fp", "text", "doc_id")
    masked = ordered.select("doc_id", "part", "text", "_fp", failures(F.col("text")).alias("mask"))
    marked = materialize(masked.mapInArrow(_mark, "doc_id long, part string, mask int, n long, edge string"), "failure-masks")
    edges = marked.where("edge is not null")  # a few rows of each partition
    first = edges.groupBy("edge").agg(F.min("doc_id").alias("_least"))
    settled = edges.join(first, "edge").withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("_least"), COPY).otherwise(0))
    columns = ["doc_id", "part", "mask", "n"]
    return marked.where("edge is null").select(*columns).unionByName(settled.select(*columns))


def orders() -> list[dict]:
    """Each step of each order: the number of its filter's bit, the bit, and the bits applied before it and with it."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, bit in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[b] for b in order), "step": step + 1, "bit": bit, "own": 1 << bit, "before": before, "after": before | 1 << bit})
            before |= 1 << bit
    return out


def audit(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step from ``failure_masks`` and labels (doc_id, quality, toxic).

    A document is good or toxic if any of its labels says so.  The counters of a
    part are three arrays by set of filters (documents, good ones and toxic ones
    that pass the whole set), so they add up over any split of the rows.
    """
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = masks.join(materialize(flags.where("good or toxic"), "label-flags"), "doc_id", "left")
    counters = known.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))
    sets = range(1 << len(FILTERS))

    def passing(rows: Column) -> Column:
        return F.array(*[F.sum(F.when((F.col("mask").bitwiseAND(s) == 0) & rows, F.col("n")).otherwise(0)) for s in sets])

    alone = F.array(*[F.sum(F.when(F.col("mask") == 1 << b, F.col("n")).otherwise(0)) for b in range(len(FILTERS))])
    per_part = counters.groupBy("part").agg(passing(F.lit(True)).alias("docs"), passing(F.col("good")).alias("good"), passing(F.col("toxic")).alias("toxic"), alone.alias("alone"))
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order string, step int, bit int, own int, before int, after int>>")
    each = per_part.select("*", F.inline(steps))

    def at(counts: str, index: str | int) -> Column:
        return F.col(counts)[F.col(index) if isinstance(index, str) else index]

    removed = at("docs", "before") - at("docs", "after")
    # a filter comes after just the set s in |s|! (4 - |s|)! of the orders
    ways = [1, 1, 2, 6, 24]
    total = [sum((ways[s.bit_count()] * ways[4 - s.bit_count()] * (at("docs", s) - at("docs", s | 1 << b)) for s in sets if not s >> b & 1), F.lit(0)) for b in range(len(FILTERS))]
    return each.select(
        "part", "filter_order", "step", at("docs", "after").alias("kept"), removed.alias("removed"),
        (at("docs", 0) - at("docs", "own") - removed).alias("redundant"), F.col("alone")[F.col("bit")].alias("unique_fails"),
        (at("good", "before") - at("good", "after")).alias("good_lost"), (at("toxic", "before") - at("toxic", "after")).alias("toxic_lost"), F.array(*total)[F.col("bit")].alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(failure_masks(docs), read_table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM docs
), masks AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM worded
), flagged AS (
  SELECT part, mask, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic FROM masks
  LEFT JOIN (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
), counters AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM flagged GROUP BY ALL
), letters AS (SELECT chr(65 + i::INT) AS f, (1 << i)::BIGINT AS b FROM range(5) r(i)
), ordered AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.b | b.b | c.b | d.b | e.b = 31
), steps AS (
  SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[:s - 1]), 0)::BIGINT AS before FROM ordered, range(1, 6) r(s)
), audited AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counters, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM audited
"""
