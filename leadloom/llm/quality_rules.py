"""Quality rules: features of whole texts and decision lists learned from labels.

Learning is sequential covering.  A rule is grown on one part of the labelled
rows by adding the threshold condition with the highest information gain, pruned on
the other part, accepted if it is precise enough on both, and the rows it covers
are set aside before the next rule is grown.  The list becomes one
ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import encode_words, materialize, read_table, slices, split_words, starts_of

#: Words of the window in which repeats are looked for.
WINDOW = 5
#: Counts of a text, in order.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_bare_words"]
#: What the rules look at: shares, so that a rule means the same for every length.
FEATURES = ["symbol_share", "dup_line_share", "repeat_share", "capital_share", "mark_share", "bare_share", "mean_chars", "log_words"]
#: Bound of the labelled rows that the driver learns from.
MAX_LABELLED = 20_000

_SYMBOL, _MARK, _CAPITAL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK[list(b"!?")] = True
_CAPITAL[65:91] = True
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def _per_row(hits: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of hits of each row; offsets are places in ``hits``."""
    return np.diff(np.searchsorted(np.flatnonzero(hits), offsets))


def repeated_words(codes: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each row that lie in a window of words found twice or more in the row."""
    n = len(codes)
    if n < window:
        return np.zeros(len(counts), np.int64)
    keys = codes
    for step in range(1, window):  # exact codes of ever longer windows
        pair = (keys[: n - step] << 32) | codes[step:]
        keys = np.unique(pair, return_inverse=True)[1] if step < window - 1 else pair
    starts = starts_of(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])  # windows inside one row
    order = np.lexsort((keys[at], row[at]))
    r, k = row[at][order], keys[at][order]
    same = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = at[order[twice]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + window, -1)
    return _per_row(np.cumsum(cover[:-1]) > 0, starts)


def count_features(texts: pa.Array) -> dict[str, np.ndarray]:
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    words, counts = split_words(texts)
    codes, distinct = encode_words(words)
    bare = ~pc.match_substring_regex(distinct, r"[\p{L}\p{N}]").to_numpy(zero_copy_only=False).astype(bool) if len(distinct) else np.zeros(0, bool)
    lists = pc.split_pattern(texts, "\n")
    line_counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    line_codes, lines = encode_words(lists.flatten())
    full = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False).astype(bool)[line_codes]
    row = np.repeat(np.arange(len(texts)), line_counts)[full]
    n_full = np.bincount(row, minlength=len(texts))
    n_distinct = np.bincount(np.unique(row * np.int64(len(lines) + 1) + line_codes[full]) // (len(lines) + 1), minlength=len(texts))
    return {
        "n_words": counts,
        "word_chars": _per_row(((data & 0xC0) != 0x80) & ~_WHITE[data], offsets),
        "n_symbols": _per_row(_SYMBOL[data], offsets),
        "n_dup_lines": n_full - n_distinct,
        "n_repeat_words": repeated_words(codes, counts),
        "n_lines": n_full,
        "n_capitals": _per_row(_CAPITAL[data], offsets),
        "n_marks": _per_row(_MARK[data], offsets),
        "n_bare_words": _per_row(bare[codes], starts_of(counts)),
    }


def add_counts(docs: DataFrame, text_column: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out`` of the counts of each whole text.

    A null text counts as empty: all counts are 0.  An input column named as
    ``out`` is replaced; all others pass through, whatever their names and
    nulls; repeated rows stay; an empty table gives an empty one.
    """
    kept = docs.drop(out) if out in docs.columns else docs
    counts = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([*kept.schema.fields, T.StructField(out, counts)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text_column):
                found = count_features(part.column(text_column))
                column = pa.StructArray.from_arrays([pa.array(found[c].astype(np.int64)) for c in COUNTS], COUNTS)
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, out])

    return kept.mapInArrow(work, schema)


def features(counts: Column) -> dict[str, Column]:
    """The shares that rules look at, from a struct of counts."""
    words, chars = F.greatest(counts["n_words"], F.lit(1)), F.greatest(counts["word_chars"], F.lit(1))
    return {
        "symbol_share": counts["n_symbols"] / chars,
        "dup_line_share": counts["n_dup_lines"] / F.greatest(counts["n_lines"], F.lit(1)),
        "repeat_share": counts["n_repeat_words"] / words,
        "capital_share": counts["n_capitals"] / chars,
        "mark_share": counts["n_marks"] / chars,
        "bare_share": counts["n_bare_words"] / words,
        "mean_chars": counts["word_chars"] / words,
        "log_words": F.log(F.lit(1.0) + counts["n_words"]),
    }


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        column = x[:, names.index(self.feature)]
        return column >= self.threshold if self.above else column < self.threshold

    def column(self, shares: dict[str, Column]) -> Column:
        share = shares[self.feature]
        return share >= F.lit(self.threshold) if self.above else share < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects; precision and cover as measured on all labelled rows left to it."""

    conditions: tuple[Condition, ...]
    precision: float
    cover: int

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x, names) for c in self.conditions]) if self.conditions else np.ones(len(x), bool)


def _candidates(x: np.ndarray, names: list[str], most: int = 32) -> list[Condition]:
    out = []
    for i, name in enumerate(names):
        values = np.unique(np.quantile(x[:, i], np.linspace(0, 1, most + 1)))
        for a, b in zip(values, values[1:], strict=False):
            out += [Condition(name, above, float((a + b) / 2)) for above in (True, False)]
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], longest: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < longest and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for c in _candidates(x[inside], names):
            hit = c.holds(x[inside], names)
            p = bad[inside][hit].sum()
            if p:
                found = p * (np.log2(p / hit.sum()) - np.log2(p0 / (p0 + n0)))
                if found > gain:
                    best, gain = c, found
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x, names)
    return rule


def _score(rule: list[Condition], x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, float, int]:
    hit = Rule(tuple(rule), 0, 0).holds(x, names)
    p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
    return (p - n) / max(1, p + n), p / max(1, p + n), p


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.95, least: int = 5, longest: int = 4, most: int = 12, seed: int = 1) -> list[Rule]:
    """The ordered rejecting rules for the rows marked ``bad``; none if there is nothing to learn."""
    rng = np.random.default_rng(seed)
    side = rng.random(len(x)) < 2 / 3
    gx, gb, px, pb = x[side], bad[side], x[~side], bad[~side]
    rules: list[Rule] = []
    for _ in range(2 * most):
        if len(rules) == most or not gb.any() or not pb.any():
            break
        grown = _grow(gx, gb, names, longest)
        fit = []  # shortened rules that are precise on both parts: score on the pruning part, length, rule
        for size in range(1, len(grown) + 1):
            rule = grown[:size]
            score, exact, cover = _score(rule, px, pb, names)
            both = _score(rule, np.concatenate([gx, px]), np.concatenate([gb, pb]), names)
            if min(exact, both[1]) >= precision and cover >= least:
                fit.append((score, -size, Rule(tuple(rule), both[1], both[2])))
        if not fit:  # what it covers may not lead the next rule astray
            gone = Rule(tuple(grown), 0, 0).holds(gx, names)
            if not grown or not gone.any():
                break
            gx, gb = gx[~gone], gb[~gone]
            continue
        rules.append(max(fit, key=lambda f: f[:2])[2])
        gone, gone_p = rules[-1].holds(gx, names), rules[-1].holds(px, names)
        gx, gb, px, pb = gx[~gone], gb[~gone], px[~gone_p], pb[~gone_p]
    return rules


def verdict(rules: list[Rule], counts: Column) -> Column:
    """The ordered conditional expression of a decision list: true keeps."""
    shares = features(counts)
    out = None
    for rule in rules:
        condition = F.lit(True)
        for c in rule.conditions:
            condition = condition & c.column(shares)
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def chosen_labels(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id`` and ``_good`` of the labelled documents to learn from, about ``max_labelled`` at most, chosen by a hash of the id.

    Rows without a label or an id don't count, and a document with labels of both
    kinds counts as good.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_good"))
    share = min(1.0, max_labelled / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def learn_rules(counted: DataFrame, chosen: DataFrame, out: str = "quality") -> list[Rule]:
    """Rules from the rows with counts whose ids are among ``chosen_labels``; without any there are none.

    Of several rows with one id the one with the smallest shares counts, so the
    rules don't depend on the order of the rows.
    """
    shares = features(F.col(out))
    rows = counted.select(F.col("doc_id"), F.struct(*[c.alias(n) for n, c in shares.items()]).alias("_x")).join(F.broadcast(chosen), "doc_id")  # a bounded number of ids
    rows = rows.groupBy("doc_id").agg(F.min("_x").alias("_x"), F.max("_good").alias("_good")).select("doc_id", "_good", "_x.*").toPandas()
    if not len(rows):
        return []
    rows = rows.sort_values("doc_id")
    return learn(rows[FEATURES].to_numpy(float), (rows["_good"] == 0).to_numpy(), FEATURES)


def judge(docs: DataFrame, labels: DataFrame, out: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` with the counts struct ``out`` and booleans ``base_failed`` and ``kept``; nothing is dropped.

    The rules are learned from the labelled rows among ``docs``, whose counts are
    taken first.  Input columns with these names are replaced.  See ``add_counts``
    for nulls, empty and repeated rows.
    """
    chosen = materialize(chosen_labels(labels, max_labelled), "chosen-labels")
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rules = learn_rules(add_counts(labelled, out=out), chosen, out)
    counted = add_counts(docs.drop("base_failed", "kept"), out=out)
    failed = base_failed(F.col(out))
    return counted.withColumns({"base_failed": failed, "kept": ~failed & verdict(rules, F.col(out))})


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = materialize(add_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality"), "quality-counts")
    rules = learn_rules(counted, chosen_labels(read_table(spark, sf_dir, "labels")))
    failed = base_failed(F.col("quality"))
    return counted.select("doc_id", *[F.col("quality")[c].alias(c) for c in COUNTS[:5]], failed.alias("base_failed"), (~failed & verdict(rules, F.col("quality"))).alias("kept"))
