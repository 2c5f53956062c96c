"""Removal of long word sequences that an earlier document also holds.

Suffix automata of reference shards give matching statistics: streaming words
through the automaton yields, at each word, the length of the longest match
that ends there, and a match as long as the window marks the words to remove.

The reference is the corpus itself, so its automata can't be broadcast whole.
It is cut into shards by content instead.  Every window of words has an anchor,
the smallest hash among its short word runs; equal windows have equal anchors.
The stretch of windows with one anchor is a segment, and a segment can only
match segments of its own anchor.  So a shard holds the distinct segments of
some anchors, and its automata meet just those: anchors that only one document
has, and segments that are equal word for word, never reach an automaton.

A passage that a great many documents quote makes its anchor hot, with as many
segments as there are texts around it.  Those are cut up by second anchors, the
smallest runs but for the anchor: parts that reach into the text around have
second anchors of their own and go, parts within the passage are mostly equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import deal, gather, groups
from .common import SHORT_SLICE_BYTES, encode_words, materialize, mix64, read_table, slices, split_words, starts_of

#: Consecutive words that make a repeat, and words of the runs among which anchors are chosen.
WINDOW, RUN = 50, 8
#: Windows whose anchors are found at a time.
STEP = 1 << 20
#: Different segments from which on an anchor is hot.
HOT = 1024
#: Segments of an anchor that meet in one block.
SEGMENT_BLOCK = 256
_EMPTY = hashlib.sha256(b"").hexdigest()


class SuffixAutomaton:
    """Of several word sequences; accepts the substrings of each."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, steps: dict[str, int]) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: str) -> int:
        """The state for the words of ``p`` and ``word``, taken out of ``q`` if that holds longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[str]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, q, word)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, self.next[p][word], word)
            last = new

    def statistics(self, words: list[str]) -> list[int]:
        """Length of the longest accepted sequence that ends at each word."""
        state = length = 0
        out = []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            step = self.next[state].get(word)
            if step is not None:
                state = step
                length += 1
            else:
                length = 0
            out.append(length)
        return out


def run_keys(hashes: np.ndarray, run: int) -> np.ndarray:
    """A key of each run of words from the words' hashes."""
    key = np.full(max(0, len(hashes) - run + 1), run, np.uint64)
    for i in range(run):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(key) + i])
    return key


def leftmost_least(key: np.ndarray, width: int, step: int = STEP) -> np.ndarray:
    """Of each run of ``width`` keys, the place of the one with the least upper bits, the leftmost of equals.

    The lower 24 bits make room for the place, so the keys are taken in
    overlapping parts of ``step`` runs, whatever their number.
    """
    low = np.uint64((1 << 24) - 1)
    if step + width > 1 << 24:
        raise ValueError("a part must hold fewer than 2**24 keys")
    out = []
    for at in range(0, max(0, len(key) - width + 1), step):
        part = key[at : at + step + width - 1]
        least, have = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while have < width:
            more = min(have, width - have)
            least = np.minimum(least[: len(least) - more], least[more:])
            have += more
        out.append((least & low).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Words:
    """Words of a slice of texts with the anchors of their windows."""

    def __init__(self, texts: pa.Array, window: int, anchored: bool = True):
        flat, self.counts = split_words(texts)
        self.starts = starts_of(self.counts)
        spaced = pc.binary_join_element_wise(flat, "", " ") if len(flat) else pa.array([], pa.string())
        spaced = pa.concat_arrays([spaced])
        self.at = np.frombuffer(spaced.buffers()[1], np.int32, len(flat) + 1, spaced.offset * 4).astype(np.int64) if len(flat) else np.zeros(1, np.int64)
        self.data = memoryview(spaced.buffers()[2] or b"")
        if not anchored:
            return
        codes, distinct = encode_words(flat)
        h = pd.util.hash_array(np.array(distinct.to_pylist(), object), categorize=False)[codes] if len(codes) else np.zeros(0, np.uint64)
        run = min(RUN, window)
        n, width = len(h), window - run + 1
        self.low = self.high = self.row = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.int64)
        if n < window:
            return
        key = run_keys(h, run)
        pick = leftmost_least(key, width)  # by first word of the window
        row = np.repeat(np.arange(len(self.counts)), self.counts)
        at = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = (pick[at][1:] != pick[at][:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        self.low = at[first]
        self.high = at[np.append(first[1:], len(at)) - 1]
        self.row = row[self.low]
        self.anchor = key[pick[self.low]].view(np.int64)

    def joined(self, low: int, high: int) -> bytes:
        """Words low..high-1, parted by one space."""
        return bytes(self.data[self.at[low] : max(self.at[low], self.at[high] - 1)])


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def _profile(rows: DataFrame, window: int) -> DataFrame:
    """Of each row: its number of words, the SHA-256 of its words and its anchors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SHORT_SLICE_BYTES):
                w = Words(part.column("text"), window)
                sha = [hashlib.sha256(w.joined(a, b)).hexdigest() for a, b in zip(w.starts[:-1].tolist(), w.starts[1:].tolist(), strict=True)]
                ends = np.searchsorted(w.row, np.arange(len(w.counts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(w.anchor))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tk"), pa.array(w.counts), pa.array(sha), lists], ["id", "tk", "n_words", "sha", "anchors"])

    return rows.mapInArrow(work, "id long, tk long, n_words long, sha string, anchors array<long>")


def _segments(rows: DataFrame, window: int) -> DataFrame:
    """Stretches of windows whose anchor is in the row's list ``shared``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SHORT_SLICE_BYTES):
                w = Words(part.column("text"), window)
                lists = part.column("shared")
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                wanted = pd.MultiIndex.from_arrays([row, lists.flatten().to_numpy(zero_copy_only=False)])
                hit = np.flatnonzero(pd.MultiIndex.from_arrays([w.row, w.anchor]).isin(wanted)) if len(w.row) else np.zeros(0, np.int64)
                texts = [w.joined(a, b) for a, b in zip(w.low[hit].tolist(), (w.high[hit] + window).tolist(), strict=True)]
                of = w.row[hit]
                pick = pa.array(of)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pick), part.column("tk").take(pick), pa.array(w.anchor[hit]), pa.array((w.low[hit] - w.starts[of]).astype(np.int32)), pa.array((w.high[hit] - w.low[hit] + window).astype(np.int32)), pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "tk", "anchor", "start", "length", "digest", "words"])

    return rows.mapInArrow(work, "id long, tk long, anchor long, start int, length int, digest binary, words string")


def _second_anchors(words: list[str], anchor: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows of a segment by their smallest run that isn't the anchor: first window, last window and that run's key.

    Windows without another run than the anchor have the key of the anchor.
    """
    h = pd.util.hash_array(np.array(words, object), categorize=False)
    run = min(RUN, window)
    key = run_keys(h, run)
    ranked = np.where(key == np.array([anchor]).view(np.uint64)[0], np.uint64(0xFFFFFFFFFFFFFFFF), key)
    pick = leftmost_least(ranked, window - run + 1)
    first = np.flatnonzero(np.append(True, pick[1:] != pick[:-1]))
    return first, np.append(first[1:], len(pick)) - 1, key[pick[first]].view(np.int64)


def _cut_up(distinct: DataFrame, window: int) -> DataFrame:
    """Parts of distinct segments by their windows' second anchors, as far as several documents have them.

    anchor, digest, first and last are the segment's; ``key`` stands for the two
    anchors, ``at`` and ``run`` tell the words of the part, ``part`` is its digest.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "words", 1 << 20):
                rows, ats, runs, keys, texts = [], [], [], [], []
                for i, (text, anchor) in enumerate(zip(batch.column("words").to_pylist(), batch.column("anchor").to_pylist(), strict=True)):
                    words = text.split(" ")
                    for low, high, key in zip(*(x.tolist() for x in _second_anchors(words, anchor, window)), strict=True):
                        rows.append(i)
                        ats.append(low)
                        runs.append(high - low + window)
                        keys.append(key)
                        texts.append(" ".join(words[low : high + window]))
                pick = pa.array(rows, pa.int64())
                digests = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pick) for c in ("anchor", "digest", "first", "last")], pa.array(keys, pa.int64()), pa.array(ats, pa.int32()), pa.array(runs, pa.int32()), pa.array(digests, pa.binary()), pa.array(texts, pa.string())], ["anchor", "digest", "first", "last", "key", "at", "run", "part", "words"])

    cut = distinct.select("anchor", "digest", "first", "last", "words").mapInArrow(work, "anchor long, digest binary, first long, last long, key long, at int, run int, part binary, words string")
    cut = materialize(cut.withColumn("key", F.xxhash64("anchor", "key")), "second-anchors")  # equal keys of unlike pairs do no harm
    held = materialize(cut.groupBy("key").agg(F.min("first").alias("_a"), F.max("last").alias("_b")).where("_a < _b").select("key"), "shared-second-anchors")
    return cut.join(held, "key", "left_semi")


def _matches(distinct: DataFrame, window: int) -> DataFrame:
    """Of each distinct segment: the spans of words in windows that a segment of a smaller id holds too."""
    keys = ["anchor"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["anchor", "cell"]):
            ids = group.column("first").to_numpy(zero_copy_only=False)
            texts = group.column("words").to_pylist()
            order = np.argsort(ids, kind="stable").tolist()
            automaton = SuffixAutomaton()
            digests, starts, lengths, waiting = [], [], [], []
            before = None
            for i in order:
                if ids[i] != before:  # only smaller ids may match
                    for words in waiting:
                        automaton.add(words)
                    waiting, before = [], ids[i]
                words = texts[i].split(" ")
                found = np.flatnonzero(np.array(automaton.statistics(words)) >= window)
                if len(found) < len(words) - window + 1:
                    waiting.append(words)
                if len(found):
                    cuts = np.flatnonzero(np.diff(found) > 1)
                    low, high = found[np.append(0, cuts + 1)], found[np.append(cuts, len(found) - 1)]
                    digests += [group.column("digest")[i].as_py()] * len(low)
                    starts += (low - window + 1).tolist()
                    lengths += (high - low + window).tolist()
            if starts:
                yield pa.RecordBatch.from_arrays([pa.array([group.column("anchor")[0].as_py()] * len(starts), pa.int64()), pa.array(digests, pa.binary()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())], ["anchor", "digest", "at", "run"])

    return gather(deal(distinct, keys, "digest", SEGMENT_BLOCK), keys).mapInArrow(work, "anchor long, digest binary, at int, run int")


def _clean(rows: DataFrame) -> DataFrame:
    """Rows with spans to remove: the number of removed words, the SHA-256 and the text of the rest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SHORT_SLICE_BYTES):
                w = Words(part.column("text"), 1, anchored=False)
                removed, sha, texts = [], [], []
                for i, (spans, a, b) in enumerate(zip(part.column("spans").to_pylist(), w.starts[:-1].tolist(), w.starts[1:].tolist(), strict=True)):
                    cover = np.zeros(b - a + 1, np.int32)
                    for s in spans:
                        cover[s["start"]] += 1
                        cover[s["start"] + s["length"]] -= 1
                    gone = np.cumsum(cover[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
                    left = b" ".join(w.joined(a + x, a + y) for x, y in edges.reshape(-1, 2).tolist())
                    removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                    texts.append(left)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tk"), pa.array(removed, pa.int64()), pa.array(sha), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "tk", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(work, "id long, tk long, n_removed long, kept_sha256 string, kept string")


def _distinct(segments: DataFrame) -> DataFrame:
    """Segments that differ, with the smallest and the largest id that has each."""
    return segments.groupBy("anchor", "digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.first("words").alias("words"))


def repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", hot_from: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Two tables: the verdict on every input row, and the texts of the rows that lose a part.

    The first has ``id``, ``tk`` (hash of the text), ``n_words``, ``n_removed``
    and ``kept_sha256`` of what is left; the second ``id``, ``tk`` and ``kept``.
    Null texts and texts shorter than the window lose nothing; a row with a null
    id loses nothing and is no reference; rows that share an id are no reference
    for one another.  An empty table gives empty ones.
    """
    rows = _keyed(docs, id_column, text_column)
    profile = materialize(_profile(rows, window), "word-profiles")
    long = profile.where((F.col("n_words") >= window) & F.col("id").isNotNull())
    # whole copies are settled by the digest of all words
    firsts = materialize(long.groupBy("sha", "n_words").agg(F.min("id").alias("first")), "first-copies")
    leaders = long.join(firsts, ["sha", "n_words"]).where(F.col("id") == F.col("first"))
    anchored = leaders.select("id", "tk", F.explode(F.array_distinct("anchors")).alias("anchor"))
    shared = materialize(anchored.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor"), "shared-anchors")
    per_doc = anchored.join(shared, "anchor").groupBy("id", "tk").agg(F.collect_set("anchor").alias("shared"))
    touched = materialize(rows.join(per_doc, ["id", "tk"]).dropDuplicates(["id", "tk"]), "touched-texts")
    segments = materialize(_segments(touched, window), "segments")
    places = segments.select("id", "tk", "anchor", "digest", "start", "length")
    distinct = materialize(_distinct(segments), "distinct-segments")
    # narrow tables: broadcast if small, so that a hot anchor's segments stay where they are
    counts = materialize(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "anchor-counts")
    several = distinct.join(counts.where(F.col("_n") <= hot_from).select("anchor"), "anchor", "left_semi")
    matched = materialize(_matches(several.select("anchor", "digest", "first", "words"), window), "matches")
    hot = materialize(counts.where(F.col("_n") > hot_from).select("anchor"), "hot-anchors")
    if not hot.isEmpty():
        cut = materialize(_cut_up(distinct.join(hot, "anchor", "left_semi"), window), "hot-parts")
        parts = materialize(cut.groupBy("key", "part").agg(F.min("first").alias("first"), F.first("words").alias("words")), "distinct-parts")
        # parts of one key have the same second anchor, so they stand for segments of one anchor
        within = materialize(_matches(parts.select(F.col("key").alias("anchor"), F.col("part").alias("digest"), "first", "words"), window), "part-matches")
        whole = cut.drop("words", "last").join(parts.select("key", "part", F.col("first").alias("_first")), ["key", "part"]).where("_first < first")
        some = cut.select("anchor", "digest", "key", "part", F.col("at").alias("_at")).join(within.select(F.col("anchor").alias("key"), F.col("digest").alias("part"), "at", "run"), ["key", "part"])
        found = whole.select("anchor", "digest", "at", "run").unionByName(some.select("anchor", "digest", (F.col("_at") + F.col("at")).alias("at"), "run"))
        matched = matched.unionByName(materialize(found, "hot-matches"))
    later = places.join(distinct.where("first < last").select("anchor", "digest", "first"), ["anchor", "digest"]).where("id > first").select("id", "tk", "start", "length")
    inside = places.join(matched, ["anchor", "digest"]).select("id", "tk", (F.col("start") + F.col("at")).alias("start"), F.col("run").alias("length"))
    spans = later.unionByName(inside).distinct().groupBy("id", "tk").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    cleaned = materialize(_clean(touched.select("id", "tk", "text").join(spans, ["id", "tk"]).select("id", "tk", "text", "spans")), "cleaned-texts")
    told = profile.select("id", "tk", "n_words", "sha").join(firsts, ["sha", "n_words"], "left").join(cleaned.select("id", "tk", "n_removed", "kept_sha256"), ["id", "tk"], "left")
    copy = F.col("first") < F.col("id")
    verdicts = told.select("id", "tk", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
    return verdicts, cleaned.select("id", "tk", "kept")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the repeated words taken out of the texts, and ``n_words`` and ``n_removed``.

    Texts that lose nothing stay as they are; in others the words left are joined
    by one space.  Input columns named like the two new ones are replaced.  See
    ``repeats`` for nulls, short texts and repeated rows.
    """
    kept = docs.drop("n_words", "n_removed")
    verdicts, cleaned = repeats(kept, window, id_column, text_column)
    verdicts = verdicts.where("n_removed > 0").groupBy("id", "tk").agg(F.first("n_removed").alias("removed"), F.first("n_words").alias("_n_words"))
    changes = verdicts.join(cleaned, ["id", "tk"], "left").select(F.col("id").alias("_id"), F.col("tk").alias("_tk"), F.col("removed"), F.coalesce("kept", F.lit("")).alias("_kept"))
    row = F.struct(*[F.col(c) for c in kept.columns]).alias("row")
    packed = kept.select(row, F.col(id_column).cast("long").alias("_id"), F.xxhash64(F.col(text_column).cast("string")).alias("_tk"))
    out = packed.join(changes, ["_id", "_tk"], "left")
    text = F.when(F.col("removed") > 0, F.col("_kept")).otherwise(F.col("row")[text_column])
    n = F.size(F.filter(F.split(F.coalesce(F.col("row")[text_column], F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return out.select(*[text.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in kept.columns], n.cast("long").alias("n_words"), F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, _ = repeats(read_table(spark, sf_dir, "documents"))
    return verdicts.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k FROM docs, LATERAL (SELECT unnest(range(1, len(words) - 48)) AS i) r
), firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (k) WHERE first < doc_id
), single AS (
  SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM docs
), remaining AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM single ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN remaining USING (doc_id)
"""
