"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled to three parts.  The normaliser rewrites the longest
strings of its character map, drops or keeps extra white space, adds the dummy
prefix and writes white space as U+2581.  The pieces are arcs of a trie.  Byte
fallback gives a symbol without a piece a path of byte arcs.  A text is composed
with them, and the shortest path in the tropical semiring (min, +) is its
encoding.  In a unigram model an arc weighs minus its score; the path is found by
relaxing the arcs in the order of their starts.  In a merge model an arc weighs 0
after a piece that it fits and infinity otherwise; ``merges`` composes the arcs
with that context and makes them deterministic, so the one path of finite weight
is read off the states.

No piece holds white space after another character, so paths of different words
are independent: each distinct word of a slice is composed once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, code_points, flat_bytes, ranges, read_table, slices, starts_of
from .merges import MergeTransducer

SPACE = "▁"
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, MERGES = 1, 2
#: Words of a generation whose paths a worker keeps, for unigram models.
KEEP = 100_000
#: What an unknown symbol costs more than the worst piece, and what a user's piece lacks to the best.
UNKNOWN_COST, USER_COST = 10.0, 0.1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of one protocol buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


class Normaliser:
    """The rewriting of texts before pieces are sought."""

    def __init__(self, charsmap: bytes = b"", prefix: bool = True, collapse: bool = False):
        self.prefix, self.collapse = prefix, collapse
        self.map = character_map(charsmap) if charsmap else {}
        self.longest: dict[str, int] = {}  # by the first character
        for key in self.map:
            self.longest[key[0]] = max(self.longest.get(key[0], 0), len(key))

    def rewrite(self, text: str) -> str:
        """The character map applied from left to right, the longest string first."""
        out, at = [], 0
        while at < len(text):
            for size in range(min(self.longest.get(text[at], 0), len(text) - at), 0, -1):
                found = self.map.get(text[at : at + size])
                if found is not None:
                    out.append(found)
                    at += size
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def __call__(self, texts: pa.Array) -> pa.Array:
        if self.map:
            texts = pa.array([t if self.longest.keys().isdisjoint(t) else self.rewrite(t) for t in texts.to_pylist()], pa.string())
        if self.collapse:
            texts = pc.replace_substring_regex(pc.ascii_trim(texts, " "), " +", " ")
        full = pc.greater(pc.binary_length(texts), 0)
        texts = pc.replace_substring(texts, " ", SPACE)
        return pc.if_else(full, pc.binary_join_element_wise(SPACE, texts, ""), texts) if self.prefix else texts


def character_map(blob: bytes) -> dict[str, str]:
    """The strings of a compiled character map and what they become.

    The map is a double-array trie over bytes, with the size of its units in
    front and the zero-ended results behind; a unit holds a label in its low
    byte, a bit that it has a value and an offset to its children.
    """
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
    results = blob[4 + size :]
    out: dict[str, str] = {}
    stack = [(0, b"")]
    while stack:
        node, key = stack.pop()
        unit = units[node]
        children = node ^ ((unit >> 10) << ((unit & 0x200) >> 6))
        if unit >> 8 & 1:
            at = units[children] & 0x7FFFFFFF
            out[key.decode()] = results[at : results.index(b"\0", at)].decode()
        for label in range(1, 256):
            child = children ^ label
            if child < len(units) and units[child] & 0x800000FF == label:
                stack.append((child, key + bytes([label])))
    return out


class Model:
    """A compiled model file of the unigram or the merge kind."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.normalise = UNIGRAM, Normaliser(collapse=True)
        for number, value in message:
            if number == 1:
                fields = dict(_fields(value))
                self.pieces.append(fields.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0)
                self.kinds.append(fields.get(3, NORMAL))
            elif number == 2:
                fields = dict(_fields(value))
                self.type = fields.get(3, UNIGRAM)
                if fields.get(24):
                    raise ValueError("models that take white space as a suffix are not supported")
            elif number == 3:
                fields = dict(_fields(value))
                if not fields.get(5, 1):
                    raise ValueError("models that don't escape white space are not supported")
                self.normalise = Normaliser(fields.get(2, b""), bool(fields.get(3, 1)), bool(fields.get(4, 1)))
        if self.type not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and merge models are supported")
        if USER in self.kinds and (self.type == MERGES or self.normalise.map):
            raise ValueError("user-defined pieces in merge models, or with a character map, are not supported")
        if UNUSED in self.kinds and self.type == MERGES:
            raise ValueError("unused pieces in merge models are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.by_line = not any("\n" in p for p in self.ids)
        if self.type == UNIGRAM:
            real = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL] or [0.0]
            self.floor = UNKNOWN_COST - min(real)
            self.weights = {p: USER_COST - len(p) * max(real) if self.kinds[i] == USER else -self.scores[i] for p, i in self.ids.items()}
            self.openings = {p[:i] for p in self.ids for i in range(1, len(p) + 1)}
            self.known = Remembered(KEEP, np.int32, self._paths)
        text = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.text, self.text_starts = np.frombuffer(b"".join(text), np.uint8), starts_of(np.array([len(t) for t in text]))

    @cached_property
    def machine(self) -> MergeTransducer:
        """Of a merge model; decoding does without it."""

        def rank(a: str, b: str) -> float | None:
            i = self.ids.get(a + b)
            return None if i is None else -self.scores[i]

        return MergeTransducer(self.ids, rank)

    def shortest_path(self, unit: str) -> list[int]:
        """Arcs of the best path of a unigram model: piece ids, or the complement of a symbol without a piece.

        Of equal paths to a place, the one whose last arc starts first stays.
        """
        n = len(unit)
        best, arc = [0.0, *[float("inf")] * n], [(0, 0)] * (n + 1)
        for at in range(n):
            single = False
            for end in range(at + 1, n + 1):
                piece = unit[at:end]
                if piece not in self.openings:
                    break
                weight = self.weights.get(piece)
                if weight is not None:
                    single |= end == at + 1
                    if best[at] + weight < best[end]:
                        best[end], arc[end] = best[at] + weight, (at, self.ids[piece])
            if not single and best[at] + self.floor < best[at + 1]:
                best[at + 1], arc[at + 1] = best[at] + self.floor, (at, ~ord(unit[at]))
        out, at = [], n
        while at:
            at, i = arc[at]
            out.append(i)
        return out[::-1]

    def _paths(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self.shortest_path, units))
        return np.fromiter(chain.from_iterable(found), np.int32), np.array([len(f) for f in found], np.int64)

    def fall_back(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece as their bytes, or as the unknown piece in models without byte pieces."""
        at = np.flatnonzero(ids < 0)
        if not len(at):
            return ids, lengths
        if not self.bytes:
            return np.where(ids < 0, self.unknown, ids).astype(np.int32), lengths
        spelt = [[self.bytes[b] for b in chr(~i).encode()] for i in ids[at].tolist()]
        size = np.ones(len(ids), np.int64)
        size[at] = [len(x) for x in spelt]
        out = np.repeat(ids, size)
        out[ranges(starts_of(size)[at], size[at])] = np.fromiter(chain.from_iterable(spelt), np.int32)
        return out, np.diff(starts_of(size)[starts_of(lengths)])

    def units(self, texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
        """Independent units of the normalised texts, flat, and the number of each text's."""
        data, offsets = flat_bytes(self.normalise(texts))
        start = np.zeros(len(data) + 1, bool)
        if self.by_word and len(data) > 2:
            white = np.zeros(len(data), bool)
            white[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
            start[:-1] = white
            start[3:-1] &= ~white[:-3]
        if self.by_line:
            line = data == 10
            start[:-1] |= line
            start[1:] |= line
        start[offsets] = True
        at = np.flatnonzero(start[: len(data)])
        flat = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data))
        return flat, np.diff(np.searchsorted(at, offsets))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number of each text's (null: none)."""
        flat, units = self.units(pc.fill_null(texts.cast(pa.string()), ""))
        coded = flat.dictionary_encode()
        distinct, of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if self.type == MERGES:
            data, offsets = flat_bytes(distinct)
            symbols, lead = code_points(data)
            ids, lengths = self.machine.paths(symbols, np.diff(np.searchsorted(lead, offsets)))
        else:
            ids, lengths = self.known.take(distinct.to_pylist(), np.arange(len(distinct)))
        ids, lengths = self.fall_back(ids, lengths)
        ids, lengths = ids[ranges(starts_of(lengths)[of], lengths[of])], lengths[of]
        ends = starts_of(lengths)[starts_of(units)]
        if not self.bytes:  # unknown pieces side by side are one
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            again[ends[:-1][ends[:-1] < len(ids)]] = False
            ids, ends = ids[~again], ends - np.append(0, np.cumsum(again))[ends]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids: white space restored, that of the dummy prefix dropped, bytes joined to characters."""
        dropped = self.normalise.prefix or self.normalise.collapse
        ids = np.where((ids >= 0) & (ids < len(self.pieces)), ids, self.unknown)
        lengths = self.text_starts[ids + 1] - self.text_starts[ids]
        data = self.text[ranges(self.text_starts[ids], lengths)].tobytes()
        piece_ends = np.cumsum(lengths)
        ends = starts_of(lengths)[starts_of(counts)]
        spoken = np.array(self.kinds)[ids] != CONTROL
        at = starts_of(counts)
        out = []
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if dropped and b > a:
                first = at[k] + int(np.argmax(spoken[at[k] : at[k + 1]])) if not spoken[at[k]] else at[k]
                if self.kinds[ids[first]] in (NORMAL, USER, UNUSED) and data[a] == 32:
                    a += 1
            mute = ~spoken[at[k] : at[k + 1]]
            if mute.any():  # a control piece parts the bytes around it
                cuts = [max(a, x) for x in piece_ends[at[k] : at[k + 1]][mute].tolist()]
                out.append("".join(_lenient(data[x:y]) for x, y in zip([a, *cuts], [*cuts, b], strict=True)))
                continue
            try:
                out.append(data[a:b].decode())
            except UnicodeDecodeError:
                out.append(_lenient(data[a:b]))
        return out


def _lenient(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that starts no character."""
    out, at = [], 0
    while at < len(data):
        size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        try:
            out.append(data[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def _path(path: str | None) -> str:
    return path or public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: the id and ``ids``, the text's piece ids as array<int>.

    A null or empty text has no ids; a null row id stays null; repeated rows each
    get a row; other columns are left aside; an empty table gives an empty one.
    Characters without a piece become bytes, or the unknown id in models without
    byte pieces.  Strings of control pieces inside a text are ordinary text.
    """
    path = _path(path)
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                ids, counts = model(path).encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(starts_of(counts).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "ids"])

    kind = dict(narrow.dtypes)["id"]
    return narrow.mapInArrow(work, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str | None = None, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """One row per input row: the id, ``ids`` and ``decoded``, the text of the ids.

    Null or no ids give an empty text, null or foreign ids count as unknown;
    invalid byte runs give U+FFFD.
    """
    path = _path(path)
    narrow = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).cast("array<int>").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                lists = part.column("ids")
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array(model(path).decode(flat, counts), pa.string())], ["id", "ids", "decoded"])

    kind = dict(narrow.dtypes)["id"]
    return narrow.mapInArrow(work, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_column)


def op4_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the ids' number and the ids, and size and checksum of the text they decode to."""
    back = decode(encode(read_table(spark, sf_dir, "documents")))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.octet_length("decoded").cast("long").alias("decoded_bytes"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))
