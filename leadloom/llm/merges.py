"""Merge vocabularies compiled to deterministic transducers.

In a merge vocabulary the last piece of an encoded prefix is unique, and a piece
may follow another exactly when encoding the two together gives the two back.
So the encoder is a weighted transducer whose arcs are pieces, of weight 0 after
a piece that they fit and infinite otherwise, and the shortest path is the one of
finite weight.  Composed with that context and made deterministic it reads one
symbol at a time.  Its state is what is still open: the longest end of the text
that more symbols could turn into a piece, and, for each place in it where such
a piece could start, the last piece up to there and how many pieces there are
more or fewer than at the end.  A transition carries the change of the number of
pieces, and its state names the last piece, from which a path is read backwards.
States and transitions are compiled when first met and kept in two generations.
Units that are too long to be met again are read by their last pieces instead, in
time and memory that follow their length.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np

from .common import ranges, starts_of

#: Compiled transitions of a generation, and pair checks that a worker keeps.
KEEP, CHECKS = 200_000, 100_000
#: Symbols of the longest unit that the machine reads; longer ones hardly share states with others.
LONG = 32
#: A transition is a number: the next state, and the change of the count plus an offset; its key is a state and a symbol.
_BITS, _ZERO, _SYMBOL = 12, 2048, 21

Key = tuple[str, tuple[tuple[str, int] | None, ...]]


class Arcs:
    """Transitions as two arrays, found by hashing (open addressing); keys are not negative."""

    def __init__(self, size: int = 1 << 16):
        self.used = 0
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        bits = np.uint64(65 - len(self.keys).bit_length())
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> bits).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = self._slots(keys)
        met = self.keys[slot]
        out = np.where(met == keys, self.values[slot], -1)
        rest = np.flatnonzero((met != keys) & (met >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) % len(self.keys)
            met = self.keys[slot[rest]]
            same = met == keys[rest]
            out[rest[same]] = self.values[slot[rest[same]]]
            rest = rest[~same & (met >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New and distinct keys."""
        self.used += len(keys)
        if 2 * self.used > len(self.keys):
            full = self.keys >= 0
            keys, values = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values])
            size = len(self.keys)
            while 2 * self.used > size:
                size *= 2
            self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        slot, rest = self._slots(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] < 0]
            self.keys[slot[free]] = keys[free]  # of several for one slot, the last stays
            self.values[slot[free]] = values[free]
            rest = rest[self.keys[slot[rest]] != keys[rest]]
            slot[rest] = (slot[rest] + 1) % len(self.keys)


class _Compiled:
    """States and transitions of one generation.

    Of each state: its key, the number of its last piece, that one's length, and
    the state's number in the generation before (-1: none).
    """

    def __init__(self, before: _Compiled | None = None):
        self.before = before.ids if before else {}
        self.ids: dict[Key, int] = {}
        self.keys: list[Key] = []
        self.last = np.zeros((1 << 12, 3), np.int32)
        self.arcs = Arcs()
        self.state(("", (("", 0),)), 0, 0)  # 0: nothing read

    def state(self, key: Key, piece: int, length: int) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.keys)
            self.keys.append(key)
            if found == len(self.last):
                self.last = np.concatenate([self.last, np.zeros_like(self.last)])
            self.last[found] = piece, length, self.before.get(key, -1)
        return found


class MergeTransducer:
    """The machine of one vocabulary.

    pieces: the number of each.  rank: of the merge of two pieces, None if there
    is none; a lower rank merges first, the leftmost of equals first.
    """

    def __init__(self, pieces: dict[str, int], rank: Callable[[str, str], float | None], keep: int = KEEP):
        self.pieces, self.rank, self.keep = pieces, rank, keep
        openings = {piece[:i] for piece in pieces for i in range(len(piece))} | {""}
        # states share the strings and pairs that they are made of
        self.openings = dict(zip(openings, openings, strict=True))
        self.pairs: dict[tuple[str, int], tuple[str, int]] = {}
        if max(map(len, pieces), default=0) >= _ZERO:
            raise ValueError("a piece is too long")
        self.fits: dict[tuple[str, str], bool] = {}
        self.trees: dict[str, tuple[str, str, float] | None] = {}
        self.matcher: ahocorasick.Automaton | None = None
        self.young, self.old = _Compiled(), None

    def merge(self, unit: str) -> tuple[list[str], tuple[str, str, float] | None]:
        """Plain merging, as the definition has it, and the last merge made."""
        parts, last = list(unit), None
        ranks = [self.rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                return parts, last
            at = ranks.index(best)
            last = (parts[at], parts[at + 1], best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = self.rank(parts[at - 1], parts[at])
            if at < len(ranks):
                ranks[at] = self.rank(parts[at], parts[at + 1])

    def tree(self, piece: str) -> tuple[str, str, float] | None:
        """The two halves of the last merge that makes ``piece`` and its rank; None if merging doesn't make it."""
        found = self.trees.get(piece, 0)
        if found == 0:
            if len(self.trees) > CHECKS:
                self.trees.clear()
            parts, last = self.merge(piece)
            found = self.trees[piece] = (last or ("", "", float("-inf"))) if len(parts) == 1 else None
        return found

    def fit(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` leaves the two apart.

        Walks down the right edge of the left piece's merges and the left edge of
        the right piece's from the last merge to the first.  A merge across the
        border happens if its rank comes before the merges that use up either side.
        """
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > CHECKS:
                self.fits.clear()
            found = self.fits[left, right] = self._apart(left, right)
        return found

    def _apart(self, a: str, b: str) -> bool:
        used_a, used_b = float("inf"), float("inf")  # ranks of the merges that use the two up
        while True:
            across = self.rank(a, b)
            if across is not None and across < used_a and across <= used_b:
                return False
            left, right = self.tree(a), self.tree(b)
            if left[2] == right[2] == float("-inf"):
                return True
            if left[2] > right[2]:
                a, used_a = left[1], left[2]
            elif left[2] < right[2]:
                b, used_b = right[0], right[2]
            else:  # of equal ranks the left one merges first
                b, used_b = right[0], right[2]

    def advance(self, key: Key, symbol: str) -> tuple[Key, str, int]:
        """The state after one more symbol, its last piece and the change of the number of pieces."""
        pending, history = key
        text, size = pending + symbol, len(pending)
        for i, before in enumerate(history):  # the longest first; one only has a finite weight
            if before is None:
                continue
            piece = text[i:]
            if i == size and piece not in self.pieces or piece in self.pieces and self.tree(piece) is not None and (not before[0] or self.fit(before[0], piece)):
                break
        change = before[1] + 1
        at = 0
        while (still := self.openings.get(text[at:])) is None:
            at += 1
        kept = [self._pair(h[0], h[1] - change) if h is not None and text[i:] in self.openings else None for i, h in enumerate(history[at:], at)]
        return (still, (*kept, self._pair(piece, 0))), piece, change

    def _pair(self, piece: str, count: int) -> tuple[str, int]:
        pair = (piece, count)
        if len(self.pairs) > CHECKS:
            self.pairs.clear()
        return self.pairs.setdefault(pair, pair)

    def _compile(self, keys: np.ndarray) -> np.ndarray:
        """New transitions of the young generation, from the old one where it has them."""
        young, old = self.young, self.old
        states, symbols = keys >> _SYMBOL, keys & (1 << _SYMBOL) - 1
        known = np.full(len(keys), -1)
        if old is not None:
            was = young.last[states, 2].astype(np.int64)
            known = np.where(was >= 0, old.arcs.find(was << _SYMBOL | symbols), -1)
        out = np.zeros(len(keys), np.int64)
        for i, (state, symbol, arc) in enumerate(zip(states.tolist(), symbols.tolist(), known.tolist(), strict=True)):
            if arc >= 0:
                then, change = arc >> _BITS, (arc & (1 << _BITS) - 1) - _ZERO
                piece, length, _ = old.last[then]
                out[i] = young.state(old.keys[then], piece, length) << _BITS | change + _ZERO
            else:
                key, piece, change = self.advance(young.keys[state], chr(symbol))
                out[i] = young.state(key, self.pieces.get(piece, ~symbol), len(piece)) << _BITS | change + _ZERO
        return out

    def _step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The transitions of states on symbols."""
        keys = states << _SYMBOL | symbols
        found = self.young.arcs.find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh, which = np.unique(keys[missing], return_inverse=True)
            made = self._compile(fresh)
            self.young.arcs.add(fresh, made)
            found[missing] = made[which]
        return found

    def _walk(self, symbols: np.ndarray, lengths: np.ndarray, reached: np.ndarray | None) -> np.ndarray:
        """Number of pieces of each unit; ``reached`` takes the state after each symbol.

        Units of ``symbols`` lie one after the other and are walked side by side,
        a symbol of each at a time.
        """
        if self.young.arcs.used > self.keep:
            self.old, self.young = self.young, _Compiled(self.young)
            self.old.before = {}
        order = np.argsort(-lengths, kind="stable")
        start, length = starts_of(lengths)[:-1][order], lengths[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        k = 0
        while m := int(np.searchsorted(-length, -k)):  # units longer than k
            at = start[:m] + k
            arc = self._step(state[:m], symbols[at])
            state[:m] = arc >> _BITS
            total[:m] += (arc & (1 << _BITS) - 1) - _ZERO
            if reached is not None:
                reached[at] = state[:m]
            k += 1
        out = np.zeros(len(order), np.int64)
        out[order] = total
        return out

    def _long(self, unit: str, pieces: array | None = None, sizes: array | None = None) -> int:
        """Number of pieces of a long unit, which would only make states that nothing else meets.

        The last piece of each prefix is the longest of the pieces ending there
        that the last piece before it leaves apart, so one pass over the matches
        gives them; only those that a piece can reach back to are kept.
        ``pieces`` and ``sizes`` take the number and the length of each.
        """
        if self.matcher is None:
            self.matcher = ahocorasick.Automaton()
            for piece in self.pieces:
                self.matcher.add_word(piece, piece)
            self.matcher.make_automaton()
        get, fits, trees, widest = self.pieces.get, self.fits, self.trees, max(map(len, self.pieces), default=1)
        last, counts, first = [""], [0], 0  # of the prefixes from the length ``first`` on
        done = 0  # length of the prefix that is settled

        def settle(piece: str, size: int) -> None:
            nonlocal done, first
            done += 1
            last.append(piece)
            counts.append(counts[done - size - first] + 1)
            if pieces is not None:
                pieces.append(get(piece, ~ord(piece[-1])))
                sizes.append(size)
            if len(last) > 2 * widest + 4096:
                first += len(last) - widest
                del last[:-widest], counts[:-widest]

        for end, piece in self.matcher.iter(unit):  # the longest of each end first
            if end < done:
                continue
            while done < end:  # no piece ends there: the symbol stands alone
                settle(unit[done], 1)
            before = last[end + 1 - len(piece) - first]
            if (trees[piece] if piece in trees else self.tree(piece)) is None:
                continue
            if not before or (fits[before, piece] if (before, piece) in fits else self.fit(before, piece)):
                settle(piece, len(piece))
        while done < len(unit):
            settle(unit[done], 1)
        return counts[-1]

    def _groups(self, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """Units that the machine reads, as many at a time as keep its memory bounded."""
        short = np.flatnonzero(lengths <= LONG)
        group = np.cumsum(lengths[short]) // self.keep
        yield from np.split(short, np.flatnonzero(np.diff(group)) + 1)

    def counts(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of pieces of each unit."""
        starts, out = starts_of(lengths), np.zeros(len(lengths), np.int64)
        for group in self._groups(lengths):
            out[group] = self._walk(symbols[ranges(starts[group], lengths[group])].astype(np.int64), lengths[group], None)
        for i in np.flatnonzero(lengths > LONG).tolist():
            out[i] = self._long(_text(symbols[starts[i] : starts[i + 1]]))
        return out

    def paths(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of each unit, flat, and their number: the path of finite weight, read backwards.

        A symbol without a piece stands alone, as the complement of the symbol.
        """
        starts, counts = starts_of(lengths), np.zeros(len(lengths), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # units and their paths
        for group in self._groups(lengths):
            mine = lengths[group]
            reached = np.zeros(int(mine.sum()), np.int32)
            counts[group] = self._walk(symbols[ranges(starts[group], mine)].astype(np.int64), mine, reached)
            first, out = starts_of(mine), np.zeros(int(counts[group].sum()), np.int32)
            units, at, place = np.arange(len(group)), mine.astype(np.int64).copy(), np.cumsum(counts[group]) - 1
            units = units[at > 0]
            while len(units):
                piece, length, _ = self.young.last[reached[first[units] + at[units] - 1]].T
                out[place[units]] = piece
                place[units] -= 1
                at[units] -= length
                units = units[at[units] > 0]
            found.append((group, out))
        for i in np.flatnonzero(lengths > LONG).tolist():
            pieces, sizes = array("i"), array("I")
            counts[i] = self._long(_text(symbols[starts[i] : starts[i + 1]]), pieces, sizes)
            back, at = [], len(sizes)
            while at:
                back.append(pieces[at - 1])
                at -= sizes[at - 1]
            found.append((np.array([i]), np.array(back[::-1], np.int32)))
        ends = starts_of(counts)
        out = np.zeros(int(counts.sum()), np.int32)
        for units, path in found:
            out[ranges(ends[units], counts[units])] = path
        return out, counts


def _text(symbols: np.ndarray) -> str:
    return symbols.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
