"""Compressed FM-index over a shard of texts: a wavelet matrix over the Burrows-Wheeler transform.

Rows are sorted by their first ``window`` symbols only, which is all that patterns of that length need, so texts of one
repeated character cost no more than others. All operations take arrays: many streams move through the index together.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
#: Window starts that one stream covers; longer texts are streamed in parts.
STREAM = 1024


class BitVector:
    """Bits in 64-bit words with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank over a sequence of small integers."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.rows: list[tuple[int, BitVector, int]] = []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            ones = ((current >> level) & 1).astype(bool)
            self.rows.append((level, BitVector(ones), int(len(current) - ones.sum())))
            current = np.concatenate([current[~ones], current[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Position of ``at`` after all levels; differences of it count a symbol."""
        for level, bits, zeros in self.rows:
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Stable order of keys, their dense ranks, and whether all differ."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return order, rank, bool(rank[order[-1]] == len(key) - 1)


def sorted_rows(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by at least their first ``depth`` symbols, and which of them differ from the one before within ``depth - 1``.

    Ranks of prefixes are doubled from as many symbols as fit into one integer.
    """
    if depth < 2:
        raise ValueError("a window has at least two symbols")
    n, bits = len(symbols), max(1, int(symbols.max()).bit_length())
    width = max(1, min(62 // bits, depth - 1))
    padded = np.concatenate([symbols, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = key << bits | padded[j : j + n]
    order, rank, apart = _dense(key)
    near, near_width, all_near = rank, width, apart
    while width < depth and not apart:
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = rank[width:] + 1
        order, rank, apart = _dense(rank * (n + 1) + second)
        width *= 2
        if width <= depth - 1:
            near, near_width, all_near = rank, width, apart
    edge = np.ones(n, bool)
    if not all_near:
        later = np.concatenate([near[depth - 1 - near_width :], np.full(depth - 1 - near_width, -1)])
        a, b = order[:-1], order[1:]
        edge[1:] = (near[a] != near[b]) | (later[a] != later[b])
    return order, edge


class FMIndex:
    """FM-index of a list of code point arrays for patterns of ``window`` points; no pattern crosses the end of a text."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, window: int):
        self.window = window
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.lengths, self.length = lengths, int(self.starts[-1]) + 1
        points = np.zeros(self.length, np.uint32)
        for start, t in zip(self.starts, texts):
            points[start : start + len(t)] = t
        inside = np.ones(self.length, bool)
        inside[self.starts[1:] - 1] = False
        inside[-1] = False
        alphabet = np.unique(points[inside])
        symbols = np.ones(self.length, np.int64)  # 1 ends a text, 0 ends the whole
        symbols[inside] = np.searchsorted(alphabet, points[inside]) + 2
        symbols[-1] = 0
        self.symbols = symbols
        order, edge = sorted_rows(symbols, window)
        bwt = symbols[order - 1]
        sigma = len(alphabet) + 2
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=sigma))])
        self.matrix = WaveletMatrix(bwt, sigma)
        self.base = self.smaller[:-1] - self.matrix.rank(np.arange(sigma), np.zeros(sigma, np.int64))
        # Rows from which the first window - 1 symbols are others, and rows at which the owner changes.
        self.edges, self.edge_rows = BitVector(edge), np.concatenate([np.flatnonzero(edge), [self.length]])
        owner = np.concatenate([np.repeat(owners, lengths + 1), [-1]])[order]
        turn = np.concatenate([[True], owner[1:] != owner[:-1]])
        self.turns, self.turn_rows = BitVector(turn), np.concatenate([np.flatnonzero(turn), [self.length]])

    def extend(self, symbol: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """One step of backward search: the intervals of the patterns with a symbol put before; ``rows`` holds their two ends."""
        return self.base[symbol] + self.matrix.rank(symbol, rows)

    def shorten(self, rows: np.ndarray) -> np.ndarray:
        """The intervals of patterns of ``window`` symbols without their last symbol."""
        at = self.edges.rank(rows + np.array([[1], [0]]))
        return np.stack([self.edge_rows[at[0] - 1], self.edge_rows[at[1]]])

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the ``window`` symbols from every position of the texts, as low and high rows; -1 where a text ends before.

        Each text runs through the index from its end to its start: the match is extended by the symbol before and its length
        is kept at ``window`` by dropping the last one. A position's matching statistic reaches ``window`` if its interval
        holds a row of another owner.
        """
        low, high = np.full(self.length, -1, np.int64), np.full(self.length, -1, np.int64)
        first, last = [], []
        for start, n in zip(self.starts.tolist(), self.lengths.tolist()):
            for s in range(start, start + n - self.window + 1, STREAM):
                first.append(s)
                last.append(min(s + STREAM, start + n - self.window + 1) - 1)
        if not first:
            return low, high
        first, last = np.array(first), np.array(last)
        order = np.argsort(first - last, kind="stable")
        steps, top = (last - first)[order] + self.window, last[order] + self.window - 1
        rows = np.stack([np.zeros(len(top), np.int64), np.full(len(top), self.length, np.int64)])
        alive = len(top) - np.searchsorted(steps[::-1], np.arange(int(steps[0])), "right")
        for t, m in enumerate(alive.tolist()):
            rows = rows[:, :m]
            at = top[:m] - t
            if t >= self.window:
                rows = self.shorten(rows)
            rows = self.extend(self.symbols[at], rows)
            if t >= self.window - 1:
                low[at], high[at] = rows
        return low, high

    def foreign(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether intervals hold rows of more than one owner."""
        return self.turn_rows[self.turns.rank(low + 1)] < high


class Matches:
    """Windows of a shard's texts that texts of other owners hold too."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, window: int):
        index = FMIndex(texts, owners, window)
        low, high = index.stream()
        have = np.flatnonzero(low >= 0)
        self.at = have[index.foreign(low[have], high[have])]
        self.kind = low[self.at]  # equal windows have equal intervals
        self.text = np.searchsorted(index.starts, self.at, "right") - 1
        self.start = self.at - index.starts[self.text]
        self.window = window
        before = low[self.at - 1]
        before[self.start == 0] = -1
        self.before = before

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and end of the parts that windows of other owners cover."""
        if not len(self.at):
            none = np.empty(0, np.int64)
            return none, none, none
        new = np.concatenate([[True], (np.diff(self.text) != 0) | (np.diff(self.start) > self.window)])
        begin = np.flatnonzero(new)
        end = np.concatenate([begin[1:], [len(new)]]) - 1
        return self.text[begin], self.start[begin], self.start[end] + self.window

    def groups(self) -> list[np.ndarray]:
        """Texts that hold the same window, for windows that do not merely continue one window to the left.

        If all places of a window follow places of one other window, its texts are among those of the other.
        """
        if not len(self.at):
            return []
        order = np.argsort(self.kind, kind="stable")
        kind, before, text = self.kind[order], self.before[order], self.text[order]
        cut = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        most, least = np.maximum.reduceat(before, cut), np.minimum.reduceat(before, cut)
        found: dict[bytes, np.ndarray] = {}
        for i in np.flatnonzero((most != least) | (least < 0)):
            own = np.unique(text[cut[i] : cut[i + 1] if i + 1 < len(cut) else len(text)])
            found[own.tobytes()] = own
        return list(found.values())
