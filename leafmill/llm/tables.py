"""Tables of strings for workers: arrays of some 12 bytes a row beside its text, so that a million rows fit where Python's dictionaries do not."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 16


def _laid(column: pa.Array) -> tuple[array, bytes]:
    """Ends of the texts of a column, from 0, and the texts."""
    _, ends, text = column.buffers()
    return array("i", bytes(ends)[: 4 * (len(column) + 1)]), text.to_pybytes()[: ends and np.frombuffer(ends, np.int32)[len(column)]] if text else b""


class Table:
    """Texts by key, laid out by a hash of the key. A key may have several rows."""

    def __init__(self, keys: pa.Array, values: pa.Array):
        self.rows = n = len(keys)
        self.mask = (1 << n.bit_length()) - 1
        hashes = np.empty(n, np.int64)
        for k in range(0, n, _CHUNK):
            part = keys.slice(k, _CHUNK).cast(pa.binary()).to_pylist()
            hashes[k : k + _CHUNK] = np.fromiter(map(crc32, part), np.int64, len(part)) & self.mask
        order = pa.array(np.argsort(hashes, kind="stable"))
        self.starts = array("i", [0])
        self.starts.frombytes(np.cumsum(np.bincount(hashes, minlength=self.mask + 1)).astype(np.int32).tobytes())
        self.key_ends, self.keys = _laid(keys.cast(pa.binary()).take(order)) if n else (array("i", [0]), b"")
        self.value_ends, self.values = _laid(values.cast(pa.binary()).take(order)) if n else (array("i", [0]), b"")

    @classmethod
    def of(cls, rows: Iterable[tuple[str, str]]) -> Table:
        keys, values = zip(*rows) if (rows := list(rows)) else ((), ())
        return cls(pa.array(keys, pa.string()), pa.array(values, pa.string()))

    def _find(self, key: str) -> int:
        """The first row of a key, -1 without any."""
        k = key.encode("utf-8", "surrogatepass")
        h = crc32(k) & self.mask
        i, stop = self.starts[h], self.starts[h + 1]
        while i < stop:
            if self.keys[self.key_ends[i] : self.key_ends[i + 1]] == k:
                return i
            i += 1
        return -1

    def _value(self, i: int):
        return self.values[self.value_ends[i] : self.value_ends[i + 1]].decode()

    def all(self, key: str) -> list:
        k = key.encode("utf-8", "surrogatepass")
        h = crc32(k) & self.mask
        return [self._value(i) for i in range(self.starts[h], self.starts[h + 1]) if self.keys[self.key_ends[i] : self.key_ends[i + 1]] == k]

    def get(self, key: str, default=None):
        i = self._find(key)
        return default if i < 0 else self._value(i)

    def __contains__(self, key: str) -> bool:
        return self._find(key) >= 0

    def __getitem__(self, key: str):
        i = self._find(key)
        if i < 0:
            raise KeyError(key)
        return self._value(i)

    def __len__(self) -> int:
        return self.rows

    def __iter__(self) -> Iterator[str]:
        for i in range(self.rows):
            yield self.keys[self.key_ends[i] : self.key_ends[i + 1]].decode()

    def items(self) -> Iterator[tuple]:
        return ((key, self._value(i)) for i, key in enumerate(self))


class Counts(Table):
    """Numbers by word."""

    def _value(self, i: int) -> int:
        return int(self.values[self.value_ends[i] : self.value_ends[i + 1]])


class PairCounts(Counts):
    """Numbers by pair of words."""

    def _find(self, key: tuple[str, str]) -> int:
        return Table._find(self, "\t".join(key))


class Scores(Table):
    """Words with their scores by word."""

    def _value(self, i: int) -> list[tuple[str, float]]:
        text = self.values[self.value_ends[i] : self.value_ends[i + 1]].decode()
        return [(w, float(score)) for w, _, score in (x.rpartition("\t") for x in text.split("\n"))] if text else []
