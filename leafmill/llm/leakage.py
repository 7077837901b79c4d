"""Passages of held-out items inside documents, by Wu-Manber multi-pattern search.

A text is its sequence of words (unbroken runs of letters or digits, case folded). The patterns
are all runs of ``run`` consecutive words of the items. The search moves a window of ``run``
words over a document: the last ``BLOCK`` words of the window select a shift; a shift above
zero skips positions at which no pattern can end; at zero the bucket of that suffix block lists
the patterns that end so, their first block is compared as a prefix filter, and then all words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
#: Words of a block of the shift table.
BLOCK = 3
#: Bytes of the tables of one pass over the documents, and at most so many for a character of items; more items take more passes.
TABLE_BYTES, CHAR_BYTES = 200_000_000, 25
ITEM_CHARS = TABLE_BYTES // CHAR_BYTES


def words(text: str | None) -> list[str]:
    """Case-folded words of a text; none for null."""
    return [w.casefold() for w in _WORD.findall(text)] if text else []


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of a hash and the numbers that follow."""
    h = (a ^ (b + np.uint64(0x9E3779B97F4A7C15) + (a << np.uint64(6)) + (a >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _blocks(ids: np.ndarray, block: int) -> np.ndarray:
    """Hash of the ``block`` numbers from each place on."""
    n = len(ids) - block + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(block if n > 0 else 0):
        h = _mix(h, ids[k : k + n].astype(np.uint64))
    return h


class WuManber:
    """Multi-pattern search over word sequences; patterns are all ``run``-word runs of the items.

    Words of items are numbered, and a pattern is the place where it starts in the row of all numbers, so a table takes some
    forty bytes a word of the items. Block hashes that meet can only shorten a shift or lengthen a bucket; numbers are compared.
    """

    def __init__(self, items: list[tuple[int, str | None]], run: int = 12, block: int = BLOCK):
        if not 1 <= block <= run:
            raise ValueError("a block must fit into a pattern")
        self.run, self.block = run, block
        self.number: dict[str, int] = {}
        ids, owners, starts, ends = [], [], [], []
        for item, text in items:
            w = words(text)
            if len(w) >= run:
                begin = len(ids)
                ids += [self.number.setdefault(x, len(self.number) + 1) for x in w]
                owners.append(item)
                starts.append(begin)
                ends.append(len(ids))
        self.ids = np.array(ids, np.int32)
        self.owners_of, self.starts = np.array(owners, np.int64), np.array(starts, np.int64)
        sizes = np.array(ends, np.int64) - self.starts
        begin, end = np.repeat(self.starts, sizes), np.repeat(np.array(ends, np.int64), sizes)
        place = np.arange(len(self.ids), dtype=np.int64)
        hashes = _blocks(self.ids, block)
        # A block that ends after word q of its item ends some pattern's first e words; the largest e gives the least shift.
        q = place[: len(hashes)] + block
        most = np.minimum(run, q - begin[: len(hashes)])
        inside = (q <= end[: len(hashes)]) & (most >= block) & (q - most + run <= end[: len(hashes)])
        order = np.lexsort((run - most[inside], hashes[inside]))
        keys = hashes[inside][order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        self.keys, self.shifts = keys[first], (run - most[inside])[order][first].astype(np.uint8 if run < 256 else np.int32)
        # Patterns in buckets of their last block, within a bucket by their first.
        at = place[place + run <= end]
        suffix, prefix = hashes[at + run - block], hashes[at]
        order = np.lexsort((prefix, suffix))
        self.suffixes, self.prefixes, self.patterns = suffix[order], prefix[order], at[order].astype(np.int64)

    def owners(self, text: str | None) -> set[int]:
        """Items of which the text holds a run."""
        found: set[int] = set()
        number = self.number.get
        ids = np.array([number(w, 0) for w in words(text)], np.int32)
        run, block, n = self.run, self.block, len(ids)
        if n < run or not len(self.keys):
            return found
        hashes = _blocks(ids, block)
        slot = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        shift = np.where(self.keys[slot] == hashes, self.shifts[slot], run - block + 1).tolist()
        at = run
        while at <= n:
            step = shift[at - block]
            if step:
                at += step
                continue
            suffix, prefix = hashes[at - block], hashes[at - run]
            low, high = np.searchsorted(self.suffixes, suffix, "left"), np.searchsorted(self.suffixes, suffix, "right")
            bucket = self.prefixes[low:high]
            for k in range(low + int(np.searchsorted(bucket, prefix, "left")), low + int(np.searchsorted(bucket, prefix, "right"))):
                start = int(self.patterns[k])
                if (self.ids[start : start + run] == ids[at - run : at]).all():
                    found.add(int(self.owners_of[np.searchsorted(self.starts, start, "right") - 1]))
            at += 1
        return found


def leaks(
    documents: DataFrame, items: DataFrame, run: int = 12, doc_id: str = "doc_id", item_id: str = "item_id",
    text: str = "text", item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """One row ``(doc_id, item_id)`` for each item of which a document holds ``run`` words in a row.

    The item set is the stated query set. It is searched in blocks of at most about
    ``item_chars`` characters, each one pass over the documents without a shuffle of texts; the
    documents themselves are never gathered. Null and short texts and items give no rows,
    repeated rows give one, an empty table on either side gives an empty result.
    """
    spark = documents.sparkSession
    schema = f"{doc_id} bigint, {item_id} bigint"
    source = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = source.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // item_chars))
    docs = documents.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    found: DataFrame | None = None
    for b in range(blocks):
        own = source.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else source
        machine = spark.sparkContext.broadcast(WuManber([(r.i, r.t) for r in own.collect()], run))

        def search(batches: Iterator[pa.RecordBatch], machine=machine) -> Iterator[pa.RecordBatch]:
            owners = machine.value.owners
            for batch in batches:
                pairs = [(d, i) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in owners(t)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], [doc_id, item_id]
                )

        part = docs.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def leak_report(leaked: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Number of documents that leak each item, 0 for clean ones."""
    counts = leaked.groupBy(item_id).agg(F.count("*").alias("documents"))
    return items.select(item_id).distinct().join(counts, item_id, "left").select(
        item_id, F.coalesce("documents", F.lit(0)).cast("long").alias("documents")
    )
