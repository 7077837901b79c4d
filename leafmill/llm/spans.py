"""Long exact spans shared between records.

1. Exact copies are folded into one representative text each.
2. Every text leaves anchors: hashes of ``ANCHOR`` code points, picked so that each run of
   ``least`` points leaves an anchor that depends on the run alone. An anchor that two texts have
   in common is the only way to share a run, so texts without one leave the computation.
3. The stretches around common anchors go to shards by the smallest id that holds the anchor, so all
   holders of an anchor meet. For pairs a large set is cut into blocks, and each pair of blocks is a shard; the result is
   as large as that. For spans the windows of a large set are counted by their 128-bit hashes, which takes no pairs.
4. Each shard builds a compressed FM-index of its stretches and streams them through it backwards, the length
   of the match kept at ``least``; windows whose interval holds a row of another text are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.fm_index import Matches
from leafmill.llm.pairs import pairs_within
from leafmill.session import stage

#: Code points of an anchor; a shared run of ``least`` points must exceed it.
ANCHOR = 100
#: Code points that one hashing pass takes; longer texts are cut into overlapping pieces.
PIECE = 1_000_000
#: Code points of stretches in one block of a shard.
SHARD = 1_000_000

_FACTOR = 6364136223846793005  # odd, so it has an inverse modulo 2**64
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _FACTOR, np.uint64), np.full(n + 1, pow(_FACTOR, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(pieces: list[np.ndarray], least: int, anchor: int, powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen anchors of pieces of text: piece number, position in the piece, hash.

    Hashes of all ``anchor``-grams are computed at once over the joined pieces. In each window of
    ``least - anchor + 1`` grams the smallest hash is chosen; among equal ones of a window one is
    kept, which leaves the value, and so the guarantee, unchanged.
    """
    width = least - anchor + 1
    lengths = np.array([len(p) for p in pieces], np.int64)
    joined = np.concatenate(pieces).astype(np.uint64) + np.uint64(1)
    n = len(joined)
    if n < least:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = powers
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(joined * down[:n], out=sums[1:])
    h = (sums[anchor:] - sums[:-anchor]) * up[: n - anchor + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    low = _sliding(h, width, np.minimum)
    valid = np.zeros(len(low), bool)
    for s, e in zip(starts[:-1], starts[1:]):
        if e - s >= least:
            valid[s : e - least + 1] = True
    low[~valid] = _NEVER
    padded = np.full(len(h) + width - 1, _NEVER, np.uint64)
    padded[width - 1 : width - 1 + len(low)] = low
    # A gram is chosen if some valid window around it has it as its minimum; no minimum of a window
    # around it is larger unless the window is not valid, and those are taken as zero here.
    padded[padded == _NEVER] = 0
    chosen = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
    piece = np.searchsorted(starts, chosen, "right") - 1
    value = h[chosen]
    keep = np.ones(len(chosen), bool)
    tied = np.flatnonzero((value[1:] == value[:-1]) & (piece[1:] == piece[:-1]) & (np.diff(chosen) < width))
    if len(tied):
        last = {}
        for i in np.unique(np.concatenate([tied, tied + 1])).tolist():
            v, at = (int(value[i]), int(piece[i])), int(chosen[i])
            more = i + 1 < len(chosen) and value[i + 1] == value[i] and piece[i + 1] == piece[i]
            if v in last and more and int(chosen[i + 1]) - last[v] < width:
                keep[i] = False
            else:
                last[v] = at
    chosen, piece, value = chosen[keep], piece[keep], value[keep]
    return piece, chosen - starts[piece], value


def _anchor_batches(least: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = PIECE + least
        powers = _powers(2 * size)

        def flush(pieces, ids, offsets) -> pa.RecordBatch:
            piece, at, value = anchors(pieces, least, anchor, powers)
            ids, offsets = np.array(ids, np.int64), np.array(offsets, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(ids[piece]), pa.array(offsets[piece] + at)], ["anchor", "id", "at"]
            )

        for batch in batches:
            pieces, ids, offsets, total = [], [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                if len(t) < least:
                    continue
                points = _points(t)
                step = size - least + 1
                for s in range(0, len(points) - least + 1, step):
                    part = points[s : s + size]
                    if total + len(part) > size and pieces:
                        yield flush(pieces, ids, offsets)
                        pieces, ids, offsets, total = [], [], [], 0
                    pieces.append(part)
                    ids.append(i)
                    offsets.append(s)
                    total += len(part)
            if pieces:
                yield flush(pieces, ids, offsets)

    return run


def _stretches(least: int, anchor: int):
    """Parts of texts around common anchors, one row for each joined stretch and set of texts."""
    reach = least - anchor

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for doc, text, hits in zip(frame["id"], frame["text"], frame["hits"]):
                by: dict[int, list[int]] = {}
                for hit in hits:
                    by.setdefault(hit["lead"], []).append(hit["at"])
                for lead, places in by.items():
                    spans: list[list[int]] = []
                    for at in sorted(places):
                        a, b = max(0, at - reach), min(len(text), at + anchor + reach)
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                    rows += [(lead, doc, a, text[a:b]) for a, b in spans]
            yield pd.DataFrame(rows, columns=["lead", "id", "start", "part"])

    return run


def _in_shards(search, names: list[str], kinds: list[pa.DataType]):
    """Runs ``search(ids, starts, sides, texts)`` over whole shards, small ones together, and gives its columns."""

    def done(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
        ids, starts, sides = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        columns = search(ids, starts, sides, [_points(r[3]) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, str]] = []
        total, shard = 0, None
        for batch in batches:
            shards, ids, starts, sides = (batch.column(k).to_pylist() for k in range(4))
            for key, *row, part in zip(shards, ids, starts, sides, batch.column(4)):
                if key != shard and total >= SHARD // 2:
                    yield done(rows)
                    rows, total = [], 0
                shard, text = key, part.as_py()
                rows.append((*row, text))
                total += len(text)
        if rows:
            yield done(rows)

    return run


def _pairs_in_shard(least: int):
    def search(ids, starts, sides, texts):
        """Pairs of ids whose texts share a window; in a shard of two blocks only those of both blocks."""
        a, b = [], []
        for group in Matches(texts, ids, least).groups():
            x, y = np.triu_indices(len(group), 1)
            x, y = group[x], group[y]
            keep = (ids[x] != ids[y]) & ((sides[x] != sides[y]) | (sides[x] == 0))
            pairs = np.unique(np.stack([np.minimum(ids[x], ids[y])[keep], np.maximum(ids[x], ids[y])[keep]]), axis=1)
            a.append(pairs[0])
            b.append(pairs[1])
        return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))

    return search


def _spans_in_shard(least: int):
    def search(ids, starts, sides, texts):
        text, start, end = Matches(texts, ids, least).spans()
        return ids[text], starts[text] + start, starts[text] + end

    return search


def copies(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, rep)``: every member of a group of equal texts with the smallest id of the group."""
    keyed = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("member"), F.unhex(F.md5(text)).alias("h"), F.length(text).alias("n")
    ).distinct()
    groups = keyed.groupBy("h", "n").agg(F.min("member").alias("rep"), F.count("*").alias("c")).where("c > 1")
    return keyed.join(groups.select("h", "n", "rep"), ["h", "n"]).select("member", "rep", "n")


def _parts(documents: DataFrame, members: DataFrame, least: int, anchor: int, doc_id: str, text: str) -> DataFrame:
    """``(lead, id, start, part, blocks)``: stretches of representatives around anchors that another one holds too.

    A text shares a window with another only if both have a stretch with it of the same ``lead``. ``blocks`` is how
    many shards the stretches of a lead would fill.
    """
    if not 0 < anchor < least:
        raise ValueError("an anchor must be shorter than a run")
    texts = documents.where(F.col(doc_id).isNotNull() & (F.length(text) >= least)).select(
        F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")
    )
    texts = texts.join(members.where("member <> rep").select(F.col("member").alias("id")), "id", "left_anti")
    found = stage(texts.mapInArrow(_anchor_batches(least, anchor), "anchor bigint, id bigint, at bigint"), "anchors")
    # The smallest and greatest holder combine map-side; no group is gathered.
    shared = found.groupBy("anchor").agg(F.min("id").alias("lead"), F.max("id").alias("hi")).where("lead < hi").select("anchor", "lead")
    hits = stage(found.join(shared, "anchor").select("id", "lead", "at").distinct(), "hits")
    sizes = hits.groupBy("lead", "id").agg(F.count("*").alias("c")).groupBy("lead").agg((F.sum("c") * F.lit(anchor) + 2 * F.count("*") * F.lit(least)).alias("points"))
    sizes = sizes.select("lead", F.ceil(F.col("points") / F.lit(SHARD)).cast("int").alias("blocks"))
    per_text = hits.groupBy("id").agg(F.collect_list(F.struct("lead", "at")).alias("hits"))
    parts = per_text.join(texts, "id").select("id", "text", "hits").mapInPandas(
        _stretches(least, anchor), "lead bigint, id bigint, start bigint, part string"
    )
    return parts.join(sizes, "lead")


def _shards(parts: DataFrame) -> DataFrame:
    """``(shard, id, start, side, part)``: a shard for each set of texts, or for each pair of blocks of a large one.

    ``side`` is 0 in a shard of one block, 1 and 2 in one of two.
    """
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = (
        parts.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("lead", F.least("block", "other"), F.greatest("block", "other")).alias("shard"), "id", "start",
            F.when((F.col("block") == F.col("other")), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).cast("long").alias("side"), "part",
        )
    )
    return spread.repartition("shard").sortWithinPartitions("shard")


def _window_hashes(least: int):
    """``(h1, h2, id, s)`` of every window of ``least`` points of stretches ``(id, start, part)``."""
    factors = (_FACTOR, 0xD1342543DE82EF95)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, start, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                points = _points(part.as_py()).astype(np.uint64) + np.uint64(1)
                n = len(points) - least + 1
                if n < 1:
                    continue
                hashes = []
                for f in factors:
                    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), f, np.uint64)]))
                    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), pow(f, -1, 2**64), np.uint64)]))
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(points * down[:-1])])
                    h = (sums[least:] - sums[:-least]) * up[:n]
                    h ^= h >> np.uint64(32)
                    h *= np.uint64(0x9E3779B97F4A7C15)
                    hashes.append((h ^ (h >> np.uint64(29))).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[0]), pa.array(hashes[1]), pa.array(np.full(n, i, np.int64)), pa.array(np.arange(start, start + n, dtype=np.int64))], ["h1", "h2", "id", "s"]
                )

    return run


#: Parts into which the rows of one window are dealt when they are looked up.
SALTS = 32


def _large_spans(parts: DataFrame, least: int) -> DataFrame:
    """``(id, s, e)`` of windows that texts of different ids hold, for sets of any size: counted map-side, looked up in salted parts."""
    windows = stage(parts.select("id", "start", "part").mapInArrow(_window_hashes(least), "h1 bigint, h2 bigint, id bigint, s bigint"), "windows")
    shared = windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    salted = shared.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = windows.withColumn("salt", F.pmod(F.xxhash64("id", "s"), F.lit(SALTS)).cast("int"))
    return own.join(salted, ["h1", "h2", "salt"], "left_semi").select("id", "s", (F.col("s") + least).alias("e"))


def shared_pairs(documents: DataFrame, least: int = 300, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id_a, doc_id_b)`` of all records that share a run of ``least`` code points.

    Pairs of representatives are expanded to the members of their groups of equal texts, and the
    members of one group are paired, as each such pair shares its whole text. Null, empty and
    shorter texts share nothing; repeated rows count once.
    """
    members = stage(copies(documents, doc_id, text), "copies")
    shards = _shards(_parts(documents, members, least, ANCHOR, doc_id, text))
    found = _in_shards(_pairs_in_shard(least), ["id_a", "id_b"], [pa.int64(), pa.int64()])
    pairs = shards.mapInArrow(found, "id_a bigint, id_b bigint").distinct()
    m = members.select("member", "rep")
    a = pairs.join(m.toDF("m_a", "id_a"), "id_a", "left").select(F.coalesce("m_a", "id_a").alias("a"), "id_b")
    b = a.join(m.toDF("m_b", "id_b"), "id_b", "left").select("a", F.coalesce("m_b", "id_b").alias("b"))
    within = pairs_within(members.where(F.col("n") >= least).select("rep", F.col("member").alias("id")), "rep")
    both = b.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(within.select("a", "b"))
    return both.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b")).distinct()


def shared_spans(documents: DataFrame, least: int = 300, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``(doc_id, n_chars, span_count, shared_chars, shared_share)`` per record with a text.

    ``shared_chars`` is the number of code points inside runs of ``least`` or more that also occur in
    another record; a copy of another record of that length is shared as a whole. Empty texts share 0.
    """
    members = stage(copies(documents, doc_id, text), "copies")
    parts = stage(_parts(documents, members, least, ANCHOR, doc_id, text), "parts")
    found = _in_shards(_spans_in_shard(least), ["id", "s", "e"], [pa.int64()] * 3)
    runs = _shards(parts.where("blocks = 1")).mapInArrow(found, "id bigint, s bigint, e bigint")
    runs = runs.unionByName(_large_spans(parts.where("blocks > 1"), least))
    # One span per start keeps a text's list within its own length, whatever the number of partners.
    spans = stage(runs.groupBy("id", "s").agg(F.max("e").alias("e")), "spans")
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct("s", "e"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c"), F.lit(-1).cast("long").alias("end")),
        lambda x, y: F.struct(
            (x["n"] + F.when(y["s"] > x["end"], 1).otherwise(0)).alias("n"),
            (x["c"] + F.greatest(y["e"] - F.greatest(y["s"], x["end"]), F.lit(0))).alias("c"),
            F.greatest(x["end"], y["e"]).alias("end"),
        ),
    )
    cover = spans.groupBy("id").agg(joined.alias("x")).select("id", F.col("x.n").alias("spans"), F.col("x.c").alias("chars"))
    base = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars")
    ).distinct()
    whole = members.select(F.col("member").alias("doc_id"), "rep")
    j = base.join(whole, "doc_id", "left").withColumn("id", F.coalesce("rep", "doc_id")).join(cover, "id", "left")
    is_copy = F.col("rep").isNotNull() & (F.col("n_chars") >= least)
    chars = F.when(is_copy, F.col("n_chars")).otherwise(F.coalesce("chars", F.lit(0))).cast("long")
    return j.select(
        "doc_id",
        "n_chars",
        F.when(is_copy, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("span_count"),
        chars.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, chars / F.col("n_chars")).otherwise(0.0).alias("shared_share"),
    )
