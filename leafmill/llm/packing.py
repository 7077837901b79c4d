"""Filling containers of fixed capacity with texts measured in tokens.

Histogram pattern packing: lengths are counted in bins; patterns are multisets of bins that fill a container; non-negative
least squares fits how often each pattern is used to the histogram, with the unused room of all patterns as one
more row that is to be zero. There are too many patterns of many texts to list them, so the one that improves the fit most is found
by a knapsack over the bins whenever the fit needs another. Counts are rounded, each pattern is filled with texts of its bins,
the last of them the longest that still fits, and what rounding left is packed best-fit over counts. The plan has one row for
each kind of container filling, so its size depends on the capacity and not on the number of texts. Texts get their
container by rank within their length.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import stage

TOKENIZER_DIR = os.environ.get("LEAFMILL_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bins of lengths for the fit, weight of a container of unused room in it, and most patterns tried.
BINS, UNUSED, ROUNDS = 128, 1.0, 600
#: Least number of salts of the ranking, and rows of a salt.
SALTS, SALT_ROWS = 64, 1_000_000
#: Rows of a plan that are broadcast; a longer one is joined by a shuffle.
PLAN_ROWS = 200_000
#: Characters encoded at once; a longer text is cut before a space.
ENCODE_CHARS = 200_000

_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _pieces(text: str) -> Iterator[str]:
    """Parts whose token counts add up to the text's: cuts lie before a space that follows a letter."""
    at = 0
    while len(text) - at > ENCODE_CHARS:
        cut = text.rfind(" ", at + 1, at + ENCODE_CHARS)
        while cut > at and not (text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            cut = at + ENCODE_CHARS
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, tokens)`` per document; a null text has 0 tokens, a repeated id its longest text."""
    path = tokenizer or f"{TOKENIZER_DIR}/{TOKENIZER}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            n = [sum(len(encode(p)) for p in _pieces(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    rows = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, "doc_id bigint, tokens bigint")
    return counted.groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def best_pattern(gain: np.ndarray, unused: float) -> tuple[float, np.ndarray]:
    """Greatest sum of gains of a multiset of bins that fills a container, ``unused`` counting for each empty unit.

    ``gain[k]`` belongs to the bin of ``k + 1`` units, of which a container has as many as there are bins. Returns the
    sum and how often each bin is taken, the empty units last.
    """
    bins = len(gain)
    best, taken = np.zeros(bins + 1), np.zeros(bins + 1, np.int64)
    for room in range(1, bins + 1):
        value = best[room - 1 :: -1] + gain[:room]
        k = int(np.argmax(value))
        empty = best[room - 1] + unused
        best[room], taken[room] = (value[k], k + 1) if value[k] > empty else (empty, 0)
    counts, room = np.zeros(bins + 1), bins
    while room:
        k = int(taken[room])
        counts[k - 1 if k else bins] += 1
        room -= k or 1
    return float(best[bins]), counts


def fit(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns as columns (bins, then empty units) and how often each is used to take up a histogram of bins.

    Non-negative least squares by the active set method; the pattern of the steepest descent among all patterns enters.
    """
    bins = len(histogram)
    scale = max(1.0, float(histogram.sum()))
    goal = np.concatenate([histogram / scale, [0.0]])
    weight = np.ones(bins + 1)
    weight[bins] = UNUSED / bins
    patterns, x = np.zeros((bins + 1, 0)), np.zeros(0)
    absent = np.where(histogram > 0, 0.0, -np.inf)
    for _ in range(ROUNDS):
        a = patterns * weight[:, None]
        rest = goal - a @ x
        value, pattern = best_pattern(rest[:bins] + absent, float(rest[bins]) * weight[bins])
        if value <= 1e-7 or (patterns == pattern[:, None]).all(axis=0).any():
            break
        patterns, x = np.column_stack([patterns, pattern]), np.append(x, 0.0)
        while patterns.shape[1]:
            a = patterns * weight[:, None]
            g = a.T @ a
            z = np.linalg.solve(g + 1e-10 * np.trace(g) / len(g) * np.eye(len(g)), a.T @ goal)
            low = z <= 1e-12
            if not low.any():
                x = z
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = np.maximum(x + step * (z - x), 0)
            stay = ~((x <= 1e-12) & low)
            if stay.all():
                stay[np.argmin(x)] = False
            patterns, x = patterns[:, stay], x[stay]
    return patterns, x * scale


def plan(histogram: dict[int, int], capacity: int, bins: int = BINS) -> list[tuple[dict[int, int], int, bool]]:
    """Container fillings ``({length: how many}, repeats, fitted)`` that take up the histogram exactly.

    Lengths are 1 to ``capacity``. Every text of the histogram is in exactly one container. ``fitted`` tells the
    containers of fitted patterns from those of the residuals.
    """
    if any(c > 0 and not 1 <= n <= capacity for n, c in histogram.items()):
        raise ValueError("lengths must lie between 1 and the capacity")
    left = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        left[n] = max(0, c)
    bins = min(bins, capacity)
    out: list[tuple[dict[int, int], int, bool]] = []

    def take(filling: Counter, repeats: int, fitted: bool) -> int:
        """Uses a filling as often as its gap can be filled alike, at most ``repeats`` times."""
        lengths, each = np.array(list(filling), np.int64), np.array(list(filling.values()), np.int64)
        while True:
            left[lengths] -= each * repeats
            room, added = capacity - int((lengths * each).sum()), Counter()
            while room > 0 and len(enough := np.flatnonzero(left[: room + 1] >= repeats)):
                n = int(enough[-1])
                k = int(min(room // n, left[n] // repeats))
                added[n] += k
                left[n] -= k * repeats
                room -= k * n
            if repeats == 1 or not left[: room + 1].any():
                break
            for n, k in added.items():  # a shorter text is left, but too few for all repeats
                left[n] += k * repeats
            left[lengths] += each * repeats
            repeats //= 2
        out.append((dict(filling + added), repeats, fitted))
        return repeats

    in_bin = np.clip(np.rint(np.arange(capacity + 1) * bins / capacity), 1, bins).astype(np.int64)
    patterns, times = fit(np.bincount(in_bin[1:] - 1, weights=left[1:], minlength=bins))
    lengths_of = {b: np.flatnonzero(in_bin[1:] == b) + 1 for b in range(1, bins + 1)}

    def filled(pattern: list[int]) -> Counter:
        """The most frequent lengths of a pattern's bins but the last, which ``take`` finds."""
        filling, room = Counter(), capacity
        for b in pattern[:-1] if len(pattern) > 1 else pattern:
            lengths = lengths_of[b]
            share = left[lengths] // np.array([filling[n] + 1 for n in lengths.tolist()])
            share[lengths > room] = 0
            if not share.any():
                return Counter()
            n = int(lengths[np.argmax(share)])
            filling[n] += 1
            room -= n
        return filling

    held = patterns[:bins].astype(int)
    for j in sorted(range(held.shape[1]), key=lambda j: -max(np.flatnonzero(held[:, j]), default=0)):
        pattern = [b + 1 for b in range(bins - 1, -1, -1) for _ in range(held[b, j])]
        todo = int(times[j] + 0.5)
        while todo > 0 and (filling := filled(pattern)):
            todo -= take(filling, min([todo, *(int(left[n]) // k for n, k in filling.items())]), True)
    while len(rest := np.flatnonzero(left)):  # what rounding left
        n = int(rest[-1])
        take(Counter({n: 1}), int(left[n]), False)
    return out


def pack(lengths: DataFrame, kinds: dict[str, int], bins: int = BINS) -> DataFrame:
    """``(container_kind, container_id, doc_id, part, tokens, from_token)``: every text placed for each kind.

    ``lengths`` is ``(doc_id, tokens)`` with unique ids. A text of more tokens than the capacity is cut
    into full containers (part 0, 1, ...) and a remainder that is packed like a text; no other text is
    split. A text without tokens takes no room and goes to container 0. Container ids are dense from 0
    for each kind. No kinds or no texts give no rows.
    """
    spark = lengths.sparkSession
    schema = "container_kind string, container_id bigint, doc_id bigint, part bigint, tokens bigint, from_token bigint"
    kinds = {k: int(c) for k, c in kinds.items() if k is not None and c is not None and c > 0}
    if not kinds:
        return spark.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in kinds.items()]))
    lengths = stage(lengths.select("doc_id", "tokens"), "lengths")
    counts = lengths.groupBy("tokens").agg(F.count("*").alias("c"))
    # Remainders are shorter than a capacity, so the histogram has at most that many rows for a kind.
    sized = counts.select("tokens", "c", each.alias("k")).select("tokens", "c", "k.*").select(
        "container_kind", F.expr("tokens % capacity").alias("rest"), F.expr("tokens div capacity").alias("full"), "c"
    )
    histogram = sized.groupBy("container_kind", "rest").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("full")).alias("full")).collect()
    slots, first_full = [], {}
    for kind, capacity in kinds.items():
        rows = {r.rest: r.c for r in histogram if r.container_kind == kind and r.rest}
        made, place = 0, Counter()
        for filling, repeats, _ in plan(rows, capacity, bins):
            for n, k in filling.items():
                slots.append((kind, n, place[n], place[n] + k * repeats, k, made))
                place[n] += k * repeats
            made += repeats
        first_full[kind] = made
    salts = max(SALTS, -(-sum(r.c for r in histogram) // (SALT_ROWS * len(kinds))))
    plan_rows = spark.createDataFrame(
        slots, "container_kind string, rest bigint, from_rank bigint, to_rank bigint, uses bigint, first bigint"
    )
    by_length = plan_rows.groupBy("container_kind", "rest").agg(F.array_sort(F.collect_list(F.struct("from_rank", "uses", "first"))).alias("slots"))
    if len(slots) <= PLAN_ROWS:
        by_length = F.broadcast(by_length)
    bases = F.broadcast(spark.createDataFrame(list(first_full.items()), "container_kind string, full_from bigint"))
    parts = lengths.select("doc_id", "tokens", each.alias("k")).select("doc_id", "tokens", "k.*").select(
        "container_kind", "doc_id", "tokens", "capacity", F.expr("tokens % capacity").alias("rest"), F.expr("tokens div capacity").alias("full"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
    )
    rest = _ranked(parts.where("rest > 0"), ["container_kind", "rest"])
    slot = F.element_at("slots", F.size(F.filter("slots", lambda x: x["from_rank"] <= F.col("rank"))))
    placed = rest.join(by_length, ["container_kind", "rest"]).withColumn("slot", slot).select("*", "slot.*")
    packed = placed.select(
        "container_kind", F.expr("first + (rank - from_rank) div uses").alias("container_id"), "doc_id", F.col("full").alias("part"),
        F.col("rest").alias("tokens"), F.expr("full * capacity").alias("from_token"),
    )
    long = _ranked(parts.where("full > 0"), ["container_kind"], F.col("full")).join(bases, "container_kind")
    cut = long.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("full") - 1))).select(
        "container_kind", F.expr("full_from + rank + part").alias("container_id"), "doc_id", "part", F.col("capacity").alias("tokens"),
        F.expr("part * capacity").alias("from_token"),
    )
    empty = parts.where("tokens = 0").select(
        "container_kind", F.lit(0).cast("long").alias("container_id"), "doc_id", F.lit(0).cast("long").alias("part"), "tokens", F.lit(0).cast("long").alias("from_token")
    )
    return packed.unionByName(cut).unionByName(empty)


def _ranked(rows: DataFrame, keys: list[str], weight=None) -> DataFrame:
    """Adds ``rank``: the sum of weights of rows before a row of its group, from 0, in any fixed order.

    Groups are salted, so a length that a third of all texts have is ranked by many tasks.
    """
    weight = F.lit(1) if weight is None else weight
    rows = rows.withColumn("w", weight.cast("long"))
    sums = rows.groupBy(*keys, "salt").agg(F.sum("w").alias("total"))
    before = Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    inner = Window.partitionBy(*keys, "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("w").over(inner), F.lit(0)))
        .join(offsets, [*keys, "salt"])
        .withColumn("rank", F.col("offset") + F.col("inside"))
        .drop("offset", "inside", "w")
    )


def container_kinds(specs: DataFrame) -> dict[str, int]:
    """Kinds and capacities; the specification table has a handful of rows, checked here."""
    rows = specs.select("container_kind", "capacity_tokens").where("container_kind IS NOT NULL AND capacity_tokens > 0").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 container kinds")
    return {r.container_kind: r.capacity_tokens for r in rows}
