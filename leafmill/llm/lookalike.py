"""One form for texts that look the same.

A text is cut into runs of characters that may change and the stretches between them. Runs are
exploded to positioned code points, joined with a broadcast table of decompositions and
look-alikes, combining marks are ordered by class, clusters are recomposed and the strings
rebuilt. Unchanged stretches travel as one row each.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.pairs import pairs_within
from leafmill.session import stage

# Letters of other alphabets that have the shape of a Latin (or, in Greek, a Cyrillic) letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХУҮаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTXYYaesijopcyxhdqwl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳΓΠΦ", "ABEZHIKMNOPTYXovcjГПФ"))
OTHER = dict(zip("ɡɑօՕսհ", "gaoOuh"))
HYPHENS = "‐‑⁃﹣­"
#: Compatibility forms that change what is seen: raised, lowered and circled signs, fractions.
_VISIBLE = ("<super>", "<sub>", "<fraction>", "<circle>", "<vertical>")
_MAX = 0x2FA20
#: First and last vowel and final sign of Korean syllables, and orders that keep them behind their lead.
VOWELS, FINALS = (0x1161, 0x1175), (0x11A8, 0x11C2)
_ORDER = {VOWELS: 300, FINALS: 301}


def _lookalike() -> dict[str, str]:
    return {**CYRILLIC, **GREEK, **OTHER}


def _parts(c: str, like: dict[str, str]) -> str:
    d = unicodedata.decomposition(c)
    if not d or d.split()[0] in _VISIBLE:
        return like.get(c, c)
    codes = d.split()
    if codes[0][0] == "<":
        if 0x3131 <= ord(c) <= 0x318E:  # single Korean letters do not join into syllables
            return c
        codes = codes[1:]
    out = "".join(chr(int(x, 16)) for x in codes)
    if " " in out and len(out) > 1:  # a spacing accent is not a space and a mark
        return c
    return "".join(_parts(x, like) for x in out)


def stands_for(c: str, like: dict[str, str]) -> str:
    """What a character stands for, itself in most cases."""
    kind, point = unicodedata.category(c), ord(c)
    if kind in ("Cn", "Co", "Cs"):
        return c
    if 0xAC00 <= point < 0xD7A4:
        return unicodedata.normalize("NFD", c)
    if kind == "Cf" or 0xFE00 <= point <= 0xFE0F or c in "͏ㅤᅟᅠﾠ":
        return ""
    if kind == "Zs":
        return " "
    if c in HYPHENS:
        return "-"
    return "".join("-" if x in HYPHENS else x for x in _parts(c, like))


@lru_cache(None)
def char_map() -> dict[str, str]:
    """Each character that does not stand for itself with what it stands for, by rule.

    Format characters vanish, spaces become U+0020, hyphens U+002D, wide, narrow and joined forms
    their parts, composed letters base and marks, look-alike letters the Latin letter.
    """
    like = _lookalike()
    return {c: to for c in map(chr, range(0x80, _MAX)) if (to := stands_for(c, like)) != c}


@lru_cache(None)
def marks() -> dict[str, int]:
    """Combining marks with their class; vowels and finals of Korean syllables behind all of them."""
    out = {chr(p): unicodedata.combining(chr(p)) for p in range(0x80, _MAX) if unicodedata.combining(chr(p))}
    return out | {chr(p): k for (a, b), k in _ORDER.items() for p in range(a, b + 1)}


@lru_cache(None)
def compositions() -> dict[str, str]:
    """Decomposed clusters of composed letters after the mapping, with the composed letter."""
    table: dict[str, str] = {}
    for c, to in char_map().items():
        if len(to) > 1 and all(x in marks() for x in to[1:]) and to[0] not in marks():
            composed = unicodedata.normalize("NFC", to)
            if len(composed) == 1:
                table[to] = composed
    return table


def _char_class(chars: set[str]) -> str:
    out, points = [], sorted(map(ord, chars))
    i = 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[i]:x}}}" + (f"-\\x{{{points[j]:x}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


@lru_cache(None)
def steady() -> str:
    """Regex class of common characters that stand for themselves, in few ranges, so that it is fast to test.

    Characters outside it may change; exploding one that does not is harmless.
    """
    final = set(compositions().values())
    areas = ((0x00, 0x24F), (0x400, 0x45F), (0x2010, 0x2026), (0x20AC, 0x20AC))
    return _char_class({chr(p) for a, b in areas for p in range(a, b + 1) if chr(p) not in marks() and (chr(p) not in char_map() or chr(p) in final)})


@lru_cache(None)
def _folding() -> dict[int, str]:
    """Every character that changes, or is a mark, to what stands for it without marks."""
    table = {ord(c): "".join(x for x in to if x not in marks()) for c, to in char_map().items()}
    return {ord(m): "" for m in marks()} | table


def _looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, h, key)`` of ``(id, text)``: 128-bit hashes of the text and of what is left without accents and marks.

    Texts that look the same have the same key. It also joins texts that do not look the same; it only decides which are exploded.
    """
    table = None
    for batch in batches:
        h, keys = [], []
        for t in batch.column(1):
            t = t.as_py()
            digest = hashlib.md5(t.encode()).digest()
            h.append(digest)
            if t.isascii():
                keys.append(digest)
            else:
                table = table or _folding()
                keys.append(hashlib.md5(t.translate(table).encode()).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.binary()), pa.array(keys, pa.binary())], ["id", "h", "key"])


def map_table(spark: SparkSession) -> DataFrame:
    """``(ch, parts)``, parts being (position, character, combining class); size bound by Unicode."""
    rows = [(c, [(i, x, marks().get(x, 0)) for i, x in enumerate(to)]) for c, to in char_map().items()]
    rows += [(m, [(0, m, k)]) for m, k in marks().items() if m not in char_map()]
    return F.broadcast(spark.createDataFrame(rows, "ch string, parts array<struct<sub:int,to:string,ccc:int>>"))


def compose_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(compositions().items()), "cluster_text string, composed string"))


def one_form(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``(key, form)``: each text in the form that all texts of the same looks share.

    ``key`` must be unique and not null. A null text gives null, an empty one is kept. Composed and decomposed
    letters come out composed, so do Korean syllables, look-alike letters in Latin.
    A text of any length works: it moves in pieces of its changing runs.
    """
    spark = texts.sparkSession
    a = steady()  # a run: the character before it, up to 256 that may change, and the marks that follow
    pattern = f"(?s)[{a}]?[^{a}]{{1,256}}[\\p{{M}}\\x{{1161}}-\\x{{1175}}\\x{{11a8}}-\\x{{11c2}}]*|[{a}]{{1,4000}}(?=[{a}][^{a}])|[{a}]{{1,4000}}"
    base = texts.select(F.col(key).alias("k"), F.col(text).alias("t"))
    work = base.where(F.col("t").rlike(f"[^{a}]"))
    still = base.where(F.col("t").isNull() | ~F.col("t").rlike(f"[^{a}]")).select("k", F.col("t").alias("form"))
    pieces = work.select("k", F.posexplode(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).alias("n", "piece"))
    runs = pieces.where(F.col("piece").rlike(f"[^{a}]"))
    points = runs.select("k", "n", F.posexplode(F.split("piece", "")).alias("pos", "ch")).where("ch <> ''")
    mapped = (
        points.join(map_table(spark), "ch", "left")
        .withColumn("parts", F.coalesce("parts", F.array(F.struct(F.lit(0).alias("sub"), F.col("ch").alias("to"), F.lit(0).alias("ccc")))))
        .select("k", "n", "pos", F.explode("parts").alias("p"))
        .select("k", "n", "pos", "p.sub", "p.to", "p.ccc")
    )
    order = Window.partitionBy("k", "n").orderBy("pos", "sub")
    clustered = mapped.repartition("k").withColumn(
        "cluster", F.coalesce(F.max(F.when(F.col("ccc") == 0, F.struct("pos", "sub"))).over(order), F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("sub")))
    )
    ordered = F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "to")))
    clusters = clustered.groupBy("k", "n", "cluster").agg(F.array_join(ordered["to"], "").alias("cluster_text"))
    # A cluster composes as a whole, or its first two characters do and the other marks follow.
    composed = clusters.join(compose_table(spark), "cluster_text", "left").select(
        "k", "n", "cluster", F.coalesce("composed", "cluster_text").alias("s"), (F.col("composed").isNull() & (F.length("cluster_text") > 2)).alias("rest")
    )
    head = F.substring("s", 1, 2)
    composed = (
        composed.withColumn("cluster_text", F.when(F.col("rest"), head))
        .join(compose_table(spark), "cluster_text", "left")
        .select("k", "n", "cluster", F.when(F.col("composed").isNull(), F.col("s")).otherwise(F.concat("composed", F.expr("substring(s, 3)"))).alias("s"))
    )
    rebuilt = composed.groupBy("k", "n").agg(F.array_join(F.array_sort(F.collect_list(F.struct("cluster", "s")))["s"], "").alias("piece"))
    whole = rebuilt.unionByName(pieces.where(~F.col("piece").rlike(f"[^{a}]")).select("k", "n", "piece"))
    full = whole.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "piece")))["piece"], "").alias("form"))
    # A text of which nothing is left, such as invisible characters only, still has its (empty) form.
    return full.unionByName(still).select(F.col("k").alias(key), "form")


def same_looks(pages: DataFrame, page_id: str = "page_id", text: str = "page_text") -> DataFrame:
    """``(page_id_a, page_id_b)``, a < b, of pages with different non-empty texts that look the same.

    Null and empty texts are no cases, repeated rows count once, equal texts are no pair. Texts are grouped by a
    coarser key first, so only texts with a possible partner are exploded, each once.
    """
    rows = pages.where(F.col(page_id).isNotNull() & (F.col(text) != "")).select(
        F.col(page_id).cast("long").alias("id"), F.col(text).alias("t")
    )
    keyed = stage(rows.mapInArrow(_looks, "id bigint, h binary, key binary").distinct(), "looks")
    groups = keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    members = stage(keyed.join(groups, "key").select("id", "h"), "candidates")
    first = members.groupBy("h").agg(F.min("id").alias("id"))
    # Few bytes but much work: the texts are dealt out before they are exploded.
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = rows.join(first, "id").where(F.unhex(F.md5("t")) == F.col("h")).select("h", "t").dropDuplicates(["h"]).repartition(tasks, "h")
    forms = one_form(texts, "h", "t").select(F.col("h").alias("id"), F.unhex(F.md5("form")).alias("form"), F.length("form").alias("n"))
    # Different texts of one form are paired, then each pair stands for all pages that have the two texts.
    alike = stage(pairs_within(stage(forms, "forms"), "form", "n"), "alike")
    a = alike.join(members.toDF("id_a", "h_a"), F.col("a") == F.col("h_a")).select("id_a", "b")
    both = a.join(members.toDF("id_b", "h_b"), F.col("b") == F.col("h_b")).where("id_a <> id_b")
    return both.select(F.least("id_a", "id_b").alias("page_id_a"), F.greatest("id_a", "id_b").alias("page_id_b")).distinct()


def readable_form(form: Column) -> Column:
    """Words of a form back in their alphabet: those with a letter only Cyrillic has become Cyrillic.

    Words made of shared shapes only follow the majority of the deciding words of their line. The
    result depends on the form alone, so texts that look the same stay equal.
    """
    back = {v: k for k, v in CYRILLIC.items() if k not in "ҮһԁԛԝӏЅѕЈј"}
    back.update({"ë": "ё", "Ë": "Ё", "ï": "ї", "Ï": "Ї"})
    latin, cyr = "".join(back), "".join(back.values())
    only = r"[\x{400}-\x{4ff}]"
    shared = f"^[^\\p{{L}}\\p{{N}}]*[{latin}](?:[{latin}]|[^\\p{{L}}\\p{{N}}])*$"

    def line_words(line: Column) -> Column:
        parts = F.split(line, " ")
        cyrillic = F.size(F.filter(parts, lambda w: w.rlike(only)))
        other = F.size(F.filter(parts, lambda w: ~w.rlike(only) & ~w.rlike(shared) & w.rlike(r"\p{L}")))
        return F.array_join(
            F.transform(parts, lambda w: F.when(w.rlike(only) | (w.rlike(shared) & (cyrillic > other)), F.translate(w, latin, cyr)).otherwise(w)), " "
        )

    lines = F.transform(F.split(form, "\n"), lambda line: F.when(line.rlike(only), line_words(line)).otherwise(line))
    return F.when(form.rlike(only), F.array_join(lines, "\n")).otherwise(form)


def normalized_pages(pages: DataFrame, page_id: str = "page_id", text: str = "page_text") -> DataFrame:
    """``(page_id, form, changed)``: one row per page with its text in one consistent, readable form.

    A page with a null text has a null form. Of rows with one page_id the greatest text counts.
    """
    rows = pages.where(F.col(page_id).isNotNull()).groupBy(F.col(page_id).cast("long").alias("id")).agg(F.max(text).alias("t"))
    rows = stage(rows, "pages")
    forms = one_form(rows, "id", "t").select("id", readable_form(F.col("form")).alias("form"))
    return rows.join(forms, "id", "left").select(
        F.col("id").alias("page_id"),
        F.when(F.col("t").isNull(), F.lit(None)).otherwise(F.coalesce("form", F.lit(""))).alias("form"),
        F.coalesce(F.col("t") != F.coalesce("form", F.lit("")), F.lit(False)).alias("changed"),
    )
