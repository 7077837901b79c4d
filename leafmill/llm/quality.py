"""Per-document text statistics and the class of a text: prose, list, table or junk.

The words of the language mix are learnt from the documents themselves: all words of a least document
frequency over all documents. Every line is judged by its marks, cells, words and neighbours,
lines are weighed by their non-blank characters, and the class with the larger share is the text's class.

Repetition enters the class: short lines that come again and again without being sentences are boilerplate, which is kept apart
from prose and does not count; lines that are no sentences and mostly hold the same three words are entries of a list; and a text of a
few words over and over, whose dominant three words cover most of it, is junk. A readable text that is repeated stays prose.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import stage

#: Words of a vocabulary that is broadcast as a whole; beyond it documents are taken in blocks, each with the words of its own
#: documents, so that none is lost. Documents a word must occur in.
VOCABULARY_ROWS, LEAST_DOCUMENTS = 2_000_000, 3
#: Times a line must occur to be boilerplate, and its most words.
BOILERPLATE, BOILERPLATE_WORDS = 3, 8
#: Share of lines with the same three words that makes entries, share of characters of the dominant three words that makes junk, with at most so many words.
TEMPLATE, DOMINANT, FEW_WORDS = 0.6, 0.5, 8
#: Words taken as common ones.
COMMON = 400

_WORD = re.compile(r"[^\W\d_]+(?:[’'\-‑][^\W\d_]+)*")
_FRAME = re.compile(r"\s*(?:-{3,}|\*\w+ \d+\*|> Source: .*)\s*$")
_TITLE = re.compile(r"# \S+\s*$")
_MARK = re.compile(r"\s*(?:[-*•·–—+▪◦‣●○■□►»→]|\[[ xX✓]?\]|[☐☑☒]|\(?(?:\d{1,4}|[A-Za-zА-я]|[ivxlcIVXLC]{1,6})[.)]|#\d+|№ ?\d+)\s+\S")
_LEADER = re.compile(r".*(?:\.{3}|(?: \.){3}|…{2}|_{3})\s*\w{1,8}\s*$")
_TAIL = re.compile(r".*\S\s*[\(\[]\s*\d[\d.,]*\s*[\)\]]\s*$")
_GAP = re.compile(r"\S(?:\s{2,}|\t)(?=\S)")
_CODE = re.compile(r"\d")
_END = re.compile(r"[.!?…:;][\"”»’)\]]*\s*$")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"’‘“”„«»()\-–—/%€£$§°±&+]")
_HEX = re.compile(r"[0-9a-fA-F]{2,8}(?:[ :]+[0-9a-fA-F]{2}){4,}")
_RULE = set("|-:+= \t,;0123456789/.")
_DIGITS = re.compile(r"\D+")
_NO_VOWEL = re.compile(r"(?<![^\W\d_])[bcdfghjklmnpqrstvwxzбвгджзклмнпрстфхцчшщ]{4,}(?![^\W\d_])", re.I)

METRICS = (
    "word_count", "mean_word_length", "real_word_ratio", "common_word_ratio", "symbol_ratio", "digit_ratio", "line_end_ratio",
    "punctuation_score", "gibberish_penalty", "duplicate_line_share", "duplicate_paragraph_share", "top_ngram_share",
    "prose_share", "list_share", "table_share", "junk_share", "boilerplate_share",
)
SCHEMA = "doc_id bigint, " + ", ".join(f"{m} {'bigint' if m == 'word_count' else 'double'}" for m in METRICS) + ", text_class string"


def _words_of(text: str) -> set[str]:
    """Words of a text in small letters, and the parts of compounds."""
    found = {w for w in _WORD.findall(text.lower()) if len(w) <= 6 or len(set(w)) > 2}  # a row of one or two letters is no word
    return found | {y for x in found if "-" in x for y in x.split("-")}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(w, c)``: words with the number of texts that hold them, counted within a worker."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(_words_of(text.as_py()))
        if len(counts) > 500_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["w", "c"])
            counts.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["w", "c"])


def vocabulary(documents: DataFrame, text: str = "text", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``(w, c)``: all words of at least ``least`` documents with their number."""
    counted = documents.where(F.col(text).isNotNull()).select(text).mapInArrow(_counted, "w string, c bigint")
    return counted.groupBy("w").agg(F.sum("c").alias("c")).where(F.col("c") >= least)


def _weight(text: str) -> int:
    return sum(map(len, text.split()))


def _delimited(line: str) -> tuple[str, int]:
    """Cell separator of a line and how many cells it has."""
    s = line.strip()
    if s.count("|") >= 2 and s[0] == "|" and s[-1] == "|" or s.count(" | ") >= 2:
        return "|", s.count("|")
    if "\t" in s:
        return "\t", line.count("\t")
    for mark in ";,":
        if (n := s.count(mark)) >= 2 and s.count(mark + " ") <= n // 4 and not s.endswith("."):
            return mark, n
    return "", 0


def line_kinds(lines: list[str], known) -> tuple[list[str], list[list[str]], list[int]]:
    """Kind of each line (frame, blank, prose, list, table or junk), its words, and its non-blank characters.

    ``known`` tells whether a lower-case word is one.
    """
    n = len(lines)
    kinds = [""] * n
    first = next((i for i, x in enumerate(lines) if x.strip()), None)
    framed = first is not None and _TITLE.match(lines[first]) and any(x.startswith("> Source: ") for x in lines[first + 1 : first + 4])
    for i, line in enumerate(lines):
        if not line or line.isspace():
            kinds[i] = "blank"
        elif line[0] in "-*> \t" and _FRAME.match(line) or framed and i == first:
            kinds[i] = "frame"
    cells = [("", 0) if k else _delimited(x) for k, x in zip(kinds, lines)]
    gaps = [0 if k or "  " not in x and "\t" not in x else len(_GAP.findall(x)) for k, x in zip(kinds, lines)]
    words = [[] if k else _WORD.findall(x) for k, x in zip(kinds, lines)]
    weights = [0 if k else _weight(x) for k, x in zip(kinds, lines)]
    live = [i for i in range(n) if not kinds[i]]
    for p, i in enumerate(live):
        line = lines[i]
        mark, count = cells[i]
        near = [live[q] for q in (p - 2, p - 1, p + 1, p + 2) if 0 <= q < len(live) and abs(live[q] - i) <= 3] if mark or gaps[i] else ()
        if mark and any(cells[j][0] == mark and abs(cells[j][1] - count) <= (0 if mark in ";," else 1) for j in near):
            kinds[i] = "table"
        elif gaps[i] >= 1 and len(words[i]) <= 6 * (gaps[i] + 1) and (
            sum(gaps[j] >= 1 and abs(gaps[j] - gaps[i]) <= 3 for j in near) >= 1 and gaps[i] + max((gaps[j] for j in near), default=0) >= 3
        ):
            kinds[i] = "table"
        elif _MARK.match(line) or len(words[i]) <= 12 and _LEADER.match(line):
            kinds[i] = "list"
        elif len(words[i]) <= 7 and _TAIL.match(line):
            kinds[i] = "list"
    # Junk overrides: lines without readable words, whatever their layout.
    for i in live:
        w, line = words[i], lines[i]
        size = weights[i]
        letters = sum(map(len, w))
        if kinds[i] == "table":
            plain = letters + len(_DIGITS.sub("", line))
            if size > 12 and plain < 0.5 * size and not set(line) <= _RULE:
                kinds[i] = "junk"
            continue
        # A name that the corpus hardly knows says nothing; unknown words in small letters do.
        long = [y for x in w if len(x) > 3 and (known(y := x.lower()) or not x[0].isupper() or x.isupper())]
        total = sum(map(len, long))
        good = sum([len(x) for x in long if known(x) or "-" in x and all([known(y) for y in x.split("-") if len(y) > 3])])
        if total >= 12 and good < 0.45 * total or size > 25 and not long and letters < 0.6 * size and kinds[i] != "list":
            kinds[i] = "junk"
        elif good < 0.6 * size:  # not plainly readable
            symbols = len(_SYMBOL.findall(line)) + line.count("�")
            if size > 20 and _HEX.search(line):
                kinds[i] = "junk"
            elif size > 6 and (letters < 0.35 * size and kinds[i] != "list" and not _CODE.search(line) or symbols > 0.25 * size and letters < 0.7 * size):
                kinds[i] = "junk"
            elif not kinds[i] and (size > 14 and not good or max(map(len, line.split()), default=0) > 45):
                kinds[i] = "junk"
        if kinds[i] != "junk" and len(w) >= 5 and len(set(w)) <= 0.5 * len(w) + 1:
            if Counter([x.lower() for x in w]).most_common(1)[0][1] >= 0.5 * len(w):
                kinds[i] = "junk"
    _blocks(lines, kinds, words, live)
    return kinds, words, weights


def _blocks(lines: list[str], kinds: list[str], words: list[list[str]], live: list[int]) -> None:
    """Decides runs of lines that are still open: entries without marks, mixed-up words, prose."""
    run: list[int] = []
    for i in [*live, -1]:
        if i >= 0 and not kinds[i] and (not run or i - run[-1] <= 2):
            run.append(i)
            continue
        if run:
            _block(lines, kinds, words, run)
        run = [i] if i >= 0 and not kinds[i] else []
    # A continuation line of an entry is part of the list.
    for a, b in zip(live, live[1:]):
        if kinds[a] == "list" and kinds[b] == "prose" and b == a + 1 and lines[b][:2].isspace() and not _END.search(lines[a]):
            kinds[b] = "list"


def _block(lines: list[str], kinds: list[str], words: list[list[str]], run: list[int]) -> None:
    text = [lines[i].strip() for i in run]
    all_words = [w for i in run for w in words[i]]
    ends = sum(bool(_END.search(x)) for x in text)
    entry = [x for x, i in zip(text, run) if len(words[i]) <= 5 and not _END.search(x)]
    tails = sum(bool(_CODE.search(x.split()[-1])) or x.split()[-1][:1].isupper() for x in entry)
    if len(run) >= 3 and len(entry) >= 0.85 * len(run) and tails >= 0.6 * len(entry) and ends <= 0.15 * len(run):
        for i in run:
            kinds[i] = "list"
        return
    if len(run) >= 4 and ends <= 0.15 * len(run) and len(all_words) <= 12 * len(run):
        small = [[x.lower() for x in words[i]] for i in run]
        grams = Counter(g for w in small for g in {*zip(w, w[1:], w[2:])})
        if grams and max(grams.values()) >= TEMPLATE * len(run):
            for i in run:
                kinds[i] = "list"
            return
    joined = " ".join(text)
    upper = sum(w[0].isupper() for w in all_words)
    stops = len(re.findall(r"[.!?](?:[\"”»’)]*)(?:\s|$)", joined))
    mixed = len(all_words) >= 12 and upper == 0 and stops <= len(all_words) // 60 and not joined[:1].isupper()
    for i in run:
        kinds[i] = "junk" if mixed else "prose"


def measure(text: str | None, known, common) -> tuple | None:
    """Figures of one text in the order of ``METRICS`` and its class; None for a text without characters."""
    if not text or text.isspace():
        return None
    lines = text.split("\n")
    kinds, found, weights = line_kinds(lines, known)
    body = [x for x, k in zip(lines, kinds) if k not in ("blank", "frame")]
    seen = Counter([x.strip() for x in body])
    if len(seen) < len(body):
        for i, (line, kind) in enumerate(zip(lines, kinds)):
            if kind == "prose" and seen[line.strip()] >= BOILERPLATE and len(found[i]) <= BOILERPLATE_WORDS and not _END.search(line):
                kinds[i] = "boilerplate"
    share = Counter()
    for weight, kind in zip(weights, kinds):
        share[kind] += weight
    total = share["prose"] + share["list"] + share["table"] + share["junk"] + share["boilerplate"]
    words = [w.lower() for line in found for w in line]
    count = len(words)
    joined = "\n".join(body)
    size = max(1, total)
    repeated = sum(len(x) * (c - 1) for x, c in seen.items() if c > 1)
    paragraphs = Counter(p.strip() for p in re.split(r"\n\s*\n", text) if p.strip() and not _FRAME.match(p))
    again = sum(len(p) * (c - 1) for p, c in paragraphs.items() if c > 1)
    top = 0
    grams = Counter(zip(words, words[1:], words[2:]))
    if len(grams) < count - 2:  # some three words repeat
        gram = max(grams, key=grams.__getitem__)
        top = grams[gram] * sum(map(len, gram))
    letters = sum(map(len, words))
    odd = sum(map(len, _NO_VOWEL.findall(joined)))
    symbols = len(_SYMBOL.findall(joined))
    sentences = len(re.findall(r"[.!?]", joined))
    figures = (
        count,
        letters / count if count else 0.0,
        sum(map(known, words)) / count if count else 0.0,
        sum(map(common, words)) / count if count else 0.0,
        symbols / size,
        len(_DIGITS.sub("", joined)) / size,
        sum(bool(_END.search(x)) for x in body) / len(body) if body else 0.0,
        min(1.0, sentences / (count / 15)) if count else 0.0,
        min(1.0, (odd + 2 * symbols) / max(1, letters)),
        repeated / max(1, sum(map(len, body))),
        again / max(1, sum(len(p) * c for p, c in paragraphs.items())),
        min(1.0, top / max(1, letters)),
        *(share[k] / total if total else 0.0 for k in ("prose", "list", "table", "junk", "boilerplate")),
    )
    best = max(("prose", "list", "table", "junk"), key=lambda k: share[k])
    if total and total == share["boilerplate"]:
        best = "list"
    if best == "prose" and count >= 12 and top >= DOMINANT * letters and len(set(words)) <= FEW_WORDS:
        best = "junk"
    return figures + (best,)


def document_quality(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: list[str] | None = None) -> DataFrame:
    """One row per non-empty document with its figures and ``text_class``.

    Null, empty and blank texts give no row; repeated rows give one. Duplicated ids with different texts give
    a row for each. ``words`` replaces the vocabulary learnt from all documents.
    """
    source = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for own, held in _in_blocks(source, words):
        part = own.mapInArrow(_measured(held), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _in_blocks(source: DataFrame, words: list[str] | None) -> list[tuple[DataFrame, object]]:
    """Documents with the broadcast ``(words, common words)`` they need: all at once, or by hash where the vocabulary is large."""
    broadcast = source.sparkSession.sparkContext.broadcast
    if words is not None:
        return [(source, broadcast((set(words), set(words[:COMMON]))))]
    known = stage(vocabulary(source), "vocabulary")
    common = {r.w for r in known.orderBy(F.desc("c"), "w").limit(COMMON).collect()}
    rows = known.count()
    if rows <= VOCABULARY_ROWS:
        return [(source, broadcast(({r.w for r in known.select("w").collect()}, common)))]
    out, blocks = [], 2 * -(-rows // VOCABULARY_ROWS)
    for b in range(blocks):
        own = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == b)
        needed = known.join(vocabulary(own, least=1).select("w"), "w", "left_semi").select("w")
        out.append((own, broadcast(({r.w for r in needed.collect()}, common))))
    return out


def _measured(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, common = held.value[0].__contains__, held.value[1].__contains__
        names = ["doc_id", *METRICS, "text_class"]
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (m := measure(t, known, common)) is not None:
                    rows.append((i, *m))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            types = [pa.int64(), pa.int64(), *[pa.float64()] * (len(METRICS) - 1), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run
