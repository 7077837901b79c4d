"""Repair of text from scanned pages.

Lines of the page frame are told from the body, words cut at line ends are joined, and words that
recognition changed are corrected by a noisy channel: each word of a line gets candidates, confusion
probabilities say how likely a candidate was read as what stands there, word and word pair counts say
how likely it is in its place, and a Viterbi search picks the best sequence of the line. A word that no native page has
is likely by its letters, in proportion to how often native text brings a new word. Only a candidate that wins makes a misread line.

Counts come from pages of native text, which went through no recognition. Confusion probabilities are estimated by
expectation and maximisation over all distinct words of the scans that native text does not know.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.encoding import ODD, QUIET, repair_text, undisguise
from leafmill.llm.tables import Counts, PairCounts, Scores, Table
from leafmill.session import stage

#: Rows of words, pairs, notices and judged words that one broadcast model may have. Beyond it pages are taken in blocks,
#: each with the rows that its own pages can meet, so that none is lost.
MODEL_ROWS = 1_000_000
#: Entries of each memory of what a worker found out; a full one is emptied.
KEPT = 50_000
#: Rows and bytes of a batch that are Python objects at a time, and rows that are given out at once.
PIECE_ROWS, PIECE_BYTES, OUT_ROWS = 2_000, 4 << 20, 50_000
#: Least count of a word or pair in native text, and paths on whose page edges a notice occurs.
LEAST_WORD, LEAST_PAIR, NOTICE_PATHS = 2, 3, 3
#: Log probabilities of the channel before they are estimated: one confusion of the table, any other changed character, a lost or added space.
CONFUSED, CHANGED, SPACED = -5.0, -10.0, -7.5
#: Rounds of the estimate, and occurrences that its first values stand for.
ROUNDS, PRIOR = 3, 2_000
#: Lowest channel score of a candidate.
LEAST_CHANNEL = -16.0
HYPHENS = "-‐‑­¬"
#: Fixed value: letters that are words.
SINGLE = "aàéoyiwzвксуи"

# Strokes that a recogniser sees in a letter. Words of equal strokes may be taken for each other.
_STROKES = {
    "i": "ilI1|!jtfrvyJT7çyтгчуГТ", "ii": "nuhwHUNµинпйцкHИНП", "iii": "mMмшщШМ", "o": "oaceO0CQGbg96q(оасеэьбёОСЕАЭБЁ", "oi": "dюыd",
    "s": "sS5$", "b": "8BEßзвЗВ3", "z": "zZ2", "p": "pPрРF", "k": "kKRж", "x": "xXхХ", "l": "L", "a": "A4л", "d": "DдД", "v": "VYУ", "w": "W",
}
STROKES = {c: s for s, chars in _STROKES.items() for c in chars}
# What is read for what, as (seen, meant).
_SEEN = (
    "rn m,m rn,cl d,d cl,li h,h li,ii u,u ii,vv w,w vv,ri n,n ri,nn m,m nn,vi w,w vi,in m,m in,ni m,rri m,lc k,"
    "1 l,l 1,I l,l I,I 1,S 8,E 3,i l,l i,1 i,i 1,I 1,1 I,| l,| I,! l,! i,l t,t l,t f,f t,r t,i j,j i,l f,f l,"
    "0 o,o 0,O 0,0 O,o a,a o,c e,e c,o e,e o,c o,o c,a e,e a,( c,Q O,C G,G C,6 b,b 6,9 g,g 9,q g,g q,6 ó,6 é,6 o,o 6,6 G,G 6,6 e,"
    "5 s,s 5,5 S,S 5,8 B,B 8,E 8,8 E,3 8,8 3,2 z,z 2,2 Z,Z 2,v y,y v,u n,n u,h b,b h,n h,h n,U V,V U,u v,v u,7 1,1 7,4 A,F E,E F,P F,F P,"
    "0 о,о 0,О 0,0 О,3 з,з 3,3 З,З 3,6 б,б 6,в з,з в,н и,и н,п л,л п,т г,г т,е с,с е,о с,с о,а о,о а,и п,п и,н п,п н,л д,ц н,ш щ,щ ш,э з,ы ь,ьl ы,ьі ы,bI ы,ы м,м ы,й и,и й,ё е,е ё,"
    "R К,4 ч,ч 4,г ч,х ж,ж х,ю о,б о,в б,0 О"
)
SEEN: dict[str, set[str]] = defaultdict(set)
for _pair in _SEEN.split(","):
    SEEN[_pair.split(" ")[0]].add(_pair.split(" ")[1])

#: Marks before and after a word.
_OPENS, _CLOSES = "\"“”„«»'‘’([…¿¡", "\"“”„«»'’)],.;:!?…"
_CODE = re.compile(
    r"[A-Z]\d{1,3}\.\d{1,4}|[A-Z]{2}-\d{2,5}|\d{4}-[A-Z]{2}-\d{1,4}|\d{1,3}/[A-Z]{2}\d{1,5}|[±€£$]?\d+(?:[.,]\d+)*(?:%|°C?|-\d*)?|\d{1,2}\.\d{1,2}\.\d{2,4}|[A-Z]{2}-|\d{4}-(?:[A-Z]{2}-)?|[A-Z]{2}-\d+"
)
_NUMERIC = re.compile(r"[±€£$]?[\dOolISsBbEeZGgQ|!]+(?:[.,][\dOolISsBbEZGgQ|!]+)*")
_LETTERS = re.compile(r"[^\W\d_]+(?:[’'\-‑‐][^\W\d_]+)*[’']?")
_BULLET = re.compile(r"\s*(?:[-*•·–+‐‑¬]|\d+[.)])\s+\S")
_ROW = re.compile(r"\s*(?:\S.*?\s{2,}[\dOlIS]+[.,][\dOlIS]{2}|\d{3,4})\s*$")
_DIGIT = "[0-9OolIiSsBE|!зЗоОбQ]"
_PAGE_NUMBER = re.compile(
    rf"\s*(?:[\[(]\s*{_DIGIT}{{1,5}}\s*[\])]|[-–—‐‑¬·~•]\s*{_DIGIT}{{1,5}}\s*[-–—‐‑¬·~•]|{_DIGIT}{{1,5}}\s*/\s*{_DIGIT}{{1,5}}|scan\s+{_DIGIT}{{4,6}}[-‐‑]{_DIGIT}{{3,5}}|[sS5]c[ao]n\s+\S+"
    rf"|(?:[A-Za-zА-яáó0-9(!|]{{4,8}}\.?|[sSpPсС]\.)\s{{1,3}}{_DIGIT}{{1,5}}(?:\s+[A-Za-zА-я0-9]{{1,3}}\s+{_DIGIT}{{1,5}})?)\s*$"
)
_PAGE_WORDS = ("page", "seite", "página", "pagina", "strona", "страница", "стр", "blatt", "hoja", "folha", "лист", "feuille", "karta", "sheet", "folio")
_INTEGER = re.compile(rf"\s*{_DIGIT}{{1,5}}\s*$")
_ROMAN = re.compile(r"\s*[-–]?\s*[ivxlcIVXLC1|ⅰ-ⅿ]{1,7}\s*[-–]?\s*$")
_SPACED = re.compile(r"\s*(?:\S ){2,}\S?(?:\s{2,}|$)")
_END_MARKS = ".!?;:,”»\"…"
_ENDS = re.compile(rf"[{_END_MARKS}]\s*$")
_DATED = re.compile(r"\|\s*\S{0,3}\d[\d.\-/OlSB·]+\s*$")
#: A line that is nothing but a code is a stamp.
_STAMP = re.compile(r"\s*(?:[A-Z]\d{1,3}\.\d{3,4}|[A-Z]{2}-\d{3,5}|\d{4}-[A-Z]{2}-\d{2,4}|\d{1,3}/[A-Z]{2}\d{2,5})\s*$")
_SECTION = re.compile(r"\s*[\dlOIS]{1,2}[.,][\dlOIS]{1,2}\s+[^\W\d_]")
_NUMBERED = re.compile(r"\s*(?:[\dlOISB]{1,5}\s{2,}\S.*[^\W\d_].*|\S.*[^\W\d_].*\s{2,}[\dlOISB]{1,5})\s*$")
_TRAILS, _TRAILER = re.compile("[·•.|‐-]"), re.compile(r"\s*[·•.|‐-]\s*\S{1,5}\s*$")
_TITLE_END = re.compile(r"(?:[–—-] \S+|\b(?:1[89]|[12lI]9|20|2[0O])\S{2})\s*$")


class _Strokes(dict):
    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = out = STROKES.get(c) or STROKES.get(_base(c), c)
        return out


_SHAPES = _Strokes()


def strokes(word: str) -> str:
    """What a recogniser sees of a word, without accents."""
    return word.translate(_SHAPES)


_BASES: dict[str, str] = {}


def _base(c: str) -> str:
    if c not in _BASES:
        _BASES[c] = unicodedata.normalize("NFD", c)[0]
    return _BASES[c]


#: Operations of the channel apart from the confusions, which are named ``seen>meant``: other letters of the same strokes, another accent,
#: another character, a space.
SHAPE, ACCENT, OTHER, SPACE = "=", "~", "*", " "
START = {SHAPE: CONFUSED - 1, ACCENT: CONFUSED - 1, OTHER: CHANGED, SPACE: SPACED}


def align(seen: str, meant: str, costs: dict[str, float], floor: float = LEAST_CHANNEL) -> tuple[float, list[str]]:
    """Log probability that ``meant`` was read as ``seen`` by the best alignment of confusions and changes, and its operations."""
    if seen == meant:
        return 0.0, []
    n, m = len(seen), len(meant)
    if abs(n - m) > 4:
        return -math.inf, []
    accent, other, shape = costs.get(ACCENT, START[ACCENT]), costs.get(OTHER, CHANGED), costs.get(SHAPE, START[SHAPE])
    seen_shape, meant_shape = [STROKES.get(c) or STROKES.get(_base(c), c) for c in seen], [STROKES.get(c) or STROKES.get(_base(c), c) for c in meant]
    best: dict[tuple[int, int], tuple[float, tuple[int, int] | None, tuple[str, ...]]] = {(0, 0): (0.0, None, ())}

    def reach(step: tuple[int, int], score: float, came: tuple[int, int], ops: tuple[str, ...]) -> None:
        old = best.get(step)
        if old is None or score > old[0]:
            best[step] = (score, came, ops)

    for i in range(n + 1):
        for j in range(max(0, i - 4), min(m, i + 4) + 1):
            here = best.get((i, j))
            if here is None or here[0] < floor:
                continue
            score = here[0]
            same = i < n and j < m and seen[i] == meant[j]
            if same:
                reach((i + 1, j + 1), score, (i, j), ())
            for a in (1, 2, 3):
                if i + a > n:
                    break
                part = seen[i : i + a]
                for target in SEEN.get(part, ()):
                    piece = meant[j : j + len(target)]
                    if piece == target:
                        op = f"{part}>{target}"
                        reach((i + a, j + len(target)), score + costs.get(op, CONFUSED), (i, j), (op,))
                    elif len(piece) == len(target) and "".join(map(_base, piece)) == target:
                        op = f"{part}>{target}"
                        reach((i + a, j + len(target)), score + costs.get(op, CONFUSED) + accent, (i, j), (op, ACCENT))
            if same:
                continue
            for a in (1, 2):
                for b in (1, 2):
                    alike = i + a <= n and j + b <= m and a + b > 2 and "".join(seen_shape[i : i + a]) == "".join(meant_shape[j : j + b])
                    if alike and [_base(c) for c in seen[i : i + a]] != [_base(c) for c in meant[j : j + b]]:
                        reach((i + a, j + b), score + shape, (i, j), (SHAPE,))
            for step in ((i + 1, j + 1), (i + 1, j), (i, j + 1)):
                if step[0] <= n and step[1] <= m:
                    if step == (i + 1, j + 1) and _base(seen[i]) == _base(meant[j]):
                        reach(step, score + accent, (i, j), (ACCENT,))
                    else:
                        reach(step, score + other, (i, j), (OTHER,))
    if (n, m) not in best:
        return -math.inf, []
    at, ops = (n, m), []
    while at is not None:
        _, came, used = best[at]
        ops += used
        at = came
    return best[n, m][0], ops


def channel(seen: str, meant: str, costs: dict[str, float] | None = None) -> float:
    return align(seen, meant, costs or {})[0]


def forms_of(word: str) -> list[tuple[str, object]]:
    """Forms under which the vocabulary may hold a word, each with the way back to the word's own capitals."""
    if word.isupper() and len(word) > 1:
        return [(word, str), (word.lower(), str.upper), (word[:1] + word[1:].lower(), str.upper)]
    if word[:1].isupper():
        return [(word, str), (word[:1].lower() + word[1:], lambda w: w[:1].upper() + w[1:])]
    return [(word, str)]


def keys_of(word: str) -> set[str]:
    """Keys that a word shares with those it may be taken for: its strokes, and its letters less one."""
    out = {f"s{strokes(word)}"}
    if len(word) > 3:
        out |= {f"c{word[:k]}{word[k + 1 :]}" for k in range(len(word))} | {f"c{word}"}
    return out


_LETTER_FOR = {d: next((t for t in "oliszgbaeh" if t in SEEN.get(d, ())), None) for d in "0123456789"}


def made_up(word: str) -> list[tuple[str, tuple[str, ...]]]:
    """Numbers, codes and unknown words that may have been read as a mix of digits and letters, with the operations."""
    if word.isalpha() or word.isdigit() or not any(map(str.isdigit, word)) or not any(c.isalpha() or c in "|!" for c in word):
        return []
    out: dict[str, tuple[str, ...]] = {}
    for kept in range(3):
        made, ops = word[:kept], []
        for c in word[kept:]:
            d = next((t for t in SEEN.get(c, ()) if t.isdigit()), None) if not c.isdigit() else None
            made += d or c
            if d:
                ops.append(f"{c}>{d}")
        if ops and _CODE.fullmatch(made):
            out.setdefault(made, tuple(ops))
    if sum(c.isdigit() for c in word) < sum(c.isalpha() for c in word):
        made, ops = "", []
        for c in word:
            d = _LETTER_FOR.get(c)
            made += d or c
            if d:
                ops.append(f"{c}>{d}")
        if ops and _LETTERS.fullmatch(made):
            out.setdefault(made, tuple(ops))
    return list(out.items())


def scored(word: str, others, costs: dict[str, float], mixed: bool = True) -> dict[str, tuple[float, list[str]]]:
    """Words among ``others`` that may have been read as ``word``, in its capitals, with channel scores and operations."""
    found: dict[str, tuple[float, list[str]]] = {}
    forms = forms_of(word)
    for w in others:
        for form, back in forms:
            if w != form:
                score, ops = align(form, w, costs)
                if score > LEAST_CHANNEL and score > found.get(back(w), (-math.inf,))[0]:
                    found[back(w)] = (score, ops)
    for w, ops in made_up(word) if mixed else ():
        score = sum(costs.get(op, CONFUSED) for op in ops)
        if score > found.get(w, (-math.inf,))[0]:
            found[w] = (score, list(ops))
    found.pop(word, None)
    return found


class Letters:
    """Likelihood of words by their letters: trigrams of the distinct words of native text, mixed with shorter ones."""

    def __init__(self, grams: dict[str, int]):
        self.grams = grams
        self.logs: dict[str, float] = {}
        self.follow: dict[str, list[int]] = {}
        for g, c in grams.items():
            f = self.follow.setdefault(g[:-1], [0, 0])
            f[0] += c
            f[1] += 1

    def log(self, word: str) -> float:
        text, total, logs = f"\2\2{word.lower()}\3", 0.0, self.logs
        for k in range(2, len(text)):
            gram = text[k - 2 : k + 1]
            total += logs[gram] if gram in logs else self._log(gram)
        return total

    def _log(self, gram: str) -> float:
        p = 1e-4  # any other character
        for context in ("", gram[1], gram[:2]):
            have = self.follow.get(context)
            if have:
                p = (self.grams.get(context + gram[2], 0) + have[1] * p) / (have[0] + have[1])
        out = math.log(p)
        _keep(self.logs, gram, out)
        return out


def grams_of(word: str) -> list[str]:
    text = f"\2\2{word.lower()}\3"
    return [text[k - n : k + 1] for k in range(2, len(text)) for n in range(3)]


class _Tokens(dict):
    """Word of a token without the marks around it, and whether it needs a closer look."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, token: str) -> tuple[str, bool]:
        model, core = self.model, _core(token)
        have = core, bool(core) and (not model.known(core) or core in model.suspect) and not _fine(core, model)
        if len(self) >= KEPT:
            self.clear()
            model.fine.clear()
        self[token] = have
        if not have[1]:
            model.fine.add(token)
        return have


class _Suspects(dict):
    """Whether a known word has a far more frequent look-alike, so that it is checked in its place."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, word: str) -> bool:
        words, c = self.model.words, self.model.words.get(word)
        have = (
            c is not None and len(word) > 1 and c * 200 < max((words[v] for v in self.model.by_strokes.all(strokes(word)) if v != word), default=0)
            and any(words.get(v, 0) > 200 * c for v, s in self.model.candidates(word) if s >= 2 * CONFUSED)
        )
        _keep(self, word, have)
        return have

    def __contains__(self, word: str) -> bool:
        return self[word]


def _keep(kept: dict, key, value) -> None:
    """Remembers what can be found out again."""
    if len(kept) >= KEPT:
        kept.clear()
    kept[key] = value


class Model:
    """Words and pairs of native text with their log probabilities, judged words, and candidates by strokes."""

    def __init__(
        self, words: dict[str, int] | Counts, pairs: dict[tuple[str, str], int] | PairCounts, notices: set[str] | Table, costs: dict[str, float] | None = None,
        judged: Scores | None = None, letters: Letters | None = None, total: int = 0, new: tuple[float, float, float] | None = None, by_strokes: Table | None = None,
    ):
        self.total = total or max(1, sum(words.values()))
        # Few words are asked for fastest in a dictionary.
        self.words = dict(words.items()) if len(words) <= KEPT else words if isinstance(words, Table) else Counts.of((w, str(c)) for w, c in words.items())
        self.pairs = pairs if isinstance(pairs, Table) else PairCounts.of((f"{a}\t{b}", str(c)) for (a, b), c in pairs.items())
        self.costs = costs or {}
        self.letters = letters or Letters(Counter(g for w in words for g in grams_of(w)))
        # Log shares of new words, new capitalised words and numbers in native text.
        self.new, self.new_name, self.number = new or (-math.log(self.total + 1),) * 3
        self.by_strokes = by_strokes or Table.of((strokes(w), w) for w in words)
        self.known_candidates: dict[str, list[tuple[str, float]]] = {}
        self.judged, self.unknown = judged or Scores.of([]), {}
        self.tokens, self.options, self.joins, self.pair_logs = _Tokens(self), {}, {}, {}
        self.fine: set[str] = set()  # tokens that need no closer look
        self.suspect = _Suspects(self)
        self.spaced = self.costs.get(SPACE, SPACED)
        plain = notices if isinstance(notices, Table) else {k for n in notices if len(k := notice_key(n)) >= 8}
        self.plain_notices = set(plain) if len(plain) <= KEPT else plain

    def known(self, word: str) -> bool:
        if word in self.words:
            return True
        low = word[:1].lower() + word[1:]
        if low in self.words:
            return True
        if word.isupper() and len(word) > 1:
            lower = word.lower()
            return lower in self.words or lower[:1].upper() + lower[1:] in self.words
        return False

    def word_log(self, word: str) -> float:
        count = self.words.get(word)
        if count is None:
            count = self.words.get(word[:1].lower() + word[1:])
            if count is None:
                have = self.unknown.get(word)
                if have is not None:
                    return have
                if word[:1].isdigit() and _CODE.fullmatch(word):
                    score = self.number - math.log(10) * sum(c.isdigit() for c in word)
                else:
                    score = (self.new_name if word[:1].isupper() else self.new) + self.letters.log(word)
                _keep(self.unknown, word, score)
                return score
            return math.log(count / self.total) - 2.0
        return math.log(count / self.total)

    def pair_log(self, left: str, right: str) -> float:
        """Word pair probability, backed off to the word."""
        have = self.pair_logs.get((left, right))
        if have is not None:
            return have
        before, own = self.words.get(left), self.word_log(right)
        count = self.pairs.get((left, right), 0)
        if count:
            own = math.log((count + 2 * math.exp(own)) / ((count if before is None else before) + 2))
        elif before is not None:
            own -= 1.0
        _keep(self.pair_logs, (left, right), own)
        return own

    def candidates(self, word: str, deep: bool = True) -> list[tuple[str, float]]:
        """Known words that may have been read as ``word``, with channel scores.

        Words of scans were judged once against the whole vocabulary. Others, put together from two, are compared with
        words of equal strokes and, if ``deep`` and without any, with words one other confusion away.
        """
        key = word if deep else "\0" + word
        have = self.known_candidates.get(key)
        if have is not None:
            return have
        have = self.judged.get(word)
        if have is not None:
            return have
        forms = [form for form, _ in forms_of(word)]
        alike = {w for form in forms for w in self.by_strokes.all(strokes(form))}
        if not deep and not alike:  # most of what is put together
            return []
        found = scored(word, alike, self.costs, deep)
        if deep and not found:
            found = scored(word, {w for form in forms for w in _one_change(form, self.words)}, self.costs)
        out = sorted(((w, score) for w, (score, _) in found.items()), key=lambda x: (-x[1], x[0]))
        _keep(self.known_candidates, key, out)
        return out


def _one_change(word: str, words) -> set[str]:
    """Known words one confusion away."""
    out = set()
    for i in range(len(word)):
        for a in (1, 2, 3):
            for target in SEEN.get(word[i : i + a], ()) if i + a <= len(word) else ():
                w = word[:i] + target + word[i + a :]
                if w in words:
                    out.add(w)
    return out


def _core(token: str) -> str:
    core = token.lstrip(_OPENS).rstrip(_CLOSES)
    return token[: token.index(core) + len(core)] if token[0] == "(" and ")" not in token and core else core


def page_number(line: str) -> bool:
    """A line that is a page number in a form no body line has."""
    m = _PAGE_NUMBER.match(line)
    if not m:
        return False
    first = line.split()[0]
    if len(first) >= 3 and "/" not in first and first[0].isalpha() and any(c.isalpha() for c in first[1:]):
        s = strokes(first.lower().rstrip("."))
        return any(s == strokes(w) for w in _PAGE_WORDS) or s == strokes("scan")
    return any(c.isdigit() for c in line) or first[0] in "-–—‐‑[("


def _titlelike(line: str, width: int, follows: str, top: bool) -> int:
    """2 for a line that can only be a title, 1 for one that may be, 0 for others."""
    s = line.strip()
    if not s or _BULLET.match(line) or _ROW.match(line) and not _NUMBERED.match(line):
        return 0
    if _DATED.search(s):
        return 2
    if not any(map(str.isalpha, s)):
        return 0
    goes_on = follows[:1].islower() and not _ROW.match(follows)
    if _SPACED.match(s) and sum(len(x) == 1 for x in s.split()) >= 0.8 * len(s.split()):
        return 2
    if _upper(s, 5) and len(s.split()) >= 2:
        return 2
    if _ENDS.search(s) or s[-1] in HYPHENS or s[0].islower() or len(s.split()) > 9 or "," in s:
        return 0
    indent = len(line) - len(line.lstrip())
    if indent >= 8:
        return 2
    if _NUMBERED.match(line) and not re.search(r"\d[.,]\d{2}\s*$", s):
        return 2
    if _TITLE_END.search(s) and not goes_on and (len(s) <= 0.8 * width or top and len(s.split()) <= 6):
        return 2 if top else 1
    if len(s) > 0.8 * width:
        return 0
    if _SECTION.match(line):
        return 2
    return 1 if follows and not goes_on else 0


def _short_title(line: str, width: int) -> bool:
    """After a footer amid the page: a short line with a capital and no end mark."""
    s = line.strip()
    return (
        s[:1].isupper() and len(s) < 0.75 * width and not _ENDS.search(s) and s[-1] not in HYPHENS
        and not _BULLET.match(line) and not _ROW.match(line)
    )


def frame_lines(lines: list[str], page_num: int | None, model: Model) -> set[int]:
    """Indexes of the lines that belong to the page frame."""
    filled = [i for i, x in enumerate(lines) if x.strip()]
    if not filled:
        return set()
    sizes = sorted(len(lines[i].rstrip()) for i in filled)
    width = sizes[int(0.8 * (len(sizes) - 1))]
    frame: set[int] = set()
    near = set()
    if page_num is not None:
        near = {page_num + k for k in (-1, 0, 1)} | {2 * page_num + k for k in (-2, -1, 0, 1)}

    def number(i: int) -> int | None:
        if not _INTEGER.match(lines[i]):
            return None
        s = lines[i].strip().translate(_AS_DIGITS)
        return int(s) if s.isdigit() else None

    def notice(i: int) -> bool:
        line = lines[i].strip()
        if len(line) < 8 or len(line) > 60 or line[-1] in _END_MARKS:
            return False
        if "�" in line:
            lost = re.compile(".{1,3}".join(re.escape(notice_key(x)) for x in line.split("�")))
            return any(lost.fullmatch(k) for k in model.plain_notices)
        if notice_key(line) in model.plain_notices:
            return True
        short = _TRAILER.sub("", line) if _TRAILS.search(line) else line
        return short != line and notice_key(short) in model.plain_notices

    def foot(p: int, edge: bool) -> bool:
        i = filled[p]
        if page_number(lines[i].replace("�", "-")) or notice(i) or _STAMP.match(lines[i]):
            return True
        if (n := number(i)) is not None and (edge and n in near or any(c.isdigit() for c in lines[i])):
            row = p > 0 and filled[p - 1] == i - 1 and _ROW.match(lines[filled[p - 1]])
            return n in near or edge and not row
        return bool(_ROMAN.match(lines[i])) and (edge or bool(re.fullmatch(r"\s*[ivxlcⅰ-ⅿ]{1,7}\s*", lines[i])))

    def interrupts(p: int) -> bool:
        """A short line that starts with a capital amid a sentence that goes on after it."""
        s, before, after = lines[filled[p]].strip(), lines[filled[p - 1]].rstrip(), lines[filled[p + 1]].strip()
        if filled[p - 1] in frame or not s[0].isupper() or _ENDS.search(s) or s[-1] in HYPHENS or _BULLET.match(s) or _ROW.match(s):
            return False
        return before[-1] in HYPHENS and after[:1].islower() or not _ENDS.search(before) and after[:1].islower() and len(s) < 0.65 * width

    def header(p: int, titles: int, weak: bool) -> bool:
        """A running header; after the first title of a page only a plain second line is one, others head the body."""
        line = lines[filled[p]]
        follows = lines[filled[p + 1]].strip()
        if _SECTION.match(line) or titles and (titles > 1 or _capitals(line)):
            return False
        return bool(_titlelike(line, width, follows if weak else "", True) or not weak and _short_title(line, width))

    p = titles = 0
    while p + 1 < len(filled):
        i = filled[p]
        if page_number(lines[i]) or notice(i) or number(i) in near:
            frame.add(i)
        elif header(p, titles, True):
            frame.add(i)
            titles += 1
        else:
            break
        p += 1
    q = len(filled) - 1
    while q >= p and foot(q, True):
        frame.add(filled[q])
        q -= 1
    k = p
    while k <= q:
        i = filled[k]
        body = lines[i].strip()
        if len(body) > 0.75 * width and not body.isupper() and "|" not in body:
            k += 1
            continue
        titles = 0
        if not foot(k, False):
            follows = lines[filled[k + 1]].strip() if k < q else ""
            strong = k < q and not _capitals(lines[i]) and not _SECTION.match(lines[i]) and _titlelike(lines[i], width, follows, False) == 2
            if not strong and not (p < k < q and interrupts(k)):
                k += 1
                continue
            titles = 1
        frame.add(i)
        k += 1
        while k < q:
            if not foot(k, False):
                if not header(k, titles, False):
                    break
                titles += 1
            frame.add(filled[k])
            k += 1
    return frame


def _capitals(line: str) -> bool:
    """A title in capitals, not spaced, without date or page number: it heads a section unless it comes first."""
    s = line.strip()
    return _upper(s, 1) and not (_DATED.search(s) or _NUMBERED.match(line) or _SPACED.match(s))


def _upper(s: str, least: int) -> bool:
    """At least ``least`` letters, nearly all of them capitals."""
    if sum(map(str.islower, s)) > 0.15 * len(s):
        return False
    letters = sum(map(str.isalpha, s))
    return letters >= least and sum(map(str.isupper, s)) >= 0.85 * letters


_AS_DIGITS = str.maketrans("OolIi|!SsBEзЗбоОQ", "00111115588336000")


_NO_WORD, _NUMBERS = re.compile(r"\W+"), re.compile(r"(?<!\w)[\dOlIS]+(?!\w)")


def notice_key(line: str) -> str:
    """Strokes of a line without digits and signs, equal for a notice however it was misread."""
    return _NO_WORD.sub("", strokes(_NUMBERS.sub("", line)))


def broken_words(lines: list[str], frame: set[int], model: Model, ends: set[int] | None = None) -> dict[int, tuple[int, str, str]]:
    """Lines that end inside a word: index of the next body line, the fragment and its continuation. ``ends`` are the lines that end with a hyphen."""
    out: dict[int, tuple[int, str, str]] = {}
    if not (ends := _hyphen_ends(lines) if ends is None else ends):
        return out
    body = [i for i, x in enumerate(lines) if i not in frame and x and not x.isspace()]
    for i, j in zip(body, body[1:]):
        if i not in ends or len(left := lines[i].rstrip()) < 2:
            continue
        right = lines[j].strip()
        if j > i + 1 and not any(k in frame for k in range(i + 1, j)):
            continue
        a = re.search(r"[^\s\"“”„«»(]*$", left[:-1])[0]
        b = re.match(r"[^\s.,;:!?\"”»)…]*", right)[0]
        if not a or not b or not b[0].isalpha() or not a[-1].isalnum():
            continue
        if b[0].isupper() and not a.isupper() or re.fullmatch(r"[\dA-Z/.-]*\d", a):
            continue
        joined, compound = a + b, f"{a}-{b}"
        if left[-1] in "¬­":
            out[i] = (j, a, b)
            continue
        if model.known(compound):
            continue
        if not model.known(joined):
            whole = max((s for _, s in model.candidates(joined)), default=-99)
            split = max((s for w, s in model.candidates(compound) if "-" in w), default=-99)
            if split > whole:
                continue
            tail = b.split("-")[0]
            if whole < -50 and model.known(a) and model.known(tail) and len(a) > 2 and len(tail) > 2:
                continue
        out[i] = (j, a, b)
    return out


def _hyphen_ends(lines: list[str]) -> set[int]:
    return {i for i, x in enumerate(lines) if (end := x.rstrip()[-1:]) and end in HYPHENS}


def token_options(token: str, model: Model) -> tuple[list[tuple[int, tuple[str, ...], float]], bool]:
    """What one token may stand for: tokens taken, words and channel score, as it is first; and whether it is a code. The same everywhere, so kept."""
    have = model.options.get(token)
    if have is not None:
        return have
    words, code = model.words, bool(_CODE.fullmatch(token))
    out: list[tuple[int, tuple[str, ...], float]] = [(1, (token,), 0.0)]
    sound = code or model.known(token)
    if not sound:
        for cut in range(1, len(token)):
            a, b = token[:cut], token[cut:]
            if b in words and (a in words or cut > 1 and model.known(a)) and (len(a) > 1 or a.lower() in SINGLE) and (len(b) > 1 or b.lower() in SINGLE):
                out.append((1, (a, b), model.spaced))
    if not sound or token in model.suspect:
        out += [(1, tuple(w.split(" ")), s) for w, s in model.candidates(token, len(out) == 1)]
    _keep(model.options, token, (out, code))
    return out, code


def joined_options(token: str, after: str, model: Model) -> list[tuple[int, tuple[str, ...], float]]:
    """What a token and the one after it may stand for together; also the same everywhere."""
    have = model.joins.get((token, after))
    if have is not None:
        return have
    known, out = model.known, []
    if _LETTERS.fullmatch(token):
        both, sound = token + after, (known(token) or token_options(token, model)[1]) and known(after)
        if not sound or (token, after) not in model.pairs:
            if known(both) and len(both) > 3:
                out.append((2, (both,), model.spaced))
            elif not sound:
                out += [(2, tuple(w.split(" ")), s + model.spaced) for w, s in model.candidates(both, deep=False)]
    _keep(model.joins, (token, after), out)
    return out


def decode(tokens: list[str], model: Model) -> list[tuple[int, int, str]]:
    """Best words of a line: ``(first token, tokens taken, word)`` by Viterbi over candidates."""
    n, codes, every, open_ = len(tokens), set(), [], False
    for i, token in enumerate(tokens):
        options, code = token_options(token, model)
        if code:
            codes.add(token)
        if i + 1 < n and (joined := joined_options(token, tokens[i + 1], model)):
            options = options + joined
        open_ = open_ or len(options) > 1
        every.append(options)
    if not open_:  # nothing but what stands there
        return [(i, 1, token) for i, token in enumerate(tokens)]
    # By last word: likelihood, and the place, last word, tokens and words of the step to it.
    best: list[dict[str, tuple[float, int, str, int, tuple[str, ...]]]] = [{} for _ in range(n + 1)]
    best[0][""] = (0.0, 0, "", 0, ())
    pair_log, pair_logs = model.pair_log, model.pair_logs
    for i in range(n):
        options = every[i]
        for last, state in best[i].items():
            so_far = state[0]
            for take, words, score in options:
                value, left = so_far + score, last
                for w in words:
                    if w not in codes:
                        have = pair_logs.get((left, w))
                        value += pair_log(left, w) if have is None else have
                    left = w
                target = best[i + take]
                old = target.get(left)
                if old is None or value > old[0]:
                    target[left] = (value, i, last, take, words)
    out = []
    at, last = n, max(best[n], key=lambda w: best[n][w][0])
    while at > 0:
        _, at, before, take, words = best[at][last]
        out.append((at, take, " ".join(words)))
        last = before
    return out[::-1]


def _windows(cores: list[str], odd: list[bool]) -> list[list[int]]:
    """Places of odd words with one word before and two after; a pair model sees no further."""
    filled = [k for k, c in enumerate(cores) if c]
    out: list[list[int]] = []
    end = -1
    for p, k in enumerate(filled):
        if odd[k]:
            start, stop = max(0, p - 1), min(len(filled), p + 3)
            if out and start <= end:
                out[-1] += filled[end:stop]
            else:
                out.append(filled[start:stop])
            end = stop
    return out


def page_lines(text: str, page_num: int | None, model: Model) -> tuple[list[str], set[int], dict, set[int], dict[int, list[str]]]:
    """Lines of a page (restored), its frame, broken words, misread lines and corrected words of changed lines."""
    lines = _restored(text)
    frame = frame_lines(lines, page_num, model)
    ends = _hyphen_ends(lines)
    broken = broken_words(lines, frame, model, ends)
    misread: set[int] = set()
    corrected: dict[int, list[str]] = {}
    continued = {j: i for i, (j, _, _) in broken.items()}
    look, fine = model.tokens, model.fine.issuperset
    compounds = {i for i in ends if i not in frame and i not in broken and lines[i].strip()[1:]}
    edges = ends.union(continued, [i + 1 for i in compounds])
    for i, line in enumerate(lines):
        if i in frame or not (tokens := line.split()):
            continue
        if i not in edges and fine(tokens):
            continue
        looked = [look[t] for t in tokens]
        if i not in edges and not any([odd for _, odd in looked]):
            continue
        cores = [core for core, _ in looked]
        odd = [o for _, o in looked]
        if i in continued:
            cores[0], odd[0] = "", False
        if i in broken:
            cores[-1], odd[-1] = "", False
        elif i in ends:  # a compound that goes on in the next line
            cores[-1], odd[-1] = "", False
        if i - 1 in compounds:
            cores[0], odd[0] = "", False
        open_ = any(odd)
        if open_:
            words = list(tokens)
            for kept in _windows(cores, odd):
                for at, take, word in decode([cores[k] for k in kept], model):
                    first = kept[at]
                    seen = [cores[kept[at + x]] for x in range(take)]
                    if " ".join(seen) != word and "�" not in "".join(seen):
                        misread.add(i)
                        rest = tokens[kept[at + 1]].replace(seen[1], "", 1) if take == 2 else ""
                        words[first] = tokens[first].replace(seen[0], word, 1) + rest
                        if take == 2:
                            words[kept[at + 1]] = ""
            if i in misread:
                corrected[i] = [w for w in words if w]
    for i in compounds:
        if i + 1 < len(lines) and i + 1 not in frame and (m := re.search(r"[^\s\"“”„«»(]+$", lines[i].rstrip()[:-1])):
            a, b = m[0], re.match(r"[^\s.,;:!?\"”»)…]*", lines[i + 1].strip())[0]
            if b and not model.known(f"{a}-{b}") and not _fine(f"{a}-{b}", model):
                options = model.candidates(f"{a}-{b}")
                if options:
                    w = options[0][0]
                    misread |= {i} if not w.startswith(a) else set()
                    misread |= {i + 1} if not w.endswith(b) else set()
    for i, (j, a, b) in broken.items():
        whole = a + b
        core_a, core = _core(a), _core(whole)
        if not core or model.known(core) or _fine(core, model):
            continue
        options = [(s + model.word_log(w), w) for w, s in model.candidates(core)]
        value, w = max(options, default=(-math.inf, ""))
        if value <= model.word_log(core):
            continue
        prefix = len(core_a)
        if w[:prefix] != core_a[:prefix]:
            misread.add(i)
        if w[len(w) - len(b) :] != b and not w.endswith(b):
            misread.add(j)
        broken[i] = (j, a, b, w)
    return lines, frame, broken, misread, corrected


def _restored(text: str) -> list[str]:
    """The lines of a page, restored."""
    lines = text.split("\n")
    if "\\x" not in text and all([x.isascii() or QUIET.fullmatch(x) or _CALM.fullmatch(x) and not ODD.search(x) for x in lines]):
        return lines
    return [_plain(x) for x, _ in repair_text(text)]


#: Lines of plain characters, whose encoding and form need no repair; a hyphen at the end may be of any kind.
_CALM = re.compile(
    r"[\x00-\x7f’‘“”„–—•€£§«»°±µ²³·¿¡№А-яЁёéèàçñóíáúüöäßôêâûîïùœłąęćśźżńãõÉÀÇÑÓÍÁÚÜÖÄÔÊÂÃÕŁŚŹŻĆŃŒÎ]*[-‐\xad¬]?[ ]*"
)
_TWO_SCRIPTS = re.compile("[A-Za-zÀ-ɏ][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-zÀ-ɏ]|[\x80-\x9f]")
_SIGNS = str.maketrans({"‑": "-", "‐": "-", "\xa0": " ", "\u202f": " ", "\u2009": " ", "\u2007": " "})


def _plain(line: str) -> str:
    """The line in the form of the model's words; a hyphen at its end keeps its kind."""
    if line.isascii():
        return line
    if QUIET.fullmatch(line):  # of the signs only a hyphen at the end can be there
        return line.replace("‐", "-")
    line = unicodedata.normalize("NFC", undisguise(line)).translate(_SIGNS)
    return re.sub("\xad(?=\\w)", "", line)


def _fine(core: str, model: Model) -> bool:
    """Numbers, codes, compounds of known words and words of damaged encoding need no correction."""
    if not core.isascii() and _TWO_SCRIPTS.search(core):
        return True
    if _CODE.fullmatch(core) or not any(c.isalnum() for c in core) or "�" in core:
        return True
    if core in ("m²", "m³", "n°", "№", "°C", "km²") or len(core) == 1 and not core.isalnum():
        return True
    for mark in "-’'‑‐":
        if mark in core[1:-1] and core not in model.suspect:
            a, _, b = core.partition(mark)
            if (model.known(a) or model.known(a + mark) or _CODE.fullmatch(a)) and (model.known(b) or _fine(b, model)):
                return True
    return False


_PLAIN_WORD = re.compile(r"[^\W\d_]+(?:[’'\-‑][^\W\d_]+)*")


def _tallied(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(codes, return_counts=True)
    return values, counts


def _pieces(batches: Iterator[pa.RecordBatch], rows: int | None = None, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches, halved until each is small; a row is never cut."""
    for batch in batches:
        if batch.num_rows > (rows or PIECE_ROWS) or batch.num_rows > 1 and batch.nbytes > (size or PIECE_BYTES):
            half = batch.num_rows // 2
            yield from _pieces(iter([batch.slice(0, half), batch.slice(half)]), rows, size)
        else:
            yield batch


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(kind, a, b, c)`` of pages ``(native, path, text)``, counted within a batch.

    Kinds: ``w`` words and ``p`` pairs of native pages, ``#`` their numbers, ``t`` pages of other engines by word, ``n`` notices with their path.
    Words are numbered once a batch, so that marks around them are taken off once for each and counts are of numbers.
    """
    for batch in _pieces(batches, 10_000, 4 * PIECE_BYTES):
        native = np.array(batch.column(0).to_pylist(), bool)
        lists = pc.utf8_split_whitespace(batch.column(2))
        encoded = lists.flatten().dictionary_encode()
        cores = [_core(t) if t else "" for t in encoded.dictionary.to_pylist()]
        names = {w: k for k, w in enumerate(dict.fromkeys(["", *cores]))}
        words = list(names)
        code = np.array([names[w] for w in cores], np.int64)[encoded.indices.to_numpy()] if cores else np.zeros(0, np.int64)
        page = np.repeat(np.arange(len(native)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        own = native[page]
        size = len(words)
        rows: list[tuple[list, list, list, list]] = []
        plain = np.array([bool(_PLAIN_WORD.fullmatch(w)) for w in words])
        numeric = np.array([w[:1].isdigit() and bool(_CODE.fullmatch(w)) for w in words])
        values, counts = _tallied(code[own])
        rows.append(("#", [""], [""], [int(counts[numeric[values]].sum())]))
        keep = plain[values]
        rows.append(("w", [words[v] for v in values[keep]], None, counts[keep].tolist()))
        near = own[:-1] & (page[:-1] == page[1:]) & plain[code[:-1]] & plain[code[1:]]
        values, counts = _tallied(code[:-1][near] * size + code[1:][near])
        rows.append(("p", [words[v] for v in values // size], [words[v] for v in values % size], counts.tolist()))
        # Once a page, so that a repeated text is no evidence for a word.
        values, counts = _tallied(_tallied(page[~own] * size + code[~own])[0] % size)
        rows.append(("t", [words[v] for v in values if v], None, [int(c) for v, c in zip(values, counts) if v]))
        notices: Counter = Counter()
        for k in np.flatnonzero(~native).tolist():
            path = batch.column(1)[k].as_py() or ""
            for n in _edge_notices(batch.column(2)[k].as_py()):
                notices[n, path] += 1
        rows.append(("n", [n for n, _ in notices], [x for _, x in notices], list(notices.values())))
        for kind, a, b, c in rows:
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b or [""] * len(a), pa.string()), pa.array(c, pa.int64())], ["kind", "a", "b", "c"]
                )


_SPACES, _END_NUMBER = re.compile(r"\s+"), re.compile(r"\s*[·•|]?\s*\d+\s*$")


def _edge_notices(text: str) -> set[str]:
    """The last two lines of a page that may be notices, without page numbers."""
    end = text.rstrip().rsplit("\n", 8)
    lines = [x for x in end if x and not x.isspace()]
    if len(lines) < 4 and len(end) == 9:
        lines = [x for x in text.split("\n") if x.strip()]
    out = set()
    for line in lines[-2:] if len(lines) > 3 else ():
        if len(line) < 60 and line.rstrip()[-1] not in ".,;:!?”»-‐":
            n = _SPACES.sub(" ", _END_NUMBER.sub("", line)).strip()
            if len(n) >= 8:
                out.add(n)
    return out


def _mapped(f, schema: str):
    """``f(row values) -> rows`` over Arrow batches."""
    names, types = zip(*[x.split(" ") for x in schema.split(", ")])
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[t] for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], list(names))

        for piece in _pieces(batches):
            for values in zip(*(c.to_pylist() for c in piece.columns)):
                rows += f(*values)
                if len(rows) >= OUT_ROWS:
                    yield out()
        yield out()

    return run


class Statistics:
    """Tables of what is known of a corpus, none of them cut: words, pairs, notices, judged words, confusions."""

    def __init__(self, pages: DataFrame, text: str = "page_text", engine: str = "engine", path: str = "path"):
        self.spark = pages.sparkSession
        held = pages.where(F.col(text) != "").select(F.coalesce(F.col(engine) == "text", F.lit(False)).alias("native"), F.col(path).cast("string").alias("path"), F.col(text).alias("t"))
        counted = stage(held.mapInArrow(_count, "kind string, a string, b string, c bigint").groupBy("kind", "a", "b").agg(F.sum("c").alias("c")), "counts")

        def of(kind: str) -> DataFrame:
            return counted.where(F.col("kind") == kind)

        self.words = of("w").where(F.col("c") >= LEAST_WORD).select(F.col("a").alias("w"), "c")
        self.pairs = of("p").where(F.col("c") >= LEAST_PAIR).select("a", "b", "c")
        self.notices = of("n").groupBy(F.col("a").alias("n")).agg(F.count("*").alias("paths")).where(F.col("paths") >= NOTICE_PATHS).select("n")
        capital = F.col("a").rlike(r"^\p{Lu}")
        once = (F.col("kind") == "w") & (F.col("c") == 1)

        def total(condition) -> object:
            return F.coalesce(F.sum(F.when(condition, F.col("c"))), F.lit(0))

        t = counted.agg(
            total(F.col("kind") == "w").alias("native"), total(once & ~capital).alias("new"), total(once & capital).alias("name"),
            total(F.col("kind") == "#").alias("number"), total(F.col("kind") == "t").alias("scans"),
            F.count_if((F.col("kind") == "w") & (F.col("c") >= LEAST_WORD) | (F.col("kind") == "p") & (F.col("c") >= LEAST_PAIR)).alias("known"), F.count_if(F.col("kind").isin("n", "t")).alias("others"),
        ).first()
        self.total, self.scale = max(1, t.native), t.scans / max(1, t.native)
        self.new = tuple(math.log((x + 1) / (self.total + 1)) for x in (t.new, t.name, t.number))
        self.costs: dict[str, float] = {}
        pieces = {t for targets in SEEN.values() for t in targets}

        def parts(w: str, c: int) -> list[tuple[str, float]]:
            """Trigrams of the distinct words, and occurrences of what can be misread."""
            plain = "".join(map(_base, w))
            read = [(f"={p}", float(c)) for k in range(len(w)) for n in (1, 2) if (p := plain[k : k + n]) in pieces]
            return [(f"g{g}", 1.0) for g in grams_of(w)] + read + [("=", float(len(w) * c))]

        # As many as the alphabets have, whatever the size of the corpus.
        sums = self.words.mapInArrow(_summed(parts), "k string, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        self.letters = Letters({r.k[1:]: int(r.v) for r in sums if r.k[0] == "g"})
        self.meant = {r.k[1:]: r.v for r in sums if r.k[0] == "="}
        self.judged = self._judge(of("t").select(F.col("a").alias("t"), "c"))
        # Words of scans and paths of notices are many more than judged words and notices, which are counted only if that matters.
        self.rows = t.known + t.others
        if self.rows > MODEL_ROWS:
            self.rows = t.known + self.judged.count() + self.notices.count()
        self._estimate()

    def _judge(self, tokens: DataFrame) -> DataFrame:
        """``(t, c, found)``: words of scans that native text does not have, each with its candidates and how they were changed."""
        low = F.concat(F.lower(F.substring("t", 1, 1)), F.expr("substring(t, 2)"))
        lower = F.lower("t")
        shapes = F.array_distinct(F.array(F.col("t"), low, F.when(F.upper("t") == F.col("t"), lower).otherwise(F.col("t")), F.when(F.upper("t") == F.col("t"), F.concat(F.substring("t", 1, 1), F.expr("substring(lower(t), 2)"))).otherwise(F.col("t"))))
        known = tokens.select("t", F.explode(shapes).alias("w")).join(self.words, "w").select("t").distinct()
        # Numbers and codes in their form are sound on any page, so nobody asks for them.
        odd = tokens.where(~F.col("t").rlike(f"^(?:{_CODE.pattern})$")).join(known, "t", "left_anti").where(F.col("t").rlike(r"\p{L}") & (F.length("t") <= 60) & ~F.col("t").rlike(r"[\t\n]"))
        keyed_words = self.words.mapInArrow(_mapped(lambda w, c: [(w, c, k) for k in keys_of(w)], "w string, n bigint, key string"), "w string, n bigint, key string")
        keyed = odd.mapInArrow(_mapped(lambda t, c: [(t, k) for k in {k for f, _ in forms_of(t) for k in keys_of(f)}], "t string, key string"), "t string, key string")
        met = keyed.join(keyed_words, "key").select("t", "w", "n").distinct().groupBy("t").agg(F.collect_list(F.struct("w", "n")).alias("o"))

        def judge(t: str, c: int, others: list[dict] | None) -> list[tuple]:
            counts = {x["w"]: x["n"] for x in others or ()}
            found = scored(t, counts, {})
            made = []
            for w, (_, ops) in found.items():
                n = counts.get(w) or next((counts[f] for f, _ in forms_of(w) if f in counts), 0)
                made.append("\t".join([w, str(n), *ops]))
            return [(t, c, "\n".join(made))] if made else []

        schema = "t string, c bigint, found string"
        # Few bytes but much work: spread over all cores, as the optimizer would put them into one task.
        work = odd.join(met, "t", "left").select("t", "c", "o").repartition(max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        return stage(work.mapInArrow(_mapped(judge, schema), schema), "judged")

    def _estimate(self) -> None:
        """Confusion probabilities by expectation and maximisation; only sums for each operation come to the driver."""
        letters, new, total, scale = self.letters, self.new, self.total, self.scale
        for _ in range(ROUNDS):
            costs = self.costs

            def expect(t: str, c: int, found: str, costs=costs) -> list[tuple[str, float]]:
                made = []
                for _, n, ops in _options(found):
                    if not _too_often(c, n, scale):
                        made.append(((math.log(n / total) if n else new[2] - 7) + _cost(ops, costs), ops))
                own = (new[1] if t[:1].isupper() else new[0]) + letters.log(t)
                top = max([own, *(score for score, _ in made)])
                weights = [math.exp(score - top) for score, _ in made]
                whole = sum(weights) + math.exp(own - top)
                return [(op, c * w / whole) for w, (_, ops) in zip(weights, made) for op in ops]

            sums = self.judged.mapInArrow(_summed(expect), "k string, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
            self.costs = {}
            for k, v in ((r.k, r.v) for r in sums):
                start = START.get(k, CONFUSED)
                times = self.scale * self.meant.get(k.split(">")[1] if ">" in k else "", 0.0)
                p = (v + PRIOR * math.exp(start)) / (times + PRIOR)
                # Another character can be any of some thirty; a step never becomes likelier than one in twenty.
                self.costs[k] = round(min(math.log(p) - (math.log(30) if k == OTHER else 0.0), -3.0), 4)

    def models(self, scans: DataFrame) -> list[tuple[DataFrame, object]]:
        """Blocks of pages ``(page_id, page_num, t, ...)``, each with the broadcast tables of its model.

        One block if the tables are small enough. Otherwise pages are split by id, and a block gets the words whose strokes
        equal those of one of its words, of two put together or of a part, and the judged words among its own. Distinct words grow
        as the root of the pages, so blocks are as many as the square of what is too much.
        """
        if self.rows <= MODEL_ROWS:
            return [(scans, self._held(self.words, self.pairs, self.notices, self.judged))]
        blocks = max(2, math.ceil((self.rows / MODEL_ROWS) ** 2))
        words = stage(self.words.mapInArrow(_mapped(lambda w, c: [(w, c, strokes(w))], "w string, c bigint, key string"), "w string, c bigint, key string"), "keyed")
        notices = stage(self.notices.mapInArrow(_mapped(lambda n: [(n, k) for k in _notice_keys(n)], "n string, key string"), "n string, key string"), "notices")
        out = []
        for b in range(blocks):
            own = scans.where(F.pmod(F.xxhash64("page_id"), F.lit(blocks)) == b)
            probes = stage(own.select("t").mapInArrow(_probed, "kind string, key string").distinct(), "probes")

            def of(kind: str) -> DataFrame:
                return probes.where(F.col("kind") == kind).select("key")

            judged = stage(self.judged.join(of("t").withColumnRenamed("key", "t"), "t", "left_semi"), "judged")
            near = words.join(of("s"), "key", "left_semi").select("w", "c")
            words_of = judged.select(F.explode(F.split("found", "\n")).alias("o")).select(F.substring_index("o", "\t", 1).alias("w"))
            forms = F.array("w", F.concat(F.lower(F.substring("w", 1, 1)), F.expr("substring(w, 2)")), F.lower("w"), F.concat(F.substring("w", 1, 1), F.expr("substring(lower(w), 2)")), F.concat(F.upper(F.substring("w", 1, 1)), F.expr("substring(w, 2)")), F.upper("w"))
            meant = words_of.unionByName(near.select("w")).select(F.explode(forms).alias("w")).distinct()
            needed = stage(near.unionByName(self.words.join(meant, "w", "left_semi")).distinct(), "words")
            pairs = self.pairs.join(needed.select(F.col("w").alias("a")), "a", "left_semi").join(needed.select(F.col("w").alias("b")), "b", "left_semi").select("a", "b", "c")
            out.append((own, self._held(needed, pairs, notices.join(of("n"), "key", "left_semi").select("n").distinct(), judged)))
        return out

    def _held(self, words: DataFrame, pairs: DataFrame, notices: DataFrame, judged: DataFrame):
        costs, scale = self.costs, self.scale

        def scores(t: str, c: int, found: str) -> list[tuple[str, str]]:
            """Candidates with their scores, the best first."""
            made = [(w, _cost(ops, costs)) for w, n, ops in _options(found) if not _too_often(c, n, scale)]
            return [(t, "\n".join(f"{w}\t{score!r}" for w, score in sorted(made, key=lambda x: (-x[1], x[0]))))]

        w = _arrow(words.select("w", F.col("c").cast("string")))
        known = Counts(*w)
        by_strokes = Table(pa.array([strokes(x) for x in w[0].to_pylist()], pa.string()), w[0])
        p = PairCounts(*_arrow(pairs.select(F.concat_ws("\t", "a", "b"), F.col("c").cast("string"))))
        found = Scores(*_arrow(judged.select("t", "c", "found").mapInArrow(_mapped(scores, "t string, found string"), "t string, found string")))
        edges = {notice_key(n) for n in _arrow(notices.select("n"))[0].to_pylist()}
        plain = Table.of((k, "") for k in sorted(edges) if len(k) >= 8)
        return self.spark.sparkContext.broadcast((known, p, plain, costs, found, self.letters.grams, self.total, self.new, by_strokes))


def _arrow(rows: DataFrame) -> list[pa.Array]:
    """The columns of a table that fits the driver; rows stay packed."""
    return [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], pa.string()) for c in rows.toArrow().columns]


def _options(found: str) -> list[tuple[str, int, list[str]]]:
    """Candidates of a judged word: word, count and operations."""
    return [(w, int(n), ops) for w, n, *ops in (x.split("\t") for x in found.split("\n"))]


def _cost(ops: list[str], costs: dict[str, float]) -> float:
    return sum(costs.get(op, START.get(op, CONFUSED)) for op in ops)


def _too_often(c: int, n: int, scale: float) -> bool:
    """Whether a word is on more pages than half of those on which another, of ``n`` times in native text, can be expected.

    It is then a word of its own, such as one of a language that native text lacks.
    """
    return n > 0 and c > 5 + 0.5 * scale * n


def _summed(f):
    """Sums of ``f(row values) -> (key, value)`` over a worker's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, float] = defaultdict(float)
        for batch in _pieces(batches):
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                for k, v in f(*values):
                    sums[k] += v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], ["k", "v"])

    return run


def _notice_keys(notice: str) -> set[str]:
    """Keys under which a page may ask for a notice: all of it, or what stands before a lost character, up to three."""
    k = notice_key(notice)
    return {f"={k}", *(f"<{k[:n]}" for n in range(4))}


_MARKS = re.compile("[-’'‑‐]")


def _alike(word: str) -> set[str]:
    """Strokes of a word in all its forms."""
    return {strokes(f) for f, _ in forms_of(word)}


def _close(word: str) -> set[str]:
    """Strokes of a word, of its parts at marks, and of words one confusion away."""
    out = _alike(word)
    marks = [m.start() for m in _MARKS.finditer(word)]
    for start in (0, *(m + 1 for m in marks)):
        out |= {x for stop in (*marks, len(word)) if stop >= start for part in (word[start:stop], word[start : stop + 1]) if part for x in _alike(part)}
    for f, _ in forms_of(word):
        for i in range(len(f)):
            for a in (1, 2, 3):
                for target in SEEN.get(f[i : i + a], ()) if i + a <= len(f) else ():
                    if strokes(target) != strokes(f[i : i + a]):
                        out.add(strokes(f[:i] + target + f[i + a :]))
    return out


def _joins(lines: list[str]) -> set[str]:
    """What may stand on both sides of a line end with a hyphen, put together; any lines between them may be of the frame."""
    out: set[str] = set()
    heads = [re.match(r"[^\s.,;:!?\"”»)…]*", x.strip())[0] for x in lines]
    for i, line in enumerate(lines):
        left = line.rstrip()
        if len(left) < 2 or left[-1] not in HYPHENS or not (a := re.search(r"[^\s\"“”„«»(]*$", left[:-1])[0]):
            continue
        for j in range(i + 1, len(lines)):
            b = heads[j]
            if b and (j == i + 1 or b[0].isalpha() and (a.isupper() or not b[0].isupper())):
                out |= {a, b, a + b, f"{a}-{b}", _core(a + b)}
    return out - {""}


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(kind, key)`` of what pages may look up: ``t`` words, ``s`` strokes of words, of parts and of neighbours put together, ``n`` keys of lines.

    Rows are given out as they come, and what was given lately is not given again.
    """
    done: set[str] = set()
    given: dict[tuple[str, str], None] = {}
    rows: list[tuple[str, str]] = []

    def new(word: str) -> bool:
        if word in done:
            return False
        if len(done) >= 4 * KEPT:
            done.clear()
        done.add(word)
        return True

    def give(kind: str, keys) -> None:
        for key in keys:
            if (kind, key) not in given:
                _keep(given, (kind, key), None)
                rows.append((kind, key))

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [(), ()]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kind", "key"])

    for piece in _pieces(batches):
        for text in piece.column(0).to_pylist():
            lines = _restored(text)
            for line in lines:
                if 8 <= len(s := line.strip()) <= 60 and not _ENDS.search(s):
                    give("n", {f"={notice_key(s)}", f"={notice_key(_TRAILER.sub('', s))}"})
                    if "�" in s:
                        give("n", (f"<{notice_key(s.split('�')[0])[:3]}",))
                cores = [c for t in line.split() if (c := _core(t))]
                for c in filter(new, cores):
                    give("t", (c,))
                    give("s", _close(c))
                    give("s", {x for k in range(1, len(c)) for part in (c[:k], c[k:]) for x in _alike(part)})
                for a, b in zip(cores, cores[1:]):
                    if _LETTERS.fullmatch(a) and new(f"{a} {b}"):
                        give("t", (a + b,))
                        give("s", _alike(a + b))
                if len(rows) >= OUT_ROWS:
                    yield out()
            for word in _joins(lines):
                if new(f" {word}"):
                    give("t", (word,))
                    give("s", _close(word))
    yield out()


def build(words, pairs, notices, costs=None, judged=None, grams=None, total=0, new=None, by_strokes=None) -> Model:
    """The model on a worker."""
    return Model(words, pairs, notices, costs, judged, Letters(grams) if grams else None, total, new, by_strokes)


def _model(held) -> Model:
    """The model of a broadcast, built once in each worker."""
    built = getattr(held, "_built", None)
    if built is None:
        built = held._built = build(*held.value)
    return built


def _scans(pages: DataFrame, page_id: str, page_num: str, text: str, engine: str) -> DataFrame:
    return pages.where(F.col(page_id).isNotNull() & F.coalesce(F.col(engine) != "text", F.lit(True)) & (F.col(text) != "")).select(
        F.col(page_id).cast("long").alias("page_id"), F.col(page_num).cast("int").alias("page_num"), F.col(text).alias("t"),
        F.col(engine).isNull().alias("unsure"),
    )


def _looks_scanned(text: str, misread: int, frame: int, broken: int) -> bool:
    """A page of unknown engine counts as a scan if it carries a scan's damage and is set in lines."""
    lines = text.split("\n")
    return max(map(len, lines)) < 110 and (frame > 0 or broken > 0 or misread > 0)


def damaged_lines(
    pages: DataFrame, page_id: str = "page_id", page_num: str = "page_num", text: str = "page_text", engine: str = "engine", path: str = "path"
) -> DataFrame:
    """``(page_id, line_no, kind)`` with kind furniture, hyphen or misread, lines numbered from 1.

    Pages of native text have none. Pages of unknown engine are judged by what they carry. Null and empty pages
    give no rows, repeated rows one result. Texts are not shuffled: the model is broadcast in checked size.
    """
    schema = "page_id bigint, line_no int, kind string"

    def finder(held):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = _model(held)
            for batch in _pieces(batches):
                ids: list[int] = []
                numbers: list[int] = []
                kinds: list[str] = []
                for i, num, t, unsure in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    _, frame, broken, misread, _ = page_lines(t, num, model)
                    if unsure and not _looks_scanned(t, len(misread), len(frame), len(broken)):
                        continue
                    for kind, found in (("furniture", frame), ("hyphen", broken), ("misread", misread)):
                        for n in found:
                            ids.append(i), numbers.append(n + 1), kinds.append(kind)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(kinds, pa.string())], ["page_id", "line_no", "kind"])

        return find

    return _over_blocks(pages, page_id, page_num, text, engine, path, finder, schema).distinct()


def _over_blocks(pages: DataFrame, page_id: str, page_num: str, text: str, engine: str, path: str, worker, schema: str) -> DataFrame:
    """Rows of ``worker(model)`` over all blocks of scanned pages."""
    out = None
    for scans, held in Statistics(pages, text, engine, path).models(_scans(pages, page_id, page_num, text, engine)):
        part = scans.mapInArrow(worker(held), schema)
        out = part if out is None else out.unionByName(part)
    return out


def paragraphs(text: str, page_num: int | None, model: Model) -> str:
    """Continuous text of a scanned page: frame dropped, words joined and corrected, one line per paragraph."""
    lines, frame, broken, _, corrected = page_lines(text, page_num, model)
    out: list[str] = []
    now: list[str] = []
    joined_from: str | None = None
    glued: str | None = None
    width = max((len(x) for i, x in enumerate(lines) if i not in frame), default=0)

    def flush() -> None:
        if now:
            out.append(" ".join(now))
            now.clear()

    for i, line in enumerate(lines):
        if i in frame:
            continue
        if not line.strip():
            if joined_from is None and glued is None and not any(k in frame for k in (i - 1, i + 1)):
                flush()
            continue
        if _BULLET.match(line) or _ROW.match(line):
            flush()
        words = corrected.get(i, line.split())
        if glued is not None and words:
            words, glued = [glued + words[0], *words[1:]], None
        if joined_from is not None and words:
            rest = re.sub(r"^[^\s.,;:!?\"”»)…]*", "", words[0], count=1)
            words = [joined_from + rest, *words[1:]]
            joined_from = None
        if i in broken:
            _, a, b, *better = broken[i]
            last = words.pop()
            joined_from = last[: len(last.rstrip(HYPHENS)) - len(a)] + (better[0] if better else a + b)
        elif words and len(words[-1]) > 1 and words[-1][-1] in HYPHENS:  # a compound that goes on
            glued = words.pop()[:-1] + "-"
        now.extend(words)
        if joined_from is None and glued is None and len(line) < 0.6 * width and re.search(r"[.!?”»]\s*$", line) or _ROW.match(line):
            flush()
    now.extend(x for x in (joined_from, glued) if x)
    flush()
    return "\n\n".join(out)


def readable_pages(
    pages: DataFrame, page_id: str = "page_id", page_num: str = "page_num", text: str = "page_text", engine: str = "engine", path: str = "path"
) -> DataFrame:
    """``(page_id, paragraphs)`` of every scanned page with a text; repeated rows give one row."""
    def reader(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = _model(held)
            for batch in _pieces(batches):
                texts = [paragraphs(t, num, model) for num, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "paragraphs"])

        return run

    rows = _over_blocks(pages, page_id, page_num, text, engine, path, reader, "page_id bigint, paragraphs string")
    return rows.groupBy("page_id").agg(F.max("paragraphs").alias("paragraphs"))
