"""Repair of text that was decoded with the wrong character encoding.

A line is encoded again under a legacy encoding and strictly decoded as the encoding it was meant
for. Sequences of UTF-8 read as single bytes are repaired run by run, texts of one single-byte encoding read
as another line by line. A round trip is accepted when a garbling cost drops, and repeated
for nested layers.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.lookalike import CYRILLIC, GREEK, stands_for

#: Encodings in which UTF-8 bytes may have been read.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "iso8859_2", "iso8859_15", "cp866")
#: (read as, meant as) of single-byte encodings.
SWAPS = (
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"),
    ("cp1252", "cp1250"), ("cp1250", "cp1252"), ("cp1252", "iso8859_2"), ("cp1252", "cp1251"), ("latin-1", "koi8_r"), ("cp1252", "koi8_r"),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp866"),
    ("cp1251", "cp1252"), ("cp1250", "iso8859_2"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"),
    ("cp850", "cp1250"), ("cp850", "cp1251"), ("cp437", "cp1251"),
)
LAYERS = 4
#: Least drop of cost for a round trip to be accepted.
RUN_DROP, LINE_DROP = 0.9, 1.8
#: Accented letters and signs that occur in plain European text.
_LETTERS = set("éèêëàâäáãåçñóôòõöúùûüíìîïœæøßąćęłńóśźżšžčřůýěťďňőűăîșțğış")
_SIGNS = set("’‘“”„«»–—…€°±µ²³·•§¿¡№£×‐‑\xad¬")


def _sloppy(encoding: str) -> tuple[dict[str, int], dict[int, str]]:
    to_byte: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)  # undefined bytes were passed on as control characters
        to_byte.setdefault(c, b)
    for b in range(0x80, 0xA0):
        to_byte.setdefault(chr(b), b)
    back: dict[int, str] = {}
    for c, b in to_byte.items():
        back.setdefault(b, c)
    return to_byte, back


class _Bytes(dict):
    """Code points to bytes of an encoding; what it does not have becomes a point that is no byte."""

    def __missing__(self, point: int) -> int:
        self[point] = out = point if point < 0x80 else 0xFFFF
        return out


@lru_cache(None)
def _encoder(encoding: str) -> _Bytes:
    return _Bytes({ord(c): b for c, b in _sloppy(encoding)[0].items()})


def encode(text: str, encoding: str) -> bytes | None:
    """Bytes of a text under a legacy encoding, control characters standing for undefined bytes; else None."""
    try:
        return text.translate(_encoder(encoding)).encode("latin-1")
    except UnicodeEncodeError:
        return None


@lru_cache(65536)
def _char_cost(c: str) -> float:
    if c < "\x80":
        return 0.0
    point = ord(c)
    if c == "�" or 0x80 <= point < 0xA0:
        return 5.0
    low = c.lower()
    if low in _LETTERS:
        return 1.0
    if c in _SIGNS or c in "\xa0  ":
        return 0.5
    if 0x410 <= point < 0x450 or low == "ё":
        return 0.05
    return 3.0


_FOREIGN = re.compile("[^\x00-\x7f]+")


def cost(text: str) -> float:
    """How garbled a text looks: odd characters, and odd neighbours inside words."""
    total = 0.0
    for run in _FOREIGN.finditer(text):  # characters beyond ASCII and the one after them
        start, end = run.span()
        before = text[max(0, start - 2) : start]
        # One by one, so that a sum is the same however its runs were found.
        for x in _kept_costs(before, text[start : end + 1]) if end - start <= KEPT_RUN else _run_costs(before, text[start : end + 1]):
            total += x
    return total


#: Longest run whose costs are kept.
KEPT_RUN = 24


def _run_costs(start: str, run: str) -> tuple[float, ...]:
    """What a run adds to the cost of a text in which ``start`` stands before it."""
    before, earlier = start[-1:] or " ", start[:-1] or " "
    out = []
    for c in run:
        if one := _char_cost(c):
            out.append(one)
        letter, last = c.isalpha(), before.isalpha()
        if letter and last:
            if c.isupper() and before.islower():
                out.append(2.0)
            if (c >= "Ѐ") != (before >= "Ѐ"):
                out.append(3.0)
            elif c >= "\x80" and before >= "\x80" and c < "Ѐ" and c + before not in _NEIGHBOURS:
                out.append(0.7)
        elif last and c in "±§°µ€£¿¡×№²³" and not (c in "²³" and before in "mk"):
            out.append(2.5)
        elif last and c in "–—„“\xa0":
            out.append(1.0)
        elif letter and before in "„“”…–—" and earlier.isalpha():
            out.append(2.5)
        elif letter and before in "§±×•·²³" or c.islower() and before == "¿":
            out.append(1.5)
        elif letter and before == "\xad" and earlier.isalpha():
            out.append(1.5)
        before, earlier = c, before
    return tuple(out)


_kept_costs = lru_cache(1 << 16)(_run_costs)


def _vowels(text: str) -> float:
    """How far the share of vowels among Cyrillic letters is from that of Russian text."""
    letters = [c for c in text.lower() if "а" <= c <= "я" or c == "ё"]
    return abs(sum(c in "аеёиоуыэюя" for c in letters) / len(letters) - 0.42) if letters else 1.0


#: Occurrences of letters in a thousand letters of Russian text, and swaps that turn Cyrillic letters into others.
_RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 73, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 9.7, 9.4, 7.3, 6.4, 4.8, 3.6, 3.2, 2.6, 0.4, 2)))
_CYRILLIC_SWAPS = tuple(x for x in SWAPS if set(x) <= {"cp1251", "koi8_r", "cp866"})
_LIKELY = {letter: math.log(n / 30) for x, n in _RUSSIAN.items() for letter in (x, x.upper())}
#: Least gain in likelihood, over a line and a letter, for a swap of a line whose characters are all plain; and beside lines with the same swap.
ALONE, ALONE_EACH, BESIDE = 5.0, 0.35, 2.0


def _likely(text: str) -> float:
    return sum([_LIKELY[c] for c in text if c in _LIKELY])


def _other_cyrillic(line: str) -> tuple[str, str] | None:
    """A line of plain Cyrillic letters that make Russian only when read in another Cyrillic encoding, and the swap."""
    letters = [c for c in line if c in _LIKELY]
    if len(set(letters)) < 4:
        return None
    if 2 * len(letters) < len(line) and len(letters) < sum("A" <= c.upper() <= "Z" for c in line):  # look-alikes within Latin words
        return None
    best, found = max(ALONE, ALONE_EACH * len(letters)), None
    for swap in _CYRILLIC_SWAPS:
        new, gain = _reread(line, *swap)
        if gain > best and not ODD.search(new) and not _unlikely_cyrillic(new):
            best, found = gain, (new, ">".join(swap))
    return found


class _Reread(dict):
    """Characters under a Cyrillic swap, empty where there is none or it makes signs of letters or letters of signs."""

    def __init__(self, read: str, meant: str):
        self.read, self.meant = read, meant

    def __missing__(self, c: str) -> str:
        raw = encode(c, self.read)
        try:
            new = raw.decode(self.meant) if raw else ""
        except UnicodeDecodeError:
            new = ""
        self[c] = out = new if (c in _LIKELY) == (new in _LIKELY) else ""
        return out


_rereads = lru_cache(None)(_Reread)


def _reread(line: str, read: str, meant: str) -> tuple[str, float]:
    """The line under a Cyrillic swap and its gain in likelihood; none where the swap makes signs of letters or letters of signs."""
    to = _rereads(read, meant)
    if not all([to[c] for c in set(line)]):
        return line, 0.0
    new = "".join([to[c] for c in line])
    return new, _likely(new) - _likely(line)


# Occurrences of letters in a thousand letters of Greek, Hebrew and Arabic text, without accents.
_SCRIPTS = {
    "greek": dict(zip("αοιετνσηρπκυλμδωγςθχφβξζψ", (115, 98, 92, 85, 84, 66, 49, 50, 43, 41, 40, 43, 32, 33, 18, 19, 17, 35, 13, 12, 9, 7, 5, 4, 2))),
    "hebrew": dict(zip("יהולארתבמשענכםדחקפסןזצגטךףץ", (110, 105, 104, 74, 63, 56, 50, 47, 46, 44, 32, 29, 27, 27, 26, 25, 21, 17, 15, 15, 13, 12, 12, 12, 8, 3, 2))),
    "arabic": dict(zip("اليمنورتبةعدسفهقكأحجشصخطإضىزثذغئءؤظآ", (125, 116, 68, 65, 62, 58, 50, 46, 39, 36, 36, 35, 30, 29, 32, 26, 22, 26, 20, 15, 13, 12, 10, 11, 11, 8, 8, 8, 7, 7, 5, 5, 5, 2, 2, 2))),
    "cyrillic": _RUSSIAN,
}
_SCRIPT_OF = {c: (name, math.log(n * len(table) / 1000)) for name, table in _SCRIPTS.items() for x, n in table.items() for c in (x, x.upper())}
#: Encodings a whole line of another script may have been read as, and those it may have been in.
_LINE_READ_AS = ("cp1252", "latin-1", "cp1251", "cp1253", "cp1255", "cp1256", "koi8_r")
_LINE_MEANT_AS = ("cp1251", "koi8_r", "cp866", "utf-8", "cp1253", "iso8859_7", "cp1255", "cp1256", "gb18030")
#: Least letters of a line that is judged as one of another script, their least share, least mean likelihood of its reading, how much
#: likelier than a reading in any other script it must be; mean likelihood of a Cyrillic reading that ends the search.
LEAST_LETTERS, OTHER_SHARE, LEAST_LIKELY, CLEARLY, RUSSIAN = 8, 0.6, 0.1, 0.15, 0.35


def _reading(text: str) -> tuple[str, float] | None:
    """Script of a line and the mean likelihood of its letters, if nearly all beyond ASCII are of one script."""
    letters = [c for c in text if c >= "\x80" and c.isalpha()]
    if 2 * len(letters) >= LEAST_LETTERS and all(0x4E00 <= ord(c) < 0xA000 for c in letters):
        try:
            common = sum(0xB0 <= c.encode("gb2312")[0] <= 0xD7 for c in letters)
        except UnicodeEncodeError:
            return None
        return ("han", 0.5) if common >= 0.9 * len(letters) and not any(c >= "\x80" and not c.isalpha() and c not in "，。、；：？！（）“”‘’《》" for c in text) else None
    if len(letters) < LEAST_LETTERS:
        return None
    plain = [unicodedata.normalize("NFD", c)[0] if "Ͱ" <= c < "Ѐ" else c for c in letters]
    found = [_SCRIPT_OF[c] for c in plain if c in _SCRIPT_OF]
    name = Counter(n for n, _ in found).most_common(1)[0][0] if found else ""
    own = [v for n, v in found if n == name]
    odd = sum(c >= "\x80" and not c.isalpha() and c not in _SIGNS and c != "\xa0" for c in text)
    if len(own) < 0.9 * len(letters) or odd > 0.1 * len(letters):
        return None
    capitals = sum(b.isupper() and a.islower() for a, b in zip(text, text[1:]))
    return name, sum(own) / len(letters) - 3 * capitals / len(letters)


def _other_script(line: str) -> tuple[str, str] | None:
    """A line of Greek, Hebrew, Arabic or Chinese read in a wrong encoding, restored if no other reading comes near; and the swap.

    Cyrillic readings only compete here; they are restored by their cost.
    """
    foreign = len(line) - len(line.encode("ascii", "ignore"))
    if foreign < LEAST_LETTERS or foreign < OTHER_SHARE * sum(not c.isspace() and not c.isdigit() for c in line):
        return None
    own = _reading(line)
    if own and own[1] >= LEAST_LIKELY:
        return None
    best: dict[str, tuple[float, str, str]] = {}
    for read in _LINE_READ_AS:
        raw = encode(line, read)
        if raw is None:
            continue
        for meant in _LINE_MEANT_AS:
            try:
                new = raw.decode(meant)
            except UnicodeDecodeError:
                continue
            got = _reading(new) if new != line else None
            if got and got[0] == "cyrillic" and got[1] >= RUSSIAN:
                return None
            if got and got[1] > best.get(got[0], (-math.inf,))[0]:
                best[got[0]] = (got[1], new, f"{read}>{meant}")
    if not best:
        return None
    ranked = sorted(best.items(), key=lambda x: -x[1][0])
    script, (value, new, how) = ranked[0]
    if script == "cyrillic" or value < LEAST_LIKELY or len(ranked) > 1 and value < ranked[1][1][0] + CLEARLY:
        return None
    return new, how


#: Mean likelihood of a letter of Russian text, its deviation, and how many deviations below the mean a swap to Cyrillic may end.
RUSSIAN_MEAN, RUSSIAN_SPREAD, DEVIATIONS = 0.48, 0.9, 2.6


def _unlikely_cyrillic(text: str) -> bool:
    """Cyrillic letters in a mix that no Russian text has: the line is better left alone."""
    letters = [_SCRIPT_OF[c][1] for c in text if _SCRIPT_OF.get(c, ("",))[0] == "cyrillic"]
    n = len(letters)
    return n >= LEAST_LETTERS and sum(letters) < n * (RUSSIAN_MEAN - DEVIATIONS * RUSSIAN_SPREAD / math.sqrt(n))


_NEIGHBOURS = {b + a for a, b in ("çã", "çõ", "çá", "éé", "üß", "öß", "äß", "óś", "śó", "żó", "łó", "łą", "żę", "ść", "śń", "ńś", "łę", "źń", "ąć", "ęć", "żą", "óż", "ół", "ćś", "áñ", "ñó", "ñá", "ñí", "çú", "êé", "éê", "èœ", "ńć", "ęś", "łż", "ąż", "ęż")}


@lru_cache(None)
def _runs(encoding: str) -> re.Pattern[str]:
    """Runs of characters that are the bytes of UTF-8 sequences in an encoding."""
    back = _sloppy(encoding)[1]
    chars = {b: c for b, c in back.items()}
    for b in range(0x80, 0xA0):
        chars.setdefault(b, chr(b))

    def group(low: int, high: int) -> str:
        found = {c for b, c in chars.items() if low <= b <= high}
        if low >= 0x80 and high < 0xC0 or low == 0x80:
            found |= {chr(b) for b in range(0x80, 0xA0)}
        return "[" + "".join(re.escape(c) for c in sorted(found)) + "]"

    tail = group(0x80, 0xBF)
    return re.compile(f"(?:{group(0xC2, 0xDF)}{tail}|{group(0xE0, 0xEF)}{tail}{{2}}|{group(0xF0, 0xF4)}{tail}{{3}})+")


@lru_cache(None)
def _wide() -> tuple[re.Pattern[str], dict[int, str]]:
    """Wide and joined forms and invisible characters, which no legacy encoding contains."""
    ranges = ((0x2000, 0x200A), (0x200B, 0x200F), (0x202F, 0x202F), (0x2060, 0x2060), (0x2160, 0x217F), (0x3000, 0x3000), (0x3300, 0x33FF), (0xFB00, 0xFB06), (0xFEFF, 0xFEFF), (0xFF00, 0xFFEF))
    like = {**CYRILLIC, **GREEK}
    table = {p: to for a, b in ranges for p in range(a, b + 1) if (to := stands_for(chr(p), like)) != chr(p)}
    return re.compile("[" + "".join(map(chr, table)) + "]"), table


_MIXED = re.compile("[Ѐ-ӿͰ-Ͽ](?:(?<=[A-Za-z].)|[A-Za-z])")
_LATIN = {ord(a): b for a, b in {**CYRILLIC, **GREEK}.items() if b < "\x80"}


def undisguise(line: str) -> str:
    """The line without wide forms, invisible characters and look-alike letters within Latin words."""
    pattern, table = _wide()
    if pattern.search(line):
        line = line.translate(table)
    if _MIXED.search(line):
        latin = sum("A" <= c <= "z" for c in line)
        if 2 * latin > len(line.replace(" ", "")) - sum(c.isdigit() for c in line):
            return line.translate(_LATIN)
        line = re.sub(r"\w+", lambda m: m[0].translate(_LATIN) if _MIXED.search(m[0]) else m[0], line)
    return line


#: Characters that plain text of the known languages consists of, and what is odd even among those.
_PLAIN = re.compile(r"[\x00-\x7f’‘“”„–—•€£§«»°±µ²³·¿¡\xa0А-яЁё№éèàçñóíáúüöäßôêâûîïùœłąęćśźżńãõÉÀÇÑÓÍÁÚÜÖÄÔÊÂÃÕŁŚŹŻĆŃŒÎ\xad¬‐‑\u0300-\u036f]*")
#: Lines in which none of the odd things can be; a hyphen at the end may be of any kind.
QUIET = re.compile(r"[\x00-\x7f’‘“”„–—•€éèàçñóíáúüöäßôêûîïùœłąęćśźżńãõ]*[-‐\xad¬]?[ ]*")
#: Every odd thing has one of the characters it begins with here, so that lines without any are passed over fast.
ODD = re.compile(
    r"[ÂÃâ³²±µ£§·¿А-ЯЁÀ-ÝŁŚŹŻĆŃ\xad](?:(?<=â)(?:€|(?=[\s,.;:)]|$))|(?<=Â)[°±µ²³·§£«»¿¡\xa0\xad¬]|(?<=Ã)(?:[^\w\s.,;:!?)\"'’”»\-–—]|[ \xa0\xad]|$)"
    r"|(?<=[РС])[°±µ·»«§–—‘’“”„•]|(?<=[^\W\dmk][³²±µ£§])|(?<=[³²±·])(?=[^\W\d])|(?<=¿)(?=[a-zà-ÿ])"
    r"|(?<=[a-z][ГВРСД])|(?<=[ГВРСД])[a-z]|(?<=[а-яё][А-ЯЁ])|(?<=[a-zß-ÿ][À-ÝŁŚŹŻĆŃ])|(?<=\xad)(?=[^\W\d]*[ÂÃ]))"
)
_LOST = re.compile(r"(?:^|(?<=[\s(\"“]))[Ãâ](?=[\s,.;:)]|$)(?!\s+[A-ZÀ-Ý0-9](?:\s|$))|Ã(?=[ \xa0](?![A-ZÀ-Ý0-9]))|â(?=[€™œ“”])|(?<=[a-z])Ã(?![A-ZÀ-Ý])|[ÂÃ](?=[^\w\s.,;:!?)\"'’”»\-–—])|[ÐÑ](?=$|[ ÐÑ])")
_CONTROL = re.compile("[\x80-\x9f]")
#: One of these is in every line of which something is lost.
_MAY_BE_LOST = re.compile("[\x80-\x9fÂÃâÐÑ�]")


@lru_cache(None)
def _leads(encoding: str) -> frozenset[str]:
    """Characters with which a run can begin."""
    back = _sloppy(encoding)[1]
    return frozenset(back.get(b, chr(b)) for b in range(0xC2, 0xF5)) | frozenset(c for c, b in _sloppy(encoding)[0].items() if 0xC2 <= b <= 0xF4)


@lru_cache(1 << 16)
def _run_repair(run: str, encoding: str) -> str:
    """A run as the UTF-8 it was meant for, if that looks better."""
    raw = encode(run, encoding)
    try:
        new = raw.decode("utf-8") if raw else run
    except UnicodeDecodeError:
        return run
    if any(unicodedata.category(c) in ("Cn", "Co") for c in new):
        return run
    return new if cost(new) < cost(run) else run


def _repair_runs(line: str, now: float) -> tuple[str, str | None, float]:
    """Best single pass of repairs of UTF-8 runs of a line that costs ``now``, the encoding the line had been read as, and its cost."""
    best, best_cost, by = line, now, None
    limit = best_cost - RUN_DROP
    if limit < 0:  # no cost is below zero
        return best, by, best_cost
    chars = set(line)
    for encoding in READ_AS:
        if chars.isdisjoint(_leads(encoding)):  # no run can begin
            continue
        new = _runs(encoding).sub(lambda m, encoding=encoding: _run_repair(m[0], encoding), line)
        if new != line and (c := cost(new)) < best_cost and c <= limit:
            best, best_cost, by = new, c, encoding
            if c < 0.2 * (limit + RUN_DROP):  # nearly nothing odd is left
                break
    return best, by, best_cost


def _repair_swap(line: str, now: float) -> tuple[str, str | None, float]:
    if now < LINE_DROP:
        return line, None, now
    best, best_cost, by = line, now - LINE_DROP, None
    encoded = {read: encode(line, read) for read in dict.fromkeys(r for r, _ in SWAPS)}
    for read, meant in SWAPS:
        raw = encoded[read]
        if raw is None:
            continue
        try:
            new = raw.decode(meant)
        except UnicodeDecodeError:
            continue
        if (c := cost(new)) >= best_cost or c >= 0.7 * now:
            continue
        cyrillic = len(_CYRILLIC.findall(new))
        if not cyrillic or cyrillic >= sum("A" <= x.upper() <= "Z" for x in new) and not _unlikely_cyrillic(new):
            best, best_cost, by = new, c, f"{read}>{meant}"
    return best, by, best_cost


_ESCAPE = re.compile(r"(?:\\x[0-9a-fA-F]{2})+")


def _unescape(m: re.Match[str]) -> str:
    raw = bytes.fromhex(m[0].replace("\\x", ""))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace")


def _sound(line: str) -> bool:
    return line.isascii() and "\\x" not in line


_CYRILLIC = re.compile("[Ѐ-ӿ]")


def _peel(line: str, swaps: bool) -> tuple[str, list[str]]:
    """Undoes layers of wrong decodings while that makes the line look better."""
    how: list[str] = []
    now = cost(line)
    for _ in range(LAYERS):
        if how and QUIET.fullmatch(line):
            break
        new, by, left = _repair_runs(line, now)
        if swaps and not how and (by is None or left > 0.3 * now):
            other, swap, less = _repair_swap(line, now)
            if swap and (by is None or less < 0.5 * left):
                new, by, left = other, swap, less
        if by is None:
            break
        line, now = new, left
        how.append(by)
    return line, how


def repair_line(line: str) -> tuple[str, str | None]:
    """``(text, how)``: the line with what could be restored, and how; ``how`` is None for a sound line.

    ``lost`` means that characters were destroyed. Layers are named from the outermost.
    """
    escaped = "\\x" in line and _ESCAPE.search(line)
    if escaped:  # bytes that were written out instead of decoded
        line = _ESCAPE.sub(_unescape, line)
        new, how = repair_line(line)
        return new, "escaped" + (f"+{how}" if how else "")
    if line.isascii() or QUIET.fullmatch(line):
        return line, None
    if _PLAIN.fullmatch(line) and not ODD.search(line):
        return _CYRILLIC.search(line) and _other_cyrillic(line) or (line, None)
    plain = undisguise(line)
    if plain != line and _PLAIN.fullmatch(plain) and not ODD.search(plain):
        return line, None
    if (other := _other_script(line)) is not None:
        return other
    sound = line
    new, how = _peel(plain, True)
    if plain != line and _CYRILLIC.search(line):  # what looks like a disguise may be part of a sequence
        other, steps = _peel(line, False)
        if steps and cost(undisguise(other)) < cost(new):
            new, how = undisguise(other), steps
    # The no-break space of a garbled à had become a plain one.
    line = re.sub("Ã (?= |$)", "à", new) if how else new
    if _MAY_BE_LOST.search(line) and ("�" in line or _CONTROL.search(line) or _LOST.search(line)):
        how.append("lost")
    return (line, "+".join(how)) if how else (sound, None)


def repair_text(text: str) -> list[tuple[str, str | None]]:
    """``repair_line`` of every line; a swap found in two lines is also tried on the weaker cases beside them."""
    found = [(line, None) if _sound(line) else repair_line(line) for line in text.split("\n")]
    swaps = Counter(how for _, how in found if how and ">" in how and "+" not in how)
    lines = text.split("\n")
    for how, n in sorted(swaps.items(), key=lambda x: x[1]):
        if n < 2:
            continue
        read, meant = how.split(">")
        cyrillic = (read, meant) in _CYRILLIC_SWAPS
        for i, (line, old) in enumerate(found):
            if old and cyrillic and tuple(old.split(">")) in _CYRILLIC_SWAPS and swaps[old] < n:  # the page tells which swap a short line had
                new, gain = _reread(lines[i], read, meant)
                if gain > BESIDE:
                    found[i] = (new, how)
            elif old is None and not line.isascii() and (raw := encode(line, read)) is not None:
                try:
                    new = raw.decode(meant)
                except UnicodeDecodeError:
                    continue
                less, gain = cost(new) - cost(line), _reread(line, read, meant)[1] if cyrillic else 0.0
                if new != line and (less < -0.9 or less < 2 and (gain > BESIDE or gain >= 0 and _vowels(new) + 0.05 < _vowels(line) < 1)):
                    found[i] = (new, how)
    return found


def garbled_lines(pages: DataFrame, page_id: str = "page_id", text: str = "page_text") -> DataFrame:
    """``(page_id, line_no, original, restored, how)`` of lines garbled by a wrong decoding, from line 1.

    Only pages with characters beyond ASCII or with escaped bytes leave the JVM. Null and empty texts have no such lines;
    repeated rows give one result.
    """
    rows = pages.where(F.col(page_id).isNotNull() & F.col(text).rlike(r"[^\x00-\x7f]|\\x[0-9a-fA-F]{2}")).select(
        F.col(page_id).cast("long").alias("page_id"), F.col(text).alias("t")
    )
    schema = "page_id bigint, line_no int, original string, restored string, how string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, (line, (new, how)) in enumerate(zip(t.split("\n"), repair_text(t)), 1):
                    if how:
                        for column, value in zip(out, (i, n, line, new, how)):
                            column.append(value)
            types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["page_id", "line_no", "original", "restored", "how"])

    return rows.mapInArrow(find, schema).distinct()


def restored_pages(pages: DataFrame, page_id: str = "page_id", text: str = "page_text") -> DataFrame:
    """``(page_id, restored, garbled_lines, lost_lines)``: every page with its restored text.

    Of rows with one page_id the greatest text counts; a null text stays null.
    """
    rows = pages.where(F.col(page_id).isNotNull()).groupBy(F.col(page_id).cast("long").alias("page_id")).agg(F.max(text).alias("t"))
    schema = "page_id bigint, restored string, garbled_lines int, lost_lines int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            texts, bad, lost = [], [], []
            for t in batch.column(1).to_pylist():
                if t is None or _sound(t):
                    texts.append(t), bad.append(0), lost.append(0)
                    continue
                lines = repair_text(t)
                texts.append("\n".join(x for x, _ in lines))
                bad.append(sum(h is not None for _, h in lines))
                lost.append(sum(h is not None and h.endswith("lost") for _, h in lines))
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(bad, pa.int32()), pa.array(lost, pa.int32())], ["page_id", "restored", "garbled_lines", "lost_lines"])

    return rows.mapInArrow(run, schema)
