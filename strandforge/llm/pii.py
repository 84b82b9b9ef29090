"""Personal data: exact patterns, and disguised forms found in a normalised text and mapped back."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import map_rows, text_of

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The same matches as IP: one that fails from a run's first digit fails from the others too, so they needn't be tried.
_IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_AT_TAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else _DOUBLED[int(c)] for i, c in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """EMAIL.finditer, but led by the @ signs: the local part is what stands before one, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _AT_TAIL.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    found = [("email", s, e) for s, e in _emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP_RUNS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "ı": "i", "ɡ": "g",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", " ": " ", " ": " ", " ": " ",
}
#: Digit names of the corpus's languages.
DIGIT_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_HIDDEN = "​‌‍⁠﻿­"
_ODD = re.compile(r"[^\x00-\x7F]")
_WORDS = "|".join(sorted(DIGIT_NAMES, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORDS}|plus)(?:[\x20,.-]{{1,2}}(?:{_WORDS}|double|triple|[0-9]+|dot|point|punkt|punto)){{3,}}(?!\w)", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(plus)|(?:(double|triple)[\x20-])?({_WORDS})|[\x20,-]*(?:dot|point|punkt|punto)[\x20,-]*|[\x20,.-]+", re.IGNORECASE)
_LOOSE = re.compile(r"(?<![A-Za-z0-9])[0-9](?:[\x20-]?[0-9OolI]){3,}(?![A-Za-z0-9])")
_HOST = r"[A-Za-z0-9-]+"
_BRACKETED = re.compile(r"[\x20]?[\[({<]\x20?(?:(at|@|ät|arroba|arobase)|dot|\.|punkt|punto|point)\x20?[\])}>][\x20]?|(&#64;|&#x40;|&commat;)|&#46;|&#x2e;|&period;", re.IGNORECASE)
_DOT = r"(?:\x20+dot\x20+|_dot_|\x20\.\x20|\.)"
#: Top-level names, those of countries and common others.
_TOP = frozenset(
    "com org net edu gov mil int io info biz name pro mobi tel jobs travel museum coop aero asia cat post xxx arpa example app dev xyz online site shop store tech cloud blog club agency email live life news world today group media digital academy wiki page ngo bank berlin hamburg koeln bayern wien zuerich paris bzh eus gal london scot wales nyc tokyo swiss "
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
#: Top-level names that are words too: after a full stop between blanks they begin a sentence.
_TOP_WORDS = frozenset("am an as at be by do et eu id ie il im in int is it je la ma me my name na ne no news page post pro re sa se so st su to today us va world group life live site store shop travel jobs bank".split())
#: ``at the dot on the map``: no host.
_NO_HOST = frozenset("a an the this that these those each every any one its his her their our my your der die das den dem ein eine einen einem le la les un une el los las una".split())
_WORDED = re.compile(rf"(?<=[A-Za-z0-9_%+-])(\x20+at\x20+|_at_|\x20*@\x20*)({_HOST}(?:{_DOT}{_HOST})*?)({_DOT})([A-Za-z]{{2,}})(?![A-Za-z0-9-]|(?:\x20+dot\x20+|_dot_)[A-Za-z0-9]|\.[A-Za-z0-9]|\x20\.\x20(?:com|org|net|edu|gov|[a-z]{{2}})(?![A-Za-z0-9-]))", re.IGNORECASE)
_TRIGGER = re.compile(r"[\[({<]\x20?(?:at|@|ät|arroba|arobase|dot|\.|punkt|punto|point)\x20?[\])}>]|\x20dot\x20|_dot_|\x20@|@\x20|&#(?:64|46|x40|x2e);|&commat;|&period;", re.IGNORECASE)


def _edit_odd(text: str) -> list[tuple[int, int, str]]:
    """Homoglyphs, full-width forms and hidden characters, one source character each."""
    edits = []
    for m in _ODD.finditer(text):
        c = m[0]
        if c in _HIDDEN:
            edits.append((m.start(), m.end(), ""))
        elif c in LOOKALIKES:
            edits.append((m.start(), m.end(), LOOKALIKES[c]))
        elif c.isdecimal():
            edits.append((m.start(), m.end(), str(unicodedata.decimal(c))))
        elif not "À" <= c <= "ɏ" and (n := unicodedata.normalize("NFKC", c)).isascii() and n != c:
            edits.append((m.start(), m.end(), n))
    return edits


def _edit_spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        for p in _SPELLED_PART.finditer(text, m.start(), m.end()):
            if p[1]:
                edits.append((p.start(), p.end(), "+"))
            elif p[3]:
                edits.append((p.start(), p.end(), DIGIT_NAMES[p[3].lower()] * {"double": 2, "triple": 3}.get((p[2] or "").lower(), 1)))
            elif any(c.isalpha() for c in p[0]):
                edits.append((p.start(), p.end(), "."))
            elif "." not in p[0]:
                edits.append((p.start(), p.end(), ""))
    return edits


def _edit_loose(text: str) -> list[tuple[int, int, str]]:
    """O, o, l and I among digits: runs that begin with a digit and are mostly digits."""
    edits = []
    for m in _LOOSE.finditer(text):
        odd = [i for i in range(m.start(), m.end()) if text[i] in "OolI"]
        if odd and 3 * len(odd) <= m.end() - m.start():
            edits += [(i, i + 1, "0" if text[i] in "Oo" else "1") for i in odd]
    return edits


def _edit_at(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if m[1] or m[2] else ".") for m in _BRACKETED.finditer(text)]


def _is_address(sign: str, host: str, dot: str, top: str) -> bool:
    """Whether ``name<sign>host<dot>top`` is an address: any last label where both signs are explicit, else a top-level name."""
    top, spelled = top.lower(), "dot" in dot.lower()
    if spelled:  # a pronoun or an article is no host, unless a top-level name tells
        return _NO_HOST.isdisjoint(re.split(_DOT, host.lower())) or top in _TOP and top not in _TOP_WORDS
    if "@" in sign:
        return dot != "." and sign != "@" or top in _TOP
    return top in _TOP and (dot == "." or top not in _TOP_WORDS)


def _edit_worded(text: str) -> list[tuple[int, int, str]]:
    """``name at host dot com``: worded or spaced signs."""
    edits, at = [], 0
    while m := _WORDED.search(text, at):
        at = m.end(1)
        if _is_address(m[1], m[2], m[3], m[4]):
            at = m.end()
            edits.append((m.start(1), m.end(1), "@"))
            for d in re.finditer(_DOT, m[2] + m[3], re.IGNORECASE):
                edits.append((m.start(2) + d.start(), m.start(2) + d.end(), "."))
    return edits


class Transduced:
    """A text after edits, with the way back: every piece of it knows the source span that it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.source = [0], [(0, True)]  # of a piece: its start here; its start in the source, whether it is copied
        self.length = len(text)

    def back(self, at: int, end: bool) -> int:
        """Source place of the character at ``at``: its start, or with ``end`` its end."""
        k = bisect_right(self.starts, at) - 1
        src, copied = self.source[k]
        if copied:
            return src + at - self.starts[k] + end
        return (self.source[k + 1][0] if k + 1 < len(self.source) else self.length) if end else src

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the spans; they are ascending and do not overlap."""
        if not edits:
            return
        out, starts, source, here, last = [], [], [], 0, 0

        def copy(a: int, b: int) -> None:
            nonlocal here
            at = a
            while at < b:
                k = bisect_right(self.starts, at) - 1
                stop = min(b, self.starts[k + 1]) if k + 1 < len(self.starts) else b
                src, copied = self.source[k]
                starts.append(here)
                source.append((src + at - self.starts[k], True) if copied else (src, False))
                here += stop - at
                at = stop
            out.append(self.text[a:b])

        for a, b, new in edits:
            copy(last, a)
            starts.append(here)
            source.append((self.back(a, False), False))
            out.append(new)
            here += len(new)
            last = b
        copy(last, len(self.text))
        starts.append(here)  # the end
        source.append((self.length, True))
        self.text, self.starts, self.source = "".join(out), starts, source


def deobfuscate(text: str) -> Transduced:
    """Homoglyphs, spelled digits and at/dot disguises, in this order, each a transducer over the result so far."""
    t = Transduced(text)
    if not text.isascii():
        t.apply(_edit_odd(t.text))
    t.apply(_edit_spelled(t.text))
    t.apply(_edit_loose(t.text))
    if _TRIGGER.search(t.text):
        t.apply(_edit_at(t.text))
        t.apply(_edit_worded(t.text))
    return t


def find_pii(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans): the exact patterns' spans stay; a disguised one is added where it overlaps none of its kind."""
    base = detect(text)
    t = deobfuscate(text)
    if t.text == text:
        return base, base
    spans = list(base)
    for kind, s, e in detect(t.text):
        s, e = t.back(s, False), t.back(e - 1, True)
        if not any(k == kind and a < e and s < b for k, a, b in spans):
            spans.append((kind, s, e))
    return base, sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


def _digest(text: str) -> tuple:
    base, spans = find_pii(text)
    join = lambda x: ",".join(f"{k}:{s}:{e}" for k, s, e in x)
    n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
    return *n, hashlib.sha256(join(base).encode()).hexdigest(), join(spans)


def scan_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    Counts and digest are of the exact patterns; spans also has the disguised identifiers, at their places in the source.
    Null counts as empty; an empty text has no spans; a very long one is read whole, and no span is bounded in length.  Base spans of one
    kind never overlap; those of different kinds may, and an added span is dropped where it overlaps one of its own kind.  Spans come by
    kind and then start, so equal starts of different kinds tie by kind.  Repeated rows give as many rows, null ids are kept, an
    empty table gives an empty result, extra columns of any name are ignored.
    """
    return map_rows(docs.select(text_of().alias("text"), F.col("doc_id").cast("long")), _digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", 1)


def mask(text: str) -> str:
    """The text with every span, overlaps joined, replaced by its kind's tag."""
    out, last = [], 0
    for kind, s, e in sorted(find_pii(text)[1], key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"<{kind}>"]
        last = max(last, e)
    return "".join(out) + text[last:]


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with masked texts; n_chars follows where the table has it.

    A null text stays null and an empty one empty; a very long one is masked whole.  Of overlapping spans the one that starts first (of
    equal starts the longest) gives the tag, and the others' places go with it.  Repeated rows are masked each, a null id doesn't
    matter, an empty table gives an empty one, and all columns are kept, whatever their names.
    """
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                old = b.column(names.index("text")).to_pylist()
                new = [None if x is None else mask(x) for x in old]
                cols = list(b.columns)
                cols[names.index("text")] = pa.array(new, b.schema.field("text").type)
                if "n_chars" in names:
                    n = b.column(names.index("n_chars")).to_pylist()
                    cols[names.index("n_chars")] = pa.array([k if y is None or x == y else len(y) for k, x, y in zip(n, old, new, strict=True)], b.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, schema)
