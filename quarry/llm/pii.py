"""PII detection with offset-preserving deobfuscation.

Base spans are found in the text itself.  Then a transducer rewrites the text, symbol by
symbol, and keeps for every symbol that it writes the range of source characters it
stands for:

* homoglyphs and full-width forms become their ASCII look-alikes,
* runs of spelled digits ("four two zero", "+49 30 one two three") become digits, spelled
  or written " dot " between them becomes a dot,
* "[at]", "(@)", " at " and their dot counterparts become @ and ".".

The same detectors run over the rewritten text, and a hit's span is mapped back to the
source characters.  A mapped span is added unless a base span of its kind contains it;
base spans stay as they are.  What may be prose is left alone: plain-word disguises need a
top-level domain (of the longer ones those of a list, of two letters any that isn't an
English word), " at " before a written domain ("jane at example.org") a name that stands
first, behind punctuation or behind a word such as "mail", and spelled digits three of
their kind in a run of eight digits or of four parts of an address.

Every text is treated whole, in linear time: detectors start at "@", "+" or the head of a
digit run, and quantifiers that could back up over a long run are possessive.

Defined results: null and empty texts have no spans; rows of equal ids are judged one by
one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.text import table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: From the head of a digit run only; the first digit comes before that test, as the
#: search for a plain character is fast.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
               for p in m.group().split(".")):
            yield "ip", m.start(), m.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            yield "phone", m.start(), m.end()


def detect(text: str) -> list[Span]:
    """Spans by kind as listed, then by start."""
    found: list[Span] = []
    if "@" in text:
        found += _emails(text)
    if "." in text:
        found += _ips(text)
    found += _cards(text)
    if "+" in text:
        found += _phones(text)
    return found


# Letters that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u",
    "О": "O", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "․": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-",
}
_FORMS = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
_DIGIT_FORMS = {chr(base + i): str(i) for base in (0x0660, 0x06F0, 0x0966) for i in range(10)}
LOOKALIKES = HOMOGLYPHS | _FORMS | _DIGIT_FORMS
#: Written as nothing: zero-width characters and the soft hyphen.
INVISIBLE = "​‌‍⁠﻿­"
_LOOK = re.compile("[" + "".join(map(re.escape, [*LOOKALIKES, *INVISIBLE])) + "]")

# Spelled digits of the four languages of the corpus.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9", "plus": "+",
}
#: Letters that patterns without case take for i and s, but lower() does not.
_FOLD = str.maketrans("İıſ", "iis")
_NUMBER = "|".join(sorted(SPELLED, key=len, reverse=True))
#: Spelled and written digits in a row; " dot " may stand between them, as in addresses.
_SAID = rf"(?:(?:{_NUMBER})(?!\w)|\+?[0-9]{{1,19}}(?!\w))"
_SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:\+ ?)?{_SAID}(?:(?:[ ,-]{{1,2}}| dot ){_SAID})++")
_SPELLED_PART = re.compile(rf"(?i)(?P<said>(?:{_NUMBER})(?!\w))|(?P<digits>\+?[0-9]+)|(?P<dot> dot )")
#: Three spelled digits with nothing but digits and dots between them, as a row of classes.
_THREE_SAID = re.compile(rb"S[D.]*S[D.]*S")
_APART = str.maketrans(dict.fromkeys(",.;:!?()[]{}<>\"'-+", " "))

_BRACKETED = re.compile(r"(?i)[\[({<][ ]?(at|dot|@|\.)[ ]?[\])}>][ ]?")
# Words that no disguised domain starts with; longer top-level domains and
# words of two letters that are none (the others are taken for countries); words that
# stand before "at" in prose, and words that announce an address.
ARTICLES = "the|a|an|this|that|these|those|our|their|his|her|my|your|its|any|every|each"
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|app|dev|xyz|online|shop|tech|cloud|blog|store"
NO_COUNTRIES = "an|go|he|hi|if|of|oh|ok|on|or|ox|up|we"
BEFORE_AT = frozenset(
    "look looking looked available hosted found find visit us me it them him her you here there "
    "more see live lives stay meet arrive arrived work works working home page site website code "
    "docs documentation download downloads read online start starts shop published posted listed "
    "is are was were be been and or not good bad best stare staring shout laugh point aim "
    "register sign login store stored located information details news".split())
_CUE = re.compile(r"(?i)(?:\A|[\n:;,(<][ ]?|(?<!\w)(?:e-?mail|mail|contact|reach|write|address|to|"
                  r"from)[ ])(?P<local>[\w.%+-]{1,64})\Z")
_TOP = rf"(?:(?:{TOP_DOMAINS})|(?!(?:{NO_COUNTRIES})(?!\w))[a-z]{{2}})(?![\w/@]|\.\w)"
_DOT = r"(?: dot |\.| ?[\[({<] ?(?:dot|\.) ?[\])}>] ?)"
_NAME = rf"(?!(?:{ARTICLES}) )[\w-]{{1,63}}(?P<dots>(?:{_DOT}[\w-]{{1,63}}){{0,3}}{_DOT}){_TOP}"
_PLAIN = re.compile(
    rf"(?i)(?<![\w.%+@-])[\w.%+-]{{1,64}}(?P<at> at |@| ?[\[({{<] ?(?:at|@) ?[\])}}>] ?){_NAME}")
_DOMAIN_NAME = re.compile(rf"(?i){_NAME}")
_SAID_DOT = re.compile(r"(?i) dot ")

Edit = tuple[int, int, str]


def _plain_words(text: str, low: str) -> Iterator[Edit]:
    """Edits of " at " and " dot " in addresses said in plain words."""
    if " dot " in low:
        for m in _PLAIN.finditer(text):
            lo, hi = m.span("dots")
            dots = list(_SAID_DOT.finditer(text, lo, hi))
            if not dots:
                continue
            if m["at"].lower() == " at ":
                yield m.start("at"), m.end("at"), "@"
            for d in dots:
                yield d.start(), d.end(), "."
    # with a written dot it may be prose ("look at example.org"): a name alone or announced
    for word in (" at ", " AT ", " At "):
        at = text.find(word)
        while at >= 0:
            m = _DOMAIN_NAME.match(text, at + 4)
            if m and not _SAID_DOT.search(m["dots"]):
                local = _CUE.search(text[max(0, at - 80):at])
                hidden = set(m["dots"]) & set("[({<")
                before = local["local"] if local else ""
                if (hidden or before) and (before or text[at - 1:at]).lower() not in BEFORE_AT:
                    yield at, at + 4, "@"
            at = text.find(word, at + 3)


def _spelled(text: str, low: str) -> Iterator[Edit]:
    """Edits that write spelled digits as digits, joined with digits beside them."""
    words = low.translate(_APART).split()
    if sum(map(SPELLED.__contains__, words)) < 3:
        return
    classes = bytes(83 if w in SPELLED else 68 if w.isdigit() else 46 if w == "dot" else 95
                    for w in words)
    if not _THREE_SAID.search(classes):
        return
    for run in _SPELLED_RUN.finditer(text):
        parts = list(_SPELLED_PART.finditer(text, run.start(), run.end()))
        said = {p.start(): SPELLED[p["said"].translate(_FOLD).lower()] for p in parts if p["said"]}
        n = sum(v != "+" for v in said.values()) + sum(len(_digits(p["digits"]))
                                                       for p in parts if p["digits"])
        if len(said) < 3 or (n < 8 and sum(p["dot"] is not None for p in parts) < 3):
            continue
        plus = text[run.start()] == "+" and parts[0].start() > run.start()
        last = run.start() + 1 if plus else parts[0].start()
        for p in parts:
            if p["said"]:
                yield last, p.end(), said[p.start()]
            elif p["dot"]:
                yield p.start(), p.end(), "."
            elif last < p.start():
                yield last, p.start(), ""
            last = p.end()


def _rewrites(text: str) -> list[Edit]:
    """(start, end, replacement) in order, without overlaps; the leftmost, then the
    longest of the transducers' edits wins."""
    edits: list[Edit] = []
    if not text.isascii():
        edits += [(m.start(), m.end(), LOOKALIKES.get(m.group(), "")) for m in _LOOK.finditer(text)]
        low = text.translate(_FOLD).lower()
    else:
        low = text.lower()
    if any(c in text for c in "[({<"):
        edits += [(m.start() - (text[max(m.start() - 1, 0):m.start()] == " "), m.end(),
                   "@" if m.group(1).lower() in ("at", "@") else ".")
                  for m in _BRACKETED.finditer(text)]
    edits += _plain_words(text, low)
    edits += _spelled(text, low)
    edits.sort(key=lambda e: (e[0], -e[1]))
    out, end = [], 0
    for e in edits:
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


class Offsets:
    """Source ranges of the characters of a rewritten text: three numbers for each edit."""

    def __init__(self, edits: list[Edit]):
        self.at, self.start, self.end = array("q"), array("q"), array("q")
        shift = 0
        for start, end, new in edits:  # `at` is where the edit's text begins in the rewritten one
            self.at.append(start + shift)
            self.start.append(start)
            self.end.append(end)
            shift += len(new) - (end - start)
        self.length = array("q", (len(new) for _, _, new in edits))

    def source(self, i: int) -> tuple[int, int]:
        """[lo, hi) in the source of character ``i`` of the rewritten text."""
        k = bisect_right(self.at, i) - 1
        if k < 0:
            return i, i + 1
        past = i - self.at[k] - self.length[k]
        if past < 0:
            return self.start[k], self.end[k]
        return self.end[k] + past, self.end[k] + past + 1


def transduce(text: str, edits: list[Edit]) -> str:
    """The text with its edits made."""
    parts, at = [], 0
    for start, end, new in edits:
        parts += (text[at:start], new)
        at = end
    parts.append(text[at:])
    return "".join(parts)


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, as source spans."""
    edits = _rewrites(text)
    if not edits:
        return []
    plain, offsets = transduce(text, edits), Offsets(edits)
    # base spans of a kind are disjoint: only the last that starts at or before can contain
    taken = {kind: sorted((s, e) for k, s, e in base if k == kind) for kind in KINDS}
    out: list[Span] = []
    for kind, s, e in detect(plain):
        start, end = offsets.source(s)[0], offsets.source(e - 1)[1]
        i = bisect_right(taken[kind], (start, len(text) + 1))
        if not i or taken[kind][i - 1][1] < end:
            out.append((kind, start, end))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in
                    sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column("text"):
            text = text.as_py() or ""
            base = detect(text)
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            rows.append((*n, digest, _joined([*base, *hidden_spans(text, base)])))
        made = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(c, t) for c, t in zip(made, types, strict=True))],
            names=[b.schema.names[0], *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def find_pii(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, the counts of base spans, their digest and all spans of each row."""
    d = docs.select(key, "text")
    kind = d.schema[key].dataType.simpleString()
    return d.mapInArrow(_scan, f"`{key}` {kind}, n_email bigint, n_ip bigint, n_card bigint, "
                               "n_phone bigint, base_sha256 string, spans string")


def query(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))
