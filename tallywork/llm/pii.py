"""Personal data with offsets in the source text, in plain and in disguised form.

The base detectors find emails, addresses of machines, payment cards and phone numbers by fixed patterns. Then a
transducer rewrites look-alike letters, spelled digits and at/dot disguises and records for every character that it
emits the source span it came from; the same detectors run over what it emits and their spans are mapped back.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallywork.llm.shared import documents

QUERY = "op6_pii"
ORACLE_SQL = None
KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: linear in the text, however long its words are."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _at_most_255(digits: str) -> bool:
    digits = digits.lstrip("0") or "0"
    return len(digits) <= 3 and int(digits) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base detectors, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_at_most_255, m.groups()))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# Look-alikes of Latin letters in the Cyrillic, Greek, Armenian and Cherokee blocks, and small capitals.
_LOOKALIKES = dict(zip("асеорхуіјѕһԁԛԝАВСЕНІЈКМОРЅТХУαονικΑΒΕΖΗΙΚΜΝΟΡΤΥΧօսհոցզՕՍᎪᎬᎻᎷᏢᏒᎢᏔᏃᏙɑɡıʟɪɴʀʏ", "aceopxyijshdqwABCEHIJKMOPSTXYaovikABEZHIKMNOPTYXouhngqOUAEHMPRTWZVagilinry", strict=True))
_UNSEEN = "­​‌‍⁠﻿"
_SPELLED = {w: str(d) for d, names in enumerate(("zero oh null cero zéro", "one eins uno un", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")) for w in names.split()}
_NUMBER_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_RUN_GAP = r"(?:[\s,\-]+|\s*(?:\bdot\b|\bpoint\b|\[dot\]|\(dot\))\s*)"
#: At least four spelled digits in a row, each after white space, a comma, a hyphen or a spelled dot.
_SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:plus[\s,\-]+)?(?:{_NUMBER_WORD})(?!\w)(?:{_RUN_GAP}(?:{_NUMBER_WORD})(?!\w)){{3,}}")
_SPELLED_PART = re.compile(rf"(?i)(plus[\s,\-]*)|({_NUMBER_WORD})(?!\w)|(\s*(?:\bdot\b|\bpoint\b|\[dot\]|\(dot\))\s*)|([\s,\-]+)")
_AT_MARK = re.compile(r"(?i)(?:\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\}|<\s*at\s*>)\s*")
_DOT_MARK = re.compile(r"(?i)(?:\[\s*(?:dot|\.)\s*\]|\(\s*(?:dot|\.)\s*\)|\{\s*(?:dot|\.)\s*\}|<\s*dot\s*>)\s*")
#: The bare words count only together: name at host dot domain.
_BARE = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(\s+at\s+|\s*@\s*|\s*[\[({<]\s*at\s*[\])}>]\s*)([A-Za-z0-9-]+)((?:(?:\s+dot\s+|\.)[A-Za-z0-9-]+\b)+)")
_BARE_DOT = re.compile(r"(?i)\s+dot\s+")
#: Last labels that count after any host; others not after a bare "at" and one of the words below, as in "look at the dot now".
_USUAL = frozenset("com org net edu gov info biz eu de fr es uk co us io ai me dev app".split())
_NO_HOST = frozenset("a an the this that these those it its my your his her our their each every any some no one which what".split())
#: Before a bare "at" and a host with plain dots: a name with a digit or a sign, or one of these words just before it.
_CUE = re.compile(r"(?i)\b(?:e-?mails?|mails?|contact|reach|write|address|courriel|correo|kontakt)\b[\s:,]+(?:(?:me|us|him|her|them|to|is|an|at)[\s:]+){0,2}$")
_PLAIN_AT = re.compile(r"(?:\sat\s+|\s@\s*|@\s+)[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,4}\b")
_ODD = re.compile("[" + "".join(_LOOKALIKES) + _UNSEEN + "\u0300-\u036f！-～٠-٩۰-۹०-९\u2100-\u214f\U0001d400-\U0001d7ff]")


def _plain(char: str) -> str:
    """First transducer: one source character to one plain character, or to nothing."""
    if char in _UNSEEN or "\u0300" <= char <= "\u036f":
        return ""
    if char in _LOOKALIKES:
        return _LOOKALIKES[char]
    if "！" <= char <= "～":
        return chr(ord(char) - 0xFEE0)
    if not char.isascii() and (digit := unicodedata.digit(char, None)) is not None and char.isdecimal():
        return str(digit)
    if "\u2100" <= char <= "\u214f" or "\U0001d400" <= char <= "\U0001d7ff":  # letters of formulas
        folded = unicodedata.normalize("NFKC", char)
        return folded if len(folded) == 1 and folded.isascii() else char
    return char


class Traced:
    """A text and, for each of its characters, the source span that it stands for."""

    def __init__(self, chars: list[str], starts: list[int], ends: list[int]):
        self.text, self.starts, self.ends = "".join(chars), starts, ends

    @classmethod
    def of(cls, text: str) -> Traced:
        if not _ODD.search(text):
            return cls([text], list(range(len(text))), list(range(1, len(text) + 1)))
        kept = [(p, i) for i, c in enumerate(text) if (p := _plain(c))]
        return cls([p for p, _ in kept], [i for _, i in kept], [i + 1 for _, i in kept])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Replace [a, b) by a text of at most one character, for edits in order that don't overlap."""
        chars, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            if a < at:
                continue
            chars.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                chars.append(new)
                starts.append(self.starts[a])
                ends.append(self.ends[b - 1])
            at = b
        chars.append(self.text[at:])
        return Traced(chars, starts + self.starts[at:], ends + self.ends[at:])


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _SPELLED_RUN.finditer(text):
        for part in _SPELLED_PART.finditer(text, run.start(), run.end()):
            new = "+" if part[1] else _SPELLED[part[2].lower()] if part[2] else "." if part[3] else ""
            edits.append((part.start(), part.end(), new))
    return edits


def _is_address(text: str, m: re.Match) -> bool:
    """Whether a match of _BARE is an address: its last label is a word of letters, and its parts don't read as prose."""
    bare = m[1].strip().lower() == "at"
    last = re.split(r"(?i)\s+dot\s+|\.", m[3])[-1].lower()
    if not (len(last) >= 2 and last.isalpha()):
        return False
    usual = last in _USUAL
    if _BARE_DOT.search(m[3]):
        return usual or not (bare and m[2].lower() in _NO_HOST)
    name = m[0][: m.start(1) - m.start()]
    if m[1].strip() == "@":
        return m[1] != "@" and (usual or len(last) == 2)
    return bare and (usual or len(last) == 2) and (not name.isalpha() or _CUE.search(text, max(0, m.start() - 40), m.start()) is not None)


def _addresses(text: str) -> Iterator[re.Match]:
    """Matches of _BARE that are addresses."""
    m = _BARE.search(text)
    while m:
        held = _is_address(text, m)
        if held:
            yield m
        m = _BARE.search(text, m.end() if held else m.start(1))


def _disguised(text: str) -> list[tuple[int, int, str]]:
    edits = {}
    for m in _addresses(text):
        edits[m.span(1)] = "@"
        for dot in _BARE_DOT.finditer(text, *m.span(3)):
            edits[dot.span()] = "."
    for mark, new in ((_AT_MARK, "@"), (_DOT_MARK, ".")):
        for m in mark.finditer(text):
            start = m.start()
            while start and text[start - 1].isspace():
                start -= 1
            edits[start, m.end()] = new
    return [(a, b, new) for (a, b), new in sorted(edits.items())]


def added(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that show only after normalisation, in source offsets; none lies inside a base span of its kind."""
    low = text.lower()
    marked = "dot" in low or any(c in text for c in "[({<") and (_AT_MARK.search(text) or _DOT_MARK.search(text))
    # A run of four spelled digits has two inner words with nothing but separators around them.
    spelled = sum(w in _SPELLED for w in low.replace(",", " ").replace("-", " ").split()) >= 2
    if not marked and not spelled and not _PLAIN_AT.search(low) and (text.isascii() or not _ODD.search(text)):
        return []
    traced = Traced.of(text)
    for stage in (_spelled, _disguised):
        traced = traced.rewrite(stage(traced.text))
    taken = [[(a, b) for a, kind, b in base if kind == k] for k in range(len(KINDS))]
    out = set()
    for a, kind, b in detect(traced.text):
        start, end = traced.starts[a], traced.ends[b - 1]
        if not any(x <= start and end <= y for x, y in taken[kind]):
            out.add((start, kind, end))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, all spans and how many the transducer added.

    Offsets are code points of the source, ends exclusive. Null and empty texts have no spans. Null ids and repeated
    rows pass through; other columns are not read. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = detect(text)
                more = added(text, base)
                counts = [sum(s[1] == k for s in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
