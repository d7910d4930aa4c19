"""Personal data behind disguises: transducers normalise a text while keeping where each character came from."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from termloom.llm import _vec

SCHEMA = "doc_id long, kind string, offset_begin int, offset_end int, value string, disguised boolean"

# Cyrillic and Greek letters that look like Latin ones; full-width forms and odd dashes are added below
_ALIKE = dict(
    zip(
        "аеорсухіјѕԁһԛԝкмтвнАВЕКМНОРСТХІЈЅУαοερνιτκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdhqwkmtbhABEKMHOPCTXIJSYaoepvitkABEZHIKMNOPTYX",
    )
)
_ALIKE |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
_ALIKE |= dict.fromkeys("‐‑‒–—−", "-") | {"　": " ", " ": " ", "∂": "d", "․": ".", "。": ".", "﹒": ".", "﹫": "@"}
_ALIKE |= {chr(b + i): str(i) for b in (0x0660, 0x06F0, 0x0966) for i in range(10)}
_HIDDEN = "​‌‍⁠﻿­"

_NUMBERS = {
    "0": "zero oh null cero zéro nul", "1": "one eins un uno", "2": "two zwei deux dos", "3": "three drei trois tres",
    "4": "four vier quatre cuatro", "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete",
    "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
_DIGIT = {w: d for d, ws in _NUMBERS.items() for w in ws.split()}
_WORD = "|".join(sorted(_DIGIT, key=len, reverse=True))

TRIGGER = (  # any text with an identifier, disguised or not, has one of these
    r"[0-9]|@|[\[({<]\s*(?:at|arroba|dot|punkt|punto|point)\s*[\])}>]|\b(?:dot|punkt|punto)\b"
    rf"|\b(?:{_WORD})[\s,-]+(?:{_WORD})[\s,-]+(?:{_WORD})\b|\b(?:at|arroba)\s+[a-z0-9-]+\.[a-z0-9-]|[Ͱ-ӿ{"".join(c for c in _ALIKE if not c.isascii())}]|[\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}\x{{ad}}]"
)

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])")
CARD = re.compile(r"(?<![\d.])(?:\d[ -]?){12,18}\d(?!\d)")
SSN = re.compile(r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)")
_DATE = r"\d{1,2}([ ./-])\d{1,2}\1(?:\d\d){1,2}(?![ ./-]?\d)"
PHONE = re.compile(  # + and a country's digits; a leading 0; or groups of 3 and 4 digits
    rf"(?<![\w.+])(?:\+\d{{1,3}}(?:[ .-]?\(\d{{1,4}}\))?(?:[ ./-]?\d){{4,12}}|(?!{_DATE})\(?0\d{{1,4}}\)?(?:[ ./-]?\d\d){{3,6}}\d?"
    r"|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{3,4}[ .-]?\d{3,4}(?:[ .-]?\d{2,4})?)(?![\w]|\.\d)"
)
_FOURS = re.compile(r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}")  # the shape of a card, whatever its check digit
_RANGE = re.compile(r"\d{4}[ -]\d{4}")  # years, pages, amounts; a phone only where the words before say so
KINDS = (("email", EMAIL), ("ip", IP), ("ssn", SSN), ("card", CARD), ("phone", PHONE))

_DIGITS = re.compile(rf"(?i)(?<!\w)(?:(?:{_WORD}|\d)[\s,-]+){{3,}}(?:{_WORD}|\d)(?!\w)")
_ONE = re.compile(rf"(?i)({_WORD}|\d)|[\s,-]+")
_BRACKET_AT = re.compile(r"(?i)[\[({<]\s*(?:at|arroba|@)\s*[\])}>]")
_BRACKET_DOT = re.compile(r"(?i)[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>]")
# an address is sought from its at sign outwards, so that every character is looked at a fixed number of times
_AT = re.compile(r"(?i)(?<!\S)(?:at|arroba)(?!\S)|@")
_HOST = re.compile(r"(?i)([a-z0-9-]+(?:(?:\s+(?:dot|punkt|punto)\s+|\.)[a-z0-9-]+)+)(?![\w])")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_PLAIN_HOST = re.compile(r"(?!www\.)[A-Za-z0-9.-]+\.[a-z]{2,6}$")
_SPOKEN_DOT = re.compile(r"(?i)\s+(?:dot|punkt|punto)\s+")
_VERSION = re.compile(r"(?i)\bv(?:er(?:sion)?)?\.? ?$")  # what stands before numbers that are no address
_CALL = re.compile(r"(?i)(?:phone|\btel|\bcall|fon|\bfax|mobile?|cell|appel|llam|ruf|number|num[ée]r|nummer)[^0-9]{0,12}$")


def _spaces(text: str, a: int, b: int) -> tuple[int, int]:
    """[a, b) with the white space around it."""
    while a and text[a - 1].isspace():
        a -= 1
    while b < len(text) and text[b].isspace():
        b += 1
    return a, b


def _local(text: str, end: int, floor: int) -> int:
    """Where the local part that ends at `end` begins: words of an address with "dot" spoken between them, not before floor."""
    begin = end
    while True:
        at = begin
        while at > floor and text[at - 1] in _LOCAL:
            at -= 1
        if at == begin:
            return begin if begin == end else _spaces(text, begin, begin)[1]
        begin = at
        a = _spaces(text, begin, begin)[0]
        dot = text[max(floor, a - 3) : a].lower()
        c = _spaces(text, max(floor, a - 3), a)[0]
        if a == begin or dot != "dot" or c == a - 3 or c <= floor or text[c - 1] not in _LOCAL:
            return begin
        begin = c


class Mapped:
    """A text and, for each of its characters, the source span [begin, end) that it stands for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.begin = np.arange(len(text), dtype=np.int32)
        self.end = self.begin + 1

    def rewrite(self, spans: list[tuple[int, int, str]]) -> None:
        """Replace disjoint ordered spans. Each new character stands for the whole span it replaces."""
        if not spans:
            return
        text, begin, end, at = [], [], [], 0
        for a, b, new in spans:
            text += [self.text[at:a], new]
            begin += [self.begin[at:a], np.full(len(new), self.begin[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.begin = np.concatenate([*begin, self.begin[at:]])
        self.end = np.concatenate([*end, self.end[at:]])


def normalise(text: str) -> Mapped:
    """Homoglyphs, hidden characters, spelled digits, then at/dot disguises, each as a transducer over the former's output."""
    m = Mapped(text.translate(str.maketrans(_ALIKE)))  # one character for one: offsets stay
    m.rewrite([(x.start(), x.end(), "") for x in re.finditer(f"[{_HIDDEN}]", m.text)])
    spans = []
    for run in _DIGITS.finditer(m.text):
        if not any(c.isalpha() for c in run.group()):
            continue
        for x in _ONE.finditer(m.text, run.start(), run.end()):
            spans.append((x.start(), x.end(), _DIGIT.get(x.group().lower(), x.group()) if x.group(1) else ""))
    m.rewrite(spans)
    for pattern, new in ((_BRACKET_AT, "@"), (_BRACKET_DOT, ".")):
        m.rewrite([(*_spaces(m.text, x.start(), x.end()), new) for x in pattern.finditer(m.text)])
    spans, done = [], 0
    for x in _AT.finditer(m.text):
        a, b = _spaces(m.text, x.start(), x.end())
        host = _HOST.match(m.text, b)
        if a < done or not host:
            continue
        begin = _local(m.text, a, done)
        while begin < a and not m.text[begin].isalnum():
            begin += 1
        if begin == a:
            continue
        local, right = m.text[begin:a], host.group(1)
        spoken = _SPOKEN_DOT.search(right)
        if x.group() == "@" and b - a == 1 and not spoken and not _SPOKEN_DOT.search(local):
            continue
        if x.group() != "@" and not spoken and not _PLAIN_HOST.match(right):
            continue  # "look at www.example.com" is no address
        spans += [(d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(m.text, begin, a)]
        spans.append((a, b, "@"))
        spans += [(d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(m.text, b, host.end())]
        done = host.end()
    m.rewrite(spans)
    return m


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[str, int, int, str, bool]]:
    """(kind, begin, end, normalised value, disguised) in order of place; spans are disjoint, earlier KINDS win."""
    m = normalise(text)
    out, taken = [], np.zeros(len(m.text) + 1, bool)
    for kind, pattern in KINDS:
        for x in pattern.finditer(m.text):
            a, b = x.span()
            value = x.group()
            digits = re.sub(r"\D", "", value)
            if taken[a:b].any():
                continue
            if kind == "card" and not luhn(digits) and not _FOURS.fullmatch(value):
                continue
            if kind == "ip" and _VERSION.search(m.text[max(0, a - 9) : a]):
                continue
            if kind == "phone" and _RANGE.fullmatch(value) and m.end[b - 1] - m.begin[a] == b - a and not _CALL.search(m.text[max(0, a - 32) : a]):
                continue
            if kind == "phone" and not (7 <= len(digits) <= 15 and (not value.isdigit() or len(digits) >= 10 or m.end[b - 1] - m.begin[a] != b - a)):
                continue
            taken[a:b] = True
            begin, end = int(m.begin[a]), int(m.end[b - 1])
            out.append((kind, begin, end, value, text[begin:end] != value))
    return sorted(out, key=lambda x: x[1:3])


def find(docs: DataFrame) -> DataFrame:
    """One row for each identifier (email, ip, ssn, card, phone) of each row of docs: its kind, the characters
    [offset_begin, offset_end) of the source text that it takes up, its normalised value, and whether it was disguised.

    Cards have a right check digit or are four groups of four; two groups of four digits are a phone only after a word like "call" or
    "tel", or if they were spelled; numbers after "v" or "version" are no ip. Time is linear in a text's length.

    Null and empty texts give no rows; texts are read whole; repeated rows give repeated results; a null doc_id is
    reported as null; other columns aren't read. A linear-time pattern over whole batches finds the texts that can hold an
    identifier at all; only those go through the transducers. A map: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column("text"), TRIGGER, ignore_case=True), False))
            rows = [(d, *x) for d, text in zip(maybe.column("doc_id").to_pylist(), maybe.column("text").to_pylist()) for x in detect(text)]
            if rows:
                d, k, b, e, v, g = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array(k), pa.array(b, pa.int32()), pa.array(e, pa.int32()), pa.array(v), pa.array(g)],
                    names=["doc_id", "kind", "offset_begin", "offset_end", "value", "disguised"],
                )

    return docs.select("doc_id", "text").mapInArrow(_vec.lean(run), SCHEMA)
