"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Spans count code points, end exclusive. Those of one kind are leftmost and do not overlap. A null or
empty text has none. Rows that repeat and null ids are each returned; an empty table gives an empty table;
columns other than the text and the kept ones are not read. Every pattern is scanned in time linear in the text, however long a run of its
characters is.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import map_rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
MIN_SCORE = 0.5
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
# Words near a span that speak for its kind.
_NEAR = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
_PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The Luhn checksum of a string of ASCII digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return bool(digits) and total % 10 == 0


def mod97(code: str) -> bool:
    """The ISO 7064 mod-97 check of an IBAN without spaces."""
    rest = 0
    for c in code[4:] + code[:4]:
        value = int(c, 36)
        rest = (rest * (100 if value > 9 else 10) + value) % 97
    return rest == 1


def _emails(text: str):
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield m.span()


def _ssns(text: str):
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = re.findall(r"[a-z]+", (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower())
    return min(1.0, _PRIOR[kind] + 0.3 * any(w.startswith(x) for w in near for x in _NEAR[kind]))


def find(text: str | None) -> list[Span]:
    """All confirmed spans by kind as in KINDS, then start; kinds beyond the base ones need MIN_SCORE."""
    out: list[Span] = []
    if not text:
        return out
    digits = _DIGIT.search(text) is not None
    for kind in KINDS:
        if "@" not in text if kind == "email" else not digits:
            continue
        for start, end in _FIND[kind](text):
            score = _score(kind, text, start, end)
            if kind in BASE_KINDS or score >= MIN_SCORE:
                out.append(Span(kind, start, end, score))
    return out


SCHEMA = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns (but for one named ``spans``) and ``spans``, an array of (kind, start, end, score), of every row."""

    def make():
        return lambda cols: [[[vars(s) for s in find(t)] for t in cols[0]]]

    return map_rows(docs, [text], f"spans {SCHEMA}", make, keep=keep)


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, ``base_sha256`` and ``spans`` as kind:start:end, comma-joined."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def row(text):
        spans = find(text)
        said = [(s.kind, f"{s.kind}:{s.start}:{s.end}") for s in spans]
        base = ",".join(x for k, x in said if k in BASE_KINDS)
        return (*(sum(k == kind for k, _ in said) for kind in BASE_KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in said))

    def make():
        return lambda cols: [cols[1], *map(list, zip(*map(row, cols[0])))] if cols[0] else [[] for _ in range(7)]

    return map_rows(docs, ["text", "doc_id"], schema, make)
