"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
contain. The texts of a batch are indexed (trigram to posting list, for the trigrams that the
queries name), postings are intersected and united as the query says, and only candidates are
verified with the expression. A rule without mandatory trigrams scans every text. The index is
built over whole texts, in lower case, segment by segment, so it never outgrows a batch.

Spans count code points, end exclusive; those of one kind are leftmost and do not overlap. A null
or empty text has none, and stays as it is. Rows that repeat, null ids and ties of kinds at one place
are each returned (spans by start, then kind); an empty table gives an empty table; long texts are
scanned whole; columns other than the text and the kept ones are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

MOST_STRINGS = 24


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = lambda m: True


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), f"{_either('api')}_?{_either('key')}"])
RULES = (
    SecretRule("assign", rf"(?:{_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: m.end(1) - m.start(1) >= 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20),
    SecretRule("hex", r"[0-9a-f]{24,}"),
    SecretRule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    SecretRule("hosted", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
)
BASE_KINDS = ("assign", "access", "hex")


# A query is True (any text), ("tri", code), or ("and" | "or", [queries]).
def _all(parts: list) -> object:
    parts = list(dict.fromkeys(x for p in parts if p is not True for x in (p[1] if p[0] == "and" else (p,))))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _trigrams(text: bytes) -> object:
    return _all([("tri", text[k] << 16 | text[k + 1] << 8 | text[k + 2]) for k in range(len(text) - 2)])


@dataclass
class _Seen:
    """What is known of the strings that a part matches: all of them, or those that they begin and end with; and a query."""

    exact: frozenset[bytes] | None
    head: frozenset[bytes]
    tail: frozenset[bytes]
    query: object


_NOTHING = frozenset([b""])


def _spill(s: _Seen) -> _Seen:
    """Give up on knowing all strings: they become a query, and short heads and tails."""
    if s.exact is None:
        return s
    return _Seen(None, frozenset(x[:2] for x in s.exact), frozenset(x[-2:] for x in s.exact), _all([s.query, _any([_trigrams(x) for x in s.exact])]))


def _then(a: _Seen, b: _Seen) -> _Seen:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _Seen(frozenset(x + y for x in a.exact for y in b.exact), _NOTHING, _NOTHING, _all([a.query, b.query]))
    ends, heads = a.exact or a.tail, b.exact or b.head
    across = _any([_trigrams(x + y) for x in ends for y in heads]) if len(ends) * len(heads) <= MOST_STRINGS**2 else True
    x, y = _spill(a), _spill(b)
    return _Seen(None, x.head, y.tail, _all([x.query, y.query, across]))


def _choice(parts: list[_Seen]) -> _Seen:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST_STRINGS:
        return _Seen(frozenset().union(*(p.exact for p in parts)), _NOTHING, _NOTHING, _any([p.query for p in parts]) if any(p.query is not True for p in parts) else True)
    parts = [_spill(p) for p in parts]
    return _Seen(None, frozenset().union(*(p.head for p in parts)), frozenset().union(*(p.tail for p in parts)), _any([p.query for p in parts]))


def _lower(code: int) -> bytes:
    return chr(code).encode().lower()


def _letters(items: list) -> frozenset[bytes] | None:
    out: set[bytes] = set()
    for op, arg in items:
        if op is rc.LITERAL:
            out.add(_lower(arg))
        elif op is rc.RANGE and arg[1] - arg[0] < 64:
            out.update(_lower(c) for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return frozenset(out) if len(out) <= MOST_STRINGS else None


def _look(parsed) -> _Seen:
    seen = _Seen(_NOTHING, _NOTHING, _NOTHING, True)
    for op, arg in parsed:
        if op is rc.LITERAL:
            one = _Seen(frozenset([_lower(arg)]), _NOTHING, _NOTHING, True)
        elif op is rc.IN and (known := _letters(arg)) is not None:
            one = _Seen(known, _NOTHING, _NOTHING, True)
        elif op is rc.SUBPATTERN:
            one = _look(arg[-1])
        elif op is rc.BRANCH:
            one = _choice([_look(x) for x in arg[1]])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            least, most, inner = arg
            body = _look(inner)
            if (least, most) == (0, 1):
                one = _choice([_Seen(_NOTHING, _NOTHING, _NOTHING, True), body])
            else:
                one = _Seen(None, _NOTHING, _NOTHING, True)
                for _ in range(min(least, 3)):
                    one = body if one.exact is None and one.query is True and one.head == _NOTHING else _then(one, body)
                if least:
                    one = _spill(one) if least != most or least > 3 else one
        elif op is rc.AT or op in (rc.ASSERT, rc.ASSERT_NOT):
            continue
        else:
            one = _Seen(None, _NOTHING, _NOTHING, True)
        seen = _then(seen, one)
    return seen


def trigram_query(pattern: str) -> object:
    """The Boolean query that every text with a match of ``pattern`` meets; True if there is none."""
    return _spill(_look(rp.parse(pattern))).query


def _named(query: object) -> set[int]:
    return set() if query is True else {query[1]} if query[0] == "tri" else set().union(*map(_named, query[1]))


class TrigramIndex:
    """Posting lists of a segment's texts, for the trigrams that are asked for."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray):
        """``wanted``: a flag for each of the 2**24 trigrams."""
        self.n = len(texts)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        if len(data) < 3:
            codes = docs = np.zeros(0, np.int64)
        else:
            wide = data.astype(np.int32)
            codes = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
            at = np.flatnonzero(wanted[codes])
            docs = np.searchsorted(ends, at, "right")
            inside = at + 3 <= ends[docs]
            codes, docs = codes[at[inside]], docs[inside]
        both = np.unique(codes.astype(np.int64) * (self.n + 1) + docs)
        codes, docs = both // (self.n + 1), both % (self.n + 1)
        heads, starts = np.unique(codes, return_index=True)
        self.postings = dict(zip(heads.tolist(), np.split(docs, starts[1:])))

    def search(self, query: object) -> np.ndarray:
        """Numbers of the texts that meet the query, in order."""
        if query is True:
            return np.arange(self.n)
        if query[0] == "tri":
            return self.postings.get(query[1], np.zeros(0, np.int64))
        found = None
        for part in query[1]:
            docs = self.search(part)
            found = docs if found is None else (np.intersect1d if query[0] == "and" else np.union1d)(found, docs)
            if query[0] == "and" and not len(found):
                break
        return found


class SecretScanner:
    def __init__(self, rules: tuple[SecretRule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        for _, _, query in self.rules:
            self.wanted[list(_named(query))] = True

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of every text, by start, then kind in the order of the rules."""
        index = TrigramIndex([(t or "").encode().lower() for t in texts], self.wanted)
        found: list[list] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(self.rules):
            for d in index.search(query).tolist():
                if texts[d]:
                    found[d] += [(m.start(), k, rule.kind, m.end()) for m in pattern.finditer(texts[d]) if rule.accept(m)]
        return [[(kind, start, end) for start, _, kind, end in sorted(x)] for x in found]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each stretch of overlapping spans replaced by the name of its first kind."""
    if not spans:
        return text
    out, last = [], 0
    runs: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: s[1:]):
        if runs and start < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], end)
        else:
            runs.append([kind, start, end])
    for kind, start, end in runs:
        out += [text[last:start], f"[{kind.upper()}]"]
        last = end
    return "".join([*out, text[last:]])


def find_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """The ``keep`` columns, ``spans`` (array of kind, start, end) and ``redacted`` of every row.

    Columns of ``keep`` named ``spans`` or ``redacted`` are left out.
    """

    def make():
        scanner = SecretScanner(rules)

        def work(cols):
            found = scanner.scan(cols[0])
            return [[[dict(zip(("kind", "start", "end"), s)) for s in x] for x in found], [redact(t, x) for t, x in zip(cols[0], found)]]

        return work

    return map_rows(docs, [text], "spans array<struct<kind:string,start:int,end:int>>, redacted string", make, keep=keep)


def secrets_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, ``base_sha256`` and ``spans`` as kind:start:end, comma-joined."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def make():
        scanner = SecretScanner()

        def work(cols):
            out: list[list] = [[] for _ in range(6)]
            for doc_id, spans in zip(cols[1], scanner.scan(cols[0])):
                said = [(k, f"{k}:{a}:{b}") for k, a, b in spans]
                base = ",".join(x for k, x in said if k in BASE_KINDS)
                row = (doc_id, *(sum(k == kind for k, _ in said) for kind in BASE_KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in said))
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return work

    return map_rows(docs, ["text", "doc_id"], schema, make)
