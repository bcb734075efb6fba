"""Byte-level BPE through a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the encoding of a piece exactly if every token encodes to itself and every two
neighbours encode, put together, to just these two. So reading left to right, each prefix has one
last token, and a token can be written as soon as all positions at which a longer token may still
begin agree on it: lookahead is bounded by the longest token. The transducer's states hold these
positions; they and their moves are made when first needed and kept in a table of bounded size.

A null or empty text has no tokens. Texts are encoded whole. Rows that repeat and null ids are each
returned; an empty table gives an empty table; columns other than the text and the kept ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import regex
from pyspark.sql import DataFrame

from .common import map_rows

MOST_STATES = 150_000
MOST_PAIRS = 400_000
MOST_PIECES = 100_000
MOST_WORDS = 500_000
# Fixed value: the public tokenizers' pattern, by which a piece begins at every single space between other characters.
CUT_AT_LONE_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNKNOWN = "\ufffd".encode()
_BYTES = [bytes((b,)) for b in range(256)]
_SPACES = re.compile(r"\A | \Z| \s|\s ")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        heads = {t[:n] for t in ranks for n in range(1, len(t))}
        self.known = {s: (ranks.get(s), s in heads) for s in heads | ranks.keys()}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())})

    def merge(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """Encoding by the definition: merge the neighbours of lowest rank (under ``below``), the leftmost first."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], below))
            if self.ranks.get(parts[best] + parts[best + 1], below) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]


class Neighbours:
    """Which tokens may follow each other, read off the order in which merges make them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.known: dict[int, bool] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of this one joins; None for a single byte, or a token that no merge makes."""
        if token not in self.halves:
            data = self.v.tokens[token]
            self.halves[token] = None
            if len(data) > 1:
                # the encoding without the token itself is what its last merge joins
                parts = self.v.merge(data, below=token)
                if len(parts) == 2 and self.v.merge(data) == [token]:
                    self.halves[token] = (parts[0], parts[1])
        return self.halves[token]

    def whole(self, token: int) -> bool:
        """Whether the token encodes to itself."""
        return len(self.v.tokens[token]) == 1 or self.split(token) is not None

    def fits(self, last: int | None, token: int) -> bool:
        """Whether ``token`` may follow ``last`` (at the start: whether it encodes to itself)."""
        if last is None:
            return self.whole(token)
        key = last << 32 | token
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= MOST_PAIRS:
                self.known.clear()
            known = self.known[key] = self.whole(token) and self._apart(last, token)
        return known

    def _apart(self, x: int, y: int) -> bool:
        """Undo merges from the last made on, on either side of the seam; see whether two parts would have merged across it first."""
        ranks, tokens = self.v.ranks, self.v.tokens
        x_gone = y_gone = 1 << 60  # when the part at the seam goes into a larger one
        while True:
            across = ranks.get(tokens[x] + tokens[y])
            if across is not None and across < x_gone and across <= y_gone:
                return False
            left, right = self.split(x), self.split(y)
            if left is None and right is None:
                return True
            if right is None or left is not None and x > y:
                x_gone, x = x, left[1]
            else:
                y_gone, y = y, right[0]


class Transducer:
    """States are numbers; ``moves`` maps state * 256 + byte to the next state.

    A move that writes tokens has them in ``writes``, and the complement of the state in ``moves``.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.fits = Neighbours(vocabulary).fits
        self._clear()

    def _clear(self) -> None:
        self.number: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.moves: dict[int, int] = {}
        self.writes: dict[int, tuple[int, ...]] = {}
        self._state((None, b"", ()))

    def _state(self, key: tuple) -> int:
        """key: the last token written, if needed; then for each open position the bytes since it and the tokens up to it that aren't written."""
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.keys)
            self.keys.append(key)
        return n

    def _move(self, at: int) -> int:
        key, byte = self.keys[at >> 8], _BYTES[at & 255]
        last, done, later, known = key[0], None, [], self.v.known
        for s, path in zip(key[1::2], key[2::2]):
            s += byte
            hit = known.get(s)
            if hit is not None:
                token, head = hit
                if token is not None and done is None and self.fits(path[-1] if path else last, token):
                    done = (*path, token)
                if head:
                    later += s, path
        if done is None:
            raise ValueError("the vocabulary lacks single bytes")
        agreed = len(done)
        for path in later[1::2]:
            agreed = min(agreed, len(path))
            while agreed and path[:agreed] != done[:agreed]:
                agreed -= 1
        if agreed:
            last = done[agreed - 1]
            rest = done[agreed:]
            later[1::2] = [p[agreed:] for p in later[1::2]]
        else:
            rest = done
        if rest and () not in later:
            last = None
        to = self._state((last, *later, b"", rest))
        if agreed:
            self.writes[at] = done[:agreed]
            to = ~to
        self.moves[at] = to
        return to

    def encode(self, piece: bytes) -> list[int]:
        if len(self.keys) > MOST_STATES:
            self._clear()
        state, out, moves, writes = 0, [], self.moves, self.writes
        for byte in piece:
            at = state << 8 | byte
            state = moves.get(at)
            if state is None:
                state = self._move(at)
            if state < 0:
                out += writes[at]
                state = ~state
        out += self.keys[state][-1]
        return out


class Utf8Stream:
    """Incremental UTF-8: bytes in any cut, text out; an unfinished character waits for its rest."""

    def __init__(self):
        self.waiting = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that may yet be completed."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 != 0x80:
                need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
                return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data) - self.unfinished(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Codec:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v = vocabulary
        self.machine = Transducer(vocabulary)
        self.pieces = regex.compile(pattern)
        self.cuts_at_spaces = pattern == CUT_AT_LONE_SPACES
        self.by_piece: dict[str, list[int]] = {}
        self.by_word: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> list[int]:
        ids = self.by_piece.get(piece)
        if ids is None:
            data = piece.encode()
            whole = self.v.ranks.get(data)
            ids = [whole] if whole is not None else self.machine.encode(data)
            if len(piece) <= 32:
                if len(self.by_piece) >= MOST_PIECES:
                    self.by_piece.clear()
                self.by_piece[piece] = ids
        return ids

    def _cut(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._piece, self.pieces.findall(text))))

    def _letters(self, word: str) -> list[int]:
        """A space and letters: one piece."""
        data = b" " + word.encode()
        whole = self.v.ranks.get(data)
        return [whole] if whole is not None else self.machine.encode(data)

    def _word(self, word: str) -> list[int]:
        """What stands after a single space, up to the next one."""
        if word.isalpha():
            ids = self._letters(word)
        elif word[-1] in ".,;:!?" and word[:-1].isalpha():
            ids = [*(self.by_word.get(word[:-1]) or self._letters(word[:-1])), *self._piece(word[-1])]
        else:
            ids = self._cut(" " + word)
        if len(word) <= 32:
            if len(self.by_word) >= MOST_WORDS:
                self.by_word.clear()
            self.by_word[word] = tuple(ids)
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text. By the pattern CUT_AT_LONE_SPACES, a piece never goes on over a space that has no
        other white space beside it, but always begins there, so the stretches between such spaces are cut into
        pieces one by one. By other patterns, texts are cut as a whole."""
        if not text:
            return []
        if not self.cuts_at_spaces:
            return self._cut(text)
        words = _LONE_SPACE.split(text) if _SPACES.search(text) else text.split(" ")
        known, word = self.by_word, self._word
        return [*self._cut(words[0]), *chain.from_iterable([known.get(w) or word(w) for w in words[1:]])]

    def decode_stream(self, ids: Iterable[int], cut: int = 8192) -> Iterator[str]:
        stream, ids = Utf8Stream(), list(ids)
        for k in range(0, len(ids), cut):
            yield stream.feed(b"".join([self.v.tokens.get(i, b"" if i is None else UNKNOWN) for i in ids[k : k + cut]]))
        yield stream.finish()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process: its tables serve all the tasks that it runs."""
    return Codec(Vocabulary.read(path), pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns (but for those named ``ids`` or ``n_tokens``), ``ids`` (array of int) and ``n_tokens`` of every row."""

    def make():
        own = codec(path, pattern)

        def work(cols):
            ids = [own.encode(t) for t in cols[0]]
            return [ids, list(map(len, ids))]

        return work

    return map_rows(docs, [text], "ids array<int>, n_tokens long", make, keep=keep)


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns (but for one named ``text``) and ``text``, decoded from the ids of every row.

    A null array or an empty one gives the empty text; a null id nothing; an id that the vocabulary lacks U+FFFD.
    """

    def make():
        own = codec(path, pattern)
        return lambda cols: [[own.decode(x or []) for x in cols[0]]]

    return map_rows(encoded, [ids], "text string", make, keep=keep)


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes of every row."""

    def make():
        own = codec(path, pattern)
        said = {i: str(i) for i in own.v.tokens}

        def work(cols):
            out: list[list] = [cols[1], [], [], []]
            for t in cols[0]:
                ids = own.encode(t)
                h = hashlib.sha256()
                for part in own.decode_stream(ids):
                    h.update(part.encode())
                out[1].append(len(ids))
                out[2].append(hashlib.sha256(",".join(map(said.__getitem__, ids)).encode()).hexdigest())
                out[3].append(h.hexdigest())
            return out

        return work

    return map_rows(docs, ["text", "doc_id"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, chunk_rows=128)
