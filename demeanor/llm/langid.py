"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary that consist of lower-case letters, with or without the
mark of a word's start; others cannot occur, as words are runs of letters in lower case. Each language has a
probability for each piece; a word's probability is the sum over all its segmentations into pieces, by the
forward algorithm, and a text's is the product over its words. The piece probabilities are fitted by
expectation maximisation (forward-backward over all segmentations) on all words of at most about
``max_rows`` labelled documents, drawn by a hash of doc_id, evenly by language. Words of any length are summed
whole; beyond SHORT characters with logarithms, so that nothing underflows.

A text that is null or has no letter is ``und`` with score 0. A character that the vocabulary lacks counts as
a piece of its own with a floor probability. Languages that tie: the first by name. Rows that repeat and null
ids are each returned (null ids are not learned from); an empty table gives an empty table, and without
labelled rows every text is ``und``; columns other than text, lang and doc_id are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

WORD, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
MAX_ROWS = 6_000
ROUNDS = 3
MARK = "▁"
MOST_KNOWN = 300_000
SHORT = 24
CHUNK = 4096
_FLOOR = 1e-9


@cache
def pieces(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece model made of lower-case letters, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        body = p.removeprefix(MARK)
        if body.isalpha() and body == body.lower():
            out[p] = len(out)
    return out


def letters_words(text: str | None) -> list[str]:
    """Runs of letters (Unicode's category L), in lower case."""
    out = WORD.findall(text.lower()) if text else []
    return out if not out or "".join(out).isalpha() else [x for w in out for x in LETTERS.findall(w)]


def _spans(word: str, known: dict[str, int], longest: int) -> Iterator[list[tuple[int, int]]]:
    """For each end, the (start, piece) of the pieces that end there; -1 for a character of its own."""
    for end in range(1, len(word) + 1):
        here = [(s, p) for s in range(max(0, end - longest), end) if (p := known.get(word[s:end])) is not None]
        if not any(s == end - 1 for s, _ in here):
            here.append((end - 1, -1))
        yield here


def _log_forward(word: str, known: dict[str, int], longest: int, logs: np.ndarray) -> np.ndarray:
    """The logarithm of a long word's probability in each language; only the last few ends are held."""
    ahead = {0: np.zeros(logs.shape[1])}
    for end, here in enumerate(_spans(word, known, longest), 1):
        ahead[end] = np.logaddexp.reduce([ahead[s] + logs[i] for s, i in here], axis=0)
        ahead.pop(end - longest, None)
    return ahead[len(word)]


def _log_expect(word: str, known: dict[str, int], longest: int, logs: np.ndarray, n: float, seen: np.ndarray) -> None:
    """Adds a long word's expected numbers of pieces, in one language, ``n`` times."""
    spans = list(_spans(word, known, longest))
    ahead = [0.0]
    for here in spans:
        ahead.append(float(np.logaddexp.reduce([ahead[s] + logs[i] for s, i in here])))
    back = [-np.inf] * len(spans) + [0.0]
    for end in range(len(spans), 0, -1):
        for s, i in spans[end - 1]:
            seen[i] += n * np.exp(ahead[s] + logs[i] + back[end] - ahead[-1])
            back[s] = float(np.logaddexp(back[s], back[end] + logs[i]))


class Lattice:
    """All segmentations of short words at once: for each end, edges (from, piece, to), ordered by where they go."""

    def __init__(self, words: list[str], root: dict, floor: int):
        self.width = width = max(map(len, words), default=0) + 1
        self.n, self.last = len(words), np.arange(len(words)) * width + np.array([len(w) for w in words], np.int64)
        ends: list[list[int]] = [[] for _ in range(width)]
        for k, text in enumerate(words):
            base, size = k * width, len(text)
            for s in range(size):
                node, at, single = root, s, True
                while at < size:
                    node = node.get(text[at])
                    if node is None:
                        break
                    at += 1
                    if "" in node:
                        ends[at] += base + s, node[""], base + at
                        single = single and at > s + 1
                if single:
                    ends[s + 1] += base + s, floor, base + s + 1
        self.edges = []
        for flat in filter(None, ends):
            e = np.array(flat, np.int64).reshape(-1, 3)
            e = e[np.argsort(e[:, 2], kind="stable")]
            self.edges.append((e, np.flatnonzero(np.diff(e[:, 2], prepend=-1))))

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """Summed probabilities by place (word and end) and language."""
        ahead = np.zeros((self.n * self.width, probs.shape[1]))
        ahead[:: self.width] = 1.0
        for e, cut in self.edges:
            ahead[e[cut, 2]] = np.add.reduceat(ahead[e[:, 0]] * probs[e[:, 1]], cut, axis=0)
        return ahead

    def expect(self, p: np.ndarray, counts: np.ndarray, seen: np.ndarray) -> None:
        """Adds the words' expected numbers of pieces, in one language, each as often as it occurs."""
        ahead = self.forward(p[:, None])[:, 0]
        back = np.zeros(len(ahead))
        back[self.last] = counts / ahead[self.last]
        for e, _ in reversed(self.edges):
            q = back[e[:, 2]] * p[e[:, 1]]
            seen += np.bincount(e[:, 1], ahead[e[:, 0]] * q, len(seen))
            back += np.bincount(e[:, 0], q, len(back))


def _trie(known: dict[str, int]) -> dict:
    root: dict = {}
    for p, i in known.items():
        node = root
        for c in p:
            node = node.setdefault(c, {})
        node[""] = i
    return root


def fit(counts: dict[str, Counter], path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and probabilities by piece and language, from word counts by language."""
    known = pieces(path)
    longest, root, floor = max(map(len, known)), _trie(known), len(known)
    langs = sorted(counts)
    probs = np.full((len(known) + 1, max(len(langs), 1)), 1.0 / (len(known) + 1))
    for k, lang in enumerate(langs):
        marked = [(MARK + w, n) for w, n in sorted(counts[lang].items())]
        short, long = [x for x in marked if len(x[0]) <= SHORT], [x for x in marked if len(x[0]) > SHORT]
        chunks = [short[at : at + CHUNK] for at in range(0, len(short), CHUNK)]
        chunks = [(Lattice([w for w, _ in c], root, floor), np.array([n for _, n in c], float)) for c in chunks]
        p = np.array([1.0 / (len(known) + 1)] * len(known) + [_FLOOR])
        for _ in range(rounds):
            seen = np.zeros(len(p))
            for lattice, n in chunks:
                lattice.expect(p, n, seen)
            logs = np.log(p)
            for w, n in long:
                _log_expect(w, known, longest, logs, n, seen)
            p = (seen + 0.01) / (seen.sum() + 0.01 * len(seen))
        probs[:, k] = p
    return langs, probs


class Scorer:
    """Scores texts; keeps the log probabilities of the words that it met last.

    The words of a batch that are new are walked through a trie of the pieces, and the forward sums
    of all of them advance together, one end position at a time.
    """

    def __init__(self, langs: list[str], probs: np.ndarray, path: str):
        self.langs, self.probs, self.log_probs = langs, probs, np.log(probs)
        self.known = pieces(path)
        self.longest, self.root = max(map(len, self.known)), _trie(self.known)
        self.place: dict[str, int] = {}
        self.logs = np.zeros((0, len(langs)))

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words, all segmentations summed: a row for each word, a column for each language."""
        marked = [MARK + w for w in words]
        short = np.array([k for k, w in enumerate(marked) if len(w) <= SHORT], np.int64)
        out = np.zeros((len(words), len(self.langs)))
        lattice = Lattice([marked[k] for k in short], self.root, len(self.known))
        out[short] = np.log(lattice.forward(self.probs)[lattice.last])
        for k, w in enumerate(marked):
            if len(w) > SHORT:
                out[k] = _log_forward(w, self.known, self.longest, self.log_probs)
        return out

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        if len(self.place) > MOST_KNOWN:
            self.place.clear()
            self.logs = self.logs[:0]
        split = [letters_words(t) for t in texts]
        new = list(set().union(*split).difference(self.place))
        for at in range(0, len(new), CHUNK):
            some = new[at : at + CHUNK]
            self.place.update(zip(some, range(len(self.place), len(self.place) + len(some))))
            self.logs = np.concatenate([self.logs[: len(self.place) - len(some)], self.forward(some)])
        out, get = [], self.place.__getitem__
        for words in split:
            if not words:
                out.append(("und", 0.0))
                continue
            total = self.logs[list(map(get, words))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.langs[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, mod 3, is 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame, path: str, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """Fit on rows that aren't held out and whose lang isn't null; at most about ``max_rows`` of them.

    Each language gets an equal part of ``max_rows``, drawn by a hash; one with fewer rows gives them all.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit({}, path)
    parts = 1 << 53
    most = {lang: min(parts, int(parts * max_rows / (len(sizes) * n)) + 1) for lang, n in sizes.items()}
    limits = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < F.element_at(limits, F.col("lang")))

    def make():
        def work(cols):
            out: dict[tuple[str, str], int] = Counter()
            for text, lang in zip(*cols):
                for w, k in Counter(letters_words(text)).items():
                    out[lang, w] += k
            return [[a for a, _ in out], [b for _, b in out], list(out.values())]

        return work

    words = map_rows(drawn, ["text", "lang"], "lang string, word string, n long", make).groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    counts: dict[str, Counter] = {lang: Counter() for lang in sizes}
    for lang, word, n in zip(words["lang"], words["word"], words["n"]):
        counts[lang][word] = n
    return fit(counts, path)


_SCORERS: dict[tuple, Scorer] = {}


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        key = (path, *shared.value[0], shared.value[1].tobytes())
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(*shared.value, path)
        scorer = _SCORERS[key]

        def work(cols):
            found = scorer.score(cols[0])
            return [cols[1], cols[2], [x for x, _ in found], [x for _, x in found]]

        return work

    return map_rows(docs.select("text", "doc_id", held_out().alias("held_out")), ["text", "doc_id", "held_out"], "doc_id long, held_out boolean, lang_pred string, score double", make)
