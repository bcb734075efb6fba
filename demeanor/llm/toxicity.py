"""Toxicity: a factorization machine over hashed terms.

Terms are words and the heads of words, hashed; the ``terms`` that speak most for or against the label among
the training rows (2,000 unless given; they bound the machine's size, not the rows or texts that it reads)
are kept, and the machine gives each a weight and a vector, whose products weigh pairs of terms. It is trained on at most about ``max_rows`` labelled documents, drawn by a hash of
doc_id, by Adam on the driver over the kept terms alone.

Texts are read whole. A null or empty text has no terms and scores by the bias alone. If no label, or
only one of them, can be learned from, every score is the share of that label. Of several labels of one
document the largest counts; ties of terms go by their hash. Rows that repeat and null ids are each scored
(null ids are not learned from); an empty table gives an empty table; columns other than doc_id, text and
toxic are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows
from .langid import held_out

MAX_ROWS = 12_000
TERMS = 2_000
RANK = 6
SPACE = 1 << 30
WORD = re.compile(r"[^\W\d_]+")
HEADS = (4, 5)
MOST_KNOWN = 400_000


def _hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode()) % SPACE


def word_terms(word: str) -> tuple[int, ...]:
    """A word's hash, and those of its heads."""
    return (_hash(word), *(_hash(f"{word[:n]}*") for n in HEADS if len(word) > n))


class Terms:
    """The hashed terms of texts; if ``kept`` is given, only those, as places in it."""

    def __init__(self, kept: dict[int, int] | None = None):
        self.kept = kept
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> list[int]:
        if not text:
            return []
        words = set(WORD.findall(text.lower()))
        if self.kept is None:
            return sorted({x for w in words for x in word_terms(w)})
        new = words - self.seen
        if new:
            if len(self.seen) > MOST_KNOWN:
                self.seen.clear()
                self.hits.clear()
                new = words
            kept = self.kept
            for w in new:
                if t := tuple(kept[x] for x in word_terms(w) if x in kept):
                    self.hits[w] = t
            self.seen |= new
        return sorted({x for w in words.intersection(self.hits) for x in self.hits[w]})


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the products of their vectors)."""

    terms: dict[int, int] = field(default_factory=dict)
    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK)))

    def raw(self, rows: list[list[int]]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for k, r in enumerate(rows):
            if r:
                v = self.vectors[r]
                total = v.sum(axis=0)
                out[k] += self.weights[r].sum() + 0.5 * (total @ total - (v * v).sum())
        return out

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def train(rows: list[list[int]], labels: np.ndarray, terms: dict[int, int], epochs: int = 12, batch: int = 256, rate: float = 0.03, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Adam on the log loss, with both labels of equal total weight."""
    y = np.asarray(labels, float)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1 or not terms:
        return Machine(bias=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rng = np.random.default_rng(seed)
    n = len(terms)
    flat = np.concatenate([np.array([*r, n]) for r in rows])  # each row ends with a term that weighs nothing
    sizes = np.array([len(r) + 1 for r in rows])
    begins = np.cumsum(sizes) - sizes
    cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    p = {"b": np.zeros(1), "w": np.zeros(n + 1), "v": rng.normal(0, 0.02, (n + 1, RANK))}
    p["v"][n] = 0
    m = {k: np.zeros_like(x) for k, x in p.items()}
    s = {k: np.zeros_like(x) for k, x in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            take = order[at : at + batch]
            size = sizes[take]
            own = np.repeat(np.arange(len(take)), size)
            cut = np.cumsum(size) - size
            i = flat[np.arange(len(own)) - cut[own] + begins[take][own]]
            v = p["v"][i]
            total = np.add.reduceat(v, cut, axis=0)
            pairs = (total**2).sum(axis=1) - np.add.reduceat((v**2).sum(axis=1), cut)
            raw = p["b"][0] + np.add.reduceat(p["w"][i], cut) + 0.5 * pairs
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[take]) * cost[take] / len(take)
            g = {"b": np.array([err.sum()]), "w": np.bincount(i, err[own], n + 1)}
            gv = err[own, None] * (total[own] - v)
            g["v"] = np.stack([np.bincount(i, gv[:, k], n + 1) for k in range(RANK)], axis=1)
            step += 1
            for k in p:
                grad = g[k] + (decay * p[k] if k != "b" else 0)
                m[k] += 0.1 * (grad - m[k])
                s[k] += 0.001 * (grad**2 - s[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
            p["w"][n] = 0
            p["v"][n] = 0
    return Machine(terms, float(p["b"][0]), p["w"][:n], p["v"][:n])


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, terms: int = TERMS, least: int = 4) -> Machine:
    """Fit on labelled rows that aren't held out.

    Terms are ranked by how far their share of the documents with the label is from that of those
    without it, in units of its standard error; a term needs ``least`` documents.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, max_rows / max(n, 1))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < int(share * (1 << 53)) + 1)
    few = drawn.join(docs.select("doc_id", "text"), "doc_id")

    def make():
        own = Terms()
        return lambda cols: [cols[1], [own.of(t) for t in cols[0]]]

    scratch = Scratch(spark)
    rows = scratch.save(map_rows(few.select("text", F.col("toxic").cast("int").alias("toxic")), ["text", "toxic"], "toxic int, terms array<long>", make), "toxicity-rows")
    sums = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, noes = sums.get(1, 0), sums.get(0, 0)

    def count():
        def work(cols):
            yes, no = Counter(), Counter()
            for toxic, t in zip(*cols):
                (yes if toxic else no).update(t)
            both = yes.keys() | no.keys()
            return [list(both), [yes[x] for x in both], [no[x] for x in both]]

        return work

    by_term = map_rows(rows, ["toxic", "terms"], "term long, yes long, no long", count, chunk_rows=4096).groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    all_ = float(max(ones + noes, 1))
    p = (F.col("yes") + F.col("no")) / F.lit(all_)
    gap = F.abs(F.col("yes") / F.lit(float(max(ones, 1))) - F.col("no") / F.lit(float(max(noes, 1))))
    rank = gap / F.sqrt(p * (1 - p) + F.lit(1.0 / all_))
    best = by_term.where(F.col("yes") + F.col("no") >= least).orderBy(F.desc(rank), "term").limit(terms).collect() if ones and noes else []
    kept = {r["term"]: k for k, r in enumerate(best)}
    shared = spark.sparkContext.broadcast(kept)

    def narrow():
        return lambda cols: [cols[0], [[shared.value[x] for x in t if x in shared.value] for t in cols[1]]]

    got = map_rows(rows, ["toxic", "terms"], "toxic int, at array<int>", narrow).orderBy("toxic", F.hash("at"), "at").toPandas()
    scratch.drop(rows)
    return train([list(map(int, r)) for r in got["at"]], got["toxic"].to_numpy(), kept)


def score_texts(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        m = shared.value
        own = Terms(m.terms)

        def work(cols):
            scores = m.scores([own.of(t) for t in cols[0]])
            return [cols[1], cols[2], scores.tolist(), (scores >= threshold).astype(int).tolist()]

        return work

    return map_rows(docs.select("text", "doc_id", held_out().alias("held_out")), ["text", "doc_id", "held_out"], "doc_id long, held_out boolean, score double, predicted int", make)
