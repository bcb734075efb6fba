"""Solvers of one component of a pair of factors: the larger side is eliminated, the rest is a Laplacian."""

from __future__ import annotations

from typing import Protocol

import numpy as np

from ..config import ApproxCholConfig, SchurComplement
from ..errors import SingularDiagonal
from .krylov import cg
from .matrices import CrossTab, SparseMatrix


EDGES_AT_ONCE = 500_000
DENSE_LEVELS = 4_000


class LocalSolver(Protocol):
    """What a user's own local solver has to offer; ``local_solver`` of a Schwarz configuration may be a function that makes one of a CrossTab."""

    n: int

    def solve(self, rhs: np.ndarray) -> np.ndarray: ...


def oriented(tab: CrossTab, q: bool | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """(eliminated level, kept level, weight, eliminated diagonal, whether q is eliminated): the larger side goes, unless one is named."""
    q = len(tab.diag_q) >= len(tab.diag_r) if q is None else q
    gone, kept, diag = (tab.q, tab.r, tab.diag_q) if q else (tab.r, tab.q, tab.diag_r)
    bad = np.flatnonzero(~(diag > 0))
    if len(bad):
        raise SingularDiagonal("q" if q else "r", int(bad[0]))
    return gone, kept, tab.w, diag, q


def exact_schur(tab: CrossTab, q: bool | None = None) -> np.ndarray:
    """The dense reduced matrix: kept diagonal less C' D^-1 C."""
    gone, kept, w, diag, q = oriented(tab, q)
    keep = tab.diag_r if q else tab.diag_q
    s = np.diag(np.asarray(keep, float))
    order = np.argsort(gone, kind="stable")
    gone, kept, w = gone[order], kept[order], w[order]
    for at in range(0, len(diag), 1024):
        lo, hi = np.searchsorted(gone, [at, min(at + 1024, len(diag))])
        c = np.zeros((min(at + 1024, len(diag)) - at, len(keep)))
        c[gone[lo:hi] - at, kept[lo:hi]] = w[lo:hi]
        s -= c.T @ (c / diag[at : at + len(c), None])
    return s


def sparse_schur(tab: CrossTab, pairs_at_once: int = 1 << 22, q: bool | None = None) -> SparseMatrix:
    """The same as ``exact_schur``, sparse: each eliminated level adds an entry for every two kept ones that it meets.

    Entries are made for some eliminated levels at a time and equal ones folded, so that memory follows the
    result and not the number of pairs made.
    """
    gone, kept, w, diag, q = oriented(tab, q)
    keep = np.asarray(tab.diag_r if q else tab.diag_q, float)
    n = len(keep)
    order = np.argsort(gone, kind="stable")
    gone, kept, w = gone[order], kept[order].astype(np.int64), w[order]
    starts = np.searchsorted(gone, np.arange(len(diag) + 1))
    degree = np.diff(starts)
    made = np.r_[0, np.cumsum(degree[gone])]  # pairs made by the entries before each
    places, values, at = [np.arange(n) * (n + 1)], [keep], 0
    while at < len(gone):
        end = max(at + 1, int(np.searchsorted(made, made[at] + pairs_at_once, "right")) - 1)
        size = degree[gone[at:end]]
        left = np.repeat(np.arange(at, end), size)
        right = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[gone[at:end]], size)
        place, own = np.unique(np.concatenate([places[-1], kept[left] * n + kept[right]]), return_inverse=True)
        total = np.bincount(own, np.concatenate([values[-1], -w[left] * w[right] / diag[gone[left]]]), len(place))
        places, values, at = [place], [total], end
    return SparseMatrix(n, places[-1] // max(n, 1), places[-1] % max(n, 1), values[-1])


def star_tree(ends: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sampled tree (ends, other ends, weights) that stands, in the mean, for the clique that eliminating a star's centre makes."""
    order = np.argsort(w, kind="stable")
    ends, w = ends[order], w[order]
    upto, rest = np.cumsum(w), np.cumsum(w[::-1])[::-1]
    k = np.arange(len(w) - 1)
    other = np.searchsorted(upto, upto[:-1] + rng.random(len(w) - 1) * rest[1:])
    other = np.clip(other, k + 1, len(w) - 1)
    return ends[:-1], ends[other], w[:-1] * rest[1:] / rest[0]


def sampled_schur(tab: CrossTab, seed: int = 0, split: int = 1, q: bool | None = None, numbers: np.ndarray | None = None) -> SparseMatrix:
    """A sparse Laplacian for the reduced matrix: at most ``split * (degree - 1)`` edges for each eliminated level, seeded by its number (``numbers``: others than its place)."""
    gone, kept, w, diag, q = oriented(tab, q)
    n = len(tab.diag_r if q else tab.diag_q)
    order = np.argsort(gone, kind="stable")
    gone, kept, w = gone[order], kept[order], w[order]
    starts = np.searchsorted(gone, np.arange(len(diag) + 1))
    out, trees, made = SparseMatrix(n, np.zeros(0, int), np.zeros(0, int), np.zeros(0)), [], 0
    for i in range(len(diag)):
        lo, hi = starts[i], starts[i + 1]
        if hi - lo > 1:
            rng = np.random.default_rng(seed + (i if numbers is None else int(numbers[i])))
            trees += [star_tree(kept[lo:hi], w[lo:hi], rng) for _ in range(split)]
            made += split * (hi - lo)
        if trees and (made > EDGES_AT_ONCE or i == len(diag) - 1):
            a, b, x = (np.concatenate(z) for z in zip(*trees))
            more = laplacian(n, a, b, x / split)
            out = SparseMatrix(n, np.r_[out.rows, more.rows], np.r_[out.cols, more.cols], np.r_[out.values, more.values])
            trees, made = [], 0
    return out


def laplacian(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> SparseMatrix:
    return SparseMatrix(n, np.r_[a, b, a, b].astype(int), np.r_[b, a, a, b].astype(int), np.r_[-w, -w, w, w])


class DenseAnchored:
    """Cholesky of a Laplacian without its last row and column; the last unknown is 0."""

    def __init__(self, s: np.ndarray):
        self.n = len(s)
        self.inverse = np.linalg.inv(np.linalg.cholesky(s[:-1, :-1])) if self.n > 1 else np.zeros((0, 0))

    def solve(self, b: np.ndarray) -> np.ndarray:
        return np.r_[self.inverse.T @ (self.inverse @ b[:-1]), 0.0]


class ApproxCholesky:
    """Randomised elimination of a Laplacian in order of degree, stars replaced by sampled trees; used as a preconditioner of CG.

    Where a quarter of all entries or more are there, they, and the inverse of the factor, are kept as dense matrices.
    """

    def __init__(self, s: SparseMatrix, config: ApproxCholConfig, tol: float = 1e-11):
        self.s, self.n, self.tol = s, s.n, tol
        rng = np.random.default_rng(config.seed)
        self.dense = None
        if 4 * s.nnz >= s.n**2 and 1 < s.n <= DENSE_LEVELS:
            self._densely(config, rng)
            return
        around: list[dict[int, float]] = []
        for i in range(s.n):  # row by row, as lists of all entries take as much again
            at = slice(s.starts[i], s.starts[i + 1])
            around.append({j: -v for j, v in zip(s.cols[at].tolist(), s.values[at].tolist()) if i != j and v < 0})
        self.order = np.argsort([len(x) for x in around], kind="stable").tolist()
        self.stars: list[tuple[int, np.ndarray, np.ndarray, float]] = []
        for i in self.order:
            ends = np.array(sorted(around[i]), int)
            w = np.array([around[i][j] for j in ends.tolist()])
            for j in ends.tolist():
                around[j].pop(i, None)
            if len(ends):
                self.stars.append((i, ends, w / w.sum(), float(w.sum())))
                for _ in range(config.split):
                    for a, b, x in zip(*(z.tolist() for z in star_tree(ends, w, rng))):
                        around[a][b] = around[a].get(b, 0.0) + x / config.split
                        around[b][a] = around[b].get(a, 0.0) + x / config.split

    def _densely(self, config: ApproxCholConfig, rng: np.random.Generator) -> None:
        """The same elimination on a dense matrix of weights."""
        self.dense, self.s = self.s.dense(), None
        around = np.maximum(-self.dense, 0.0)
        np.fill_diagonal(around, 0.0)
        self.order = np.argsort(np.count_nonzero(around, axis=1), kind="stable").tolist()
        at, self.scale, lower = np.empty(self.n, int), np.zeros(self.n), np.eye(self.n)
        at[self.order] = np.arange(self.n)
        for i in self.order:
            ends = np.flatnonzero(around[i])
            if not len(ends):
                continue
            w = around[i, ends]
            around[i, ends] = around[ends, i] = 0.0
            self.scale[at[i]] = 1 / w.sum()
            lower[at[ends], at[i]] = -w / w.sum()
            for _ in range(config.split):
                a, b, x = star_tree(ends, w, rng)
                around[a, b] += x / config.split
                around[b, a] += x / config.split
        self.lower_inverse = np.linalg.inv(lower)

    def once(self, b: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            x = np.empty_like(b)
            x[self.order] = self.lower_inverse.T @ (self.scale * (self.lower_inverse @ b[self.order]))
            return x - x.mean()
        y = b.copy()
        for i, ends, share, _ in self.stars:
            y[ends] += share * y[i]
        x = np.zeros_like(y)
        for i, ends, share, d in reversed(self.stars):
            x[i] = y[i] / d + share @ x[ends]
        return x - x.mean()

    def solve(self, b: np.ndarray) -> np.ndarray:
        b = b - b.mean()
        return cg(self.s.matvec if self.dense is None else self.dense.__matmul__, b, self.once, self.tol, 200).x


class BlockElimination:
    """Solves one component's singular system, by eliminating the larger side; constants are projected out."""

    def __init__(self, tab: CrossTab, config: SchurComplement):
        self.tab, self.n = tab, len(tab.diag_q) + len(tab.diag_r)
        self.gone, self.kept, self.w, self.diag, self.q_gone = oriented(tab)
        self.n_kept = self.n - len(self.diag)
        if config.dense_threshold and self.n_kept <= config.dense_threshold:
            try:
                self.reduced = DenseAnchored(exact_schur(tab))
                return
            except np.linalg.LinAlgError:
                pass
        if config.approx_schur is not None:
            s = sampled_schur(tab, config.approx_schur.seed, config.approx_schur.split)
        else:
            s = sparse_schur(tab)
        self.reduced = ApproxCholesky(s, config.approx_chol)

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        n_q = len(self.tab.diag_q)
        b = rhs.copy()
        b[n_q:] *= -1
        b -= b.mean()
        g, k = (b[:n_q], b[n_q:]) if self.q_gone else (b[n_q:], b[:n_q])
        e = g / self.diag
        t = k + np.bincount(self.kept, self.w * e[self.gone], self.n_kept)
        z_k = self.reduced.solve(t - t.mean())
        z_g = e + np.bincount(self.gone, self.w * z_k[self.kept], len(self.diag)) / self.diag
        z = np.r_[z_g, z_k] if self.q_gone else np.r_[z_k, z_g]
        z -= z.mean()
        z[n_q:] *= -1
        return z
