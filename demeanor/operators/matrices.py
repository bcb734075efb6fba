"""Sparse matrices, cross-tabulations and their graphs, on aggregates that are small beside the observations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np


class SparseMatrix:
    """A square matrix in compressed rows, columns sorted; equal entries add up."""

    def __init__(self, n: int, rows: np.ndarray, cols: np.ndarray, values: np.ndarray):
        order = np.lexsort((cols, rows))
        rows, cols, values = np.asarray(rows)[order], np.asarray(cols)[order], np.asarray(values, float)[order]
        if len(rows):
            first = np.flatnonzero(np.r_[True, (np.diff(rows) != 0) | (np.diff(cols) != 0)])
            rows, cols, values = rows[first], cols[first], np.add.reduceat(values, first)
        self.n, self.rows, self.cols, self.values = n, rows.astype(np.int64), cols.astype(np.int64), values
        self.starts = np.searchsorted(self.rows, np.arange(n + 1))

    @property
    def nnz(self) -> int:
        return len(self.values)

    def matvec(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * x[self.cols], self.n)

    def diagonal(self) -> np.ndarray:
        on = self.rows == self.cols
        return np.bincount(self.rows[on], self.values[on], self.n)

    def submatrix(self, index: np.ndarray) -> SparseMatrix:
        place = np.full(self.n, -1)
        place[index] = np.arange(len(index))
        on = (place[self.rows] >= 0) & (place[self.cols] >= 0)
        return SparseMatrix(len(index), place[self.rows[on]], place[self.cols[on]], self.values[on])

    def take_columns(self, index: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The product with a vector that is zero but at ``index``; the matrix is symmetric."""
        at = np.concatenate([np.arange(self.starts[i], self.starts[i + 1]) for i in index]) if len(index) else np.zeros(0, int)
        return np.bincount(self.cols[at], self.values[at] * np.repeat(x, self.starts[np.asarray(index, int) + 1] - self.starts[np.asarray(index, int)]), self.n) if len(at) else np.zeros(self.n)

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        out[self.rows, self.cols] = self.values
        return out


@dataclass
class CrossTab:
    """Weights by pairs of levels of two factors, and by the levels of each; levels are numbered from 0."""

    q: np.ndarray
    r: np.ndarray
    w: np.ndarray
    diag_q: np.ndarray
    diag_r: np.ndarray

    def components(self) -> np.ndarray:
        """A component number for each level, the q levels first; numbers follow the smallest level."""
        n = len(self.diag_q) + len(self.diag_r)
        return connected(n, self.q, self.r + len(self.diag_q))

    def part(self, levels_q: np.ndarray, levels_r: np.ndarray) -> CrossTab:
        pq, pr = np.full(len(self.diag_q), -1, np.int32), np.full(len(self.diag_r), -1, np.int32)
        pq[levels_q], pr[levels_r] = np.arange(len(levels_q)), np.arange(len(levels_r))
        on = (pq[self.q] >= 0) & (pr[self.r] >= 0)
        return CrossTab(pq[self.q[on]], pr[self.r[on]], self.w[on], self.diag_q[levels_q], self.diag_r[levels_r])


class TabGram:
    """The Gramian as tabulations of every two factors; entries by row and column are made when first asked for."""

    def __init__(self, tabs: dict[tuple[int, int], CrossTab], offsets: np.ndarray, diag: np.ndarray):
        self.tabs, self.offsets, self.diag, self.n = tabs, offsets, diag, len(diag)

    def matvec(self, x: np.ndarray) -> np.ndarray:
        out = self.diag * x
        for (q, r), t in self.tabs.items():
            a, b = slice(self.offsets[q], self.offsets[q + 1]), slice(self.offsets[r], self.offsets[r + 1])
            out[a] += np.bincount(t.q, t.w * x[b][t.r], a.stop - a.start)
            out[b] += np.bincount(t.r, t.w * x[a][t.q], b.stop - b.start)
        return out

    def diagonal(self) -> np.ndarray:
        return self.diag

    @cached_property
    def matrix(self) -> SparseMatrix:
        rows, cols, vals = [np.arange(self.n)], [np.arange(self.n)], [self.diag]
        for (q, r), t in self.tabs.items():
            a, b = t.q + self.offsets[q], t.r + self.offsets[r]
            rows += [a, b]
            cols += [b, a]
            vals += [t.w, t.w]
        return SparseMatrix(self.n, np.concatenate(rows), np.concatenate(cols), np.concatenate(vals))

    rows = property(lambda self: self.matrix.rows)
    cols = property(lambda self: self.matrix.cols)
    values = property(lambda self: self.matrix.values)

    def take_columns(self, index: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.matrix.take_columns(index, x)


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component numbers by hooking every root to its smallest neighbour, all at once, until nothing moves."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        new = label.copy()
        np.minimum.at(new, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        new = new[label]
        if (new == label).all():
            break
        label = new
    return np.unique(label, return_inverse=True)[1]
