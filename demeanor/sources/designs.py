"""Synthetic designs as DataFrames: f0, f1, ... and y (the sum of random level effects, and noise)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def with_response(spark: SparkSession, codes: list[np.ndarray], rng: np.random.Generator, noise: float = 0.1) -> DataFrame:
    y = sum(rng.normal(size=int(c.max()) + 1)[c] for c in codes) + noise * rng.normal(size=len(codes[0]))
    return spark.createDataFrame(pd.DataFrame({f"f{k}": c.astype(np.int64) for k, c in enumerate(codes)} | {"y": y}))


def uniform(spark, n_rows: int, n_levels: list[int], seed: int = 0) -> DataFrame:
    rng = np.random.default_rng(seed)
    return with_response(spark, [rng.integers(0, m, n_rows) for m in n_levels], rng)


def chain(spark, n: int, n_factors: int = 2, seed: int = 0) -> DataFrame:
    """Each level meets its own number and the next one: the longest path there is."""
    base = np.arange(n)
    codes = [np.r_[base, base]] + [np.r_[base, np.minimum(base + k, n - 1)] for k in range(1, n_factors)]
    return with_response(spark, codes, np.random.default_rng(seed))


def star(spark, n: int, seed: int = 0) -> DataFrame:
    """One level of the first factor meets all of the second; the others meet one each."""
    base = np.arange(n)
    return with_response(spark, [np.r_[np.zeros(n, int), base], np.r_[base, base]], np.random.default_rng(seed))


def barbell(spark, n: int, density: int = 5, seed: int = 0) -> DataFrame:
    """Two dense halves with one link between them."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, n, (2, n * density))
    return with_response(spark, [np.r_[a, a + n, 0], np.r_[b, b + n, n]], rng)


def expander(spark, n: int, degree: int = 4, seed: int = 0) -> DataFrame:
    rng = np.random.default_rng(seed)
    return with_response(spark, [np.tile(np.arange(n), degree), np.concatenate([rng.permutation(n) for _ in range(degree)])], rng)


def grid(spark, side: int, seed: int = 0) -> DataFrame:
    """A square lattice, its points coloured like a chess board for the two factors."""
    i, j = (x.ravel() for x in np.meshgrid(np.arange(side), np.arange(side)))
    number = i * side + j
    edges = np.concatenate([np.stack([number[j < side - 1], number[j < side - 1] + 1], 1), np.stack([number[i < side - 1], number[i < side - 1] + side], 1)])
    white = ((edges[:, 0] // side + edges[:, 0] % side) % 2 == 0)[:, None]
    a, b = np.where(white[:, 0], edges[:, 0], edges[:, 1]), np.where(white[:, 0], edges[:, 1], edges[:, 0])
    codes = [np.unique(x, return_inverse=True)[1] for x in (a, b)]
    return with_response(spark, codes, np.random.default_rng(seed))


def components(spark, n_parts: int, n_levels: int, rows: int, n_factors: int = 2, bridges: int = 0, seed: int = 0) -> DataFrame:
    """Parts that share no level, but for so many rows between each two neighbours: their levels come from either."""
    rng = np.random.default_rng(seed)
    part = np.repeat(np.arange(n_parts), rows)
    between = np.repeat(np.arange(n_parts - 1), bridges)
    codes = []
    for _ in range(n_factors):
        at = np.r_[part, between + rng.integers(0, 2, len(between))]
        codes.append(at * n_levels + rng.integers(0, n_levels, len(at)))
    return with_response(spark, codes, rng)


def sparse(spark, n_levels: list[int], rows_per_level: int = 3, seed: int = 0) -> DataFrame:
    """Every level of every factor has a few rows of its own, the other factors at random."""
    rng = np.random.default_rng(seed)
    own = [np.repeat(np.arange(m), rows_per_level) for m in n_levels]
    codes = [np.concatenate([x if f == g else rng.integers(0, m, len(x)) for g, x in enumerate(own)]) for f, m in enumerate(n_levels)]
    return with_response(spark, codes, rng)


def steps(spark, n: int, n_factors: int = 3, seed: int = 0) -> DataFrame:
    """Each number meets itself in all factors, and the next one in one factor at a time: every pair of factors is a path."""
    i = np.arange(n)
    codes = [np.concatenate([i, *(i[:-1] + (f == g) for g in range(n_factors))]) for f in range(n_factors)]
    return with_response(spark, codes, np.random.default_rng(seed))


def barbell_many(spark, n: int, n_factors: int = 3, degree: int = 3, bridge: int = 4, seed: int = 0) -> DataFrame:
    """Two halves in all factors, joined by rows in which one factor lies across."""
    rng, half = np.random.default_rng(seed), n // 2
    first = np.repeat(np.arange(n), degree)
    upper, k = first >= half, np.arange(min(bridge, half))
    codes = []
    for f in range(n_factors):
        inside = first if f == 0 else np.where(upper, rng.integers(half, n, len(first)), rng.integers(0, half, len(first)))
        codes.append(np.concatenate([inside, *(half + k if f == g else half - 1 - k for g in range(n_factors))]))
    return with_response(spark, codes, rng)


def imbalanced(spark, n_rows: int, n_levels: list[int], exponent: float = 1.5, seed: int = 0) -> DataFrame:
    """Levels as frequent as a power of their number."""
    rng = np.random.default_rng(seed)
    shares = [np.arange(1, m + 1) ** -exponent for m in n_levels]
    return with_response(spark, [rng.choice(len(p), n_rows, p=p / p.sum()) for p in shares], rng)


def dominant_block(spark, n_rows: int, n_levels: list[int], share: float = 0.8, part: float = 0.1, seed: int = 0) -> DataFrame:
    """A share of the rows lies in the first levels of all factors at once, the others in the remaining levels."""
    rng = np.random.default_rng(seed)
    dense = rng.random(n_rows) < share
    codes = []
    for m in n_levels:
        cut = min(max(2, int(m * part)), m - 1)
        codes.append(np.where(dense, rng.integers(0, cut, n_rows), rng.integers(cut, m, n_rows)))
    return with_response(spark, codes, rng)


def hub(spark, n_rows: int, n_levels: list[int], share: float = 0.5, seed: int = 0) -> DataFrame:
    """Level 0 of the first factor holds a share of all rows."""
    rng = np.random.default_rng(seed)
    codes = [rng.integers(0, m, n_rows) for m in n_levels]
    codes[0][rng.random(n_rows) < share] = 0
    return with_response(spark, codes, rng)


def panel(spark, n_workers: int, n_years: int, n_firms: int, mobility: float = 0.1, exponent: float = 1.0, regions: int = 1, cross: float = 0.0, seed: int = 0) -> DataFrame:
    """Workers, firms, years; a worker changes firm with the given chance each year.

    Firms are drawn by sizes that fall as a power of their number (0: all alike). With several regions, each a run
    of firms, a worker stays inside one but for a share ``cross`` of the moves.
    """
    rng = np.random.default_rng(seed)
    reach = np.r_[0, np.cumsum(np.arange(1, n_firms + 1) ** -float(exponent))]
    edge = np.linspace(0, n_firms, regions + 1).astype(int)

    def draw(lo, hi):
        """A firm from lo to hi - 1 for each worker, by size."""
        x = reach[lo] + rng.random(n_workers) * (reach[hi] - reach[lo])
        return np.clip(np.searchsorted(reach, x, "right") - 1, lo, hi - 1)

    everywhere = np.zeros(n_workers, int), np.full(n_workers, n_firms)
    firm = np.empty((n_workers, n_years), int)
    firm[:, 0] = draw(*everywhere)
    for t in range(1, n_years):
        here = np.searchsorted(edge, firm[:, t - 1], "right") - 1
        away = rng.random(n_workers) < cross
        goes = draw(np.where(away, 0, edge[here]), np.where(away, n_firms, edge[here + 1]))
        firm[:, t] = np.where(rng.random(n_workers) < mobility, goes, firm[:, t - 1])
    worker, year = np.repeat(np.arange(n_workers), n_years), np.tile(np.arange(n_years), n_workers)
    return with_response(spark, [worker, firm.ravel(), year], rng)


def individuals(spark, n_rows: int, difficult: bool = False, seed: int = 0) -> DataFrame:
    """Ten years of each individual; firms at random, or in order, which ties the factors tightly."""
    rng = np.random.default_rng(seed)
    i = np.arange(n_rows)
    firms = max(1, n_rows // 230)
    return with_response(spark, [i // 10, i % 10, i % firms if difficult else rng.integers(0, firms, n_rows)], rng)


#: Small designs by name, for suites and tests: (spark, scale) -> DataFrame.
DESIGNS = {
    "uniform": lambda s, k=1: uniform(s, 10_000 * k, [50 * k, 80 * k, 30 * k]),
    "uniform_4": lambda s, k=1: uniform(s, 10_000 * k, [50 * k] * 4),
    "sparse_3": lambda s, k=1: sparse(s, [100 * k] * 3),
    "sparse_5": lambda s, k=1: sparse(s, [30 * k] * 5),
    "chain_2": lambda s, k=1: chain(s, 100 * k),
    "steps_3": lambda s, k=1: steps(s, 100 * k),
    "steps_4": lambda s, k=1: steps(s, 30 * k, 4),
    "star": lambda s, k=1: star(s, 100 * k),
    "barbell_2": lambda s, k=1: barbell(s, 50 * k),
    "barbell_3": lambda s, k=1: barbell_many(s, 100 * k),
    "expander": lambda s, k=1: expander(s, 100 * k, 3),
    "grid": lambda s, k=1: grid(s, 10 * k),
    "imbalanced_3": lambda s, k=1: imbalanced(s, 10_000 * k, [100 * k] * 3),
    "imbalanced_4": lambda s, k=1: imbalanced(s, 10_000 * k, [50 * k] * 4),
    "clustered": lambda s, k=1: components(s, 5, 20 * k, 100 * k, 3, 5),
    "disconnected": lambda s, k=1: components(s, 10, 10 * k, 200 * k, 3),
    "hub": lambda s, k=1: hub(s, 20_000 * k, [200 * k, 200 * k, 80 * k], 0.85),
    "dominant_block": lambda s, k=1: dominant_block(s, 20_000 * k, [200 * k, 160 * k, 120 * k]),
    "individuals": lambda s, k=1: individuals(s, 10_000 * k),
    "individuals_difficult": lambda s, k=1: individuals(s, 10_000 * k, True),
    "panel_power_law": lambda s, k=1: panel(s, 1000 * k, 10, 50 * k, 0.15, 1.5),
    "panel_low_mobility": lambda s, k=1: panel(s, 1000 * k, 10, 50 * k, 0.05, 0.0),
    "panel_regions": lambda s, k=1: panel(s, 1000 * k, 10, 50 * k, 0.1, 0.0, 5, 0.01),
    "panel_realistic": lambda s, k=1: panel(s, 1000 * k, 10, 50 * k, 0.1, 1.3, 5, 0.02),
}
