"""The design of categorical factors, as relational operations on the observations.

Observations stay in Spark. One scan with grouping sets aggregates them by every level, and another,
made only when it is asked for and bounded, by every pair of levels; what comes back is as large as the
factors, not as the data. Factor levels may be of any type that can be grouped; levels are numbered in
their order, one factor after another.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyObservations, InvalidInput, TooLarge
from .matrices import CrossTab, SparseMatrix, TabGram

MOST_PAIRS = 20_000_000
DRIVER_PAIRS = 2_000_000  # beyond, products and what is chosen for want of a wish leave pairs of levels on the executors
FAR_LEVELS = 2_000_000  # beyond, the largest factor's levels and unknowns stay on the executors where a solver eliminates it
BROADCAST_LEVELS = 1_000_000
BLOCK_ROWS = 500_000
SUM_UNKNOWNS = 20_000  # sums of more unknowns than that are added up on the executors, so many at a time
LOCAL_BYTES = "1m"  # larger frames go to Spark as arrays, not as rows that the driver's JVM makes of them


@contextlib.contextmanager
def _arrow(spark):
    """Frames come and go as arrays, not as objects of Python for every row."""
    wanted = {"spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.execution.arrow.localRelationThreshold": LOCAL_BYTES}
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def fetch(df: DataFrame) -> pd.DataFrame:
    with _arrow(df.sparkSession):
        return df.toPandas()


def send(spark, rows: pd.DataFrame) -> DataFrame:
    with _arrow(spark):
        return spark.createDataFrame(rows)


def gather(df: DataFrame, factors: list[str], tables: list[DataFrame], value: str) -> Column | DataFrame:
    """``df`` with ``value`` added: the sum of the factors' coefficients, each table being (level, coef)."""
    for k, (f, t) in enumerate(zip(factors, tables)):
        df = df.join(t.select(F.col("level").alias(f"__l{k}"), F.col("coef").alias(f"__c{k}")), F.col(f"`{f}`").eqNullSafe(F.col(f"__l{k}")), "left").drop(f"__l{k}")
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"__c{k}"), F.lit(0.0)) for k in range(len(factors))])
    return df.withColumn(value, total).drop(*[f"__c{k}" for k in range(len(factors))])


def scatter(df: DataFrame, factors: list[str], values: dict[str, Column]) -> DataFrame:
    """Sums of the values by every level of every factor, in one pass: (factor number, level as text, sums)."""
    parts = F.array(*[F.struct(F.lit(k).alias("factor"), F.col(f"`{f}`").cast("string").alias("level")) for k, f in enumerate(factors)])
    spread = df.select(F.explode(parts).alias("p"), *[v.alias(n) for n, v in values.items()])
    return spread.groupBy("p.factor", "p.level").agg(*[F.sum(n).alias(n) for n in values])


def cross_tab(df: DataFrame, q: str, r: str, weight: Column) -> DataFrame:
    return df.groupBy(F.col(f"`{q}`").alias("q"), F.col(f"`{r}`").alias("r")).agg(F.sum(weight).alias("w"))


def reduced_matrix(tab: DataFrame) -> DataFrame:
    """(i, j, s): what eliminating the q levels of a cross-tabulation (q, r, w) leaves between those of r, every cell that a q level reaches.

    Each q level meets every two of its r levels. Before any of that is dealt out, products are made and added up some q levels at a time,
    those with near smallest r levels together, and only for i <= j: what is shuffled follows the tabulation and the result, not the products.
    Rows without q count on the diagonal alone.
    """
    met = tab.repartition("q").groupBy("q").agg(F.min("r").alias("least"), F.collect_list(F.struct("r", "w")).alias("l"))
    met = met.select("least", F.col("q").isNotNull().alias("goes"), F.transform("l", lambda x: x["r"]).alias("r"), F.transform("l", lambda x: x["w"]).alias("w")).repartitionByRange("least")
    kind = tab.schema["r"].dataType.simpleString()
    half = met.select("goes", "r", "w").mapInArrow(eliminated, f"i {kind}, j {kind}, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    both = F.when(F.col("i").eqNullSafe(F.col("j")), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.select(F.explode(both).alias("at"), "s").select("at.i", "at.j", "s")


def eliminated(batches, products: int = 4_000_000, cells: int = 8_000_000):
    """Cells i <= j (in the order of levels, null last) of the reduced matrix from rows of lists r and w, one for each level that goes or
    merely counts; equal cells are one for about so many products."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        r, w = b.column("r"), b.column("w").flatten().to_numpy()
        coded = r.flatten().dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        levels, code = coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]
        sizes = np.diff(np.asarray(r.offsets))
        row = np.repeat(np.arange(len(sizes)), sizes)
        goes = b.column("goes").to_numpy(zero_copy_only=False)[row]
        share = np.where(goes, w / np.bincount(row, w, len(sizes))[row], 0.0)
        sort = np.lexsort((code, row))
        code, w, share = code[sort], w[sort], share[sort]
        upto = np.where(goes, np.repeat(np.cumsum(sizes), sizes) - np.arange(len(row)), 1)  # of its own row, those from each entry on
        made, at = np.r_[0, np.cumsum(upto)], 0
        while at < len(code):
            end = max(at + 1, int(np.searchsorted(made, made[at] + products, "right")) - 1)
            n = upto[at:end]
            left = np.repeat(np.arange(at, end), n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + left
            lo, hi = code[at:end].min(), code[right].max()
            k = hi - lo + 1
            cell, value = (code[left] - lo) * k + code[right] - lo, np.where(left == right, w[left], 0.0) - share[left] * w[right]
            if k * k <= cells:
                seen = np.flatnonzero(np.bincount(cell, minlength=k * k))
                total = np.bincount(cell, value, k * k)[seen]
            else:
                seen, own = np.unique(cell, return_inverse=True)
                total = np.bincount(own, value, len(seen))
            for x in range(0, len(seen), 100_000):
                i, j = seen[x : x + 100_000] // k + lo, seen[x : x + 100_000] % k + lo
                yield pa.RecordBatch.from_arrays([levels.take(pa.array(i)), levels.take(pa.array(j)), pa.array(total[x : x + 100_000])], ["i", "j", "s"])
            at = end


def places(levels: np.ndarray, values) -> np.ndarray:
    """Where the values, all of them levels, stand among the levels."""
    if levels.dtype.kind in "iu":
        return np.searchsorted(levels, np.asarray(values)).astype(np.int32)
    return pd.Index(levels).get_indexer(pd.Index(values)).astype(np.int32)


@dataclass
class Cells:
    """Distinct tuples of levels: codes by factor, weight, weighted sum of each response and of its squares."""

    codes: np.ndarray
    w: np.ndarray
    wy: np.ndarray
    wyy: np.ndarray


class Design:
    """Factors, optional weights and what one aggregation says of them.

    ``levels="codes"`` takes integer codes from 0 to the largest, unseen ones included, and
    ``"observed"`` the levels that occur. ``null_policy``: ``"error"``, or ``"drop"`` rows with a null
    factor or weight. Weights that are negative are refused; those that are NaN are an error too.
    ``most_pairs`` bounds pairs of levels wherever they are; None: only those on the driver, by ``MOST_PAIRS``.
    """

    def __init__(self, df: DataFrame, factors: list[str], weight: str | None = None, levels: str = "observed", null_policy: str = "error", most_pairs: int | None = None):
        if not factors or len(set(factors)) != len(factors):
            raise InvalidInput("give at least one factor, each once")
        if levels not in ("observed", "codes") or null_policy not in ("error", "drop"):
            raise InvalidInput("unknown levels or null_policy")
        self.factors, self.weight, self.levels_mode, self.null_policy = list(factors), weight, levels, null_policy
        self.most_pairs, self.bounded = MOST_PAIRS if most_pairs is None else most_pairs, most_pairs is not None
        used = [*factors, *([weight] if weight else [])]
        if null_policy == "drop":
            df = df.dropna(subset=used)
        self.df, self.kept = df, []  # kept: more frames to give back on release

    @property
    def w(self) -> Column:
        return F.col(f"`{self.weight}`").cast("double") if self.weight else F.lit(1.0)

    n_factors = property(lambda self: len(self.factors))

    @cached_property
    def far(self) -> int | None:
        """The factor of most levels, if there are more than ``FAR_LEVELS`` and no level has more rows than a block; known without its levels."""
        if self.n_factors < 2 or self.levels_mode != "observed" or self.df.count() <= FAR_LEVELS:
            return None
        cols = [F.col(f"`{f}`") for f in self.factors]
        about = self.df.agg(*[F.approx_count_distinct(c, 0.03) for c in cols], *[F.max(c.isNull()) for c in cols]).first()
        k = max(range(self.n_factors), key=lambda k: about[k])
        if about[k] <= FAR_LEVELS or self.df.schema[self.factors[k]].dataType.typeName() not in ("byte", "short", "integer", "long", "string"):
            return None
        if any(about[self.n_factors :]):
            raise InvalidInput("a factor is null in some rows; use null_policy='drop'")
        return k if self.df.groupBy(cols[k].alias("f")).count().where(F.col("count") > BLOCK_ROWS).isEmpty() else None

    def _grouped(self, sets: list[list[int]]) -> DataFrame:
        """Weights, counts and checks by the levels of each set of factors, from one scan."""
        base = self.df.select(*[F.col(f"`{f}`").alias(f"f{k}") for k, f in enumerate(self.factors)], self.w.alias("w"))
        cols = [f"f{k}" for k in range(self.n_factors)]
        bad = (F.col("w").isNull() | F.isnan("w") | (F.col("w") < 0)).cast("long")
        nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]).cast("long")
        checked = base.withColumn("bad", bad).withColumn("nulls", nulls)
        grouped = checked.groupingSets([[F.col(f"f{k}") for k in s] for s in sets], *[F.col(c) for c in cols]).agg(
            F.grouping_id().alias("gid"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"), F.sum("nulls").alias("nulls")
        )
        return self._whole(grouped)

    @cached_property
    def _margins(self) -> list[pd.DataFrame]:
        """Single levels of each factor, and totals: as many rows as unknowns, so they have no bound."""
        got = self._grouped([[k] for k in range(self.n_factors)] + [[]])
        got = fetch(got.withColumns({"gid": F.col("gid").cast("int"), "bad": F.col("bad") > 0, "nulls": F.col("nulls") > 0}))
        return [got.loc[got["gid"] == self._gid(k), [f"f{k}", "w", "n"]] for k in range(self.n_factors)] + [got.loc[got["gid"] == self._gid(), ["n", "bad", "nulls"]]]

    def _gid(self, *which: int) -> int:
        """What Spark calls the set of these factors."""
        return sum(1 << (self.n_factors - 1 - k) for k in range(self.n_factors) if k not in which)

    @cached_property
    def _pairs(self) -> pd.DataFrame:
        """Pairs of levels, if they do not exceed the bound."""
        if not self.pairs_fit:
            raise TooLarge(f"more than {self.most_pairs} pairs of levels; use the Implicit operator without an explicit preconditioner, or with Preconditioner.Off")
        got = self._pair_groups().drop("n", "bad", "nulls")
        small = {c: F.col(c).cast("int") for c, kind in got.dtypes if c[0] == "f" and kind == "bigint" and all(-(1 << 31) <= x < 1 << 31 for x in self.levels[int(c[1:])][[0, -1]].tolist())}
        return fetch(got.withColumns(small | {"gid": F.col("gid").cast("int")}))

    def _pair_groups(self) -> DataFrame:
        return self._grouped([list(p) for p in combinations(range(self.n_factors), 2)])

    @cached_property
    def pairs_fit(self) -> bool:
        """Whether there are at most ``most_pairs`` pairs of levels; they are counted in Spark unless rows and levels rule more out."""
        return self._pairs_within(self.most_pairs)

    @property
    def cluster_pairs_fit(self) -> bool:
        """Whether products may be made of pairs of levels on the executors."""
        return not self.bounded or self.pairs_fit

    @cached_property
    def pairs_few(self) -> bool:
        """Whether they are few enough for products on the driver, and for choices that nobody made by name."""
        return self._pairs_within(min(self.most_pairs, DRIVER_PAIRS))

    def _pairs_within(self, most: int) -> bool:
        if sum(min(self.n_obs, a * b) for a, b in combinations(self.n_levels, 2)) <= most:
            return True
        about = self._pairs_about
        return about < 0.7 * most or about <= 1.3 * most and self._pairs_counted <= most

    @cached_property
    def _pairs_about(self) -> int:
        """Roughly (within a few hundredths) as many pairs as there are, from one scan without shuffle."""
        both = [F.approx_count_distinct(F.struct(F.col(f"`{a}`"), F.col(f"`{b}`")), 0.03) for a, b in combinations(self.factors, 2)]
        return sum(self.df.agg(*both).first())

    @cached_property
    def _pairs_counted(self) -> int:
        return self._pair_groups().count()

    @staticmethod
    def _whole(grouped: DataFrame) -> DataFrame:
        """Integer levels without the nulls of other grouping sets, which would turn them into doubles."""
        ints = [f.name for f in grouped.schema if f.name[:1] == "f" and f.dataType.typeName() in ("byte", "short", "integer", "long")]
        return grouped.withColumns({c: F.coalesce(c, F.lit(0).cast(grouped.schema[c].dataType)) for c in ints})

    def _set(self, *which: int) -> pd.DataFrame:
        if len(which) < 2:
            return self._margins[which[0] if which else -1]
        return self._pairs if self.n_factors == 2 else self._pairs[self._pairs["gid"] == self._gid(*which)]

    @cached_property
    def n_obs(self) -> int:
        total = self._set()
        n = int(total["n"].sum()) if len(total) else 0
        if n == 0:
            raise EmptyObservations("there are no observations")
        if int(total["nulls"].iloc[0] or 0):
            raise InvalidInput("a factor is null in some rows; use null_policy='drop'")
        if int(total["bad"].iloc[0] or 0):
            raise InvalidInput("weights must not be null, NaN or negative")
        return n

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """The levels of each factor, in order."""
        self.n_obs
        out = []
        for k in range(self.n_factors):
            seen = self._set(k)[f"f{k}"].to_numpy()
            if self.levels_mode == "codes":
                if (seen.astype(np.int64) < 0).any():
                    raise InvalidInput("codes must not be negative")
                out.append(np.arange(int(seen.max()) + 1))
            else:
                out.append(np.sort(seen) if seen.dtype.kind in "iu" else np.array(sorted(seen), dtype=seen.dtype))
        return out

    n_levels = property(lambda self: [len(x) for x in self.levels])

    @cached_property
    def offsets(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.n_levels)]

    n_dofs = property(lambda self: int(self.offsets[-1]))

    def codes(self, factor: int, values) -> np.ndarray:
        return places(self.levels[factor], values)

    @cached_property
    def fingerprint(self) -> int:
        """A digest of the factors' levels that is the same in every process."""
        h = hashlib.sha256()
        for x in self.levels:
            h.update(f"{len(x)}:".encode())
            for v in map(str, x):
                h.update(f"{len(v)}:{v}".encode())
        return int.from_bytes(h.digest()[:7], "big")

    def active(self, factor: int) -> np.ndarray:
        """Which levels occur."""
        out = np.zeros(self.n_levels[factor], bool)
        out[self.codes(factor, self._set(factor)[f"f{factor}"])] = True
        return out

    def diagonal(self) -> np.ndarray:
        """Weights by level: the Gramian's diagonal."""
        out = np.zeros(self.n_dofs)
        for k in range(self.n_factors):
            s = self._set(k)
            out[self.offsets[k] + self.codes(k, s[f"f{k}"])] = s["w"].to_numpy(float)
        return out

    def tab(self, q: int, r: int, all_levels: bool = False) -> CrossTab:
        """The cross-tabulation of two factors. Sums of 0 are no edges."""
        s = self._set(q, r)
        if not (s["w"] > 0).all():
            s = s[s["w"] > 0]
        d = self.diagonal()
        return CrossTab(self.codes(q, s[f"f{q}"]), self.codes(r, s[f"f{r}"]), s["w"].to_numpy(float), d[self.offsets[q] : self.offsets[q + 1]], d[self.offsets[r] : self.offsets[r + 1]])

    @cached_property
    def tab_gram(self) -> SparseMatrix | TabGram:
        """D'WD on the driver, whatever the number of pairs up to the bound."""
        return self.gram if self.pairs_few else TabGram(self.tabs, self.offsets, self.diagonal())

    @cached_property
    def tabs(self) -> dict[tuple[int, int], CrossTab]:
        out = {(q, r): self.tab(q, r) for q in range(self.n_factors) for r in range(q + 1, self.n_factors)}
        if not self.pairs_few:
            self.__dict__.pop("_pairs", None)  # the tabulations hold it all
        return out

    @cached_property
    def gram(self) -> SparseMatrix | TabGram | ClusterGram:
        """D'WD, put together from the tabulations; no scan of its own. With many pairs of levels, they are left on the executors."""
        if not self.pairs_few:
            if not self.cluster_pairs_fit:
                raise TooLarge(f"more than {self.most_pairs} pairs of levels; use the Implicit operator")
            return ClusterGram(self)
        d = self.diagonal()
        rows, cols, vals = [np.arange(self.n_dofs)], [np.arange(self.n_dofs)], [d]
        for (q, r), t in self.tabs.items():
            a, b = t.q + self.offsets[q], t.r + self.offsets[r]
            rows += [a, b]
            cols += [b, a]
            vals += [t.w, t.w]
        return SparseMatrix(self.n_dofs, np.concatenate(rows), np.concatenate(cols), np.concatenate(vals))

    def sums(self, df: DataFrame, columns: dict[str, Column]) -> np.ndarray:
        """D'W y for each column, one pass for all: an array of (unknowns, columns). A null in a column is an error,
        as its row counts in the Gramian."""
        names = list(columns)
        base = df.select(*[F.col(f"`{f}`").alias(f"f{k}") for k, f in enumerate(self.factors)], *[(self.w * v.cast("double")).alias(f"v{j}") for j, v in enumerate(columns.values())], *[v.isNull().cast("long").alias(f"z{j}") for j, v in enumerate(columns.values())])
        cols = [f"f{k}" for k in range(self.n_factors)]
        sums = base.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(F.grouping_id().alias("gid"), *[F.sum(f"{x}{j}").alias(f"{x}{j}") for x in "vz" for j in range(len(names))])
        got = fetch(self._whole(sums).withColumns({"gid": F.col("gid").cast("int")} | {f"z{j}": F.col(f"z{j}") > 0 for j in range(len(names))}))
        empty = [n for j, n in enumerate(names) if got[f"z{j}"].sum()]
        if empty:
            raise InvalidInput(f"null in some rows of {empty}; drop those rows first (solve with null_policy='drop' does)")
        out = np.zeros((self.n_dofs, len(names)))
        for k in range(self.n_factors):
            s = got[got["gid"] == self._gid(k)]
            out[self.offsets[k] + self.codes(k, s[f"f{k}"])] = s[[f"v{j}" for j in range(len(names))]].to_numpy(float)
        return out

    def cells(self, columns: dict[str, Column]) -> Cells:
        """Observations by distinct tuple of levels, for solvers that work on rows."""
        base = self.df.select(*[F.col(f"`{f}`").alias(f"f{k}") for k, f in enumerate(self.factors)], self.w.alias("w"), *[v.cast("double").alias(f"y{j}") for j, v in enumerate(columns.values())])
        n = len(columns)
        got = base.groupBy(*[f"f{k}" for k in range(self.n_factors)]).agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f"y{j}")).alias(f"s{j}") for j in range(n)], *[F.sum(F.col("w") * F.col(f"y{j}") * F.col(f"y{j}")).alias(f"t{j}") for j in range(n)])
        if not self.cells_fit:
            raise TooLarge(f"more than {min(self.most_pairs, DRIVER_PAIRS)} distinct tuples of levels")
        got = fetch(got)
        codes = np.stack([self.offsets[k] + self.codes(k, got[f"f{k}"]) for k in range(self.n_factors)])
        order = np.lexsort(codes[::-1])
        pick = lambda p: got[[f"{p}{j}" for j in range(n)]].to_numpy(float)[order]
        return Cells(codes[:, order], got["w"].to_numpy(float)[order], pick("s"), pick("t"))

    @cached_property
    def cells_fit(self) -> bool:
        """Whether the distinct tuples of levels are few enough for the driver; counted in Spark unless rows or levels rule more out."""
        most = min(self.most_pairs, DRIVER_PAIRS)
        if min(self.n_obs, math.prod(self.n_levels)) <= most:
            return True
        cols = [F.col(f"`{f}`") for f in self.factors]
        about = self.df.agg(F.approx_count_distinct(F.struct(*cols), 0.03)).first()[0]
        return about < 0.7 * most or about <= 1.3 * most and self.df.select(*cols).distinct().count() <= most

    def coefficient_tables(self, x: np.ndarray) -> list[DataFrame]:
        """(level, coef) of each factor, as tables; small ones are marked for broadcast."""
        spark, out = self.df.sparkSession, []
        for k, f in enumerate(self.factors):
            part = pd.DataFrame({"level": self.levels[k], "coef": x[self.offsets[k] : self.offsets[k + 1]].astype(float)})
            kind = self.df.schema[f].dataType.simpleString()
            t = send(spark, part).select(F.col("level").cast(kind).alias("level"), "coef")
            out.append(F.broadcast(t) if len(part) <= BROADCAST_LEVELS else t)
        return out

    def fitted(self, df: DataFrame, x: np.ndarray, value: str) -> DataFrame:
        return gather(df, self.factors, self.coefficient_tables(x), value)

    def coefficients(self, x: np.ndarray, name: str = "coef") -> DataFrame:
        """factor, level (as text), dof and coefficient of every level."""
        out = []
        for k, f in enumerate(self.factors):
            at = slice(self.offsets[k], self.offsets[k + 1])
            level = self.levels[k] if self.levels[k].dtype.kind in "iu" else [str(v) for v in self.levels[k]]
            part = send(self.df.sparkSession, pd.DataFrame({"level": level, "dof": np.arange(at.start, at.stop), name: x[at].astype(float)}))
            out.append(part.select(F.lit(f).alias("factor"), F.col("level").cast("string").alias("level"), "dof", F.col(f"`{name}`")))
        return reduce(DataFrame.unionAll, out)

    @cached_property
    def encoded(self) -> DataFrame:
        """Blocks of all observations, for products over them; kept until ``release``."""
        return self.encode().persist()

    @cached_property
    def pair_blocks(self) -> list[DataFrame]:
        """Blocks of each pair of factors: its pairs of levels and their weights; kept until ``release``."""
        return [self._blocks(self._rows({"w": self.w}), p, summed=True).persist() for p in combinations(range(self.n_factors), 2)]

    def release(self) -> None:
        """Give back what is kept on the executors."""
        for kept in (self.__dict__.pop("encoded", None), *self.__dict__.pop("pair_blocks", ()), *self.kept):
            if kept is not None:
                kept.unpersist()
        self.kept.clear()

    def _rows(self, more: dict[str, Column]) -> DataFrame:
        return self.df.select(*[F.col(f"`{f}`").alias(f"f{k}") for k, f in enumerate(self.factors)], *[v.alias(n) for n, v in more.items()])

    def encode(self, y: Column | None = None, far: str | None = None) -> DataFrame:
        """The observations, with their weights and responses if there are any, in blocks (see ``pack``).

        ``far``: a column that is one more factor, the last, without unknowns; blocks are ranges of its levels.
        """
        more = ({"w": self.w} if self.weight else {}) | ({} if y is None else {"y": y.cast("double")}) | ({} if far is None else {"far": F.col(f"`{far}`")})
        return self._blocks(self._rows(more), tuple(range(self.n_factors)))

    def _blocks(self, rows: DataFrame, which: tuple[int, ...], summed: bool = False) -> DataFrame:
        """Rows of f0, f1, ... and w and y, dealt out by the factor of most levels, so that sums by its levels meet in one block, and packed.

        ``summed``: rows with the same levels are one, their weights added up. With a column ``far``, rows are dealt out by its ranges.
        """
        spark, cols = rows.sparkSession, [f"f{k}" for k in which]
        more = [c for c in ("w", "y", "far") if c in rows.columns]
        rows = rows.select(*cols, *more)
        levels = [self.levels[k] for k in which]
        for c, lv in zip(cols, levels):
            if rows.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long", "string"):
                t = spark.createDataFrame(pd.DataFrame({"l": lv, "d": np.arange(len(lv), dtype=np.int64)}))
                rows = rows.join(F.broadcast(t) if len(lv) <= BROADCAST_LEVELS else t, F.col(c) == F.col("l")).withColumn(c, F.col("d")).select(*cols, *more)
        coded = [rows.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") and lv.dtype.kind not in "iu" for c, lv in zip(cols, levels)]
        most = which.index(max(which, key=lambda k: self.n_levels[k]))
        n = max(-(-self.n_obs // BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, -(-self.n_obs // 50_000)))
        rows = rows.repartitionByRange(n, "far") if "far" in more else rows.repartition(n, cols[most])
        if summed:
            rows = rows.groupBy(*cols).agg(F.sum("w").alias("w"))
        shared = spark.sparkContext.broadcast([None if c else x for c, x in zip(coded, levels)])
        offsets = [int(self.offsets[k]) for k in which]
        hot = self._hot if which[most] == self.largest and not summed and "far" not in more else np.zeros(0, int)
        hot = (most, hot if coded[most] else self.levels[which[most]][hot].tolist())
        n_cols = len(cols) + ("far" in more)
        return rows.mapInArrow(lambda batches: pack(batches, shared.value, offsets, more, hot), ", ".join([*(f"{x}{k} binary" for k in range(n_cols) for x in "ud"), "w binary", "y binary"]))

    @cached_property
    def largest(self) -> int:
        """The factor of most levels, by which blocks are dealt out."""
        return max(range(self.n_factors), key=lambda k: self.n_levels[k])

    @cached_property
    def _hot(self) -> np.ndarray:
        """Its levels with so many rows that they stand in several blocks."""
        s = self._set(self.largest)
        return np.sort(self.codes(self.largest, s[f"f{self.largest}"])[s["n"].to_numpy() > BLOCK_ROWS])

    @cached_property
    def eliminable(self) -> tuple[int, int, int] | None:
        """The largest factor and the range of its unknowns, if every level of it has all its rows in one block."""
        k = self.largest
        return None if len(self._hot) or self.n_factors < 2 else (k, int(self.offsets[k]), int(self.offsets[k + 1]))

    def implicit_product(self, x: np.ndarray) -> np.ndarray:
        """D'W D x over the observations: each block gathers, scatters into its own sums, and those add up."""
        return sweep(self.encoded, x)[0]


def pack(batches, levels: list, offsets: list[int], more: list[str], hot: tuple[int, list]):
    """A block of all rows, as one row of bytes: for each factor the unknowns that occur, in u0, u1, ..., and in d0, d1, ... which of them
    every row has; the rows' weights (null: all 1) and responses (null: none). A column ``far`` has no unknowns and numbers of its own in each
    block. Rows with a hot level (factor, levels) are in blocks of their own, of limited size."""
    import pyarrow as pa
    import pyarrow.compute

    def block(held):
        table, out, names = pa.Table.from_batches(held), [], []
        for k, (lv, at) in enumerate(zip(levels, offsets)):
            local, u = pd.factorize(table.column(k).to_numpy(), sort=True)
            u = (np.asarray(u, np.int64) if lv is None else places(lv, u).astype(np.int64)) + at
            out += [u.astype(np.int32).tobytes(), local.astype(np.int32).tobytes()]
            names += [f"u{k}", f"d{k}"]
        if "far" in more:
            out += [b"", pd.factorize(table.column("far").to_numpy())[0].astype(np.int32).tobytes()]
            names += [f"u{len(levels)}", f"d{len(levels)}"]
        for c in "wy":
            out.append(table.column(c).to_numpy().astype(float).tobytes() if c in more else None)
            names.append(c)
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in out], names)

    held, many, n = [], [], 0
    for b in batches:
        if len(hot[1]):
            own = pa.compute.is_in(b.column(hot[0]), value_set=pa.array(hot[1], b.column(hot[0]).type))
            part, b = b.filter(own), b.filter(pa.compute.invert(own))
            if part.num_rows:
                many.append(part)
                n += part.num_rows
            if n >= BLOCK_ROWS:
                yield block(many)
                many, n = [], 0
        if b.num_rows:
            held.append(b)
    for rows in (many, held):
        if rows:
            yield block(rows)


def sweep(blocks: DataFrame, x: np.ndarray, c: float = 0.0, across: bool = False, gone: tuple[int, int, int] | None = None) -> tuple[np.ndarray, float]:
    """D'W v and v'W v of v = D x + c y, from one pass over the blocks. ``across``: of two factors, sums by the levels of
    each are made of the other's part of v alone. ``gone``: a factor and the range of its unknowns, which x lacks; v is less its means
    by their levels. Sums of many unknowns are added up on the executors, ``SUM_UNKNOWNS`` of them in one place, always in the order of blocks:
    what reaches the driver follows the unknowns, not the blocks."""
    import pyarrow as pa
    from pyspark import TaskContext

    width = SUM_UNKNOWNS
    spans = -(-len(x) // width)
    kinds = ["p", "k", "u", "v", "s"]
    shared, q = blocks.sparkSession.sparkContext.broadcast(x), sum(f[0] == "d" for f in blocks.columns)

    def run(batches):
        at = TaskContext.get().partitionId() << 32
        for b in batches:
            for row in range(b.num_rows):
                at += 1
                get = lambda name, kind: np.frombuffer(b.column(name)[row].as_buffer(), kind)  # noqa: B023, E731
                us, ds = [get(f"u{k}", np.int32) for k in range(q)], [get(f"d{k}", np.int32) for k in range(q)]
                w = get("w", float) if b.column("w")[row].is_valid else 1.0
                if gone:
                    f, start, end = gone
                    us = [np.where(u < start, u, u - (end - start)) for k, u in enumerate(us) if k != f]
                    by = ds.pop(f)
                own = [shared.value[u][d] for u, d in zip(us, ds)]
                if across:
                    parts, square = [own[1] * w, own[0] * w], 0.0
                else:
                    v = sum(own[1:], own[0])
                    if c:
                        v = v + c * get("y", float)
                    if gone:
                        total = np.bincount(by, v * w)
                        weight = np.bincount(by, None if np.isscalar(w) else w)
                        v = v - np.divide(total, weight, out=np.zeros_like(total), where=weight > 0)[by]
                    parts = [v * w] * len(us)
                    square = float(v @ parts[0])
                sums = [np.bincount(d, p, len(u)) for u, d, p in zip(us, ds, parts)]
                u, v = np.concatenate(us).astype(np.int32), np.concatenate(sums).astype(float)
                if spans > 1:
                    order = np.argsort(u, kind="stable")
                    u, v = u[order], v[order]
                cut = np.searchsorted(u, np.arange(1, spans) * width)
                some = [(p, a, z) for p, (a, z) in enumerate(zip(np.r_[0, cut], np.r_[cut, len(u)])) if z > a or p == 0]
                rows = [[p for p, _, _ in some], [at] * len(some), *[[c[int(a) : int(z)].tobytes() for _, a, z in some] for c in (u, v)], [0.0 if p else square for p, _, _ in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64()))], kinds)

    def add_up(batches):
        """One row for each p; those that come are in order."""
        now, total, square = None, None, 0.0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([np.arange(now * width, now * width + len(total), dtype=np.int32).tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary()), pa.array([square])], kinds[2:])

        for b in batches:
            for p, u, v, s in zip(b.column("p").to_pylist(), b.column("u"), b.column("v"), b.column("s").to_pylist()):
                if p != now:
                    if now is not None:
                        yield row()
                    now, total, square = p, np.zeros(min(width, len(shared.value) - p * width)), 0.0
                total[np.frombuffer(u.as_buffer(), np.int32) - p * width] += np.frombuffer(v.as_buffer(), float)
                square += s
        if now is not None:
            yield row()

    sums = blocks.mapInArrow(run, "p int, k long, u binary, v binary, s double")
    if spans > 1:
        n = min(spans, blocks.sparkSession.sparkContext.defaultParallelism)
        sums = sums.repartition(n, "p").sortWithinPartitions("p", "k").mapInArrow(add_up, "u binary, v binary, s double")
    got = sums.select("u", "v", "s").toArrow()
    shared.destroy()
    out = np.zeros(len(x))
    for u, v in zip(got.column(0), got.column(1)):
        out[np.frombuffer(u.as_buffer(), np.int32)] += np.frombuffer(v.as_buffer(), float)
    return out, float(sum(got.column(2).to_pylist()))


class ClusterGram:
    """D'WD whose pairs of levels, with their weights, stay on the executors; a product is a pass over them."""

    def __init__(self, design: Design):
        self.design, self.n = design, design.n_dofs

    def matvec(self, x: np.ndarray) -> np.ndarray:
        out = self.design.diagonal() * x
        for blocks in self.design.pair_blocks:
            out += sweep(blocks, x, across=True)[0]
        return out

    def diagonal(self) -> np.ndarray:
        return self.design.diagonal()


class RowVector:
    """The vector D x + c y, with an entry for each observation, known by x and c alone.

    Solvers that combine a response with products of the design need no column for it: the vectors that
    they make are all of this form. Its length, weighted, and its sums by level come from one pass over ``rows``
    (``Design.encode``), made when first asked for. c stays bounded by the ratio of y to the part of y that no x reaches.
    """

    def __init__(self, rows: DataFrame, x: np.ndarray, c: float):
        self.rows, self.x, self.c = rows, x, c
        self._known: tuple[np.ndarray, float] | None = None

    def product(self, x: np.ndarray) -> RowVector:
        return RowVector(self.rows, x, 0.0)

    def __sub__(self, other: RowVector) -> RowVector:
        return RowVector(self.rows, self.x - other.x, self.c - other.c)

    def __rmul__(self, by: float) -> RowVector:
        return self._scaled(by)

    def __truediv__(self, by: float) -> RowVector:
        return self._scaled(1 / by)

    def _scaled(self, by: float) -> RowVector:
        out = RowVector(self.rows, self.x * by, self.c * by)
        if self._known:
            out._known = self._known[0] * by, self._known[1] * abs(by)
        return out

    def length(self) -> float:
        return self._pass()[1]

    def sums(self) -> np.ndarray:
        """D'W of the vector."""
        return self._pass()[0]

    def _pass(self) -> tuple[np.ndarray, float]:
        if self._known is None:
            total, square = sweep(self.rows, self.x, self.c)
            self._known = total, float(np.sqrt(square))
        return self._known
