"""Projecting factors out of responses: one-shot functions, a solver to reuse, and regression on what is left."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import GMRES, LSMR, AdditiveSchwarz, MultiplicativeSchwarz, OperatorRepr, Preconditioner, SchurComplement, check
from .errors import BuildError, InvalidInput
from .operators import schwarz
from .operators.design import Design, RowVector, gather, sweep
from .operators.far import Far, squares
from .operators.spread import Spread
from .operators.krylov import EPS, Outcome, StopReason, cg, gmres, lsmr


@dataclass
class SolveResult:
    """``x``: coefficients by factor and level; ``demeaned``: the input rows and what the factors leave of the response."""

    design: Design
    demeaned: DataFrame
    converged: bool
    iterations: int
    residual: float
    time_total: float
    time_setup: float
    time_solve: float
    vector: np.ndarray  # with a far factor, without its unknowns
    reason: StopReason
    far: tuple[Far, str] | None = None

    @property
    def x(self) -> DataFrame:
        return self.design.coefficients(self.vector) if self.far is None else self.far[0].coefficients(self.far[1], self.vector)


@dataclass
class BatchSolveResult:
    names: list[str]
    design: Design
    vectors: np.ndarray
    demeaned_all: DataFrame
    converged: list[bool]
    iterations: list[int]
    final_residual: list[float]
    time_solve: list[float]
    time_total: float
    reasons: list[StopReason]
    far: Far | None = None

    n_rhs = property(lambda self: len(self.names))

    def _coefficients(self, i: int, coef: str = "coef") -> DataFrame:
        return self.design.coefficients(self.vectors[:, i], coef) if self.far is None else self.far.coefficients(self.names[i], self.vectors[:, i], coef)

    def x(self, i: int) -> DataFrame:
        return self._coefficients(i)

    @property
    def x_all(self) -> DataFrame:
        out = self._coefficients(0, f"coef_{self.names[0]}")
        for i, n in enumerate(self.names[1:], 1):
            out = out.join(self._coefficients(i, f"coef_{n}").drop("factor", "level"), "dof")
        return out

    def demeaned(self, i: int) -> DataFrame:
        keep = [c for c in self.demeaned_all.columns if c not in {f"{n}_demeaned" for n in self.names} - {f"{self.names[i]}_demeaned"}]
        return self.demeaned_all.select(*keep)

    def report(self) -> DataFrame:
        rows = [(n, bool(c), int(k), float(r), why.value) for n, c, k, r, why in zip(self.names, self.converged, self.iterations, self.final_residual, self.reasons)]
        return self.design.df.sparkSession.createDataFrame(rows, "response string, converged boolean, iterations long, residual double, reason string")


class Solver:
    """Built once for a design; solves for any responses among the columns of its DataFrame.

    ``preconditioner``: None or ``Preconditioner.Additive``, ``Multiplicative`` (GMRES only), ``Off``, a
    configuration, or one built earlier for the same design. A single factor is solved in closed form.

    With more than ``DRIVER_PAIRS`` pairs of levels, products are passes over blocks on the executors (of observations, or
    of pairs with ``Explicit``), and None stands for the diagonal instead of additive Schwarz. With more than ``MOST_PAIRS``,
    Schwarz of two factors is made and applied on the executors (``Spread``), for CG and GMRES; otherwise, and for the bare ``Preconditioner.Additive``,
    what needs the pairs on the driver raises TooLarge, and so do ``Explicit`` and Schwarz if ``most_pairs`` is given and exceeded.
    A factor of more than ``FAR_LEVELS`` levels is eliminated on the executors (CG and GMRES without Schwarz or ``Explicit``); results'
    vectors then lack its unknowns, and ``x`` makes them in Spark.
    """

    def __init__(self, df: DataFrame, factors: list[str], config=None, weights: str | None = None, preconditioner=None, levels: str = "observed", null_policy: str = "error", most_pairs: int | None = None):
        self._build(Design(df, factors, weights, levels, null_policy, most_pairs), config, preconditioner)

    @classmethod
    def from_design(cls, design: Design, config=None, preconditioner=None) -> Solver:
        """A solver of a design that was made, and perhaps scanned, before."""
        out = cls.__new__(cls)
        out._build(design, config, preconditioner)
        return out

    def _build(self, design: Design, config, preconditioner) -> None:
        began = time.perf_counter()
        self.config, choice = check(config, preconditioner)
        self.operator = getattr(self.config, "operator", OperatorRepr.Auto)
        self.design = design
        self._m = self._diagonal = self._far = self._spread = None
        given = choice if isinstance(choice, schwarz.FePreconditioner) and choice.kind == "diagonal" else None
        if (preconditioner is None or choice is Preconditioner.Off or given) and not isinstance(self.config, LSMR) and self.operator is not OperatorRepr.Explicit and design.far is not None:
            self._far = Far(design)
            diag = self._far.near.diagonal()
            if given:
                self._check_fit(given, self._far.near)
                self._diagonal = given.values
            elif preconditioner is None:
                self._diagonal = np.divide(1.0, diag, out=np.zeros_like(diag), where=diag > 0)
            self.time_setup = time.perf_counter() - began
            return
        self.design.n_obs
        if isinstance(choice, Spread):
            if isinstance(self.config, LSMR) or choice.fingerprint != self.design.fingerprint:
                raise BuildError("the preconditioner was built for another design or stays on the executors, which LSMR can't use")
            self._spread = choice
        elif isinstance(choice, schwarz.FePreconditioner):
            self._check_fit(choice, self.design)
            if given:
                self._diagonal = given.values
            else:
                self._m = choice
        elif preconditioner is None and not self.design.pairs_few:
            if self.operator is OperatorRepr.Explicit:
                self.design.gram
            diag = self.design.diagonal()
            self._diagonal = np.divide(1.0, diag, out=np.zeros_like(diag), where=diag > 0)
        elif choice is not Preconditioner.Off and self.design.n_factors > 1:
            assert isinstance(choice, AdditiveSchwarz | MultiplicativeSchwarz)
            if preconditioner is not Preconditioner.Additive and self._spreads(choice):
                kind = "multiplicative" if isinstance(choice, MultiplicativeSchwarz) else "additive"
                self._spread = Spread(self.design, kind, choice.local_solver, self.operator is OperatorRepr.Explicit)
            else:
                self._m = self._schwarz(choice)
        self.time_setup = time.perf_counter() - began

    n_dofs = property(lambda self: self.design.n_dofs)
    n_obs = property(lambda self: (self.design if self._far is None else self._far.near).n_obs)

    @staticmethod
    def _check_fit(choice: schwarz.FePreconditioner, design: Design) -> None:
        if choice.n != design.n_dofs or choice.fingerprint not in (0, design.fingerprint):
            raise BuildError("the preconditioner was built for another design")

    def _spreads(self, choice: AdditiveSchwarz | MultiplicativeSchwarz) -> bool:
        """Whether its solvers are to stay on the executors."""
        d = self.design
        return d.n_factors == 2 and not isinstance(self.config, LSMR) and isinstance(choice.local_solver, SchurComplement) and not d.bounded and not d.pairs_fit

    def _schwarz(self, choice: AdditiveSchwarz | MultiplicativeSchwarz) -> schwarz.FePreconditioner:
        gram = self.design.tab_gram if isinstance(choice, MultiplicativeSchwarz) else None
        return schwarz.build(choice, self.design.tabs, self.design.offsets, gram, self.design.fingerprint)

    def preconditioner(self) -> schwarz.FePreconditioner | Spread | None:
        """The one in use; where that is the diagonal, as there are many pairs of levels, additive Schwarz is built if it may be,
        and a diagonal is given beyond (with a far factor, of the other factors' unknowns)."""
        if self._diagonal is not None:
            if self._far is None and self.design.pairs_fit:
                return self._schwarz(AdditiveSchwarz())
            of = self.design if self._far is None else self._far.near
            return schwarz.FePreconditioner("diagonal", of.n_dofs, [], fingerprint=of.fingerprint, values=self._diagonal)
        return self._m or self._spread

    def _product(self):
        if "tabs" in self.design.__dict__ and self.operator is not OperatorRepr.Implicit:
            return self.design.tab_gram.matvec
        if self.operator is OperatorRepr.Implicit or self.operator is OperatorRepr.Auto and not self.design.pairs_few:
            return self.design.implicit_product
        return self.design.gram.matvec

    def _apply(self):
        return self._m if self._diagonal is None else lambda r: self._diagonal * r

    def _krylov(self, a, b: np.ndarray, tol: float, m=None) -> Outcome:
        c, m = self.config, m or self._apply()
        if isinstance(c, GMRES):
            return gmres(a, b, m, tol, c.maxiter, c.restart)
        return cg(a, b, m, tol, c.maxiter)

    def _cluster_blocks(self) -> DataFrame | None:
        """The blocks that products pass over, if they are such that the largest factor can be eliminated in them."""
        d = self.design
        if self._spread is not None:
            return self._spread.blocks
        if d.pairs_few or self._m is not None or d.eliminable is None:
            return None
        if self.operator is OperatorRepr.Explicit:
            return d.pair_blocks[0] if d.cluster_pairs_fit and d.n_factors == 2 else None
        return d.encoded

    def _iterate(self, b: np.ndarray, tol: float) -> Outcome:
        """Solves for all unknowns; with blocks, for those of the other factors, what the largest one's levels
        explain being taken off within each block. The largest factor's unknowns follow, and the residual is that of all."""
        blocks = self._cluster_blocks()
        if blocks is None:
            return self._krylov(self._product(), b, tol)
        _, start, end = gone = self.design.eliminable if self._spread is None else self._spread.gone
        diag, rest = self.design.diagonal(), np.r_[0:start, end : len(b)]
        x, size = np.zeros_like(b), float(np.linalg.norm(b))
        x[start:end] = np.divide(b[start:end], diag[start:end], out=np.zeros(end - start), where=diag[start:end] > 0)
        left = b[rest] - sweep(blocks, x)[0][rest]
        small = float(np.linalg.norm(left))
        if size < EPS or small <= tol * size:
            return Outcome(x, True, 0, small / size if size else 0.0, StopReason.Tolerance if size >= EPS else StopReason.ZeroRhs)
        m = self._spread.apply if self._spread is not None else None if self._diagonal is None else lambda r: self._diagonal[rest] * r
        out = self._krylov(lambda z: sweep(blocks, z, gone=gone)[0], left, tol * size / small, m)
        x[:] = 0.0
        x[rest] = out.x
        own = b[start:end] - sweep(blocks, x)[0][start:end]
        x[start:end] = np.divide(own, diag[start:end], out=np.zeros(end - start), where=diag[start:end] > 0)
        return Outcome(x, out.converged, out.iterations, out.residual * small / size, out.reason)

    def _residual_sums(self, names: list[str], x: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
        """D'W(y - Dx) of all responses, in one pass over the observations; with many pairs of levels, over the blocks for each."""
        if b is not None and not self.design.pairs_few and np.isfinite(x).all():
            blocks = self._cluster_blocks()
            product = self._product() if blocks is None else lambda v: sweep(blocks, v)[0]
            return np.stack([b[:, j] - product(x[:, j]) for j in range(len(names))], axis=1)
        df = self.design.df
        for j, n in enumerate(names):
            df = self.design.fitted(df, x[:, j], f"__fit{j}")
        return self.design.sums(df, {n: F.col(f"`{n}`").cast("double") - F.col(f"__fit{j}") for j, n in enumerate(names)})

    def _solve(self, names: list[str]) -> tuple[np.ndarray, list[Outcome], list[float], list[float]]:
        d = self.design
        missing = [n for n in names if n not in d.df.columns]
        if missing or not names:
            raise InvalidInput(f"no such response: {missing}" if missing else "give at least one response")
        if self._far is not None:
            return self._solve_far(names)
        b = d.sums(d.df, {n: F.col(f"`{n}`") for n in names})
        norms = np.linalg.norm(b, axis=0)
        x, out, took = np.zeros_like(b), [], []
        for j, _ in enumerate(names):
            began = time.perf_counter()
            if not np.isfinite(b[:, j]).all():
                if isinstance(self.config, LSMR):
                    raise InvalidInput("the response must be finite")
                x[:, j] = np.nan
                out.append(Outcome(x[:, j], False, 0, float("nan"), StopReason.NotFinite))
            elif d.n_factors == 1:
                diag = d.diagonal()
                x[:, j] = np.divide(b[:, j], diag, out=np.zeros_like(diag), where=diag > 0)
                out.append(Outcome(x[:, j], True, 0, 0.0, StopReason.ClosedForm))
            elif isinstance(self.config, LSMR):
                out.append(self._lsmr(names[j]))
                x[:, j] = out[-1].x
            else:
                out.append(self._iterate(b[:, j], self.config.tol))
                x[:, j] = out[-1].x
            took.append(time.perf_counter() - began)
        left = self._residual_sums(names, x, b if d.n_factors > 1 else None)
        for _ in range(0 if isinstance(self.config, LSMR) or d.n_factors == 1 else self.config.max_refinements):
            again = [j for j, o in enumerate(out) if np.isfinite(norms[j]) and norms[j] >= EPS and np.linalg.norm(left[:, j]) > self.config.tol * norms[j]]
            if not again:
                break
            for j in again:
                size = float(np.linalg.norm(left[:, j]))
                more = self._iterate(left[:, j], min(self.config.tol * norms[j] / size, 1.0))
                x[:, j] += more.x
                out[j] = Outcome(x[:, j], more.converged, out[j].iterations + more.iterations, more.residual, more.reason)
            left = self._residual_sums(names, x, b if d.n_factors > 1 else None)
        final = [float(np.linalg.norm(left[:, j]) / max(norms[j], 1e-15)) for j in range(len(names))]
        return x, out, final, took

    def _solve_far(self, names: list[str]) -> tuple[np.ndarray, list[Outcome], list[float], list[float]]:
        """The same for the unknowns of all factors but the far one, which is eliminated in blocks; sizes are those of all sums of the response."""
        far, c = self._far, self.config
        b = far.near.sums(far.near.df, {n: F.col(f"`{n}`") for n in names})
        x, out, final, took = np.zeros_like(b), [], [], []
        for j, n in enumerate(names):
            began = time.perf_counter()
            if not np.isfinite(b[:, j]).all():
                x[:, j] = np.nan
                out.append(Outcome(x[:, j], False, 0, float("nan"), StopReason.NotFinite))
                final.append(float("nan"))
                took.append(time.perf_counter() - began)
                continue
            blocks = far.blocks(F.col(f"`{n}`")).persist()
            size = float(np.sqrt(b[:, j] @ b[:, j] + squares(blocks)))
            left = far.left(blocks, x[:, j])
            small = float(np.linalg.norm(left))
            done = Outcome(x[:, j], True, 0, small / max(size, 1e-15), StopReason.Tolerance if size >= EPS else StopReason.ZeroRhs)
            for _ in range(1 + c.max_refinements):
                if size < EPS or small <= c.tol * size:
                    break
                more = self._krylov(lambda z, blocks=blocks: far.product(blocks, z), left, min(c.tol * size / small, 1.0))
                x[:, j] += more.x
                left = far.left(blocks, x[:, j])
                small = float(np.linalg.norm(left))
                done = Outcome(x[:, j], more.converged, done.iterations + more.iterations, small / size, more.reason)
            blocks.unpersist()
            out.append(done)
            final.append(small / max(size, 1e-15))
            took.append(time.perf_counter() - began)
        return x, out, final, took

    def _lsmr(self, name: str) -> Outcome:
        """On distinct tuples of levels if they fit; beyond, each step is a pass over the observations."""
        d, c = self.design, self.config
        if not d.cells_fit:
            rows = d.encode(F.col(f"`{name}`")).persist()
            try:
                y = RowVector(rows, np.zeros(d.n_dofs), 1.0)
                return lsmr(y.product, RowVector.sums, y, self._apply(), c.tol, c.maxiter, c.local_size)
            finally:
                rows.unpersist()
        cells = d.cells({name: F.col(f"`{name}`")})
        on = cells.w > 0
        root = np.sqrt(cells.w[on])
        codes, b = cells.codes[:, on], cells.wy[on, 0] / root
        extra = max(float(cells.wyy[on, 0].sum() - b @ b), 0.0)

        def a(x):
            return root * x[codes].sum(axis=0)

        def at(u):
            v = root * u
            return sum(np.bincount(k, v, d.n_dofs) for k in codes)

        return lsmr(a, at, b, self._apply(), c.tol, c.maxiter, c.local_size, extra)

    def _demeaned(self, names: list[str], x: np.ndarray, single: bool) -> DataFrame:
        df = self.design.df
        for j, n in enumerate(names):
            out = "demeaned" if single else f"{n}_demeaned"
            if self._far is not None:
                df = self._far.demeaned(df, n, x[:, j], out)
                continue
            df = gather(df, self.design.factors, self.design.coefficient_tables(x[:, j]), "__fit").withColumn(out, F.col(f"`{n}`").cast("double") - F.col("__fit")).drop("__fit")
        return df

    def solve(self, y: str) -> SolveResult:
        began = time.perf_counter()
        x, out, final, took = self._solve([y])
        o, total = out[0], time.perf_counter() - began
        return SolveResult(self.design, self._demeaned([y], x, True), o.converged, o.iterations, final[0], total, total - took[0], took[0], x[:, 0], o.reason, None if self._far is None else (self._far, y))

    def solve_batch(self, ys: list[str]) -> BatchSolveResult:
        began = time.perf_counter()
        x, out, final, took = self._solve(list(ys))
        return BatchSolveResult(list(ys), self.design, x, self._demeaned(list(ys), x, False), [o.converged for o in out], [o.iterations for o in out], final, took, time.perf_counter() - began, [o.reason for o in out], self._far)


def solve(df: DataFrame, factors: list[str], y: str, weights: str | None = None, config=None, preconditioner=None, **options) -> SolveResult:
    """Demeans one response. With ``null_policy="drop"``, rows whose response is null are left out, too; else they are an error."""
    began = time.perf_counter()
    if options.get("null_policy") == "drop" and y in df.columns:
        df = df.where(F.col(f"`{y}`").isNotNull())
    s = Solver(df, factors, config, weights, preconditioner, **options)
    r = s.solve(y)
    r.time_total, r.time_setup = time.perf_counter() - began, r.time_setup + s.time_setup
    s.design.release()
    return r


def solve_batch(df: DataFrame, factors: list[str], ys: list[str], weights: str | None = None, config=None, preconditioner=None, **options) -> BatchSolveResult:
    """Demeans several responses of one design. A null in any of them is an error: they share their rows."""
    began = time.perf_counter()
    r = Solver(df, factors, config, weights, preconditioner, **options).solve_batch(ys)
    r.time_total = time.perf_counter() - began
    r.design.release()
    return r


def regress(df: DataFrame, factors: list[str], y: str, xs: list[str], weights: str | None = None, config=None, preconditioner=None) -> DataFrame:
    """Slopes of y on xs beside the factors: demean all of them in one batch, then least squares on what is left."""
    r = solve_batch(df, factors, [y, *xs], weights, config, preconditioner)
    w = F.col(f"`{weights}`").cast("double") if weights else F.lit(1.0)
    cols = [F.col(f"`{n}_demeaned`") for n in (y, *xs)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    got = r.demeaned_all.agg(*[F.sum(w * cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    a = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        a[i, j] = a[j, i] = got[f"s{i}_{j}"] or 0.0
    slopes = np.linalg.lstsq(a[1:, 1:], a[1:, 0], rcond=None)[0]
    return df.sparkSession.createDataFrame([(n, float(b)) for n, b in zip(xs, slopes)], "term string, slope double")
