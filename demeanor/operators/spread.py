"""Schwarz preconditioners of two factors with too many pairs of levels for the driver: reduced systems stay on the executors."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import functions as F

from ..config import SchurComplement
from ..errors import BuildError
from .design import Design
from .local import DENSE_LEVELS, ApproxCholesky, DenseAnchored, exact_schur, sampled_schur, sparse_schur
from .matrices import CrossTab, SparseMatrix, connected

PAIRS_AT_ONCE = 500_000


class Spread:
    """Schwarz of the components of two factors, which do not touch each other, so that additive and multiplicative are the same.

    The larger factor is eliminated in blocks by the solver; this applies, to the other's unknowns, the solvers of what
    that leaves in each component. They are made and used on the executors, one component's in one place.
    """

    def __init__(self, design: Design, kind: str, config: SchurComplement, pairs: bool = False):
        self.design, self.kind, self.fingerprint = design, kind, design.fingerprint
        k = design.largest
        self.gone = (k, int(design.offsets[k]), int(design.offsets[k + 1]))
        self.pairs = pairs or design.eliminable is None
        self.n = design.n_dofs
        self.label = self._components()
        sizes = np.bincount(self.label)
        self.order, self.starts = np.argsort(self.label, kind="stable"), np.r_[0, np.cumsum(sizes)]
        self.reduced = self._solvers(config, sizes).persist()
        design.kept.append(self.reduced)

    @property
    def blocks(self):
        """Those of observations, or of pairs of levels, each with all that the levels it has of the larger factor meet."""
        return self.design.pair_blocks[0] if self.pairs else self.design.encoded

    def _components(self) -> np.ndarray:
        """A component's number for each kept level: blocks' own components, joined."""
        gone, start = self.gone[0], int(self.design.offsets[1 - self.gone[0]])

        def run(batches):
            import pyarrow as pa

            for _, u, a, _, b, w in opened(batches, gone):
                label = connected(len(u) + (int(a.max(initial=-1)) + 1), b[w > 0], len(u) + a[w > 0])[: len(u)]
                first = np.full(label.max(initial=0) + 1, len(u))
                np.minimum.at(first, label, np.arange(len(u)))
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (u - start, u[first[label]] - start)], ["u", "v"])

        n = self.design.n_levels[1 - gone]
        every = first = label = np.arange(n)
        got = self.blocks.mapInArrow(run, "u binary, v binary").toArrow()
        for u, v in zip(got.column(0), got.column(1)):
            label = connected(n, np.r_[every, np.frombuffer(u.as_buffer(), np.int32)], np.r_[first, np.frombuffer(v.as_buffer(), np.int32)])
            first = np.unique(label, return_index=True)[1][label]
        return label

    def _solvers(self, config: SchurComplement, sizes: np.ndarray):
        """(component, solver) of components with several kept levels; each block's pairs go to their components."""
        gone, start = self.gone[0], int(self.design.offsets[1 - self.gone[0]])
        place = np.empty(len(self.label), np.int32)
        place[self.order] = np.arange(len(self.label)) - np.repeat(self.starts[:-1], sizes)
        spark = self.design.df.sparkSession
        known = spark.sparkContext.broadcast((self.label.astype(np.int32), place, sizes))
        n = max(1, min(int((sizes > 1).sum()), 16 * spark.sparkContext.defaultParallelism))
        slot = np.zeros(len(sizes), np.int32)  # the largest first, so that each place has some of every size
        slot[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes)) % n
        slots = spark.sparkContext.broadcast(slot)

        def deal(batches):
            import pyarrow as pa

            label, place, sizes = known.value
            for at, u, a, g, b, w in opened(batches, gone):
                key, own = np.unique(a.astype(np.int64) * len(u) + b, return_inverse=True)
                total = np.bincount(own, w, len(key))
                key, total = key[total > 0], total[total > 0]
                a, b = key // max(len(u), 1), u[key % max(len(u), 1)] - start
                order = np.argsort(label[b], kind="stable")
                a, b, total = a[order], b[order], total[order]
                of = label[b]
                ends = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)] if len(of) else np.zeros(1, int)
                some = [(int(of[x]), slice(x, y)) for x, y in zip(ends[:-1], ends[1:]) if sizes[of[x]] > 1]
                cols = [[int(slots.value[c]) for c, _ in some], [c for c, _ in some], [at] * len(some), [g[a[s]].astype(np.int32).tobytes() for _, s in some], [place[b[s]].tobytes() for _, s in some], [total[s].tobytes() for _, s in some]]
                for x in range(0, len(some), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[x : x + 1000], t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["slot", "c", "k", "g", "u", "w"])

        def make(batches):
            import pyarrow as pa

            now = held = None
            row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pickle.dumps(held.solver(), 5)], pa.binary())], ["c", "solver"])
            for b in batches:
                for c, g, u, w in zip(b.column("c").to_pylist(), b.column("g"), b.column("u"), b.column("w")):
                    if c != now:
                        if now is not None:
                            yield row()
                        now, held = c, Reduced(int(known.value[2][c]), config)
                    held.add(*(np.frombuffer(x.as_buffer(), t) for x, t in ((g, np.int32), (u, np.int32), (w, float))))
            if now is not None:
                yield row()

        dealt = self.blocks.mapInArrow(deal, "slot int, c int, k long, g binary, u binary, w binary")
        return dealt.repartitionById(n, F.col("slot")).sortWithinPartitions("c", "k").mapInArrow(make, "c int, solver binary")

    def apply(self, r: np.ndarray) -> np.ndarray:
        """For the kept factor's unknowns."""
        shared = self.design.df.sparkSession.sparkContext.broadcast((r[self.order], self.starts))

        def run(batches):
            import pyarrow as pa

            r, starts = shared.value
            for b in batches:
                for c, solver in zip(b.column("c").to_pylist(), b.column("solver")):
                    t = r[starts[c] : starts[c + 1]]
                    z = pickle.loads(solver.as_buffer()).solve(t - t.mean())
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([(z - z.mean()).tobytes()], pa.binary())], ["c", "z"])

        got = self.reduced.mapInArrow(run, "c int, z binary").toArrow()
        shared.destroy()
        out = np.zeros(len(r))
        for c, z in zip(got.column(0).to_pylist(), got.column(1)):
            out[self.order[self.starts[c] : self.starts[c + 1]]] = np.frombuffer(z.as_buffer(), float)
        return out

    def to_bytes(self) -> bytes:
        raise BuildError("this preconditioner stays on the executors and can't be saved")


def opened(batches, gone: int):
    """Of each block: its number, the kept unknowns, every row's gone level as a number of the block's, the gone levels' numbers, every row's place among the kept, and weights."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    for b in batches:
        for row in range(b.num_rows):
            at += 1
            get = lambda name, kind: np.frombuffer(b.column(name)[row].as_buffer(), kind)  # noqa: B023, E731
            a = get(f"d{gone}", np.int32)
            w = get("w", float) if b.column("w")[row].is_valid else np.ones(len(a))
            yield at, get(f"u{1 - gone}", np.int32), a, get(f"u{gone}", np.int32), get(f"d{1 - gone}", np.int32), w


class Reduced:
    """The reduced matrix of one component, added up from parts that have all pairs of the eliminated levels in them."""

    def __init__(self, n: int, config: SchurComplement):
        self.n, self.config, self.held, self.many = n, config, [], 0
        self.direct = bool(config.dense_threshold) and n <= config.dense_threshold
        self.dense = self.direct or n <= DENSE_LEVELS
        self.total = np.zeros((n, n)) if self.dense else SparseMatrix(n, np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def add(self, g: np.ndarray, u: np.ndarray, w: np.ndarray) -> None:
        self.held.append((g, u, w))
        self.many += len(g)
        if self.many >= PAIRS_AT_ONCE:
            self._fold()

    def _fold(self) -> None:
        g, u, w = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.many = [], 0
        numbers, own = np.unique(g, return_inverse=True)
        t = CrossTab(own, u, w, np.bincount(own, w, len(numbers)), np.bincount(u, w, self.n))
        sampled = self.config.approx_schur
        if self.direct or sampled is None:
            more = exact_schur(t, True) if self.dense else sparse_schur(t, q=True)
        else:
            more = sampled_schur(t, sampled.seed, sampled.split, True, numbers)
        if self.dense:
            self.total += more if isinstance(more, np.ndarray) else more.dense()
        else:
            a = self.total
            self.total = SparseMatrix(self.n, np.r_[a.rows, more.rows], np.r_[a.cols, more.cols], np.r_[a.values, more.values])

    def solver(self) -> DenseAnchored | ApproxCholesky:
        if self.held:
            self._fold()
        if self.direct:
            try:
                return DenseAnchored(self.total)
            except np.linalg.LinAlgError:
                pass
        s = self.total
        if self.dense:
            rows, cols = np.nonzero(s)
            s = SparseMatrix(self.n, rows, cols, s[rows, cols])
        return ApproxCholesky(s, self.config.approx_chol)
