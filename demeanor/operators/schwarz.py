"""Schwarz preconditioners: corrections from the components of every pair of factors, overlapping where levels meet several."""

from __future__ import annotations

import io
import json
from dataclasses import asdict, dataclass
from itertools import combinations

import numpy as np

from ..config import AdditiveSchwarz, ApproxCholConfig, ApproxSchurConfig, MultiplicativeSchwarz, SchurComplement
from ..errors import ApplyError, BuildError, DemeanError
from .local import BlockElimination, LocalSolver
from .matrices import CrossTab, SparseMatrix


@dataclass
class Subdomain:
    """A component of a pair of factors: its global unknowns (q levels, then r levels), their shares and the local solver."""

    pair: tuple[int, int]
    component: int
    index: np.ndarray
    omega: np.ndarray
    tab: CrossTab
    solver: LocalSolver | None = None

    def apply(self, r: np.ndarray) -> np.ndarray:
        return self.omega * self.solver.solve(self.omega * r[self.index])


def pairs(n_factors: int) -> list[tuple[int, int]]:
    return list(combinations(range(n_factors), 2))


def subdomains(tabs: dict[tuple[int, int], CrossTab], offsets: np.ndarray) -> list[Subdomain]:
    """Components of all pairs, in order of pair, then component; shares make squares add up to 1 on every unknown."""
    out: list[Subdomain] = []
    for (q, r), tab in sorted(tabs.items()):
        label = tab.components()
        n_q = len(tab.diag_q)
        order = np.argsort(label, kind="stable")
        for c, members in enumerate(np.split(order, np.flatnonzero(np.diff(label[order])) + 1)):
            lq, lr = members[members < n_q], members[members >= n_q] - n_q
            if len(lq) and len(lr):
                index = np.r_[offsets[q] + lq, offsets[r] + lr]
                out.append(Subdomain((q, r), c, index, np.ones(len(index)), tab.part(lq, lr)))
    count = np.zeros(int(offsets[-1]))
    for s in out:
        count[s.index] += 1
    for s in out:
        s.omega = 1 / np.sqrt(count[s.index])
    return out


class FePreconditioner:
    """Additive or multiplicative Schwarz, or a diagonal (``values``); can be kept, pickled and given to another solver of the same design."""

    def __init__(self, kind: str, n: int, parts: list[Subdomain], gram: SparseMatrix | None = None, symmetric: bool = False, fingerprint: int = 0, local: object = None, values: np.ndarray | None = None):
        if (kind == "diagonal") != (values is not None) or values is not None and (values.shape != (n,) or parts or not np.isfinite(values).all() or (values < 0).any()):
            raise BuildError("a diagonal has one finite value, not negative, for each unknown, and nothing else has any")
        if kind == "multiplicative" and gram is None:
            raise BuildError("multiplicative Schwarz needs the explicit Gramian")
        for s in parts:
            if len(s.index) and (s.index.min() < 0 or s.index.max() >= n):
                raise BuildError("a subdomain has an unknown outside the design")
            if s.solver is None or s.solver.n != len(s.index) or len(s.omega) != len(s.index):
                raise BuildError("a subdomain's solver and unknowns differ in size")
        self.kind, self.n, self.parts, self.gram, self.symmetric, self.fingerprint = kind, n, parts, gram, symmetric, fingerprint
        self.local, self.values = local, values

    nrows = ncols = property(lambda self: self.n)
    n_subdomains = property(lambda self: len(self.parts))

    def __call__(self, r: np.ndarray) -> np.ndarray:
        if len(r) != self.n:
            raise ApplyError(f"expected a vector of {self.n}, got {len(r)}")
        if self.values is not None:
            return self.values * r
        z = np.zeros(self.n)
        if self.kind == "additive":
            for s in self.parts:
                np.add.at(z, s.index, s.apply(r))
            return z
        left = r.copy()
        if not self.symmetric and len({s.pair for s in self.parts}) < 2:  # components of one pair do not touch each other
            for s in self.parts:
                z[s.index] += s.apply(left)
            return z
        for s in [*self.parts, *(reversed(self.parts) if self.symmetric else ())]:
            d = s.apply(left)
            z[s.index] += d
            left -= self.gram.take_columns(s.index, d)
        return z

    apply = __call__

    def diagnostics(self) -> dict[str, float] | None:
        """Sizes and work of additive Schwarz; None for multiplicative, whose parts come one after another, and for a diagonal."""
        if self.kind != "additive":
            return None
        sizes = [len(s.index) for s in self.parts]
        work = [len(s.tab.w) + len(s.index) for s in self.parts]
        return {"subdomains": len(sizes), "total_inner_work": sum(work), "max_inner_work": max(work, default=0), "scatter_dofs": sum(sizes), "overlap": sum(sizes) / self.n if self.n else 0.0}

    def subdomain_inner_work(self) -> list[int]:
        return [len(s.tab.w) + len(s.index) for s in self.parts]

    def to_bytes(self) -> bytes:
        """Plain arrays, without code: subdomains, their tabulations, the Gramian, or a diagonal; local solvers are built anew on loading."""
        out = io.BytesIO()
        if self.values is not None:
            head = {"format": FORMAT, "kind": self.kind, "n": self.n, "fingerprint": self.fingerprint}
            np.savez_compressed(out, head=np.frombuffer(json.dumps(head).encode(), np.uint8), values=self.values)
            return out.getvalue()
        if not isinstance(self.local, SchurComplement):
            raise BuildError("only preconditioners with a SchurComplement local solver can be saved")
        sizes = [[*s.pair, s.component, len(s.index), len(s.tab.w), len(s.tab.diag_q), len(s.tab.diag_r)] for s in self.parts]
        head = {"format": FORMAT, "kind": self.kind, "n": self.n, "symmetric": self.symmetric, "fingerprint": self.fingerprint, "gram": self.gram is not None, "local": asdict(self.local)}
        put = {"head": np.frombuffer(json.dumps(head).encode(), np.uint8), "sizes": np.array(sizes, np.int64).reshape(-1, 7)}
        for name, of in _ARRAYS.items():
            kind = np.int32 if name in ("index", "q", "r") and self.n < 1 << 31 else float
            put[name] = np.concatenate([np.zeros(0, kind), *(np.asarray(of(s), kind) for s in self.parts)])
        if self.gram is not None:
            put |= {"rows": self.gram.rows, "cols": self.gram.cols, "values": self.gram.values}
        np.savez_compressed(out, **put)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> FePreconditioner:
        """Checks sizes, places and values, and raises BuildError for anything that ``to_bytes`` can't have written."""
        try:
            with np.load(io.BytesIO(data), allow_pickle=False) as z:
                got = {k: z[k] for k in z.files}
            head = json.loads(got["head"].tobytes())
            if head["format"] != FORMAT or head["kind"] not in ("additive", "multiplicative", "diagonal"):
                raise BuildError("unknown format")
            if head["kind"] == "diagonal":
                return cls("diagonal", int(head["n"]), [], fingerprint=int(head["fingerprint"]), values=got["values"].astype(float))
            n, local = int(head["n"]), head["local"]
            schur = local["approx_schur"]
            local = SchurComplement(ApproxCholConfig(**local["approx_chol"]), ApproxSchurConfig(**schur) if schur is not None else None, local["dense_threshold"])
            ends = {name: 0 for name in _ARRAYS}
            parts = []
            for q, r, component, size, nnz, n_q, n_r in got["sizes"].tolist():
                one = {}
                for name, length in zip(_ARRAYS, (size, size, nnz, nnz, nnz, n_q, n_r)):
                    one[name] = got[name][ends[name] : ends[name] + length]
                    ends[name] += length
                    if length < 0 or len(one[name]) != length or not np.isfinite(one[name]).all():
                        raise BuildError("a subdomain's arrays are cut off or not finite")
                index, tq, tr = (one[k].astype(np.int32 if one[k].dtype == np.int32 else np.int64) for k in ("index", "q", "r"))
                if size != n_q + n_r or len(np.unique(index)) != size or nnz and (tq.min() < 0 or tr.min() < 0 or tq.max() >= n_q or tr.max() >= n_r):
                    raise BuildError("a subdomain's levels do not fit its tabulation")
                if size and (one["omega"].min() <= 0 or one["omega"].max() > 1) or nnz and one["w"].min() <= 0 or size and (index.min() < 0 or index.max() >= n):
                    raise BuildError("a subdomain's shares, weights or unknowns are out of range")
                t = CrossTab(tq, tr, one["w"], one["diag_q"], one["diag_r"])
                parts.append(Subdomain((q, r), component, index, one["omega"], t, BlockElimination(t, local)))
            if any(ends[name] != len(got[name]) for name in _ARRAYS):
                raise BuildError("there is more data than subdomains")
            gram = None
            if head["gram"]:
                rows, cols, values = got["rows"], got["cols"], got["values"]
                if not len(rows) == len(cols) == len(values) or not np.isfinite(values).all() or len(rows) and (min(rows.min(), cols.min()) < 0 or max(rows.max(), cols.max()) >= n):
                    raise BuildError("the Gramian is out of range")
                gram = SparseMatrix(n, rows, cols, values)
            return cls(head["kind"], n, parts, gram, bool(head["symmetric"]), int(head["fingerprint"]), local)
        except DemeanError as e:
            raise BuildError(f"not a preconditioner: {e}") from e
        except Exception as e:
            raise BuildError("not a preconditioner") from e


FORMAT = 1
_ARRAYS = {"index": lambda s: s.index, "omega": lambda s: s.omega, "q": lambda s: s.tab.q, "r": lambda s: s.tab.r, "w": lambda s: s.tab.w, "diag_q": lambda s: s.tab.diag_q, "diag_r": lambda s: s.tab.diag_r}


def build(config: AdditiveSchwarz | MultiplicativeSchwarz, tabs: dict[tuple[int, int], CrossTab], offsets: np.ndarray, gram: SparseMatrix | None, fingerprint: int = 0) -> FePreconditioner:
    """The preconditioner of these tabulations; a ``local_solver`` that is a function makes each subdomain's solver from its CrossTab."""
    parts, local = subdomains(tabs, offsets), config.local_solver
    for s in parts:
        s.solver = BlockElimination(s.tab, local) if isinstance(local, SchurComplement) else local(s.tab)
    kind = "multiplicative" if isinstance(config, MultiplicativeSchwarz) else "additive"
    return FePreconditioner(kind, int(offsets[-1]), parts, gram if kind == "multiplicative" else None, False, fingerprint, local)
