"""Settings of solvers, preconditioners and local solvers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from .errors import ConfigError


class OperatorRepr(Enum):
    Implicit = "implicit"  # a pass over the observations for each product
    Explicit = "explicit"  # aggregated cross-tabulations, on the driver
    Auto = "auto"  # explicit as long as the aggregates do not exceed their bound


class Preconditioner(Enum):
    Additive = "additive"
    Multiplicative = "multiplicative"
    Off = "off"


class ReductionStrategy(Enum):
    """Accepted for compatibility; Spark schedules reductions itself."""

    Auto = "auto"
    AtomicScatter = "atomic"
    ParallelReduction = "parallel"


def _split(split: int) -> None:
    if int(split) < 1:
        raise ConfigError("split must be at least 1")


@dataclass(frozen=True)
class ApproxCholConfig:
    seed: int = 0
    split: int = 1

    def __post_init__(self):
        _split(self.split)

    @property
    def split_merge(self) -> int | None:
        return None if self.split == 1 else self.split


@dataclass(frozen=True)
class ApproxSchurConfig:
    seed: int = 0
    split: int = 1

    def __post_init__(self):
        _split(self.split)


@dataclass(frozen=True)
class SchurComplement:
    """Local solver: exact reduced system by default, sampled if ``approx_schur`` is given.

    Reduced systems of at most ``dense_threshold`` unknowns are factored densely; 0 turns that off.
    """

    approx_chol: ApproxCholConfig = field(default_factory=ApproxCholConfig)
    approx_schur: ApproxSchurConfig | None = None
    dense_threshold: int = 24

    def __post_init__(self):
        if not isinstance(self.approx_chol, ApproxCholConfig) or not isinstance(self.approx_schur, ApproxSchurConfig | None):
            raise TypeError("SchurComplement takes ApproxCholConfig and ApproxSchurConfig")

    @classmethod
    def solver_default(cls) -> SchurComplement:
        """What a bare preconditioner choice stands for. The threshold is larger than ``SchurComplement``'s own,
        as dense factors of up to 2,000 unknowns are faster in numpy than sampled ones in Python."""
        return cls(ApproxCholConfig(split=2), ApproxSchurConfig(), 2000)


@dataclass(frozen=True)
class AdditiveSchwarz:
    local_solver: SchurComplement | Callable = field(default_factory=SchurComplement.solver_default)
    reduction: ReductionStrategy = ReductionStrategy.Auto


@dataclass(frozen=True)
class MultiplicativeSchwarz:
    local_solver: SchurComplement | Callable = field(default_factory=SchurComplement.solver_default)


@dataclass(frozen=True)
class CG:
    tol: float = 1e-8
    maxiter: int = 1000
    operator: OperatorRepr = OperatorRepr.Auto
    max_refinements: int = 2


@dataclass(frozen=True)
class GMRES:
    tol: float = 1e-8
    maxiter: int = 1000
    operator: OperatorRepr = OperatorRepr.Auto
    max_refinements: int = 2
    restart: int = 30


@dataclass(frozen=True)
class LSMR:
    tol: float = 1e-8
    maxiter: int = 1000
    local_size: int | None = None


def check(config, preconditioner) -> tuple[object, object]:
    """Config and preconditioner with defaults filled in: no preconditioner given means additive."""
    config = CG() if config is None else config
    if not isinstance(config, CG | GMRES | LSMR):
        raise TypeError("config must be CG, GMRES or LSMR")
    if preconditioner is None or preconditioner is Preconditioner.Additive:
        preconditioner = AdditiveSchwarz()
    elif preconditioner is Preconditioner.Multiplicative:
        preconditioner = MultiplicativeSchwarz()
    kind = getattr(preconditioner, "kind", None)
    if preconditioner is not Preconditioner.Off and kind is None and not isinstance(preconditioner, AdditiveSchwarz | MultiplicativeSchwarz):
        raise TypeError("unknown preconditioner")
    if isinstance(config, CG | LSMR) and (isinstance(preconditioner, MultiplicativeSchwarz) or kind == "multiplicative"):
        raise ConfigError(f"{type(config).__name__} requires a symmetric preconditioner; use GMRES with multiplicative Schwarz")
    return config, preconditioner
