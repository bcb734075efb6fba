"""Projecting categorical fixed effects out of regression data, on Spark."""

from .config import (
    CG,
    GMRES,
    LSMR,
    AdditiveSchwarz,
    ApproxCholConfig,
    ApproxSchurConfig,
    MultiplicativeSchwarz,
    OperatorRepr,
    Preconditioner,
    ReductionStrategy,
    SchurComplement,
)
from .operators.krylov import StopReason
from .operators.schwarz import FePreconditioner
from .solver import BatchSolveResult, Solver, SolveResult, regress, solve, solve_batch

__all__ = [
    "CG", "GMRES", "LSMR", "AdditiveSchwarz", "ApproxCholConfig", "ApproxSchurConfig", "BatchSolveResult", "FePreconditioner",
    "MultiplicativeSchwarz", "OperatorRepr", "Preconditioner", "ReductionStrategy", "SchurComplement", "SolveResult", "Solver", "StopReason",
    "regress", "solve", "solve_batch",
]
