"""Suites of timed solves: ``python -m demeanor.plans.suites list``, or ``run NAME... [--profile quick|full]``.

Each problem is solved with each configuration, once to warm up and then three times (full: once); the medians
are shown, and a star marks a run that did not converge.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Iterable
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.diagnostics import max_abs_group_mean
from ..solver import solve
from ..sources.designs import DESIGNS

TOL_FLOOR = 1e-7
ROW = "problem string, config string, rows long, converged boolean, iterations long, seconds double, group_mean double"


def solver_tol(tol: float) -> float:
    """What timed solves ask for at least."""
    return max(tol, TOL_FLOOR)


def standard_configs(tol: float = 1e-8, maxiter: int = 1000, seed: int = 0) -> dict[str, tuple]:
    """Additive CG, multiplicative GMRES and additive LSMR, with sampled local solvers."""
    local, tol = C.SchurComplement(C.ApproxCholConfig(seed), C.ApproxSchurConfig(seed)), solver_tol(tol)
    return {
        "CG": (C.CG(tol, maxiter), C.AdditiveSchwarz(local)),
        "GMRES": (C.GMRES(tol, maxiter), C.MultiplicativeSchwarz(local)),
        "LSMR": (C.LSMR(tol, maxiter), C.AdditiveSchwarz(local)),
    }


SUITES: dict[str, tuple[str, ...]] = {
    "difficult": ("individuals", "individuals_difficult"),
    "panels": ("panel_power_law", "panel_low_mobility", "panel_regions", "panel_realistic"),
    "topologies": ("chain_2", "star", "barbell_2", "expander", "grid"),
    "many_factors": ("uniform", "uniform_4", "sparse_3", "sparse_5", "steps_3", "steps_4"),
    "components": ("clustered", "disconnected", "barbell_3"),
    "regimes": ("hub", "dominant_block", "imbalanced_3", "imbalanced_4"),
}


def timed(df: DataFrame, config, preconditioner, warm: int = 1, runs: int = 3) -> tuple:
    """(converged, iterations, median of seconds, largest group mean) of solves for ``y`` on all factors."""
    factors = [c for c in df.columns if c != "y"]
    took = []
    for k in range(warm + runs):
        began = time.perf_counter()
        r = solve(df, factors, "y", None, config, preconditioner)
        r.demeaned.write.format("noop").mode("overwrite").save()
        if k >= warm:
            took.append(time.perf_counter() - began)
    worst = max_abs_group_mean(r.demeaned, factors).first()[0]
    return r.converged, r.iterations, float(median(took)), float(worst)


def run_suite(spark: SparkSession, names: Iterable[str], profile: str = "quick", scale: int = 1) -> DataFrame:
    """One row for each problem and configuration."""
    out = []
    for problem in names:
        df = DESIGNS[problem](spark, scale).cache()
        rows = df.count()
        for name, (config, m) in standard_configs().items():
            out.append((problem, name, rows, *timed(df, config, m, *((1, 3) if profile == "quick" else (0, 1)))))
        df.unpersist()
    return spark.createDataFrame(out, ROW)


def pivot(results: DataFrame) -> DataFrame:
    """Seconds by problem and configuration, as text; a star stands beside what did not converge."""
    shown = F.concat(F.format_number("seconds", 3), F.when(F.col("converged"), "").otherwise("*"))
    return results.withColumn("shown", shown).groupBy("problem").pivot("config").agg(F.first("shown")).orderBy("problem")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("action", choices=["list", "run"])
    p.add_argument("names", nargs="*", help="suites; all if none is given")
    p.add_argument("--profile", choices=["quick", "full"], default="quick")
    p.add_argument("--scale", type=int, default=1)
    a = p.parse_args(args)
    if a.action == "list":
        for name, problems in SUITES.items():
            print(name, *problems)
        return
    spark = SparkSession.builder.appName("suites").getOrCreate()
    for name in a.names or SUITES:
        results = run_suite(spark, SUITES[name], a.profile, a.scale)
        print(name)
        results.show(1000, False)
        pivot(results).show(1000, False)


if __name__ == "__main__":
    main()
