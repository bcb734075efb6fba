import numpy as np
import pytest

import demeanor as D
from demeanor.errors import BuildError, InvalidInput
from demeanor.operators import design

from test_solver import by_least_squares, frame, left


@pytest.mark.parametrize("weight, text", [(None, False), ("w", True)])
def test_levels_of_a_far_factor_stay_on_the_executors(spark, monkeypatch, weight, text):
    rng = np.random.default_rng(31)
    factors = [rng.integers(0, 7, 400), rng.integers(0, 90, 400), rng.integers(0, 5, 400)]
    df = frame(spark, [[f"v{x}" for x in f] for f in factors] if text else factors, rng.normal(size=400), np.where(rng.random(400) < 0.1, 0.0, rng.random(400))).withColumn("z", design.F.col("y") ** 2).cache()
    names = ["f0", "f1", "f2"]
    p = df.toPandas()
    want = {n: by_least_squares(p.assign(y=p[n]), names, weight) for n in "yz"}
    on = np.ones(400, bool) if weight is None else p["w"].to_numpy() > 0
    monkeypatch.setattr(design, "FAR_LEVELS", 50)
    monkeypatch.setattr(design, "DRIVER_PAIRS", 10)
    came, fetch = [], design.fetch
    monkeypatch.setattr(design, "fetch", lambda got: came.append(fetch(got)) or came[-1])
    for config, m in ((D.CG(tol=1e-12), D.Preconditioner.Off), (D.GMRES(tol=1e-12), None)):
        s = D.Solver(df, names, config, weight, m)
        r = s.solve("y")
        assert r.converged and np.abs(left(r) - want["y"])[on].max() < 1e-9
        assert len(r.vector) == 12 and max(map(len, came)) < 20
    both = s.solve_batch(["y", "z"])
    for j, n in enumerate("yz"):
        assert np.abs(both.demeaned(j).orderBy("id").toPandas()[f"{n}_demeaned"].to_numpy() - want[n])[on].max() < 1e-9
    x = r.x.orderBy("dof").toPandas()
    assert x["dof"].tolist() == list(range(102 - 90 + p["f1"].nunique())) and both.x_all.count() == len(x)
    assert x["factor"].tolist() == sorted(x["factor"]) and all(g["level"].astype(str).tolist() == [str(v) for v in sorted(p[f].unique())] for f, g in x.groupby("factor"))
    coef = {(f, lv): c for f, lv, c in zip(x["factor"], x["level"], x["coef"])}
    fit = sum(np.array([coef[f, str(v)] for v in p[f]]) for f in names)
    assert np.abs(p["y"].to_numpy() - fit - want["y"])[on].max() < 1e-9
    assert not {"_margins", "levels"} & s.design.__dict__.keys()
    with pytest.raises(InvalidInput):
        D.solve(df.withColumn("f1", design.F.when(design.F.col("id") > 0, design.F.col("f1"))), names, "y", config=config)


def test_a_level_of_very_many_rows_is_not_eliminated_as_far(spark, monkeypatch):
    rng = np.random.default_rng(32)
    df = frame(spark, [rng.integers(0, 7, 400), np.where(np.arange(400) < 200, 0, rng.integers(0, 90, 400))], rng.normal(size=400)).cache()
    monkeypatch.setattr(design, "FAR_LEVELS", 50)
    monkeypatch.setattr(design, "DRIVER_PAIRS", 10)
    monkeypatch.setattr(design, "BLOCK_ROWS", 90)
    assert design.Design(df, ["f0", "f1"]).far is None
    r = D.solve(df, ["f0", "f1"], "y", config=D.CG(tol=1e-12))
    assert r.converged and np.abs(left(r) - by_least_squares(df.toPandas(), ["f0", "f1"])).max() < 1e-9


@pytest.mark.parametrize("hot, weight", [(False, None), (True, "w")])
def test_schwarz_of_too_many_pairs_stays_on_the_executors(spark, monkeypatch, hot, weight):
    rng = np.random.default_rng(33)
    a, part = rng.integers(0, 60, 600), rng.integers(0, 3, 600)
    a = np.where((np.arange(600) < 150) & (part == 0), 0, a)
    df = frame(spark, [a + 60 * part, rng.integers(0, 8, 600) + 8 * part], rng.normal(size=600), np.where(rng.random(600) < 0.1, 0.0, rng.random(600))).cache()
    want, names = by_least_squares(df.toPandas(), ["f0", "f1"], weight), ["f0", "f1"]
    on = np.ones(600, bool) if weight is None else df.toPandas()["w"].to_numpy() > 0
    monkeypatch.setattr(design, "DRIVER_PAIRS", 10)
    monkeypatch.setattr(design, "MOST_PAIRS", 30)
    monkeypatch.setattr(design, "BLOCK_ROWS", 40 if hot else 200)
    sampled = D.AdditiveSchwarz(D.SchurComplement(approx_schur=D.ApproxSchurConfig(split=2), dense_threshold=0))
    for config, m in ((D.CG(tol=1e-12), sampled), (D.GMRES(tol=1e-12), D.Preconditioner.Multiplicative)):
        s = D.Solver(df, names, config, weight, m)
        r = s.solve("y")
        assert r.converged and np.abs(left(r) - want)[on].max() < 1e-9 and not {"_pairs", "tabs"} & s.design.__dict__.keys()
        assert (s.design.eliminable is None) == hot and len(s.preconditioner().starts) == 4
        if m is not sampled:
            assert r.iterations <= 3
    again = D.Solver(df, names, config, weight, s.preconditioner()).solve("y")
    assert np.allclose(again.vector, r.vector)
    s.design.release()


@pytest.mark.parametrize("far", [False, True])
def test_a_diagonal_is_saved_and_used_again(spark, monkeypatch, far):
    rng = np.random.default_rng(34)
    df = frame(spark, [rng.integers(0, 60, 300), rng.integers(0, 8, 300)], rng.normal(size=300)).cache()
    names = ["f0", "f1"]
    monkeypatch.setattr(design, "DRIVER_PAIRS", 10)
    monkeypatch.setattr(design, "MOST_PAIRS", 30)
    if far:
        monkeypatch.setattr(design, "FAR_LEVELS", 40)
    s = D.Solver(df, names)
    data = s.preconditioner().to_bytes()
    built = D.FePreconditioner.from_bytes(data)
    assert built.kind == "diagonal" and np.allclose(built.values, 1 / (s._far.near if far else s.design).diagonal())
    r = D.Solver(df, names, D.CG(tol=1e-12), preconditioner=built).solve("y")
    assert r.converged and np.abs(left(r) - by_least_squares(df.toPandas(), names)).max() < 1e-9
    same = D.Solver(df, names, D.CG(tol=1e-12)).solve("y")
    assert np.allclose(r.vector, same.vector) and r.iterations == same.iterations
    with pytest.raises(BuildError):
        D.FePreconditioner("diagonal", built.n, [], values=-built.values)
    with pytest.raises(BuildError):
        D.FePreconditioner.from_bytes(data[:-20])
    with pytest.raises(BuildError):
        D.Solver(df.where("f1 <> 3"), names, preconditioner=built)
