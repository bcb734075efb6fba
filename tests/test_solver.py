import io
import os
import pickle
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest

import demeanor as D
from demeanor.errors import BuildError, EmptyObservations, InvalidInput, TooLarge
from demeanor.operators.design import Design
from demeanor.sources import designs


def frame(spark, factors, y, w=None):
    cols = {f"f{k}": f for k, f in enumerate(factors)} | {"y": np.asarray(y, float), "id": range(len(y))}
    return spark.createDataFrame(pd.DataFrame(cols | ({"w": np.asarray(w, float)} if w is not None else {})))


def by_least_squares(p, factors, w=None):
    x = np.concatenate([pd.get_dummies(p[f]).to_numpy(float) for f in factors], axis=1)
    s = np.sqrt(p["w"].to_numpy()) if w else np.ones(len(p))
    y = p["y"].to_numpy()
    return y - x @ np.linalg.lstsq(x * s[:, None], y * s, rcond=None)[0]


def left(r):
    return r.demeaned.orderBy("id").toPandas()["demeaned"].to_numpy()


def test_three_factors_by_hand(spark):
    df = frame(spark, [[0, 0, 1, 1, 2, 2], [0, 1, 0, 0, 1, 1], [0, 1, 0, 1, 0, 1]], [3.2, 4.1, 2.8, 3.9, 5.0, 4.5])
    d = Design(df, ["f0", "f1", "f2"])
    assert np.allclose(d.diagonal(), [2, 2, 2, 3, 3, 3, 3])
    assert np.allclose(left(D.solve(df, ["f0", "f1", "f2"], "y", config=D.CG(tol=1e-13))), [0, 0, -0.4, 0.4, 0.4, -0.4])


def test_gather_and_scatter_are_adjoint(spark):
    df = frame(spark, [[0, 1, 2, 0, 1], [0, 1, 2, 3, 0]], [1, 2, 3, 4, 5])
    d = Design(df, ["f0", "f1"])
    fit = d.fitted(df, np.array([1.0, 2, 3, 10, 20, 30, 40]), "fit").orderBy("id").toPandas()["fit"]
    assert fit.tolist() == [11, 22, 33, 41, 12]
    assert d.sums(df, {"y": df["y"]})[:, 0].tolist() == [5, 7, 3, 6, 2, 3, 4]
    x = np.arange(7.0)
    assert np.allclose(d.implicit_product(x), d.gram.matvec(x))


@pytest.mark.parametrize("weight", [None, "w"])
def test_methods_agree_with_least_squares(spark, weight):
    rng = np.random.default_rng(9)
    df = frame(spark, [rng.integers(0, 9, 200), rng.integers(0, 7, 200), rng.integers(0, 4, 200)], rng.normal(size=200), rng.random(200) + 0.1)
    want = by_least_squares(df.toPandas(), ["f0", "f1", "f2"], weight)
    for config, m in ((D.CG(tol=1e-12), None), (D.GMRES(tol=1e-12), D.Preconditioner.Multiplicative), (D.LSMR(tol=1e-12), None)):
        r = D.solve(df, ["f0", "f1", "f2"], "y", weight, config, m)
        assert r.converged and np.abs(left(r) - want).max() < 1e-9


def test_edges(spark):
    df = frame(spark, [["a", "a", "b"], ["x", "y", "x"]], [1, np.nan, 3])
    assert not D.solve(df, ["f0", "f1"], "y").converged
    zero = D.solve(frame(spark, [[0, 1], [0, 1]], [0, 0]), ["f0", "f1"], "y")
    assert zero.converged and zero.iterations == 0
    with pytest.raises(EmptyObservations):
        D.solve(df.limit(0), ["f0", "f1"], "y")
    with pytest.raises(InvalidInput):
        D.solve(frame(spark, [["a", None, "b"], ["x", "y", "x"]], [1, 2, 3]), ["f0", "f1"], "y")
    with pytest.raises(InvalidInput):
        D.solve(frame(spark, [[0, 1], [0, 1]], [1, 2], [1, -1]), ["f0", "f1"], "y", "w")
    assert Design(frame(spark, [[0, 2, 4]], [1, 2, 3]), ["f0"], levels="codes").active(0).tolist() == [True, False, True, False, True]


def test_batch_reuse_and_regression(spark):
    df = designs.panel(spark, 40, 5, 6).withColumnRenamed("y", "a").selectExpr("*", "a * 2 + f2 % 2 AS b", "a * a AS c").cache()
    s = D.Solver(df, ["f0", "f1"], D.CG(tol=1e-12))
    batch = s.solve_batch(["a", "b"])
    assert batch.n_rhs == 2 and all(batch.converged) and batch.x_all.count() == s.n_dofs
    again = D.Solver(df, ["f0", "f1"], D.CG(tol=1e-12), preconditioner=D.FePreconditioner.from_bytes(s.preconditioner().to_bytes())).solve("a")
    assert np.allclose(again.vector, batch.vectors[:, 0])
    p = df.toPandas().rename(columns={"a": "y"})
    e = {k: by_least_squares(p.assign(y=p[k]), ["f0", "f1"]) for k in ("y", "c")}
    got = D.regress(df, ["f0", "f1"], "a", ["c"], config=D.CG(tol=1e-12)).first()["slope"]
    assert abs(got - (e["y"] @ e["c"]) / (e["c"] @ e["c"])) < 1e-8


@pytest.mark.parametrize("factors", [["f0", "f1"], ["f0", "f1", "f2"]])
def test_more_pairs_than_the_bound(spark, factors):
    rng = np.random.default_rng(4)
    df = frame(spark, [rng.integers(0, 9, 150), rng.integers(0, 7, 150), rng.integers(0, 4, 150)], rng.normal(size=150), rng.random(150) + 0.1).cache()
    want = by_least_squares(df.toPandas(), factors, "w")
    auto, implicit, explicit = (D.CG(tol=1e-12, operator=o) for o in (D.OperatorRepr.Auto, D.OperatorRepr.Implicit, D.OperatorRepr.Explicit))
    for config, m in ((auto, None), (auto, D.Preconditioner.Off), (implicit, None), (implicit, D.Preconditioner.Off), (D.GMRES(tol=1e-12), None)):
        s = D.Solver(df, factors, config, "w", m, most_pairs=30)
        r = s.solve("y")
        assert r.converged and np.abs(left(r) - want).max() < 1e-9 and "_pairs" not in s.design.__dict__
    for config, m in ((explicit, None), (explicit, D.Preconditioner.Off), (auto, D.Preconditioner.Additive), (D.GMRES(), D.Preconditioner.Multiplicative)):
        with pytest.raises(TooLarge):
            D.Solver(df, factors, config, "w", m, most_pairs=30).solve("y")
    n = len(Design(df, factors)._pairs)
    assert Design(df, factors, most_pairs=n).pairs_fit and not Design(df, factors, most_pairs=n - 1).pairs_fit


def test_null_responses(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", None), ("a", "y", 3.0), ("b", "y", 2.0)], "f0 string, f1 string, y double")
    for f in (["f0"], ["f0", "f1"]):
        for config in (D.CG(), D.LSMR()):
            with pytest.raises(InvalidInput, match="null"):
                D.solve(df, f, "y", config=config)
    got = D.solve(df, ["f0"], "y", null_policy="drop").demeaned.orderBy("y").toPandas()["demeaned"]
    assert got.tolist() == [-1.0, 0.0, 1.0]


def test_preconditioner_in_another_process(spark, tmp_path):
    df = designs.panel(spark, 30, 4, 5).cache()
    kept = D.Solver(df, ["f0", "f1", "f2"], D.GMRES(), preconditioner=D.Preconditioner.Multiplicative).preconditioner()
    data = kept.to_bytes()
    (tmp_path / "m").write_bytes(data)
    code = f"import numpy as np; from demeanor import FePreconditioner as P; m = P.from_bytes(open({str(tmp_path / 'm')!r}, 'rb').read()); print(m.fingerprint, repr(float(m(np.arange(m.n) % 7.0).sum())))"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONHASHSEED": "7"}).stdout.split()
    r = np.arange(kept.n) % 7.0
    assert int(said[0]) == Design(df, ["f0", "f1", "f2"]).fingerprint and abs(float(said[1]) - kept(r).sum()) < 1e-9
    for bad in (b"", b"junk", data[:-40], pickle.dumps(kept)):
        with pytest.raises(BuildError):
            D.FePreconditioner.from_bytes(bad)
    with np.load(io.BytesIO(data)) as z:
        good = {k: z[k] for k in z.files}
    for name, value in (("index", 10**6), ("omega", -1), ("q", 10**6), ("w", np.nan), ("cols", 10**6)):
        changed = {k: v.copy() for k, v in good.items()}
        changed[name][0] = value
        out = io.BytesIO()
        np.savez(out, **changed)
        with pytest.raises(BuildError):
            D.FePreconditioner.from_bytes(out.getvalue())


def test_own_local_solver_and_design(spark):
    class LeastSquares:
        def __init__(self, t):
            self.n, n_q = len(t.diag_q) + len(t.diag_r), len(t.diag_q)
            m = np.diag(np.r_[t.diag_q, t.diag_r].astype(float))
            m[t.q, n_q + t.r] = m[n_q + t.r, t.q] = t.w
            self.inverse = np.linalg.pinv(m)

        def solve(self, rhs):
            return self.inverse @ rhs

    df = designs.panel(spark, 30, 4, 5).cache()
    design = Design(df, ["f0", "f1", "f2"])
    own = D.Solver.from_design(design, D.CG(tol=1e-11), D.AdditiveSchwarz(LeastSquares))
    usual = D.Solver.from_design(design, D.CG(tol=1e-11))
    assert np.abs(left_of(own.solve("y")) - left_of(usual.solve("y"))).max() < 1e-8
    with pytest.raises(BuildError):
        own.preconditioner().to_bytes()


def left_of(r):
    return r.demeaned.orderBy("f0", "f1", "f2", "y").toPandas()["demeaned"].to_numpy()


@pytest.mark.parametrize("weight", [None, "w"])
def test_lsmr_beyond_the_bound_passes_over_the_observations(spark, weight):
    rng = np.random.default_rng(12)
    df = frame(spark, [rng.integers(0, 9, 200), rng.integers(0, 7, 200), rng.integers(0, 4, 200)], rng.normal(size=200), rng.random(200) + 0.1).cache()
    want = by_least_squares(df.toPandas(), ["f0", "f1", "f2"], weight)
    for local_size in (None, 5):
        s = D.Solver(df, ["f0", "f1", "f2"], D.LSMR(tol=1e-11, local_size=local_size), weight, most_pairs=30)
        r = s.solve("y")
        assert not s.design.cells_fit and r.converged and np.abs(left(r) - want).max() < 1e-8
        assert r.reason is D.StopReason.NormalEquations


def test_stop_reasons(spark):
    df = frame(spark, [[0, 0, 1, 1], [0, 1, 0, 1]], [1, 2, 3, 5])
    why = lambda y, f=("f0", "f1"), **o: D.solve(df.withColumn("y", y), list(f), "y", **o).reason
    from pyspark.sql import functions as F

    assert why(F.lit(0.0)) is D.StopReason.ZeroRhs
    assert why(F.lit(float("nan"))) is D.StopReason.NotFinite
    assert why(F.col("y"), ["f0"]) is D.StopReason.ClosedForm
    assert why(F.col("y")) is D.StopReason.Tolerance
    assert why(F.col("y"), config=D.CG(maxiter=0, max_refinements=0)) is D.StopReason.Iterations


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("weight", [None, "w"])
def test_many_pairs_stay_on_the_executors(spark, monkeypatch, weight, hot):
    from demeanor.operators import design

    rng = np.random.default_rng(21)
    df = frame(spark, [np.where(np.arange(300) < 100, 0, rng.integers(0, 40, 300)), rng.integers(0, 7, 300), rng.integers(0, 4, 300)], rng.normal(size=300), rng.random(300) + 0.1).cache()
    monkeypatch.setattr(design, "DRIVER_PAIRS", 10)
    if hot:
        monkeypatch.setattr(design, "BLOCK_ROWS", 90)
    for factors in (["f0", "f1"], ["f0", "f1", "f2"]):
        want = by_least_squares(df.toPandas(), factors, weight)
        for operator in D.OperatorRepr:
            s = D.Solver(df, factors, D.CG(tol=1e-12, operator=operator), weight)
            r = s.solve("y")
            assert r.converged and np.abs(left(r) - want).max() < 1e-9 and not {"_pairs", "tabs"} & s.design.__dict__.keys()
            assert (s.design.eliminable is None) == hot
            s.design.release()
    built = D.Solver(df, ["f0", "f1"], weights=weight).preconditioner()
    r = D.Solver(df, ["f0", "f1"], D.CG(tol=1e-12), weight, preconditioner=D.FePreconditioner.from_bytes(built.to_bytes())).solve("y")
    assert r.converged and np.abs(left(r) - by_least_squares(df.toPandas(), ["f0", "f1"], weight)).max() < 1e-9


def test_explicit_products_on_the_executors_have_no_bound_but_a_given_one(spark, monkeypatch):
    from demeanor.operators import design

    rng = np.random.default_rng(22)
    df = frame(spark, [rng.integers(0, 40, 300), rng.integers(0, 7, 300)], rng.normal(size=300)).cache()
    monkeypatch.setattr(design, "DRIVER_PAIRS", 10)
    monkeypatch.setattr(design, "MOST_PAIRS", 30)
    explicit = D.CG(tol=1e-12, operator=D.OperatorRepr.Explicit)
    for m in (None, D.Preconditioner.Off):
        r = D.solve(df, ["f0", "f1"], "y", config=explicit, preconditioner=m, most_pairs=None)
        assert r.converged and np.abs(left(r) - by_least_squares(df.toPandas(), ["f0", "f1"])).max() < 1e-9
    d = Design(df, ["f0", "f1"], most_pairs=None)
    x = np.arange(d.n_dofs) % 7.0
    assert not d.pairs_fit and np.allclose(d.gram.matvec(x), d.implicit_product(x))
    with pytest.raises(TooLarge):
        D.solve(df, ["f0", "f1"], "y", config=explicit, most_pairs=30)
    with pytest.raises(TooLarge):
        D.solve(df, ["f0", "f1"], "y", preconditioner=D.Preconditioner.Additive, most_pairs=None)


@pytest.mark.parametrize("text", [False, True])
def test_sums_reach_the_driver_once_for_each_unknown(spark, monkeypatch, text):
    from demeanor.operators import design

    rng = np.random.default_rng(23)
    factors = [rng.integers(0, 40, 300), rng.integers(0, 7, 300), rng.integers(0, 13, 300)]
    df = frame(spark, [[f"v{x}" for x in f] for f in factors] if text else factors, rng.normal(size=300), rng.random(300) + 0.1).cache()
    names = ["f0", "f1", "f2"]
    small = Design(df, names, "w")
    x = rng.normal(size=small.n_dofs)
    want = small.gram.matvec(x)
    monkeypatch.setattr(design, "DRIVER_PAIRS", 10)
    monkeypatch.setattr(design, "BLOCK_ROWS", 25)
    monkeypatch.setattr(design, "SUM_UNKNOWNS", 9, raising=False)
    came, whole = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: came.append(whole(self)) or came[-1])
    d = Design(df, names, "w")
    assert np.allclose(d.implicit_product(x), want)
    assert np.sort(np.concatenate([np.frombuffer(u.as_buffer(), np.int32) for u in came[-1].column(0)])).tolist() == list(range(d.n_dofs))
    again = d.implicit_product(x)
    assert (again == d.implicit_product(x)).all()
    assert np.allclose(d.gram.matvec(x), want)
    d.release()
    r = D.solve(df, names[:2], "y", "w", D.CG(tol=1e-10, operator=D.OperatorRepr.Explicit))
    assert r.converged and np.abs(left(r) - by_least_squares(df.toPandas(), names[:2], "w")).max() < 1e-8


def test_large_frames_go_to_spark_as_arrays(spark):
    from demeanor.operators import design

    rows = pd.DataFrame({"level": np.arange(200_000), "coef": np.arange(200_000) / 7})
    sent = design.send(spark, rows)
    assert "LocalRelation" not in sent._jdf.queryExecution().optimizedPlan().toString()
    assert design.fetch(sent).sort_values("level")["coef"].tolist() == rows["coef"].tolist()
