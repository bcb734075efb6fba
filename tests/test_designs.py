import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demeanor import Preconditioner, Solver
from demeanor.functions.components import largest_component, pair_components
from demeanor.operators.design import Design
from demeanor.operators.matrices import connected
from demeanor.plans import suites
from demeanor.sources import designs


def parts_of(p, q, r):
    """The component of each level of q, named by its smallest, by plain search."""
    a, b = np.unique(p[q], return_inverse=True), np.unique(p[r], return_inverse=True)
    label = connected(len(a[0]) + len(b[0]), a[1], b[1] + len(a[0]))[: len(a[0])]
    least = pd.Series(a[0]).groupby(label).min()
    return dict(zip(a[0].tolist(), least[label].tolist()))


def found(df, q="f0", r="f1"):
    return {x[q]: x["component"] for x in pair_components(df, q, r).where("factor = 0").collect()}


def test_components_on_the_cluster(spark):
    rng = np.random.default_rng(5)
    random = spark.createDataFrame(pd.DataFrame({"f0": rng.integers(0, 60, 45), "f1": rng.integers(0, 60, 45)}))
    for df in (random, designs.chain(spark, 70), designs.components(spark, 3, 8, 40)):
        p = df.toPandas()
        assert found(df) == parts_of(p, "f0", "f1")
        of = parts_of(p, "f0", "f1")
        best = p["f0"].map(of).value_counts()
        best = min(best[best == best.max()].index)
        assert largest_component(df, "f0", "f1").count() == (p["f0"].map(of) == best).sum()
    text = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), (None, "y"), ("d", "y")], "f0 string, f1 string")
    assert found(text) == {"a": "a", "b": "a", "d": "d"}
    assert found(text.limit(0)) == {} and largest_component(text.limit(0), "f0", "f1").count() == 0


def test_shapes_of_designs(spark):
    made = {n: make(spark).toPandas() for n, make in designs.DESIGNS.items()}
    assert len(made) == 24 and all(np.isfinite(p["y"]).all() and (p.drop(columns="y").min() >= 0).all() for p in made.values())
    parts = lambda n: len(set(parts_of(made[n], "f0", "f1").values()))
    assert {n: parts(n) for n in ("disconnected", "clustered", "barbell_3", "steps_3", "sparse_3")} == {"disconnected": 10, "clustered": 1, "barbell_3": 1, "steps_3": 1, "sparse_3": 1}
    assert len(made["steps_3"]) == 100 + 3 * 99 and len(made["sparse_3"]) == 900 and len(made["barbell_3"]) == 312
    assert (made["hub"]["f0"] == 0).mean() > 0.8 and abs((made["dominant_block"].max(axis=1) < 25).mean() - 0.8) < 0.05
    top = made["imbalanced_3"]["f0"].value_counts(normalize=True)
    assert top.index[0] == 0 and top.iloc[0] > 0.35
    moves = {n: (made[n].sort_values(["f0", "f2"]).groupby("f0")["f1"].diff().fillna(0) != 0).mean() for n in made if n.startswith("panel")}
    assert moves["panel_low_mobility"] < 0.06 < moves["panel_realistic"]
    regions = made["panel_regions"].assign(f1=made["panel_regions"]["f1"] // 10).groupby("f0")["f1"].nunique()
    assert (regions == 1).mean() > 0.95


def test_suites(spark):
    got = suites.run_suite(spark, ["chain_2"], "full").toPandas()
    assert got["converged"].all() and (got["group_mean"] < 1e-4).all() and got["config"].tolist() == ["CG", "GMRES", "LSMR"]
    assert set(sum(suites.SUITES.values(), ())) == set(designs.DESIGNS) and suites.solver_tol(1e-9) == 1e-7
    shown = suites.pivot(spark.createDataFrame([("p", "CG", 1, True, 1, 0.5, 0.0), ("p", "LSMR", 1, False, 1, 2.0, 0.0)], suites.ROW)).first()
    assert (shown["CG"], shown["LSMR"]) == ("0.500", "2.000*")


def test_only_additive_preconditioners_have_diagnostics(spark):
    d = Design(designs.steps(spark, 20), ["f0", "f1", "f2"])
    from demeanor import GMRES

    own = Solver.from_design(d).preconditioner()
    assert own.diagnostics()["subdomains"] == own.n_subdomains == 3
    assert Solver.from_design(d, GMRES(), Preconditioner.Multiplicative).preconditioner().diagnostics() is None


def test_release(spark):
    d = Design(designs.steps(spark, 20), ["f0", "f1", "f2"])
    x = np.arange(d.n_dofs, dtype=float)
    first = d.implicit_product(x)
    assert d.encoded.is_cached
    d.release()
    assert "encoded" not in d.__dict__ and np.allclose(d.implicit_product(x), first)
    d.release()


@pytest.mark.parametrize("name", ["star", "grid", "expander"])
def test_two_factors_solve(spark, name):
    assert suites.timed(designs.DESIGNS[name](spark), *suites.standard_configs()["CG"], 0, 1)[0]


def test_reduced_matrix_is_folded_before_it_is_dealt_out(spark, tmp_path):
    import duckdb

    import __spark_entry__

    rng = np.random.default_rng(5)
    part, supp = rng.integers(0, 12, 400), rng.integers(0, 9, 400)
    rows = pd.DataFrame({"l_orderkey": range(400), "l_partkey": pd.array(np.where(part == 7, None, part), "Int64"), "l_suppkey": pd.array(np.where(supp == 3, None, supp), "Int64"), "l_linenumber": 1, "l_returnflag": "A", "l_extendedprice": 1.0, "l_quantity": 1.0})
    rows.to_parquet(tmp_path / "lineitem.parquet")
    df = __spark_entry__.queries()["schur_exact"](spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, df.collect()), key=str)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = sorted(c.execute(__spark_entry__.oracle_sql()["schur_exact"]).fetchall(), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_reduced_matrix_in_pieces(spark, kind):
    from demeanor.operators import design

    rng = np.random.default_rng(6)
    c = np.where(rng.random((30, 11)) < 0.5, rng.random((30, 11)), 0.0)
    c[:, 0] += 0.1
    q, r = np.nonzero(c)
    df = spark.createDataFrame(pd.DataFrame({"q": q, "r": r + 10, "w": c[q, r]})).withColumn("r", F.col("r").cast(kind))
    want = np.diag(c.sum(0)) - c.T @ (c / c.sum(1)[:, None])
    got = np.zeros((11, 11))
    for i, j, s in design.reduced_matrix(df).collect():
        got[int(i) - 10, int(j) - 10] += s
    assert np.allclose(got, want)
    lists = df.groupBy("q").agg(F.lit(True).alias("goes"), F.collect_list("r").alias("r"), F.collect_list("w").alias("w")).drop("q").coalesce(1).toArrow().to_batches()
    for products, cells in ((1, 100), (40, 100), (40, 1), (10**6, 1), (10**6, 10**6)):
        out = [x for b in design.eliminated(lists, products, cells) for x in b.to_pylist()]
        sums = np.zeros((11, 11))
        for x in out:
            assert x["i"] <= x["j"]
            sums[int(x["i"]) - 10, int(x["j"]) - 10] += x["s"]
        assert np.allclose(sums, np.triu(want)) and (products < 10**6 or len(out) == len({(x["i"], x["j"]) for x in out}))
