"""Queries over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.components import largest_component
from ..functions.components import pair_components as components_of
from ..functions.diagnostics import max_abs_group_mean
from ..operators import design as D
from ..operators import schwarz
from ..solver import Solver, regress, solve, solve_batch

TIGHT = 1e-13
PART, SUPP = "l_partkey", "l_suppkey"
Query = Callable[[SparkSession, str], DataFrame]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", PART, SUPP, "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity")


def _coef(key: str) -> str:
    return f"(({key} % 7) - 3)::DOUBLE"


def level_counts(spark, sf_dir):
    d = D.Design(_lines(spark, sf_dir), [PART, SUPP])
    rows = [(f, int(n), int(lv.max()) + 1) for f, n, lv in zip(d.factors, d.n_levels, d.levels)]
    return spark.createDataFrame(rows, "factor string, n_levels long, n_codes long")


def gram_diagonal(spark, sf_dir, weight=None):
    d = D.Design(_lines(spark, sf_dir), [PART, SUPP], weight)
    diag = d.diagonal()
    out = [(f, int(v), float(x)) for k, f in enumerate(d.factors) for v, x in zip(d.levels[k], diag[d.offsets[k] : d.offsets[k + 1]])]
    return spark.createDataFrame(pd.DataFrame(out, columns=["factor", "level", "weight"]))


def scatter_wy(spark, sf_dir, weight=None):
    w = F.col(weight) if weight else F.lit(1.0)
    s = D.scatter(_lines(spark, sf_dir), [PART, SUPP], {"wy": w * F.col("l_extendedprice")})
    return s.select("factor", F.col("level").cast("long").alias("level"), F.round("wy", 2).alias("wy"))


def _tables(lines):
    return [lines.select(F.col(f).alias("level")).distinct().withColumn("coef", ((F.col("level") % 7) - 3).cast("double")) for f in (PART, SUPP)]


def gather_fitted(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    got = D.gather(lines, [PART, SUPP], _tables(lines), "fitted")
    return got.groupBy("l_returnflag", "fitted").agg(F.count(F.lit(1)).alias("n"))


def gram_matvec(spark, sf_dir, implicit=False):
    lines = _lines(spark, sf_dir)
    d = D.Design(lines, [PART, SUPP])
    x = pd.concat([pd.Series(lv) for lv in d.levels]).mod(7).sub(3).to_numpy(float)
    y = (d.implicit_product if implicit else d.gram.matvec)(x)
    d.release()
    return D.send(spark, pd.DataFrame({"factor": np.repeat(np.arange(2), d.n_levels), "level": np.concatenate(d.levels), "value": y}))


def cross_tab(spark, sf_dir):
    return D.cross_tab(_lines(spark, sf_dir), PART, SUPP, F.col("l_quantity").cast("double")).select("q", "r", F.round("w", 4).alias("w"))


def gram_explicit(spark, sf_dir):
    d = D.Design(_lines(spark, sf_dir), ["l_linenumber", SUPP])
    g, lv = d.gram, [(k, int(v)) for k in range(2) for v in d.levels[k]]
    rows = pd.DataFrame({"row_factor": [lv[i][0] for i in g.rows], "row_level": [lv[i][1] for i in g.rows], "col_factor": [lv[i][0] for i in g.cols], "col_level": [lv[i][1] for i in g.cols], "value": g.values})
    return spark.createDataFrame(rows)


def _customers(spark, sf_dir):
    return D.Design(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"), ["c_custkey", "c_nationkey"])


def pair_components(spark, sf_dir):
    d = _customers(spark, sf_dir)
    label = d.tab(0, 1).components()[: d.n_levels[0]]
    out = pd.DataFrame({"level": [int(v) for v in d.levels[0]], "label": label})
    out["component"] = out.groupby("label")["level"].transform("min")
    return spark.createDataFrame(out[["level", "component"]])


def largest_component_rows(spark, sf_dir):
    """Rows of the component with most rows; of equal ones, that with the smallest level."""
    d = _customers(spark, sf_dir)
    of = pair_components(spark, sf_dir)
    rows = d.df.join(of, d.df["c_custkey"] == of["level"]).select("c_custkey", "c_nationkey", "component")
    best = rows.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return rows.join(F.broadcast(best.select("component")), "component", "left_semi").select("c_custkey", "c_nationkey")


def _paths(spark, sf_dir):
    """All customers as links of paths: each hundred keys is one, and each key ties two halved numbers together."""
    key, path = F.col("c_custkey"), F.floor(F.col("c_custkey") / 100) * 1000
    of = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return of.select("c_custkey", (path + F.floor(key % 100 / 2)).alias("a"), (path + F.floor((key % 100 + 1) / 2)).alias("b"))


def path_components(spark, sf_dir):
    """Components that take many hops, found on the cluster."""
    return components_of(_paths(spark, sf_dir), "a", "b").select("factor", F.coalesce("a", "b").alias("level"), "component")


def path_components_driver(spark, sf_dir):
    """The same from the pairs on the driver."""
    d = D.Design(_paths(spark, sf_dir), ["a", "b"])
    of = pd.DataFrame({"factor": [k for k in range(2) for _ in d.levels[k]], "level": [int(v) for lv in d.levels for v in lv], "label": d.tab(0, 1).components()})
    of["component"] = of["label"].map(of[of["factor"] == 0].groupby("label")["level"].min())
    return spark.createDataFrame(of[["factor", "level", "component"]]).withColumn("factor", F.col("factor").cast("int"))


def largest_path(spark, sf_dir):
    return largest_component(_paths(spark, sf_dir), "a", "b")


def coefficients_2way(spark, sf_dir):
    """Coefficients of every level, less their means over the rows, which two factors leave open."""
    lines = _lines(spark, sf_dir)
    s = Solver(lines, [PART, SUPP], C.CG(tol=TIGHT))
    x, n = s.solve("l_extendedprice").vector, s.design.diagonal()
    for lo, hi in zip(s.design.offsets, s.design.offsets[1:]):
        x[lo:hi] -= (x[lo:hi] * n[lo:hi]).sum() / n[lo:hi].sum()
    return s.design.coefficients(x).select("factor", F.col("level").cast("long").alias("level"), F.round(F.col("coef") * F.pi(), 2).alias("coef"))


def pou_weights(spark, sf_dir):
    d = D.Design(_lines(spark, sf_dir), ["l_linenumber", SUPP, "l_returnflag"])
    parts = schwarz.subdomains(d.tabs, d.offsets)
    lv = [(k, str(v)) for k in range(3) for v in d.levels[k]]
    rows = [(s.pair[0], s.pair[1], *lv[i], float(round(w, 9))) for s in parts for i, w in zip(s.index, s.omega)]
    return spark.createDataFrame(rows, "q int, r int, factor int, level string, omega double")


def schur_exact(spark, sf_dir):
    """Suppliers' reduced matrix: their counts, less what they share through each part."""
    t = D.cross_tab(_lines(spark, sf_dir), PART, SUPP, F.lit(1.0))
    return D.reduced_matrix(t).select("i", "j", (F.round("s", 6) + F.lit(0.0)).alias("s"))


def _squares(df: DataFrame, col: str = "demeaned") -> DataFrame:
    return df.groupBy("l_returnflag").agg(F.round(F.avg(F.col(col) * F.col(col)) / 1e6, 4).alias("msr"))


def demean(spark, sf_dir, factors, weight=None, config=None, preconditioner=None, **options):
    r = solve(_lines(spark, sf_dir), factors, "l_extendedprice", weight, config or C.CG(tol=TIGHT), preconditioner, **options)
    return _squares(r.demeaned)


def demean_rows(spark, sf_dir):
    """What is left of every single row; times pi, so that no value lies on the edge between two rounded ones."""
    r = solve(_lines(spark, sf_dir), [PART, SUPP], "l_extendedprice", config=C.CG(tol=TIGHT))
    return r.demeaned.select("l_orderkey", "l_linenumber", F.round(F.col("demeaned") * F.pi(), 2).alias("demeaned"))


def demean_null_y(spark, sf_dir):
    """Rows whose response is null are left out of sums and counts alike."""
    lines = _lines(spark, sf_dir).withColumn("y", F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")))
    r = solve(lines, [SUPP], "y", null_policy="drop")
    return r.demeaned.select("l_orderkey", "l_linenumber", F.round(F.col("demeaned") * F.pi(), 2).alias("demeaned"))


def demean_implicit_large(spark, sf_dir):
    """More pairs of levels than the bound: products over the observations, without a preconditioner."""
    config = C.CG(tol=TIGHT, operator=C.OperatorRepr.Implicit)
    return _squares(solve(_lines(spark, sf_dir), [PART, SUPP], "l_extendedprice", None, config, C.Preconditioner.Off, most_pairs=1000).demeaned)


def demean_batch(spark, sf_dir):
    r = solve_batch(_lines(spark, sf_dir), [PART, SUPP], ["l_extendedprice", "l_quantity"], config=C.CG(tol=TIGHT))
    sq = [F.round(F.avg(F.col(f"{n}_demeaned") ** 2) / s, 4).alias(a) for n, s, a in (("l_extendedprice", 1e6, "msr_price"), ("l_quantity", 1.0, "msr_quantity"))]
    return r.demeaned_all.groupBy("l_returnflag").agg(*sq)


def group_mean_max(spark, sf_dir):
    """After one factor is projected out, the largest mean that the other still has; after both, none."""
    one, both = (solve(_lines(spark, sf_dir), f, "l_extendedprice", config=C.CG(tol=TIGHT)).demeaned for f in ([PART], [PART, SUPP]))
    left = max_abs_group_mean(one, [PART, SUPP]).select(F.round(F.col("max_abs_group_mean") * F.pi(), 4).alias("after_one"))
    return left.withColumn("after_both", F.lit(max_abs_group_mean(both, [PART, SUPP]).select(F.round("max_abs_group_mean", 6)).first()[0]))


def fwl_slope(spark, sf_dir):
    r = regress(_lines(spark, sf_dir), [PART, SUPP], "l_extendedprice", ["l_quantity"], config=C.CG(tol=TIGHT))
    return r.select("term", F.round(F.col("slope") / 1e3, 6).alias("slope"))


def user_type_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "value")
    r = solve(events, ["user_id", "event_type"], "value", config=C.CG(tol=TIGHT))
    return r.demeaned.groupBy("event_type").agg(F.round(F.avg(F.col("demeaned") ** 2), 4).alias("msr"))


def solver_report(spark, sf_dir):
    s = Solver(_lines(spark, sf_dir), [SUPP, "l_linenumber", "l_returnflag"])
    return s.solve_batch(["l_extendedprice", "l_quantity"]).report()


def preconditioner_reuse(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    built = schwarz.FePreconditioner.from_bytes(Solver(lines, [PART, SUPP]).preconditioner().to_bytes())
    return demean(spark, sf_dir, [PART, SUPP], preconditioner=built)


_TWO = [PART, SUPP]
_VARIANTS: dict[str, Query] = {
    "demean_1way": partial(demean, factors=[PART]),
    "demean_1way_weighted": partial(demean, factors=[PART], weight="l_quantity"),
    "demean_2way": partial(demean, factors=_TWO),
    "demean_2way_weighted": partial(demean, factors=_TWO, weight="l_quantity"),
    "demean_3way": partial(demean, factors=[SUPP, "l_linenumber", "l_returnflag"]),
    "demean_cg_explicit": partial(demean, factors=_TWO, config=C.CG(tol=TIGHT, operator=C.OperatorRepr.Explicit)),
    "demean_cg_implicit": partial(demean, factors=_TWO, config=C.CG(tol=TIGHT, operator=C.OperatorRepr.Implicit)),
    "demean_gmres_mult": partial(demean, factors=_TWO, config=C.GMRES(tol=TIGHT), preconditioner=C.Preconditioner.Multiplicative),
    "demean_lsmr": partial(demean, factors=_TWO, config=C.LSMR(tol=TIGHT)),
    "demean_lsmr_rows": partial(demean, factors=_TWO, config=C.LSMR(tol=1e-10), most_pairs=1000),
    "demean_3way_large": partial(demean, factors=["l_orderkey", PART, SUPP], config=C.CG(tol=1e-11), preconditioner=C.Preconditioner.Off),
    "demean_unprec": partial(demean, factors=_TWO, preconditioner=C.Preconditioner.Off),
    "demean_approx_schur": partial(demean, factors=_TWO, preconditioner=C.AdditiveSchwarz(C.SchurComplement(approx_schur=C.ApproxSchurConfig(split=2), dense_threshold=0))),
    "gram_diagonal_weighted": partial(gram_diagonal, weight="l_quantity"),
    "scatter_wy_weighted": partial(scatter_wy, weight="l_quantity"),
    "gram_matvec_implicit": partial(gram_matvec, implicit=True),
}


def queries() -> dict[str, Query]:
    plain = [level_counts, gram_diagonal, scatter_wy, gather_fitted, gram_matvec, cross_tab, gram_explicit, pair_components, largest_component_rows, path_components, path_components_driver, largest_path, coefficients_2way, pou_weights, schur_exact]
    plain += [demean_rows, demean_null_y, demean_implicit_large, demean_batch, group_mean_max, fwl_slope, user_type_events, solver_report, preconditioner_reuse]
    return {f.__name__: f for f in plain} | _VARIANTS


def _sweeps(source: str, factors: list[str], ys: list[str], sweeps: int, w: str = "1.0") -> str:
    """CTEs that demean by one factor after another, over and over; the last is ``e``."""
    ctes = [f"e0 AS MATERIALIZED (SELECT *, {w}::DOUBLE AS w, {', '.join(f'{y}::DOUBLE AS r{j}' for j, y in enumerate(ys))} FROM {source})"]
    k = 0
    for _ in range(sweeps):
        for f in factors:
            mean = ", ".join(f"sum(w * r{j}) / sum(w) AS m{j}" for j in range(len(ys)))
            less = ", ".join(f"e.r{j} - m.m{j} AS r{j}" for j in range(len(ys)))
            ctes.append(f"m{k} AS MATERIALIZED (SELECT {f} AS lv, {mean} FROM e{k} GROUP BY 1)")
            ctes.append(f"e{k + 1} AS MATERIALIZED (SELECT e.* REPLACE ({less}) FROM e{k} e JOIN m{k} m ON e.{f} = m.lv)")
            k += 1
    return "WITH " + ",\n".join([*ctes, f"e AS (SELECT * FROM e{k})"])


def oracle_sql() -> dict[str, str]:
    def msr(factors, w="1.0", sweeps=20):
        return _sweeps("lineitem", factors, ["l_extendedprice"], sweeps, w) + "\nSELECT l_returnflag, round(avg(r0 * r0) / 1e6, 4) AS msr FROM e GROUP BY 1"

    two = msr(_TWO)
    lv = [f"SELECT {k} AS factor, {f} AS level" for k, f in enumerate(_TWO)]
    matvec = f"WITH v AS (SELECT *, {_coef(PART)} + {_coef(SUPP)} AS v FROM lineitem) " + " UNION ALL ".join(f"{s}, sum(v) AS value FROM v GROUP BY {f}" for s, f in zip(lv, _TWO))

    def diag(w):
        return " UNION ALL ".join(f"SELECT '{f}' AS factor, {f} AS level, sum({w})::DOUBLE AS weight FROM lineitem GROUP BY {f}" for f in _TWO)

    def wy(w):
        return " UNION ALL ".join(f"{s}, round(sum({w} * l_extendedprice), 2) AS wy FROM lineitem GROUP BY {f}" for s, f in zip(lv, _TWO))

    gram = ["l_linenumber", SUPP]
    explicit = " UNION ALL ".join(
        f"SELECT {i} AS row_factor, {a}::BIGINT AS row_level, {j} AS col_factor, {b}::BIGINT AS col_level, count(*)::DOUBLE AS value FROM lineitem GROUP BY {a}, {b}" for i, a in enumerate(gram) for j, b in enumerate(gram)
    )
    three = ["l_linenumber", SUPP, "l_returnflag"]
    pou = " UNION ALL ".join(f"SELECT {q} AS q, {r} AS r, {k} AS factor, {three[k]}::VARCHAR AS level, round(1 / sqrt(2.0), 9) AS omega FROM lineitem GROUP BY {three[k]}" for q in range(3) for r in range(q + 1, 3) for k in (q, r))
    paths = """WITH RECURSIVE p AS (SELECT c_custkey, c_custkey // 100 * 1000 + c_custkey % 100 // 2 AS a, c_custkey // 100 * 1000 + (c_custkey % 100 + 1) // 2 AS b FROM customer),
l AS (SELECT DISTINCT x.a AS n, y.a AS m FROM p x JOIN p y ON x.b = y.b),
reach AS (SELECT n, m FROM l UNION SELECT reach.n, l.m FROM reach JOIN l ON reach.m = l.n),
named AS (SELECT n, min(m) AS component FROM reach GROUP BY 1)"""
    comp = "WITH c AS (SELECT c_custkey, c_nationkey, min(c_custkey) OVER (PARTITION BY c_nationkey) AS component FROM customer)"
    return {
        "level_counts": " UNION ALL ".join(f"SELECT '{f}' AS factor, count(DISTINCT {f}) AS n_levels, max({f}) + 1 AS n_codes FROM lineitem" for f in _TWO),
        "gram_diagonal": diag("1.0"),
        "gram_diagonal_weighted": diag("l_quantity"),
        "scatter_wy": wy("1.0"),
        "scatter_wy_weighted": wy("l_quantity"),
        "gather_fitted": f"SELECT l_returnflag, {_coef(PART)} + {_coef(SUPP)} AS fitted, count(*) AS n FROM lineitem GROUP BY 1, 2",
        "gram_matvec": matvec,
        "gram_matvec_implicit": matvec,
        "cross_tab": f"SELECT {PART} AS q, {SUPP} AS r, round(sum(l_quantity::DOUBLE), 4) AS w FROM lineitem GROUP BY 1, 2",
        "gram_explicit": explicit,
        "pair_components": comp + " SELECT c_custkey AS level, component FROM c",
        "largest_component_rows": comp + " SELECT c_custkey, c_nationkey FROM c WHERE component = (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)",
        "pou_weights": pou,
        "schur_exact": f"""WITH t AS (SELECT {PART} AS q, {SUPP} AS r, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2),
s AS (SELECT q, sum(w) AS d FROM t GROUP BY 1),
x AS (SELECT a.r AS i, b.r AS j, -sum(a.w / s.d * b.w) AS s FROM t a JOIN s USING (q) JOIN t b USING (q) GROUP BY 1, 2 UNION ALL SELECT r, r, sum(w) FROM t GROUP BY r)
SELECT i, j, round(sum(s), 6) + 0.0 AS s FROM x GROUP BY 1, 2""",
        "demean_rows": _sweeps("lineitem", _TWO, ["l_extendedprice"], 30) + "\nSELECT l_orderkey, l_linenumber, round(r0 * pi(), 2) AS demeaned FROM e",
        "demean_null_y": f"SELECT l_orderkey, l_linenumber, round((l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY {SUPP})) * pi(), 2) AS demeaned FROM lineitem WHERE l_linenumber <> 3",
        "demean_1way": msr([PART], sweeps=1),
        "demean_1way_weighted": msr([PART], "l_quantity", 1),
        **{k: two for k in ("demean_2way", "demean_cg_explicit", "demean_cg_implicit", "demean_gmres_mult", "demean_lsmr", "demean_unprec", "demean_approx_schur", "demean_lsmr_rows", "preconditioner_reuse", "demean_implicit_large")},
        "demean_2way_weighted": msr(_TWO, "l_quantity"),
        "demean_3way": msr([SUPP, "l_linenumber", "l_returnflag"], sweeps=20),
        "demean_batch": _sweeps("lineitem", _TWO, ["l_extendedprice", "l_quantity"], 20) + "\nSELECT l_returnflag, round(avg(r0 * r0) / 1e6, 4) AS msr_price, round(avg(r1 * r1), 4) AS msr_quantity FROM e GROUP BY 1",
        "demean_3way_large": msr(["l_orderkey", *_TWO], sweeps=40),
        **{k: paths + " SELECT 0 AS factor, n AS level, component FROM named UNION ALL SELECT DISTINCT 1, b, component FROM p JOIN named ON p.a = named.n" for k in ("path_components", "path_components_driver")},
        "largest_path": paths + " SELECT c_custkey, a, b FROM p JOIN named ON p.a = named.n WHERE component = (SELECT component FROM p JOIN named ON p.a = named.n GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)",
        "coefficients_2way": _sweeps("lineitem", _TWO, ["l_extendedprice"], 30) + "".join(f",\nc{k} AS (SELECT lv, sum(m0) AS x FROM ({' UNION ALL '.join(f'SELECT lv, m0 FROM m{j}' for j in range(k, 60, 2))}) GROUP BY 1)" for k in range(2))
        + " UNION ALL ".join(f"\nSELECT '{f}' AS factor, lv AS level, round((x - (SELECT avg(x) FROM lineitem JOIN c{k} ON {f} = lv)) * pi(), 2) AS coef FROM c{k}" for k, f in enumerate(_TWO)),
        "group_mean_max": f"WITH e AS (SELECT {SUPP}, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY {PART}) AS r FROM lineitem), m AS (SELECT avg(r) AS m FROM e GROUP BY {SUPP}) SELECT round(max(abs(m)) * pi(), 4) AS after_one, 0.0::DOUBLE AS after_both FROM m",
        "fwl_slope": _sweeps("lineitem", _TWO, ["l_extendedprice", "l_quantity"], 20) + "\nSELECT 'l_quantity' AS term, round(sum(r0 * r1) / sum(r1 * r1) / 1e3, 6) AS slope FROM e",
        "user_type_events": _sweeps("events", ["user_id", "event_type"], ["value"], 12) + "\nSELECT event_type, round(avg(r0 * r0), 4) AS msr FROM e GROUP BY 1",
    }
