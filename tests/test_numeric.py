import numpy as np
import pytest

from demeanor import config as C
from demeanor.errors import BuildError, ConfigError, SingularDiagonal
from demeanor.operators import krylov, local, schwarz
from demeanor.operators.matrices import CrossTab, SparseMatrix, connected


def tab(c, dq, dr):
    c = np.asarray(c, float)
    q, r = np.nonzero(c)
    return CrossTab(q, r, c[q, r], np.asarray(dq, float), np.asarray(dr, float))


def test_schur_by_hand():
    s = local.exact_schur(tab([[1, 2], [3, 0], [0, 4]], [5, 6, 8], [7, 9]))
    assert np.allclose(s, [[5.3, -0.4], [-0.4, 6.2]])


def test_zero_diagonal_is_an_error():
    with pytest.raises(SingularDiagonal):
        local.exact_schur(tab([[1, 2, 0], [1, 0, 1]], [3, 2], [5, 6, 0]))


def test_sampled_schur_is_a_seeded_laplacian_of_few_edges_and_right_in_the_mean():
    rng = np.random.default_rng(1)
    c = rng.random((9, 4)) + 0.1
    t = tab(c, c.sum(1), c.sum(0))
    a, b = local.sampled_schur(t, 5).dense(), local.sampled_schur(t, 5).dense()
    assert (a == b).all() and np.allclose(a, a.T) and np.allclose(a.sum(1), 0)
    mean = np.mean([local.sampled_schur(t, 1000 * k).dense() for k in range(400)], axis=0)
    assert np.abs(mean - local.exact_schur(t)).max() < 0.15


@pytest.mark.parametrize("config", [C.SchurComplement(), C.SchurComplement(dense_threshold=0), C.SchurComplement(approx_schur=C.ApproxSchurConfig(), dense_threshold=2000)])
def test_local_solver_inverts_a_component(config):
    rng = np.random.default_rng(2)
    c = rng.random((7, 5)) + 0.1
    t = tab(c, c.sum(1), c.sum(0))
    g = np.block([[np.diag(t.diag_q), c], [c.T, np.diag(t.diag_r)]])
    b = g @ rng.normal(size=12)
    assert np.allclose(g @ local.BlockElimination(t, config).solve(b), b, atol=1e-7)


def test_components_agree_with_search():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.integers(0, 30, (2, 20))
        label = connected(30, a, b)
        reach = np.eye(30, dtype=bool)
        reach[a, b] = reach[b, a] = True
        for _ in range(5):
            reach = reach @ reach
        assert ((label[:, None] == label) == reach).all()


def test_shares_add_up():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 5, (3, 60))
    tabs = {}
    for q, r in schwarz.pairs(3):
        c = np.zeros((5, 5))
        np.add.at(c, (codes[q], codes[r]), 1)
        tabs[q, r] = tab(c, c.sum(1), c.sum(0))
    total = np.zeros(15)
    for s in schwarz.subdomains(tabs, np.array([0, 5, 10, 15])):
        total[s.index] += s.omega**2
    assert np.allclose(total, 1)


def test_krylov_small_systems():
    a = np.array([[4.0, 1, 0], [1, 3, 1], [0, 1, 2]])
    b = np.array([1.0, 2, 3])
    out = krylov.cg(a.__matmul__, b, tol=1e-12)
    assert out.converged and out.iterations <= 3 and np.allclose(a @ out.x, b)
    a2 = np.array([[3.0, 1, 0], [0, 4, 2], [1, 0, 5]])
    assert np.allclose(a2 @ krylov.gmres(a2.__matmul__, b, tol=1e-12, restart=2).x, b)
    tall = np.random.default_rng(5).normal(size=(12, 4))
    y = np.arange(12.0)
    assert np.allclose(krylov.lsmr(tall.__matmul__, tall.T.__matmul__, y, tol=1e-13).x, np.linalg.lstsq(tall, y, rcond=None)[0])
    assert krylov.cg(a.__matmul__, np.zeros(3)).iterations == 0
    with pytest.raises(ConfigError):
        krylov.lsmr(tall.__matmul__, tall.T.__matmul__, y, tol=-1)


def test_settings_are_checked():
    for bad in (lambda: C.ApproxCholConfig(split=0), lambda: C.check(C.CG(), C.Preconditioner.Multiplicative), lambda: C.check(C.LSMR(), C.MultiplicativeSchwarz())):
        with pytest.raises(ConfigError):
            bad()
    with pytest.raises(TypeError):
        C.check("cg", None)
    with pytest.raises(BuildError):
        schwarz.FePreconditioner.from_bytes(b"junk")


def test_sparse_matrix():
    d = np.array([[2.0, 0, 1], [0, 3, 0], [1, 0, 4]])
    i, j = np.nonzero(d)
    m = SparseMatrix(3, i, j, d[i, j])
    assert np.allclose(m.matvec(np.array([1.0, 2, 3])), d @ [1, 2, 3]) and np.allclose(m.diagonal(), [2, 3, 4])
    assert np.allclose(m.submatrix(np.array([0, 2])).dense(), [[2, 1], [1, 4]])
    assert np.allclose(m.take_columns(np.array([0, 2]), np.array([1.0, 3])), d @ [1, 0, 3])


def test_sparse_schur_equals_the_dense_one():
    rng = np.random.default_rng(8)
    for shape in ((40, 12), (12, 40), (1, 5), (7, 7)):
        c = rng.random(shape) * (rng.random(shape) < 0.4) + 0.01 * np.eye(*shape)
        c[0] += 0.1
        c[:, 0] += 0.1
        i, j = np.nonzero(c)
        t = CrossTab(i, j, c[i, j], c.sum(axis=1), c.sum(axis=0))
        for at_once in (1, 30, 1 << 22):
            assert np.allclose(local.sparse_schur(t, at_once).dense(), local.exact_schur(t))


def test_sampled_schur_folds_edges_some_at_a_time(monkeypatch):
    c = np.random.default_rng(3).random((9, 4)) + 0.1
    t = tab(c, c.sum(1), c.sum(0))
    whole = local.sampled_schur(t, 5, 2).dense()
    monkeypatch.setattr(local, "EDGES_AT_ONCE", 1)
    assert np.allclose(local.sampled_schur(t, 5, 2).dense(), whole)


def test_multiplicative_needs_no_columns_for_components_of_one_pair():
    from demeanor.operators.matrices import TabGram

    c = np.array([[1.0, 2, 0, 0], [2, 1, 0, 0], [0, 0, 3, 1], [0, 0, 1, 1]])
    t = tab(c, c.sum(1), c.sum(0))
    offsets = np.array([0, 4, 8])
    gram = TabGram({(0, 1): t}, offsets, np.r_[c.sum(1), c.sum(0)])
    r = gram.matvec(np.arange(8.0))
    z = schwarz.build(C.MultiplicativeSchwarz(), {(0, 1): t}, offsets, gram)(r)
    assert "matrix" not in gram.__dict__ and np.allclose(gram.matvec(z), r) and np.allclose(gram.matrix.matvec(z), r)


def test_approximate_cholesky_makes_no_lists_of_all_entries():
    import tracemalloc

    a, b = np.triu_indices(300, 1)
    s = local.laplacian(300, a, b, np.random.default_rng(7).random(len(a)) + 0.1)
    tracemalloc.start()
    try:
        local.ApproxCholesky(s, C.ApproxCholConfig())
        assert tracemalloc.get_traced_memory()[1] < 90 * s.nnz
    finally:
        tracemalloc.stop()


def test_dense_approximate_cholesky_is_the_sparse_one(monkeypatch):
    a, b = np.triu_indices(30, 1)
    s = local.laplacian(30, a, b, np.random.default_rng(8).random(len(a)) + 0.1)
    dense = local.ApproxCholesky(s, C.ApproxCholConfig(split=2))
    monkeypatch.setattr(local, "DENSE_LEVELS", 0)
    sparse = local.ApproxCholesky(s, C.ApproxCholConfig(split=2))
    x = np.random.default_rng(9).normal(size=30)
    assert dense.dense is not None and sparse.dense is None and np.allclose(dense.once(x - x.mean()), sparse.once(x - x.mean()))
    assert np.allclose(s.matvec(dense.solve(x)), x - x.mean())
