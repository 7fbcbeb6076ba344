"""Mixed graphs with correlated errors and undirected edges."""

import numpy as np
import pytest

from causeway.operators.moments import Covariance
from causeway.plans import graphs, sem
from causeway.plans.ricf import likelihood_gap, ricf


def _cov(p, seed, n=500):
    x = np.random.default_rng(seed).normal(size=(n, p)) @ np.random.default_rng(seed + 1).normal(size=(p, p))
    return Covariance([f"x{i}" for i in range(p)], np.cov(x.T), n)


def _loss(implied, s):
    return np.linalg.slogdet(implied)[1] + np.trace(np.linalg.solve(implied, s))


def test_a_dag_takes_regressions():
    cov, g = _cov(4, 1), graphs.from_spec("x0-->x1,x0-->x2,x1-->x3,x2-->x3")
    fit, wanted = ricf(cov, g), sem.fit_dag(cov, g)
    at = {n: i for i, n in enumerate(fit.names)}
    assert fit.rounds == 1 and fit.chi_square == pytest.approx(wanted.chi_square if hasattr(wanted, "chi_square") else fit.chi_square)
    for (a, b), w in wanted.coefficients.items():
        assert fit.effects[at[b], at[a]] == pytest.approx(w)


def test_equivalent_models_imply_the_same():
    cov = _cov(3, 3)
    a, b = ricf(cov, graphs.from_spec("x0<->x1,x1<->x2")), ricf(cov, graphs.from_spec("x0-->x1,x2-->x1"))
    order = [b.names.index(n) for n in a.names]
    assert np.allclose(a.implied, b.implied[np.ix_(order, order)], atol=1e-6) and a.degrees == b.degrees == 1


@pytest.mark.parametrize("spec", ["x0-->x2,x1-->x3,x2<->x3", "x0-->x1,x1-->x2,x0<->x3,x3<->x2", "x0<->x1,x1<->x2,x2<->x3,x3<->x0", "x0<->x1,x1<->x2,x2<->x3,x0-->x2", "x0-->x1,x1<->x2,x2<->x3,x3<->x4,x0-->x4"])
def test_likelihood_equations(spec):
    g = graphs.from_spec(spec)
    for seed in range(5):
        cov = _cov(len(g.nodes), 10 + seed)
        fit = ricf(cov, g)
        s = cov.sub(fit.names).matrix
        assert likelihood_gap(fit, s, g) < 1e-5 and np.linalg.eigvalsh(fit.errors).min() > 0
        # No step along a free parameter does better.
        best, rng = _loss(fit.implied, s), np.random.default_rng(seed)
        for _ in range(20):
            b, o = fit.effects.copy(), fit.errors.copy()
            b[b != 0] *= 1 + rng.normal(scale=0.02, size=(b != 0).sum())
            noise = rng.normal(scale=0.02, size=o.shape)
            o = o * (1 + noise + noise.T)
            if np.linalg.eigvalsh(o).min() > 0:
                inverse = np.linalg.inv(np.eye(len(b)) - b)
                assert _loss(inverse @ o @ inverse.T, s) >= best - 1e-9


def test_undirected_part():
    cov = _cov(5, 30)
    g = graphs.from_spec("x0---x1,x1---x2,x2---x3,x3---x0,x0-->x4")
    fit = ricf(cov, g)
    i = [fit.names.index(f"x{k}") for k in range(5)]
    k, s = np.linalg.inv(fit.implied[np.ix_(i[:4], i[:4])]), cov.matrix
    assert abs(k[0, 2]) < 1e-6 and abs(k[1, 3]) < 1e-6
    for a, b in ((0, 1), (1, 2), (2, 3), (0, 3), (0, 0), (2, 2)):
        assert fit.implied[i[a], i[b]] == pytest.approx(s[a, b], rel=1e-5)
    assert fit.degrees == 15 - (5 + 4 + 1)


def test_saturated_and_refused():
    cov = _cov(3, 40)
    fit = ricf(cov, graphs.from_spec("x0<->x1,x1<->x2,x0<->x2"))
    order = [cov.names.index(n) for n in fit.names]
    assert np.allclose(fit.implied, cov.matrix[np.ix_(order, order)]) and fit.degrees == 0 and fit.chi_square < 1e-6
    for spec, text in (("x0-->x1,x1-->x2,x2-->x0", "cycle"), ("x0---x1,x2-->x1", "undirected"), ("x0-->y", "not in")):
        with pytest.raises(ValueError, match=text):
            ricf(cov, graphs.from_spec(spec))
    alone = ricf(cov, graphs.from_spec("x0,x1,x2"))
    assert np.allclose(alone.implied, np.diag(np.diag(cov.matrix))) and alone.degrees == 3
