"""Delta tests of tetrads and sextads, and the cluster searches on them."""

import numpy as np
import pandas as pd
import pytest

from causeway.operators import delta
from causeway.operators.moments import Covariance
from causeway.plans import clusters


def _indicators(n, seed, errors="normal", impure=True):
    """Four indicators of each of two correlated factors, and one of both."""
    rng = np.random.default_rng(seed)
    draw = {"normal": lambda *s: rng.normal(size=s), "skew": lambda *s: rng.exponential(size=s) - 1}[errors]
    f = draw(n)
    g = 0.5 * f + draw(n)
    out = {f"a{i}": (1 + i / 5) * f + draw(n) for i in range(4)} | {f"b{i}": (1 + i / 5) * g + draw(n) for i in range(4)}
    if impure:
        out["z"] = f + g + draw(n)
    return pd.DataFrame(out)


def _matrix(pdf):
    return Covariance(list(pdf.columns), np.cov(pdf.to_numpy().T), len(pdf))


def test_statistics_row_by_row(spark):
    pdf = _indicators(500, 1, "skew")
    x = (pdf - pdf.mean()).to_numpy()
    at = {c: i for i, c in enumerate(pdf.columns)}
    test = delta.from_table(spark.createDataFrame(pdf), list(pdf.columns))
    s = np.cov(x.T)

    def influence(value_of):
        """Slopes by differences of the value, then each row's share."""
        slope = np.zeros_like(s)
        for i in range(len(s)):
            for j in range(len(s)):
                up, down = s.copy(), s.copy()
                up[i, j] += 1e-6
                down[i, j] -= 1e-6
                slope[i, j] = (value_of(up) - value_of(down)) / 2e-6
        return np.einsum("ij,ni,nj->n", slope, x, x), (slope * s).sum()

    tetrad = lambda a, b, c, d: lambda m: m[at[a], at[b]] * m[at[c], at[d]] - m[at[a], at[c]] * m[at[b], at[d]]
    sextad = lambda *v: lambda m: np.linalg.det(m[np.ix_([at[k] for k in v[:3]], [at[k] for k in v[3:]])])
    for names, make, of in (([("a0", "a1", "b0", "b1"), ("a0", "a1", "a2", "a3")], tetrad, test.tetrads), ([("a0", "a1", "b0", "a2", "b1", "b2"), ("a0", "a1", "a2", "b1", "b2", "b3")], sextad, test.sextads)):
        shares = [influence(make(*v)) for v in names]
        v = np.array([[(p * q).mean() - mp * mq for q, mq in shares] for p, mp in shares])
        t = np.array([make(*v_)(s) for v_ in names])
        chi, df, _ = of(*names)
        assert df == 2 and chi == pytest.approx(500 * t @ np.linalg.solve(v, t), rel=1e-4)


@pytest.mark.parametrize("kind", ["table", "covariance", "correlation"])
def test_levels_under_the_null(spark, kind):
    """The statistic of vanishing tetrads has its chi-square mean; that of others grows with the rows."""
    chis = []
    for seed in range(60 if kind != "table" else 12):
        pdf = _indicators(800, seed, impure=False)
        test = {"table": lambda: delta.from_table(spark.createDataFrame(pdf), list(pdf.columns)), "covariance": lambda: delta.from_covariance(_matrix(pdf)), "correlation": lambda: delta.from_correlation(_matrix(pdf).correlation())}[kind]()
        chis.append([test.tetrads(("a0", "a1", "a2", "a3"), ("a0", "a1", "a3", "a2"))[0], test.sextads(("a0", "a1", "b0", "a2", "b1", "b2"))[0], test.tetrads(("a0", "a1", "b0", "b1"))[0]])
    mean = np.mean(chis, 0)
    assert 1 < mean[0] < 4 and 0.3 < mean[1] < 2.2 and mean[2] > 20


def test_fewer_degrees_for_redundant_restrictions():
    test = delta.from_covariance(_matrix(_indicators(500, 3)))
    once, twice = test.tetrads(("a0", "a1", "a2", "a3")), test.tetrads(("a0", "a1", "a2", "a3"), ("a0", "a1", "a2", "a3"))
    assert twice == pytest.approx(once)
    assert 0 <= test.two_factors(["a0", "a1", "a2", "b0", "b1", "b2"]) <= 1
    with pytest.raises(ValueError, match="columns"):
        delta.from_table(None, [f"c{i}" for i in range(41)])


def test_missing_values_and_large_means(spark):
    pdf = _indicators(400, 5) + 1e6
    with_gaps = pd.concat([pdf, pdf.head(20).assign(a0=None)])
    a = delta.from_table(spark.createDataFrame(with_gaps.astype(object).where(with_gaps.notna(), None), ", ".join(f"{c} double" for c in pdf)), list(pdf.columns))
    b = delta.from_table(spark.createDataFrame(pdf - 1e6), list(pdf.columns))
    assert a.cov.n == 400 and a.tetrads(("a0", "a1", "b0", "b1"))[0] == pytest.approx(b.tetrads(("a0", "a1", "b0", "b1"))[0], rel=1e-4)


WANTED = [[f"a{i}" for i in range(4)], [f"b{i}" for i in range(4)]]


@pytest.mark.parametrize("errors", ["normal", "skew"])
def test_pure_clusters(spark, errors):
    pdf = _indicators(20_000, 2, errors)
    assert clusters.build_pure_clusters(delta.from_table(spark.createDataFrame(pdf), list(pdf.columns)), 0.0001) == WANTED


def test_pure_clusters_of_odd_columns():
    pdf = _indicators(5000, 7)
    rng = np.random.default_rng(0)
    pdf["noise"] = rng.normal(size=5000)
    pdf["a9"] = pdf["a3"] + 0.7 * rng.normal(size=5000)
    found = clusters.build_pure_clusters(delta.from_covariance(_matrix(pdf)), 0.001)
    assert all("noise" not in x and "z" not in x for x in found) and not any({"a3", "a9"} <= set(x) for x in found)
    alone = clusters.build_pure_clusters(delta.from_covariance(_matrix(pd.DataFrame(rng.normal(size=(2000, 5)), columns=list("pqrst")))), 0.001)
    assert alone == []


def test_two_factor_clusters():
    rng = np.random.default_rng(11)
    f, g = rng.normal(size=(2, 20_000))
    pdf = pd.DataFrame({f"y{i}": p * f + q * g + rng.normal(size=20_000) for i, (p, q) in enumerate(zip([1, 1.2, 0.8, 0.3, 0.4, 0.2, 0.9], [0.3, 0.2, 0.5, 1, 1.2, 0.9, -0.6]))} | {f"n{i}": rng.normal(size=20_000) for i in range(2)})
    test = delta.from_covariance(_matrix(pdf))
    assert clusters.two_factor_clusters(test, 0.001) == [[f"y{i}" for i in range(7)]]
    one = pd.DataFrame({f"o{i}": f + rng.normal(size=20_000) for i in range(7)})
    assert clusters.two_factor_clusters(delta.from_covariance(_matrix(one)), 0.001) == []
