import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import distributions as d
from causeway.functions import statistics as st
from causeway.functions.expressions import transform


@pytest.mark.parametrize(
    ("found", "wanted"),
    [
        (d.normal_cdf(1.96), 0.9750021048517795), (d.chisq_quantile(0.95, 3), 7.814727903251179), (d.t_quantile(0.975, 5), 2.5705818366147395), (d.f_cdf(3.0, 2, 10), 0.9046325683593751),
        (d.beta_cdf(0.5, 2, 3), 0.6875), (d.gamma_cdf(2.0, 3.0), 1 - 4 * math.exp(-3)), (d.binomial_cdf(3, 10, 0.3), 0.6496107184), (d.poisson_cdf(4, 4.0), 0.6288369351798734), (d.normal_quantile(0.5), 0.0),
        (d.bivariate_normal_cdf(0, 0, 0.5), 1 / 3), (d.chisq_tail(0.0, 0), 1.0), (d.poisson_quantile(0.5, 4.0), 4), (d.binomial_quantile(0.5, 10, 0.3), 3), (d.t_pdf(0.0, 1), 1 / math.pi),
    ],
)
def test_distributions(found, wanted):
    assert float(found) == pytest.approx(wanted, abs=1e-9)


def test_distribution_columns(spark):
    df = spark.createDataFrame([(0.3,), (None,), (0.9,)], "u double")
    rows = [r.p for r in df.select(d.column("normal_cdf", F.col("u")).alias("p")).collect()]
    assert rows[1] is None and rows[0] == pytest.approx(float(d.normal_cdf(0.3)))


def test_moments_follow_the_formulas(spark):
    x = np.array([1.0, 2.0, 4.0, 8.0, 9.5])
    df = spark.createDataFrame([(float(v),) for v in x] + [(float("nan"),), (None,)], "x double")
    row = df.agg(st.skewness("x"), st.kurtosis("x"), st.ssx("x"), st.median("x"), st.count("x")).first()
    c, n = x - x.mean(), len(x)
    assert row[0] == pytest.approx((c**3).sum() / (n - 1) / ((c**2).sum() / n) ** 1.5)
    assert row[1] == pytest.approx((c**4).sum() / n / x.var(ddof=1) ** 2 - 3)
    assert row[2] == pytest.approx((c**2).sum()) and row[3] == 4.0 and row[4] == 5


def test_quartiles_and_ranks(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 2, 2, 9, 7)], "x double")
    # Sorted 1 2 2 5 7 9: place q/4 * 7 - 1.
    assert [st.quartile(df, "x", q) for q in (1, 2, 3)] == [pytest.approx(1.75), pytest.approx(3.5), pytest.approx(7.5)]
    from causeway.operators.ordering import average_ranks, ecdf_ranks

    assert sorted(r["rank"] for r in average_ranks(df, "x").collect()) == [1.0, 2.5, 2.5, 4.0, 5.0, 6.0]
    assert sorted(r["rank"] for r in ecdf_ranks(df, "x").collect()) == [1.0, 3.0, 3.0, 4.0, 5.0, 6.0]


def test_rank_measures(spark):
    g = np.random.default_rng(3)
    x, y = g.integers(0, 30, 200), g.integers(0, 30, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    tau = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(200) for j in range(i)) / (200 * 199 / 2)
    assert st.kendalls_tau(df, "x", "y") == pytest.approx(tau)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert st.rank_correlation(df, "x", "y") == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_auc_and_fdr(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.2, 0), (0.2, 1)], "s double, y int")
    pairs = [1.0 if a > b else 0.5 if a == b else 0.0 for a in (0.9, 0.7, 0.2) for b in (0.8, 0.2)]
    assert st.auc(df, "s", "y") == pytest.approx(np.mean(pairs))
    p = spark.createDataFrame([(v,) for v in (0.001, 0.01, 0.02, 0.5)], "p double")
    assert st.fdr_cutoff(p, 0.05) == 0.02 and st.fdr_cutoff(p, 1e-6) == 0.0


def test_calculator(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 2.0)], "x double, y double")
    out = transform(df, "a = x + y * 2 ^ 2", "b = IF(x < y, max(x, y, 10), -x)", "c = AND(x < y, y > 3) + XOR(1, 0)", "d = round(-1.5)", "e = Switch(x - 1, 7, 8, 9)", "f = (x + y) / 2 - -1").collect()
    assert [tuple(r)[2:] for r in out] == [(17.0, 10.0, 2.0, -1.0, 7.0, 3.5), (11.0, -3.0, 1.0, -1.0, 9.0, 3.5)]
    with pytest.raises(ValueError):
        transform(df, "z = nothing + 1")


def test_draws_are_repeatable(spark):
    df = spark.range(2000)
    one = transform(df, "u = U(0, 1)", "g = Gamma(2, 1)", "k = Discrete(0.2, 0.8)").orderBy("id").collect()
    two = transform(df, "u = U(0, 1)", "g = Gamma(2, 1)", "k = Discrete(0.2, 0.8)").orderBy("id").collect()
    assert one == two
    assert np.mean([r.u for r in one]) == pytest.approx(0.5, abs=0.05) and np.mean([r.g for r in one]) == pytest.approx(2, abs=0.15) and np.mean([r.k for r in one]) == pytest.approx(0.8, abs=0.05)


def test_anderson_darling_far_from_normal(spark):
    # The statistic grows with the rows: from 402 on its p-value's formula exceeds a double, as SQL's does.
    squared, star, p = st.anderson_darling(spark.range(20_000).selectExpr("if(id % 2 = 0, 0.0, 1.0) x"), "x")
    assert squared > 402 and star > squared and p == math.inf
    assert st.anderson_darling_p(20.0) == pytest.approx(math.exp(1.2937 - 5.709 * 20 + 0.0186 * 400))
