import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import moments, ordering, preparation, regression, series, tables


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(1)
    x = g.standard_normal(500)
    z = g.standard_normal(500)
    y = 2 + 3 * x - z + 0.1 * g.standard_normal(500)
    return spark.createDataFrame([(i, float(a), float(b), float(c), int(k)) for i, (a, b, c, k) in enumerate(zip(x, y, z, g.integers(0, 3, 500)))], "_row long, x double, y double, z double, k int").cache()


def test_row_numbers_and_lags(spark):
    g = np.random.default_rng(2)
    v = g.permutation(1000)
    df = ordering.with_row_number(spark.createDataFrame([(int(a),) for a in v], "v int").repartition(7), "v")
    assert all(r.v == r._row for r in df.collect())
    out = ordering.lagged(df, {"a": ("v", 3), "b": ("v", -2)}, block=100).collect()
    assert len(out) == 1000
    for r in out:
        assert r.a == (r.v - 3 if r.v >= 3 else None) and r.b == (r.v + 2 if r.v < 998 else None)


def test_running_sums(spark):
    df = spark.createDataFrame([(float(k % 17), k) for k in range(300)] + [(None, 1000)], "k double, n int")
    got = {(r.k, r.n): r.s for r in ordering.running(df, "k", {"s": F.col("n")}, ["n"]).collect()}
    total = 0
    for k, n in sorted(got, key=lambda t: (t[0] is not None, t[0] or 0, t[1])):
        total += n
        assert got[k, n] == total


def test_tables(spark, rows):
    n = tables.subset_columns(rows.filter("_row < 5"), ["x", "k"])
    picked = tables.subset_rows(n, [4, 0, 4]).orderBy("_row").collect()
    assert [r._row for r in picked] == [0, 1, 2] and picked[0].x == picked[2].x
    assert tables.remove_rows(n, [1]).count() == 4
    down = {r._row: r.k for r in tables.shift_column_down(n.withColumn("k", F.col("_row").cast("int")), 2, "k", 2).collect()}
    assert down == {0: 0, 1: 1, 2: None, 3: None, 4: 2, 5: 3, 6: 4}
    missing = spark.createDataFrame([(1.0, -99, "a"), (float("nan"), 2, None), (3.0, 4, "b")], "c double, d int, e string")
    assert tables.complete_cases(missing).count() == 1 and tables.has_missing(missing)
    assert tables.drop_constant_columns(missing.withColumn("f", F.lit(1))).columns == ["c", "d", "e"]
    coded, cats = tables.index_categories(missing, ["e"])
    assert [r.e for r in coded.collect()] == [0, None, 1] and cats == {"e": ["a", "b"]}
    assert tables.power_set(spark.range(4), "id").count() == 16
    assert tables.combinations_of(spark.range(5), "id", 3).count() == 10
    shuffled = tables.permute_rows(n, 7).orderBy("_row").collect()
    assert sorted(r.x for r in shuffled) == sorted(r.x for r in n.collect()) and tables.permute_rows(n, 7).orderBy("_row").collect() == shuffled


def test_covariance(rows):
    data = np.array([r[1:4] for r in rows.collect()], float)
    cov = moments.covariance_matrix(rows, ["x", "y", "z"])
    assert np.allclose(cov.matrix, np.cov(data.T)) and cov.n == 500
    frame = {(r.var_i, r.var_j): r.value for r in moments.covariance_frame(rows, ["x", "y"]).collect()}
    assert frame["x", "y"] == pytest.approx(cov.matrix[0, 1])
    p = np.linalg.inv(cov.matrix)
    assert moments.partial_correlation(cov, "x", "y", ["z"]) == pytest.approx(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1]))


def test_wide_covariance(rows, monkeypatch):
    monkeypatch.setattr(moments, "BLOCK_COLUMNS", 2)
    assert np.allclose(moments.gram_matrix(rows, ["x", "y", "z"]).matrix[1:, 1:], (lambda d: d.T @ d)(np.array([r[1:4] for r in rows.collect()], float)))


def test_entropies(spark):
    bits = lambda s: [int(c) for c in s]
    a, b, c = bits("00001111"), bits("00110011"), bits("01010101")
    nb, nc = bits("01011111"), bits("00010111")
    df = spark.createDataFrame(list(zip(a, b, c, nb, nc)), "a int, b int, c int, nb int, nc int")
    assert moments.entropy(df, ["a"]) == pytest.approx(1.0)
    assert moments.entropy(df, ["nb"]) == pytest.approx(0.8112781244591328)
    assert moments.entropy(df, ["nb", "a"]) == pytest.approx(1.5)
    assert moments.entropy(df, ["nc", "a", "b", "c"]) == pytest.approx(3.0)
    assert moments.mutual_information(df, "nb", ["a"]) == pytest.approx(0.31127812445913294)
    assert moments.mutual_information(df, "nc", ["a", "b", "c"]) == pytest.approx(1.0)


def test_series(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(10)], "_row long, x double")
    e = series.lag_embed(df, 2).orderBy("_row").collect()
    assert len(e) == 8 and e[0]["x"] == 4.0 and e[0]["x:1"] == 1.0 and e[0]["x:2"] == 0.0
    assert [r.x for r in series.difference(df, 2).orderBy("_row").collect()] == [2.0] * 8
    assert abs(series.standardize(df).agg(F.avg("x")).first()[0]) < 1e-12
    assert series.shift(df.withColumn("y", F.col("x")), [0, 3]).count() == 7


def test_ols(rows):
    f = regression.ols(rows, "y", ["x", "z"])
    data = np.array([r[1:4] for r in rows.collect()], float)
    a = np.column_stack([np.ones(500), data[:, 0], data[:, 2]])
    b = np.linalg.lstsq(a, data[:, 1], rcond=None)[0]
    assert np.allclose(f.coefficients, b)
    s2 = ((data[:, 1] - a @ b) ** 2).sum() / 497
    assert np.allclose(f.errors, np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * s2)) and f.p[1] < 1e-6


def test_logistic(spark):
    g = np.random.default_rng(4)
    x = g.standard_normal(4000)
    y = (g.random(4000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(int)
    f = regression.logistic(spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int"), "y", ["x"])
    assert f.coefficients[0] == pytest.approx([0.5, 1.5], abs=0.2)


def test_cox_against_brute_force(spark):
    g = np.random.default_rng(5)
    x = g.standard_normal(60)
    t = np.ceil(g.exponential(1 / np.exp(0.8 * x)) * 4)
    e = (g.random(60) < 0.7).astype(int)
    fit = regression.cox(spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, x)], "t double, e int, x double"), "t", "e", ["x"], tolerance=1e-8)

    def ll(b):
        out = 0.0
        for u in np.unique(t):
            d = (t == u) & (e == 1)
            m = d.sum()
            out += b * x[d].sum() - sum(np.log(np.exp(b * x[t >= u]).sum() - k / m * np.exp(b * x[d]).sum()) for k in range(m))
        return out

    grid = np.linspace(-1, 3, 4001)
    best = grid[np.argmax([ll(b) for b in grid])]
    assert fit.coefficients[0] == pytest.approx(best, abs=2e-3)


def test_discretization(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.5, 5.0, 10.0, float("inf"), float("-inf"), float("nan"), None)], "x double")
    got = [r.k for r in preparation.discretize(df, "x", [2.5, 5.0], "k").collect()]
    assert got == [0, 0, 1, 2, 2, 2, 2, None, None]
    assert preparation.count_cutoffs(spark.range(10).select(F.col("id").cast("double").alias("x")), "x", 3) == [3.0, 6.0]


def test_imputation(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (1, None, "b"), (2, 3.0, None), (3, 8.0, "b")], "_row long, x double, s string")
    assert [r.x for r in preparation.impute_mean(df).orderBy("_row").collect()] == [1.0, 4.0, 3.0, 8.0]
    filled = preparation.impute_mode(df).orderBy("_row").collect()
    assert [r.x for r in filled] == [1.0, 3.0, 3.0, 8.0] and [r.s for r in filled] == ["a", "b", "b", "b"]
    assert preparation.impute_random(df, ["x", "s"], 1).filter("x is null or s is null").count() == 0
    y = spark.createDataFrame([(float(i), 2.0 * i + 1 if i != 3 else None) for i in range(8)], "x double, y double")
    assert {round(r.y, 6) for r in preparation.impute_regression(y).collect()} == {2.0 * i + 1 for i in range(8)}


def test_resampling(spark):
    df = spark.range(23).withColumnRenamed("id", "_row").withColumn("v", F.col("_row") * 2)
    b = preparation.bootstrap(df, 50, 1, 2)
    assert b.count() == 100 and {r.replicate for r in b.collect()} == {0, 1}
    sizes = sorted(r["count"] for r in preparation.folds(df, 5, 1).groupBy("fold").count().collect())
    assert sizes == [4, 4, 5, 5, 5]
    s = preparation.subsample(df, 7, 3, 2)
    assert s.count() == 14 and s.select("replicate", "_row").distinct().count() == 14
    assert preparation.subsample_size(10000) == 1000 and preparation.subsample_size(40) == 30
