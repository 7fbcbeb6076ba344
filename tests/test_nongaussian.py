"""Orientation by residual shapes, independent components of whole tables, cyclic models."""

from itertools import permutations

import numpy as np
import pandas as pd
import pytest

from causeway.functions.distributions import normal_cdf
from causeway.plans import graphs, lofs, nongaussian

COLUMNS = ["a", "b", "c", "d"]


def _frame(n=4000, seed=1):
    """a -> c <- b, c -> d with uniform errors; b has ties."""
    rng = np.random.default_rng(seed)
    u = lambda: rng.uniform(-1, 1, n)
    a, b = u(), np.round(2 * u())
    c = a + b + u()
    return pd.DataFrame({"a": a, "b": b, "c": c, "d": 0.8 * c + u()})


def _statistic(v):
    """Row by row."""
    z, n = np.sort((v - v.mean()) / v.std(ddof=1)), len(v)
    i = np.arange(1, n + 1)
    a = -n - ((2 * i - 1) * (np.log(normal_cdf(z)) + np.log(normal_cdf(-z[::-1])))).sum() / n
    return a * (1 + 0.75 / n + 2.25 / n**2)


def _residual(pdf, y, x):
    m = np.column_stack([np.ones(len(pdf)), pdf[list(x)]])
    return pdf[y].to_numpy() - m @ np.linalg.lstsq(m, pdf[y], rcond=None)[0]


def test_scores_row_by_row(spark):
    pdf = _frame(700)
    held = spark.createDataFrame(pdf).repartition(5)
    wanted = [lofs.Candidate("a"), lofs.Candidate("b"), lofs.Candidate("c", ("a", "b")), lofs.Candidate("d", ("c",)), lofs.Candidate("a", ("c", "d"))]
    found = lofs.scores(held, COLUMNS, [*wanted, wanted[0]])
    assert set(found) == set(wanted)
    for c in wanted:
        v = _residual(pdf, c.name, c.parents)
        assert found[c] == pytest.approx(_statistic(v), rel=1e-6)
        z = v / v.std(ddof=1)
        for name, of in lofs.MEANS.items():
            if c is wanted[2]:
                assert lofs.scores(held, COLUMNS, [c], name)[c] == pytest.approx(abs(of(z).mean()), abs=1e-9)


def test_order_over_chunks_and_buckets(spark, monkeypatch):
    # Residuals travel as arrays, cut at bounds that follow the data: a heavy tail and many ties fill buckets evenly, and nothing depends on the cuts.
    monkeypatch.setattr(lofs, "BUCKET_ROWS", 500)
    monkeypatch.setattr(lofs, "CHUNK_VALUES", 1)
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.exponential(1, 30_000) ** 2, "b": rng.integers(0, 3, 30_000).astype(float)})
    pdf["c"] = pdf.b + rng.uniform(-1, 1, 30_000)
    held = spark.createDataFrame(pdf).coalesce(1)
    wanted = [lofs.Candidate("a"), lofs.Candidate("b"), lofs.Candidate("c", ("b",))]
    found = lofs.scores(held, list("abc"), wanted)
    for c in wanted:
        assert found[c] == pytest.approx(_statistic(_residual(pdf, c.name, c.parents)), rel=1e-9)


def test_residuals_without_spread(spark):
    pdf = pd.DataFrame({"a": np.arange(50.0), "b": 2 * np.arange(50.0) + 1, "c": [5.0] * 50})
    found = lofs.scores(spark.createDataFrame(pdf), ["a", "b", "c"], [lofs.Candidate("c"), lofs.Candidate("a")])
    assert found[lofs.Candidate("c")] == 0 and found[lofs.Candidate("a")] > 0


@pytest.mark.parametrize("score", ["ad", "kurtosis", "logcosh"])
def test_rules(spark, score):
    held, skeleton = spark.createDataFrame(_frame(20_000)), graphs.from_spec("a---c,b---c,c---d")
    for rule in (lofs.rule1, lofs.rule2, lofs.rule3):
        g = rule(held, skeleton, score)
        assert g.directed("a", "c") and g.directed("b", "c") and g.directed("c", "d"), rule
    with pytest.raises(ValueError, match="neighbours: c"):
        lofs.rule1(held, skeleton, depth=2)


def test_two_cycles():
    skeleton = graphs.from_spec("a---b,b---c")
    assert lofs.two_cycles(skeleton, {"a": ("b",), "b": ("a", "c"), "c": ()}) == [("a", "b")]


def test_components_of_whole_tables(spark):
    rng = np.random.default_rng(5)
    mix = np.array([[1, 0.5, 0], [0.2, 1, 0.4], [0, 0.3, 1]])
    x = rng.uniform(-1, 1, (20_000, 3)) @ mix.T
    w = nongaussian.fast_ica_table(spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))), list("abc"))
    shape = np.abs(w @ mix)
    shape /= shape.max(1, keepdims=True)
    assert sorted(shape.argmax(1)) == [0, 1, 2] and np.sort(shape, 1)[:, :2].max() < 0.05
    with pytest.raises(ValueError, match="dependent"):
        nongaussian.fast_ica_table(spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": 2 * x[:, 0]})), ["a", "b"])


def test_cyclic_models_are_all_admissible_orders():
    rng = np.random.default_rng(2)
    for _ in range(20):
        w = np.where(rng.random((4, 4)) < 0.6, rng.normal(size=(4, 4)), 0) + np.diag(rng.normal(size=4))
        scaled = w / np.linalg.norm(w, axis=1, keepdims=True)
        scaled = np.where(np.abs(scaled) > 0.1, scaled, 0)
        wanted = [o for o in permutations(range(4)) if all(scaled[r, i] for i, r in enumerate(o))]
        models = nongaussian.cyclic_models(w, list("abcd"))
        assert len(models) == len(wanted)
        for m in models:
            b = m.coefficients
            assert m.stable == bool(np.abs(np.linalg.eigvals(b)).max() < 1) and np.allclose(np.diag(b), 0)
            rows = np.eye(4) - b
            assert any(np.allclose(rows, scaled[list(o)] / np.diag(scaled[list(o)])[:, None]) for o in wanted)


def test_a_planted_cycle(spark):
    rng = np.random.default_rng(9)
    b = np.zeros((3, 3))
    b[1, 0], b[2, 1], b[0, 2] = 0.8, 0.7, -0.9
    x = rng.uniform(-1, 1, (30_000, 3)) * [1, 10, 0.1] @ np.linalg.inv(np.eye(3) - b).T
    models = nongaussian.ling(spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))), list("abc"), 0.02)
    first = {(u, v): w for u, v, w in models[0].edges()}
    assert models[0].stable and {("a", "b"), ("b", "c")} <= set(first) and first["a", "b"] == pytest.approx(0.8, abs=0.5)
