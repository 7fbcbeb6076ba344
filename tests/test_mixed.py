"""Mixed and survival graphical models: objective against brute force, optimality conditions in SQL, planted pairs."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from causeway.operators.regression import cox
from causeway.plans import mixed

CONTINUOUS, DISCRETE, SURVIVAL = ["a", "b", "c"], ["d", "e"], [mixed.Survival("s", "st", "se"), mixed.Survival("u", "ut", "ue")]
PENALTIES = {"cc": 0.06, "cd": 0.05, "dd": 0.04, "sc": 0.05, "sd": 0.05}


def _table(n=600, seed=4):
    """a - b, a - d, d - e, survival s falls with b and with category 2 of d; u depends on nothing; many ties."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    b, c = a + rng.normal(size=n), 3 + 2 * rng.normal(size=n)
    d = np.where(a + rng.normal(size=n) > 0.5, 2, rng.integers(0, 2, n))
    e = np.where(rng.random(n) < 0.6, d % 2, rng.integers(0, 2, n))
    s = np.ceil(10 * rng.exponential(1 / np.exp(0.7 * b + 0.8 * (d == 2)))).astype(float)
    s[: n // 3] = 4.0
    return pd.DataFrame({"a": a, "b": b, "c": c, "d": d, "e": np.array(["x", "y"])[e], "st": s, "se": (rng.random(n) < 0.7).astype(int), "ut": rng.integers(1, 9, n).astype(float), "ue": (rng.random(n) < 0.5).astype(int)})


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(_table())


def _objective(pdf, layout, v):
    """Every conditional likelihood row by row."""
    x = ((pdf[CONTINUOUS] - pdf[CONTINUOUS].mean()) / pdf[CONTINUOUS].std()).to_numpy()
    codes = [pd.Categorical(pdf[c]).codes for c in DISCRETE]
    d = np.hstack([np.eye(k)[c] for c, k in zip(codes, layout.levels)])
    z, n, loss = np.hstack([np.ones((len(pdf), 1)), x, d]), len(pdf), 0.0
    take = lambda at: np.where(at >= 0, v[at], 0.0)
    for s in range(layout.p):
        b = v[layout.at["precision"][s]]
        mean = z @ take(layout.normal(s)) / b
        loss += (b * (x[:, s] - mean) ** 2 / 2 - np.log(b) / 2).sum() / n
    for j, c in enumerate(codes):
        e = z @ take(layout.softmax(j))
        loss += (np.log(np.exp(e).sum(1)) - e[np.arange(n), c]).sum() / n
    for k, s in enumerate(SURVIVAL):
        eta = z[:, 1:] @ take(layout.cox(k))
        t, dead = pdf[s.time].to_numpy(), pdf[s.event].to_numpy() == 1
        for when in np.unique(t[dead]):
            hit = dead & (t == when)
            risk, m = np.exp(eta[t >= when]).sum(), hit.sum()
            loss += (sum(np.log(risk - i / m * np.exp(eta[hit]).sum()) for i in range(m)) - eta[hit].sum()) / dead.sum()
    return loss


@pytest.mark.parametrize("cell", [7, 100, 20_000])
def test_sums_over_cells(data, monkeypatch, cell):
    monkeypatch.setattr(mixed, "CELL", cell)
    held = mixed.prepare(data, CONTINUOUS, DISCRETE, SURVIVAL)
    rng, pdf = np.random.default_rng(1), _table()
    v = mixed._null(held) + rng.normal(scale=0.1, size=held.layout.size)
    v[held.layout.at["precision"]] = np.abs(v[held.layout.at["precision"]])
    loss, grad, hess = mixed.smooth(held, v)
    assert loss == pytest.approx(_objective(pdf, held.layout, v), rel=1e-9)
    for i in range(len(v)):
        step = np.zeros(len(v))
        step[i] = 1e-5
        slope = (_objective(pdf, held.layout, v + step) - _objective(pdf, held.layout, v - step)) / 2e-5
        assert grad[i] == pytest.approx(slope, abs=2e-6)
    assert np.linalg.eigvalsh(hess).min() > -1e-9


@pytest.mark.parametrize("most", [1, 2, 3])
def test_passes_of_a_step(spark, monkeypatch, most):
    """A step reads all cells twice; a third time only where times lie inside cells, as other cells need no such sums."""
    pdf = _table()
    pdf["st"], pdf["ut"] = np.arange(600) % most + 1.0, 5.0
    held = mixed.prepare(spark.createDataFrame(pdf), CONTINUOUS, DISCRETE, SURVIVAL)
    v, frames, taken = mixed._null(held) + 0.05, type(held.cells), []
    collect = frames.collect
    monkeypatch.setattr(frames, "collect", lambda self: taken.append(1) or collect(self))
    assert mixed.smooth(held, v)[0] == pytest.approx(_objective(pdf, held.layout, v), rel=1e-9)
    assert len(taken) == (2 if most < 3 else 3)


@pytest.mark.parametrize("continuous, discrete", [([], DISCRETE), (CONTINUOUS, []), (["a"], ["k", "e"])])
def test_rows_of_few_and_of_many_combinations(spark, monkeypatch, continuous, discrete):
    """No continuous columns, no discrete ones, nearly as many combinations as rows: all as with indicators row by row."""
    pdf = _table().assign(k=np.arange(600) % 12)
    found = []
    for shared in (0, 10**9):
        monkeypatch.setattr(mixed, "SHARED", shared)
        held = mixed.prepare(spark.createDataFrame(pdf), continuous, discrete, SURVIVAL)
        found.append(mixed.smooth(held, mixed._null(held) + 0.01))
    for a, b in zip(*found):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("risk", [1.0, 1.001, 7.0, 1e6])
@pytest.mark.parametrize("m", [1_001, 40_000])
def test_many_events_of_one_time(risk, m):
    """The closed form is the sum over all events; it takes no longer for a billion of them."""
    dead = 0.3 * m
    wanted = mixed._efron(np.array([risk * dead]), np.array([dead]), np.array([m]))
    assert mixed._efron_of_one(risk * dead, dead, m) == pytest.approx([x[0] for x in wanted], rel=1e-10)
    h, ties, logs = mixed._efron_of_one(4e9, 2e9, 10**9)
    assert (h, ties, logs / 1e9) == pytest.approx((np.log(2) / 2, np.log(2) - 0.5, np.log(4e9) + np.log(2) - 1), rel=1e-6)


def _norms_in_sql(pdf, model):
    """For each pair the length of the gradient of the loss, and of its parameters, from DuckDB on the raw rows."""
    duck, p, q = duckdb.connect(), len(CONTINUOUS), sum(len(x) for x in model.categories.values())
    duck.register("raw", pdf)
    columns = [(f"(({c} - {model.means[c]!r}) / {model.deviations[c]!r})") for c in CONTINUOUS]
    columns += [f"({c} = {x!r})::double" for c in DISCRETE for x in model.categories[c]]
    cut = np.concatenate([[0], np.cumsum([len(model.categories[c]) for c in DISCRETE])])
    duck.sql("create table z as select row_number() over () as r, *, " + ", ".join(f"{c} as z{i}" for i, c in enumerate(columns)) + " from raw")
    linear = lambda w, base=0.0: " + ".join([repr(float(base)), *[f"{float(x)!r} * z{i}" for i, x in enumerate(w) if x]])
    grad = np.zeros(model.layout.size)
    for s in range(p):
        b = float(model.part("precision")[s])
        at = model.layout.normal(s)[1:]
        u = linear(np.where(at >= 0, model.parameters[at], 0), model.part("intercept")[s])
        row = duck.sql("select " + ", ".join(f"avg((({u}) / {b!r} - z{s}) * z{i})" for i in range(p + q)) + " from z").fetchall()[0]
        np.add.at(grad, at[at >= 0], np.array(row)[at >= 0])
    for j, c in enumerate(DISCRETE):
        places = model.layout.softmax(j)
        e = [f"exp({linear(np.where(places[1:, k] >= 0, model.parameters[places[1:, k]], 0), model.part('base')[cut[j] + k])})" for k in range(len(model.categories[c]))]
        for k in range(len(e)):
            row = duck.sql("select " + ", ".join(f"avg(({e[k]} / ({' + '.join(e)}) - z{p + cut[j] + k}) * z{i})" for i in range(p + q)) + " from z").fetchall()[0]
            at = places[1:, k]
            np.add.at(grad, at[at >= 0], np.array(row)[at >= 0])
    for k, s in enumerate(SURVIVAL):
        eta = linear(model.parameters[model.layout.cox(k)])
        sums = ", ".join(f"sum(w * z{i}) as s{i}, sum(w * z{i}) filter (where dead) as d{i}, sum(z{i}) filter (where dead) as h{i}" for i in range(p + q))
        later = ", ".join(f"sum(s{i}) over (order by t desc) as r{i}" for i in range(p + q))
        duck.sql(f"create or replace table t as select t, count(*) filter (where dead) as m, sum(w) as s, sum(w) filter (where dead) as d, {sums} from (select *, {s.time} as t, {s.event} = 1 as dead, exp({eta}) as w from z) group by t")
        each = ", ".join(f"sum((r{i} - l / m * d{i}) / (r - l / m * d)) - sum(case when l = 0 then h{i} else 0 end)" for i in range(p + q))
        row = duck.sql(f"select {each} from (select *, unnest(range(m))::double as l from (select *, sum(s) over (order by t desc) as r, {later} from t) where m > 0)").fetchall()[0]
        grad[model.layout.cox(k)] = np.array(row) / pdf[s.event].sum()
    return [(float(np.linalg.norm(grad[x.at] + (PENALTIES[x.kind] * x.weight * model.parameters[x.at] / model.norm(x) if model.norm(x) else 0))), model.norm(x), PENALTIES[x.kind] * x.weight) for x in model.pairs]


def test_fit_is_optimal_by_sql(data):
    model = mixed.fit(data, CONTINUOUS, DISCRETE, SURVIVAL, PENALTIES)
    assert model.gap < 1e-6 and model.n == 600
    for rest, norm, weight in _norms_in_sql(_table(), model):
        assert rest <= (1e-5 if norm else weight + 1e-5)
    g = model.graph()
    assert g.adjacent("a", "b") and g.adjacent("a", "d") and g.adjacent("d", "e") and g.adjacent("b", "s")
    assert not any(g.adjacent("u", x) for x in [*CONTINUOUS, *DISCRETE]) and not g.adjacent("c", "b")


def test_without_penalty_it_is_cox_regression(spark):
    pdf = _table()
    held = spark.createDataFrame(pdf[["a", "b", "st", "se"]])
    model = mixed.fit(held, ["a", "b"], [], [SURVIVAL[0]], {"cc": 9.0}, tolerance=1e-8)
    wanted = cox(held, "st", "se", ["a", "b"], tolerance=1e-9)
    assert model.part("gamma")[:, 0] / [model.deviations["a"], model.deviations["b"]] == pytest.approx(wanted.coefficients, abs=1e-5)


def test_without_survival(spark, data):
    model = mixed.fit(data, CONTINUOUS, DISCRETE, None, PENALTIES)
    found = {(x.a, x.b) for x in model.pairs if model.norm(x) > 0}
    assert {("a", "b"), ("a", "d"), ("d", "e")} <= found and not any("c" in x for x in found)
    assert model.gap < 1e-6


def test_priors_scale_single_pairs(data):
    none = {("b", "a"): float("inf"), ("c", "d"): 0.0}
    model = mixed.fit(data, CONTINUOUS, DISCRETE, None, PENALTIES, priors=none)
    norm = {(x.a, x.b): model.norm(x) for x in model.pairs}
    plain = mixed.fit(data, CONTINUOUS, DISCRETE, None, PENALTIES)
    assert norm["a", "b"] == 0 < next(plain.norm(x) for x in plain.pairs if (x.a, x.b) == ("a", "b"))
    assert norm["c", "d"] > 0 and model.gap < 1e-6
    with pytest.raises(ValueError, match="no such pair: a - q"):
        mixed.fit(data, CONTINUOUS, DISCRETE, None, PENALTIES, priors={("a", "q"): 1.0})


def test_entry_penalties(data):
    """A pair is out of the model at its penalty and in just below, if no other pair is in."""
    found = {(a, b): (kind, x) for a, b, kind, x in mixed.entry_penalties(data, CONTINUOUS, DISCRETE, SURVIVAL)}
    pdf = _table()
    assert found["a", "b"][1] == pytest.approx(2 * abs(np.corrcoef(pdf.a, pdf.b)[0, 1]) * 599 / 600, rel=1e-9)
    kind, most = found["b", "s"]
    others = {k: 99.0 for k in mixed.KINDS if k != kind}
    above = mixed.fit(data, ["b"], [], [SURVIVAL[0]], {**others, kind: most * 1.001})
    below = mixed.fit(data, ["b"], [], [SURVIVAL[0]], {**others, kind: most * 0.999})
    assert above.norm(above.pairs[-1]) == 0 < below.norm(below.pairs[-1])


def test_odd_tables(spark):
    schema = "a double, d string, st double, se int"
    with pytest.raises(ValueError, match="no complete row"):
        mixed.fit(spark.createDataFrame([(None, "x", 1.0, 1)], schema), ["a"], ["d"])
    with pytest.raises(ValueError, match="constant"):
        mixed.fit(spark.createDataFrame([(1.0, "x", 1.0, 1)] * 3, schema), ["a"], ["d"])
    with pytest.raises(ValueError, match="negative"):
        mixed.fit(spark.createDataFrame([(1.0, "x", -1.0, 1), (2.0, "y", 1.0, 1)], schema), ["a"], ["d"], [mixed.Survival("s", "st", "se")])
    none = mixed.fit(spark.createDataFrame([(float(i), "xy"[i % 2], float(i % 5), 0) for i in range(40)], schema), ["a"], ["d"], [mixed.Survival("s", "st", "se")], {k: 0.1 for k in mixed.KINDS})
    assert none.part("gamma").tolist() == [[0.0]]
