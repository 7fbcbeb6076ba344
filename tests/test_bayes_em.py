"""EM over distinct rows on the executors, and structural EM, against enumeration."""

from itertools import product

import numpy as np
import pytest

from causeway.operators import tables
from causeway.plans import bayes_em, graphs

SIZES = {"a": 2, "b": 3, "c": 2, "d": 2}
SPEC = "a-->c,b-->c,c-->d"


def _rows(n=300, seed=1, gaps=0.25):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2, n), rng.integers(0, 3, n)
    c = np.where(rng.random(n) < 0.85, (a + (b == 2)) % 2, rng.integers(0, 2, n))
    d = np.where(rng.random(n) < 0.8, c, 1 - c)
    out = np.column_stack([a, b, c, d])
    hide = rng.random(out.shape) < gaps
    return [tuple(None if h else int(v) for v, h in zip(row, hides)) for row, hides in zip(out, hide)]


def _enumerated(rows, net, families):
    nodes, counts, loss = list(net.graph.nodes), {f: np.zeros((int(np.prod([SIZES[p] for p in f[1]] or [1])), SIZES[f[0]])) for f in families}, 0.0
    for row in rows:
        held = dict(zip("abcd", row))
        free = [n for n in nodes if held[n] is None]
        full = [{**held, **dict(zip(free, v))} for v in product(*[range(SIZES[n]) for n in free])]
        p = np.array([net.probability(x) for x in full])
        loss += np.log(p.sum())
        for x, w in zip(full, p / p.sum()):
            for n, parents in families:
                at = 0
                for v in parents:
                    at = at * SIZES[v] + x[v]
                counts[n, parents][at, x[n]] += w
    return counts, loss


@pytest.mark.parametrize("most", [4096, 3])
def test_expected_counts(spark, monkeypatch, most):
    monkeypatch.setattr(bayes_em, "COMPLETIONS", most)
    monkeypatch.setattr(bayes_em, "CHUNK", 7)
    rows = _rows(120)
    net = bayes_em.starting_net(graphs.from_spec(SPEC), SIZES, 4)
    held = bayes_em.distinct_rows(spark.createDataFrame(rows, "a int, b int, c int, d int"), list(net.graph.nodes))
    families = [("c", ("a", "b")), ("d", ()), ("a", ("d",)), ("b", ("c", "d"))]
    counts, loss = bayes_em.expected_counts(held, net, families)
    wanted, wanted_loss = _enumerated(rows, net, families)
    assert loss == pytest.approx(wanted_loss)
    for f in families:
        assert np.allclose(counts[f], wanted[f])


def test_em_is_a_maximum(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    net = bayes_em.em(df, graphs.from_spec(SPEC), SIZES, steps=200, tolerance=1e-7)
    families = [(n, tuple(net.parents(n))) for n in net.graph.nodes]
    counts, best = _enumerated(rows, net, families)
    for n, parents in families:
        assert np.allclose(net.tables[n], bayes_em._normalized(counts[n, parents]), atol=1e-4)
    rng = np.random.default_rng(0)
    for _ in range(10):
        other = bayes_em.BayesNet(net.graph, net.categories, {n: bayes_em._normalized(np.clip(t + rng.normal(scale=0.02, size=t.shape), 1e-6, None)) for n, t in net.tables.items()})
        assert _enumerated(rows, other, families)[1] <= best + 1e-6


def test_complete_and_empty_tables(spark):
    rows = _rows(gaps=0.0)
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    net = bayes_em.em(df, graphs.from_spec(SPEC), SIZES)
    at = net.row("c", {"a": 1, "b": 2})
    own = [r[2] for r in rows if r[:2] == (1, 2)]
    assert net.tables["c"][at, 1] == pytest.approx(sum(own) / len(own))
    none = bayes_em.em(df.limit(0), graphs.from_spec(SPEC), SIZES)
    assert np.allclose(none.tables["c"], 0.5)


def test_structural_em(spark):
    df = spark.createDataFrame(_rows(4000, 5, 0.15), "a int, b int, c int, d int")
    net, history = bayes_em.structural_em(df, SIZES)
    assert {frozenset(e[:2]) for e in net.graph.edges()} == {frozenset(x) for x in ("ac", "bc", "cd")}
    assert net.graph.directed("a", "c") and net.graph.directed("b", "c")
    assert all(y >= x - 5 for x, y in zip(history, history[1:]))
    again = bayes_em.structural_em(df, SIZES, net.graph, rounds=2)[0]
    assert set(again.graph.edges()) == set(net.graph.edges())


def test_categories_are_bounded(spark):
    df = spark.range(50).selectExpr("id % 7 as v", "id as w")
    assert tables.categories(df, "v") == list(range(7))
    with pytest.raises(ValueError, match="more than 40"):
        tables.categories(df, "w", 40)
