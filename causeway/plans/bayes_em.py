"""Bayes nets from tables with missing values: expected counts from distinct rows that stay on the executors, and structural EM on them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.scratch import drop, stored
from causeway.operators.scores import Score
from causeway.plans.bayes import BayesNet, _product, _rows
from causeway.plans.graphs import Graph, dag_to_pattern, pattern_to_dag
from causeway.plans.search import fges

#: Completions of one row that are written out; rows with more go by variable elimination.
COMPLETIONS = 4096
#: Completed rows that a task works on at a time.
CHUNK = 1 << 18
#: A family: a node and its parents in sorted order.
Family = tuple[str, tuple[str, ...]]


def distinct_rows(df: DataFrame, nodes: list[str]) -> DataFrame:
    """``(c0, c1 ..., n)``: distinct rows of codes, -1 where missing, with their number; a stored table."""
    codes = [F.coalesce(F.col(f"`{n}`").cast("int"), F.lit(-1)).alias(f"c{i}") for i, n in enumerate(nodes)]
    return stored(df.select(*codes).groupBy(*[f"c{i}" for i in range(len(nodes))]).agg(F.count("*").alias("n")), "bayes-rows")


def _sizes(net: BayesNet) -> dict[str, int]:
    return {n: len(net.categories[n]) for n in net.graph.nodes}


def _index(codes: np.ndarray, at: list[int], sizes: list[int]) -> np.ndarray:
    """The place of each row's codes in a table over some columns."""
    out = np.zeros(len(codes), np.int64)
    for i, k in zip(at, sizes):
        out = out * k + codes[:, i]
    return out


def _completed(codes: np.ndarray, weights: np.ndarray, sizes: list[int], factors: list[tuple[list[int], np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """All completions of rows with the same columns missing, with their expected numbers; and the log likelihood of the rows."""
    free = np.flatnonzero(codes[0] < 0)
    ways = np.array(list(product(*[range(sizes[i]) for i in free])), np.int64)
    step = max(1, CHUNK // len(ways))
    for start in range(0, len(codes), step):
        part = codes[start : start + step]
        full = np.repeat(part, len(ways), axis=0)
        full[:, free] = np.tile(ways, (len(part), 1))
        p = np.ones(len(full))
        for at, table in factors:
            p *= table[_index(full, at, [sizes[i] for i in at])]
        p = p.reshape(len(part), len(ways))
        total = p.sum(1, keepdims=True)
        n = weights[start : start + step]
        share = p / np.maximum(total, 1e-300) * n[:, None]
        yield full, share.ravel(), float((np.log(np.maximum(total[:, 0], 1e-300)) * n).sum())


def _eliminated(row: np.ndarray, names: list[str], factors: list[tuple[list[str], np.ndarray]], scope: list[str]) -> tuple[list[str], np.ndarray]:
    """``(free names of the scope, their joint probabilities with the row's known codes)``, other missing ones summed out."""
    known = {n: int(c) for n, c in zip(names, row) if c >= 0}
    reduced = [([v for v in s if v not in known], t[tuple(known.get(v, slice(None)) for v in s)]) for s, t in factors]
    left = [n for n in names if n not in known and n not in scope]
    while left:
        n = min(left, key=lambda v: len({w for s, _ in reduced if v in s for w in s}))
        left.remove(n)
        s, t = _product([f for f in reduced if n in f[0]])
        reduced = [f for f in reduced if n not in f[0]] + [([v for v in s if v != n], t.sum(s.index(n)))]
    s, t = _product(reduced)
    wanted = [v for v in scope if v not in known]
    return wanted, np.transpose(np.broadcast_to(t, [t.shape[i] for i in range(t.ndim)]), [s.index(v) for v in wanted]) if wanted else np.asarray(t)


def expected_counts(rows: DataFrame, net: BayesNet, families: list[Family]) -> tuple[dict[Family, np.ndarray], float]:
    """Expected numbers of each family's combinations (parents' combinations x categories) under ``net``, and the log likelihood: one pass.

    Each task adds up its own rows.  Missing codes are completed by the net's
    own probabilities, exactly.
    """
    names, sizes_of = list(net.graph.nodes), _sizes(net)
    sizes, place = [sizes_of[n] for n in names], {n: i for i, n in enumerate(names)}
    scopes = [[*parents, n] for n, parents in families]
    lengths = [int(np.prod([sizes_of[v] for v in s])) for s in scopes]
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(int)
    tables = [([*net.parents(n), n], net.tables[n]) for n in names]
    flat = [([place[v] for v in s], t.ravel()) for s, t in tables]
    shaped = [(s, t.reshape([sizes_of[v] for v in s])) for s, t in tables]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(starts[-1] + 1)
        for batch in batches:
            codes = np.column_stack([batch.column(i).to_numpy() for i in range(len(names))]).astype(np.int64)
            weights = batch.column(len(names)).to_numpy().astype(float)
            pattern, which = np.unique(codes < 0, axis=0, return_inverse=True)
            for k, missing in enumerate(pattern):
                own = codes[which.ravel() == k], weights[which.ravel() == k]
                if np.prod([sizes[i] for i in np.flatnonzero(missing)], dtype=float) <= COMPLETIONS:
                    for full, n, loss in _completed(*own, sizes, flat):
                        total[-1] += loss
                        for s, a, size in zip(scopes, starts, lengths):
                            total[a : a + size] += np.bincount(_index(full, [place[v] for v in s], [sizes_of[v] for v in s]), n, size)
                    continue
                for row, n in zip(*own):
                    likelihood = float(_eliminated(row, names, shaped, [])[1])
                    total[-1] += n * np.log(max(likelihood, 1e-300))
                    for s, a, size in zip(scopes, starts, lengths):
                        free, p = _eliminated(row, names, shaped, s)
                        at = tuple(slice(None) if v in free else int(row[place[v]]) for v in s)
                        total[a : a + size].reshape([sizes_of[v] for v in s])[at] += n * p / max(likelihood, 1e-300)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["i", "v"])

    out = np.zeros(starts[-1] + 1)
    for i, v in rows.mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[i] = v
    return {f: out[a : a + size].reshape(-1, sizes_of[f[0]]) for f, a, size in zip(families, starts, lengths)}, float(out[-1])


def _family(net: BayesNet, n: str) -> Family:
    return n, tuple(net.parents(n))


def _normalized(counts: np.ndarray, pseudo: float = 0.0) -> np.ndarray:
    c = counts + pseudo
    total = c.sum(1, keepdims=True)
    return np.where(total > 0, c / np.where(total > 0, total, 1), 1 / c.shape[1])


def fit(rows: DataFrame, net: BayesNet, steps: int = 50, tolerance: float = 1e-6, pseudo: float = 0.0) -> tuple[BayesNet, float]:
    """The net's tables by EM from where they are, and the log likelihood before the last step."""
    families, loss = [_family(net, n) for n in net.graph.nodes], -np.inf
    for _ in range(steps):
        counts, loss = expected_counts(rows, net, families)
        tables = {f[0]: _normalized(counts[f], pseudo) for f in families}
        moved = max(float(np.abs(tables[n] - net.tables[n]).max()) for n in tables)
        net = BayesNet(net.graph, net.categories, tables)
        if moved < tolerance:
            break
    return net, loss


def starting_net(graph: Graph, categories: dict[str, int], seed: int) -> BayesNet:
    """Drawn tables: equal ones would leave hidden nodes where they are."""
    held, g = {n: list(range(categories[n])) for n in graph.nodes}, np.random.default_rng(seed)
    return BayesNet(graph, held, {n: g.dirichlet(np.ones(categories[n]), _rows(graph, held, n)) for n in graph.nodes})


def em(df: DataFrame, graph: Graph, categories: dict[str, int], steps: int = 50, tolerance: float = 1e-6, seed: int = 42, pseudo: float = 0.0) -> BayesNet:
    """Maximum likelihood with missing codes (0, 1, 2 ... or null): expected counts over all distinct rows, one pass a step."""
    rows = distinct_rows(df, list(graph.nodes))
    out = fit(rows, starting_net(graph, categories, seed), steps, tolerance, pseudo)[0]
    drop(rows)
    return out


class ExpectedScore(Score):
    """BIC of families on the counts that a net expects: the expected log likelihood less half a log of the rows for each free parameter.

    A family that isn't known yet is asked for together with those that differ
    from it by one parent, in one pass over the distinct rows.  Families of
    more than ``most_parents`` parents are never chosen.
    """

    def __init__(self, rows: DataFrame, net: BayesNet, n: float, most_parents: int) -> None:
        super().__init__(sorted(net.graph.nodes))
        self.rows, self.net, self.n, self.most = rows, net, n, most_parents

    def compute(self, i: int, parents: tuple[int, ...]) -> float:
        if len(parents) > self.most:
            return -1e18
        others = [j for j in range(len(self.names)) if j != i and j not in parents]
        near = [parents, *[tuple(sorted((*parents, j))) for j in others if len(parents) < self.most], *[tuple(p for p in parents if p != j) for j in parents]]
        new = [x for x in near if (i, x) not in self._cache]
        families = [(self.names[i], tuple(self.names[p] for p in x)) for x in new]
        for x, c in zip(new, expected_counts(self.rows, self.net, families)[0].values()):
            self._cache[i, x] = self._bic(c)
        return self._cache[i, parents]

    def _bic(self, counts: np.ndarray) -> float:
        total = counts.sum(1, keepdims=True)
        share = counts / np.where(total > 0, total, 1)
        likelihood = (counts * np.log(np.where(share > 0, share, 1))).sum()
        return float(likelihood - np.log(max(self.n, 1)) / 2 * counts.shape[0] * (counts.shape[1] - 1))


def structural_em(df: DataFrame, categories: dict[str, int], start: Graph | None = None, most_parents: int = 3, rounds: int = 10, steps: int = 50, tolerance: float = 1e-5, seed: int = 42) -> tuple[BayesNet, list[float]]:
    """A net whose graph, too, is chosen with missing values: ``(net, score of each round's graph)``.

    A round fits the tables of the graph at hand by EM, then searches the
    equivalence classes greedily by scores on the counts that the fitted net
    expects.  Rounds end when the class stays.
    """
    nodes = sorted(categories)
    rows = distinct_rows(df, nodes)
    n = float(rows.agg(F.sum("n")).first()[0] or 0)
    graph = Graph(nodes, start.edges() if start else ())
    net, history = starting_net(graph, categories, seed), []
    for _ in range(rounds):
        net = fit(rows, net, steps, tolerance)[0]
        score = ExpectedScore(rows, net, n, most_parents)
        pattern = fges(score, faithful=False)
        found = pattern_to_dag(pattern)
        if found is None:
            break
        history.append(score.total({score.names.index(v): [score.names.index(x) for x in found.parents(v)] for v in nodes}))
        if dag_to_pattern(net.graph) == pattern:
            break
        graph = Graph(nodes, found.edges())
        counts = expected_counts(rows, net, [(v, tuple(graph.parents(v))) for v in nodes])[0]
        net = BayesNet(graph, net.categories, {f[0]: _normalized(c) for f, c in counts.items()})
    drop(rows)
    return net, history
