"""Discrete Bayes nets: estimation from counts, drawing, and updating.  ``bayes_em`` estimates with missing values."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import tables
from causeway.operators.moments import contingency
from causeway.operators.tables import ROW, uniform
from causeway.plans.graphs import Graph

#: A table with more rows is refused.
MOST_ROWS = 1_000_000


@dataclass
class BayesNet:
    """A DAG, each node's categories, and a table (parents' combinations x categories) for each node; parents in sorted order."""

    graph: Graph
    categories: dict[str, list]
    tables: dict[str, np.ndarray]

    def parents(self, n: str) -> list[str]:
        return self.graph.parents(n)

    def row(self, n: str, codes: dict[str, int]) -> int:
        out = 0
        for p in self.parents(n):
            out = out * len(self.categories[p]) + codes[p]
        return out

    def probability(self, codes: dict[str, int]) -> float:
        """Of a full assignment."""
        return float(np.prod([self.tables[n][self.row(n, codes), codes[n]] for n in self.graph.nodes]))


def _rows(graph: Graph, categories: dict[str, list], n: str) -> int:
    rows = int(np.prod([len(categories[p]) for p in graph.parents(n)], dtype=float)) if graph.parents(n) else 1
    if rows > MOST_ROWS:
        raise ValueError(f"the table of {n} has {rows} rows")
    return rows


def estimate(df: DataFrame, graph: Graph, pseudo: float = 0.0) -> BayesNet:
    """Maximum likelihood, or with a pseudo-count in each cell the mean of a Dirichlet posterior; rows without cases are uniform."""
    categories = {n: tables.categories(df, n) for n in graph.nodes}
    net = BayesNet(graph, categories, {})
    for n in graph.nodes:
        parents = graph.parents(n)
        table = np.full((_rows(graph, categories, n), len(categories[n])), float(pseudo))
        code = {v: {c: i for i, c in enumerate(categories[v])} for v in [n, *parents]}
        for r in contingency(df, [n, *parents]).collect():
            table[net.row(n, {p: code[p][r[i + 1]] for i, p in enumerate(parents)}), code[n][r[0]]] += r[-1]
        total = table.sum(1, keepdims=True)
        net.tables[n] = np.where(total > 0, table / np.where(total == 0, 1, total), 1 / table.shape[1])
    return net


def random_net(graph: Graph, categories: int, seed: int) -> BayesNet:
    """Uniformly drawn rows of probabilities."""
    g = np.random.default_rng(seed)
    held = {n: list(range(categories)) for n in graph.nodes}
    return BayesNet(graph, held, {n: g.dirichlet(np.ones(categories), _rows(graph, held, n)) for n in graph.nodes})


def simulate(spark: SparkSession, net: BayesNet, n: int, seed: int) -> DataFrame:
    """Rows of category codes; each node by one cumulative lookup on its parents' codes."""
    out = spark.range(n).withColumnRenamed("id", ROW)
    for x in net.graph.causal_order():
        row = F.lit(0)
        for p in net.parents(x):
            row = row * len(net.categories[p]) + F.col(p)
        sums = np.cumsum(net.tables[x], 1)[:, :-1]
        u = uniform(seed, F.lit(x), F.col(ROW))
        value = F.lit(0)
        for k in range(sums.shape[1]):
            value = value + (u >= F.element_at(F.array(*[F.lit(float(v)) for v in sums[:, k]]), row + 1)).cast("int")
        out = out.withColumn(x, value.cast("int"))
    return out.select(ROW, *net.graph.nodes)


def distance(a: BayesNet, b: BayesNet) -> float:
    """Euclidean distance between the tables of two nets with the same graph and categories."""
    if set(a.graph.edges()) != set(b.graph.edges()) or a.categories != b.categories:
        raise ValueError("the nets differ in graph or categories")
    return float(np.sqrt(sum(((a.tables[n] - b.tables[n]) ** 2).sum() for n in a.graph.nodes)))


def log_likelihood(df: DataFrame, net: BayesNet) -> float:
    """Of a table, from one count for each node."""
    total = 0.0
    for n in net.graph.nodes:
        parents = net.parents(n)
        code = {v: {c: i for i, c in enumerate(net.categories[v])} for v in [n, *parents]}
        for r in contingency(df, [n, *parents]).collect():
            p = net.tables[n][net.row(n, {v: code[v][r[i + 1]] for i, v in enumerate(parents)}), code[n][r[0]]]
            total += r[-1] * np.log(max(p, 1e-300))
    return float(total)


def posterior(net: BayesNet, target: str, evidence: dict[str, int] | None = None, do: dict[str, int] | None = None) -> np.ndarray:
    """Distribution of a node given evidence and manipulations, by variable elimination."""
    evidence, do = dict(evidence or {}), dict(do or {})
    factors = []
    for n in net.graph.nodes:
        if n in do:
            t = np.zeros(len(net.categories[n]))
            t[do[n]] = 1.0
            factors.append(([n], t))
            continue
        scope = [*net.parents(n), n]
        factors.append((scope, net.tables[n].reshape([len(net.categories[v]) for v in scope])))
    fixed = {**evidence, **do}
    reduced = []
    for scope, t in factors:
        at = tuple(fixed[v] if v in fixed and v != target else slice(None) for v in scope)
        reduced.append(([v for v in scope if v not in fixed or v == target], t[at]))
    left = [n for n in net.graph.nodes if n != target and n not in fixed]
    while left:
        n = min(left, key=lambda v: len({w for s, _ in reduced if v in s for w in s}))
        left.remove(n)
        scope, t = _product([f for f in reduced if n in f[0]])
        reduced = [f for f in reduced if n not in f[0]]
        reduced.append(([v for v in scope if v != n], t.sum(scope.index(n))))
    scope, t = _product(reduced)
    t = np.asarray(t, float).reshape(-1)
    if target in fixed:
        keep = np.zeros_like(t)
        keep[fixed[target]] = t[fixed[target]]
        t = keep
    return t / t.sum()


def _product(factors: list[tuple[list[str], np.ndarray]]) -> tuple[list[str], np.ndarray]:
    scope = list(dict.fromkeys(v for s, _ in factors for v in s))
    out = np.ones([1] * len(scope))
    for s, t in factors:
        order = sorted(range(len(s)), key=lambda i: scope.index(s[i]))
        shape = [1] * len(scope)
        for i in order:
            shape[scope.index(s[i])] = t.shape[i]
        out = out * np.transpose(t, order).reshape(shape)
    return scope, out


def approximate_posterior(spark: SparkSession, net: BayesNet, target: str, evidence: dict[str, int], draws: int, seed: int) -> np.ndarray:
    """Shares of the target's categories among draws that agree with the evidence."""
    rows = simulate(spark, net, draws, seed)
    for n, v in evidence.items():
        rows = rows.filter(F.col(n) == v)
    out = np.zeros(len(net.categories[target]))
    for r in rows.groupBy(target).count().collect():
        out[r[0]] = r[1]
    return out / max(out.sum(), 1)


def classify(df: DataFrame, net: BayesNet, target: str) -> DataFrame:
    """Rows with the most probable category given all other columns: log-probabilities of the factors around the target."""
    k = len(net.categories[target])
    around = [target, *net.graph.children(target)]
    scored = df
    logs = []
    for c in range(k):
        total = F.lit(0.0)
        for n in around:
            row = F.lit(0)
            for p in net.parents(n):
                row = row * len(net.categories[p]) + (F.lit(c) if p == target else F.col(p))
            value = F.lit(c) if n == target else F.col(n)
            flat = F.array(*[F.lit(float(np.log(max(v, 1e-300)))) for v in net.tables[n].reshape(-1)])
            total = total + F.element_at(flat, (row * len(net.categories[n]) + value + 1).cast("int"))
        logs.append(total)
    best = F.array_position(F.array(*logs), F.array_max(F.array(*logs))) - 1
    return scored.withColumn("predicted", best.cast("int"))


def to_xml(net: BayesNet) -> str:
    root = ET.Element("bayesNet")
    for n in net.graph.nodes:
        e = ET.SubElement(root, "variable", name=n, parents=",".join(net.parents(n)))
        for c in net.categories[n]:
            ET.SubElement(e, "category").text = str(c)
        for row in net.tables[n]:
            ET.SubElement(e, "row").text = " ".join(repr(float(v)) for v in row)
    return ET.tostring(root, encoding="unicode")


def from_xml(text: str) -> BayesNet:
    root = ET.fromstring(text)
    graph = Graph([v.get("name") for v in root.iter("variable")])
    categories, tables = {}, {}
    for v in root.iter("variable"):
        n = v.get("name")
        for p in filter(None, v.get("parents").split(",")):
            graph.orient(p, n)
        categories[n] = [c.text for c in v.iter("category")]
        tables[n] = np.array([[float(x) for x in r.text.split()] for r in v.iter("row")])
    return BayesNet(graph, categories, tables)


def from_xdsl(text: str) -> BayesNet:
    """A network in XDSL: ``cpt`` elements with states, parents and probabilities (parents' states slowest)."""
    root = ET.fromstring(text)
    nodes = list(root.iter("cpt"))
    graph = Graph([n.get("id") for n in nodes])
    categories = {n.get("id"): [s.get("id") for s in n.findall("state")] for n in nodes}
    net = BayesNet(graph, categories, {})
    for n in nodes:
        for p in (n.findtext("parents") or "").split():
            graph.orient(p, n.get("id"))
    for n in nodes:
        name, given = n.get("id"), (n.findtext("parents") or "").split()
        shape = [len(categories[p]) for p in given] + [len(categories[name])]
        table = np.array([float(v) for v in n.findtext("probabilities").split()]).reshape(shape)
        order = [given.index(p) for p in net.parents(name)]
        net.tables[name] = np.transpose(table, [*order, len(given)]).reshape(-1, shape[-1])
    return net
