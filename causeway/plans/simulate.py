"""Random graphs, and data drawn from them on the executors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.distributions import sample
from causeway.operators.tables import ROW, uniform
from causeway.plans.graphs import Graph

# Graphs -----------------------------------------------------------------------------


def _shuffled(n: int, g: np.random.Generator) -> Iterator[int]:
    """The numbers below ``n`` in a random order, each once; memory grows with how many are taken."""
    moved: dict[int, int] = {}
    for left in range(n, 0, -1):
        k = int(g.integers(left))
        yield moved.get(k, k)
        moved[k] = moved.pop(left - 1, left - 1)


def random_forward(nodes: int, edges: int, seed: int, latents: int = 0, max_degree: int = -1, max_in: int = -1, max_out: int = -1, connected: bool = False) -> Graph:
    """A DAG of a number of edges drawn among earlier-to-later pairs, within the limits on degrees."""
    g = np.random.default_rng(seed)
    names = [f"X{i + 1}" for i in range(nodes)]
    out = Graph(names)
    if connected:
        for j in range(1, nodes):
            out.orient(names[int(g.integers(j))], names[j])
    for k in _shuffled(nodes * (nodes - 1) // 2, g):
        if out.number_of_edges() >= edges:
            break
        # The k-th pair i < j, counted by j.
        j = (1 + math.isqrt(8 * k + 1)) // 2
        a, b = names[k - j * (j - 1) // 2], names[j]
        full = lambda n, most, now: 0 <= most <= now(n)
        if out.adjacent(a, b) or full(a, max_degree, out.degree) or full(b, max_degree, out.degree) or full(b, max_in, out.indegree) or full(a, max_out, out.outdegree):
            continue
        out.orient(a, b)
    out.latent = {names[i] for i in g.choice(nodes, latents, replace=False)} if latents else set()
    return out


def random_forward_distributed(spark: SparkSession, nodes: int, edges: int, seed: int) -> DataFrame:
    """Edges ``(i, j)``, i < j, of a large sparse DAG: distinct draws, made on the executors."""
    draws = spark.range(2 * edges + 100).select(F.floor(uniform(seed, F.lit("a"), F.col("id")) * nodes).alias("a"), F.floor(uniform(seed, F.lit("b"), F.col("id")) * nodes).alias("b"), uniform(seed, F.lit("u"), F.col("id")).alias("u"))
    return draws.filter("a != b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "u").groupBy("i", "j").agg(F.min("u").alias("u")).orderBy("u", "i", "j").limit(edges).select("i", "j")


def scale_free(nodes: int, seed: int, per_node: int = 2) -> Graph:
    """Each new node gets edges from earlier ones, drawn in proportion to their degree plus one."""
    g = np.random.default_rng(seed)
    names = [f"X{i + 1}" for i in range(nodes)]
    out = Graph(names)
    for j in range(1, nodes):
        w = np.array([out.degree(n) + 1.0 for n in names[:j]])
        for i in g.choice(j, min(per_node, j), replace=False, p=w / w.sum()):
            out.orient(names[int(i)], names[j])
    return out


def random_cyclic(nodes: int, edges: int, seed: int) -> Graph:
    """Directed edges between random pairs; cycles may arise."""
    g = np.random.default_rng(seed)
    names = [f"X{i + 1}" for i in range(nodes)]
    out = Graph(names)
    while out.number_of_edges() < min(edges, nodes * (nodes - 1) // 2):
        i, j = g.choice(nodes, 2, replace=False)
        if not out.adjacent(names[i], names[j]):
            out.orient(names[i], names[j])
    return out


def multiple_indicator(factors: int, indicators: int, edges: int, seed: int) -> Graph:
    """Latent factors with a random DAG among them, each with indicators of its own."""
    structure = random_forward(factors, edges, seed).rename({f"X{i + 1}": f"L{i + 1}" for i in range(factors)})
    out = structure.copy()
    out.latent = set(structure.nodes)
    k = 0
    for f in structure.nodes:
        for _ in range(indicators):
            k += 1
            out.add_node(f"X{k}")
            out.orient(f, f"X{k}")
    return out


def bipartite(left: int, right: int, edges: int, seed: int) -> Graph:
    g = np.random.default_rng(seed)
    names = [f"L{i + 1}" for i in range(left)] + [f"R{i + 1}" for i in range(right)]
    out = Graph(names)
    for k in g.permutation(left * right)[:edges]:
        out.orient(names[k // right], names[left + k % right])
    return out


# Data -------------------------------------------------------------------------------


@dataclass
class LinearModel:
    """Structural equations: coefficients by edge, error variances by node, means."""

    graph: Graph
    coefficients: dict[tuple[str, str], float]
    variances: dict[str, float]
    means: dict[str, float]

    def implied_covariance(self) -> np.ndarray:
        at = {n: i for i, n in enumerate(self.graph.nodes)}
        b = np.zeros((len(at), len(at)))
        for (x, y), w in self.coefficients.items():
            b[at[y], at[x]] = w
        inverse = np.linalg.inv(np.eye(len(at)) - b)
        return inverse @ np.diag([self.variances[n] for n in self.graph.nodes]) @ inverse.T


def linear_model(graph: Graph, seed: int, low: float = 0.2, high: float = 0.9, variance: tuple[float, float] = (1.0, 3.0), symmetric: bool = True) -> LinearModel:
    """Random coefficients of either sign and error variances."""
    g = np.random.default_rng(seed)
    coefficients = {}
    for a, b, _, _ in graph.edges():
        x, y = (a, b) if graph.directed(a, b) else (b, a)
        coefficients[x, y] = float(g.uniform(low, high) * (g.choice([-1, 1]) if symmetric else 1))
    return LinearModel(graph, coefficients, {n: float(g.uniform(*variance)) for n in graph.nodes}, dict.fromkeys(graph.nodes, 0.0))


def _errors(graph: Graph, rows: DataFrame, seed: int, kind: str, variances: dict[str, float]) -> DataFrame:
    """A column of errors for each node."""
    out = []
    for i, n in enumerate(graph.nodes):
        s = float(np.sqrt(variances[n]))
        if kind == "normal":
            e = F.randn(seed + i) * s
        elif kind == "uniform":
            e = (F.rand(seed + i) - 0.5) * (s * float(np.sqrt(12)))
        elif kind == "exponential":
            e = (-F.log(1 - F.rand(seed + i)) - 1) * s
        elif kind == "gamma":
            e = (sample("gamma", seed + i, 2.0) - 2) * (s / float(np.sqrt(2)))
        else:
            raise ValueError(kind)
        out.append(e.alias(f"__e{i}"))
    return rows.select(ROW, *out)


def simulate_linear(spark: SparkSession, model: LinearModel, n: int, seed: int, errors: str = "normal", latent: bool = False) -> DataFrame:
    """Rows of a linear model; a cyclic one is solved for its equilibrium.  Latent columns are left out unless asked for."""
    g = model.graph
    order = g.causal_order()
    rows = spark.range(n).withColumnRenamed("id", ROW)
    out = _errors(g, rows, seed, errors, model.variances)
    at = {x: i for i, x in enumerate(g.nodes)}
    if order is not None:
        for x in order:
            value: Column = F.col(f"__e{at[x]}") + model.means[x]
            for p in g.parents(x):
                value = value + model.coefficients[p, x] * (F.col(p) - model.means[p])
            out = out.withColumn(x, value)
    else:
        b = np.zeros((len(at), len(at)))
        for (x, y), w in model.coefficients.items():
            b[at[y], at[x]] = w
        solve = np.linalg.inv(np.eye(len(at)) - b)
        out = out.select(ROW, *[sum((F.lit(float(solve[i, j])) * F.col(f"__e{j}") for j in range(len(at))), F.lit(model.means[x])).alias(x) for x, i in at.items()])
    return out.select(ROW, *[x for x in g.nodes if latent or x not in g.latent])


def simulate_nonlinear(spark: SparkSession, model: LinearModel, n: int, seed: int, f: str = "tanh") -> DataFrame:
    """As the linear model, with a function of each weighed parent."""
    shape = {"tanh": F.tanh, "sin": F.sin, "square": lambda c: c * c}[f]
    out = _errors(model.graph, spark.range(n).withColumnRenamed("id", ROW), seed, "normal", model.variances)
    at = {x: i for i, x in enumerate(model.graph.nodes)}
    for x in model.graph.causal_order():
        value: Column = F.col(f"__e{at[x]}")
        for p in model.graph.parents(x):
            value = value + shape(F.lit(model.coefficients[p, x]) * F.col(p))
        out = out.withColumn(x, value)
    return out.select(ROW, *[x for x in model.graph.nodes if x not in model.graph.latent])


def simulate_time_series(spark: SparkSession, coefficients: np.ndarray, n: int, seed: int, series: int = 1) -> DataFrame:
    """Vector autoregressions of order one, one task for each series (``series`` id)."""
    p = len(coefficients)
    names = [f"X{i + 1}" for i in range(p)]

    def run(key, pdf):
        import pandas as pd

        g = np.random.default_rng([seed, int(key[0])])
        x, out = np.zeros(p), np.zeros((n, p))
        for t in range(n):
            x = coefficients @ x + g.standard_normal(p)
            out[t] = x
        return pd.DataFrame({"series": int(key[0]), ROW: np.arange(n), **{c: out[:, i] for i, c in enumerate(names)}})

    return spark.range(series).groupBy("id").applyInPandas(run, f"series long, {ROW} long, " + ", ".join(f"{c} double" for c in names))


def simulate_mixed(spark: SparkSession, graph: Graph, n: int, seed: int, discrete_share: float = 0.5, categories: int = 3) -> DataFrame:
    """Continuous nodes linear in their parents' values or codes; discrete ones drawn from a softmax of theirs."""
    g = np.random.default_rng(seed)
    discrete = {x for x in graph.nodes if g.random() < discrete_share}
    out = spark.range(n).withColumnRenamed("id", ROW)
    for i, x in enumerate(graph.causal_order()):
        parents = graph.parents(x)
        weights = {p: g.uniform(0.5, 1.5, categories) * g.choice([-1, 1], categories) for p in parents}
        if x in discrete:
            shares = [F.exp(sum((F.lit(float(weights[p][k])) * F.col(p) for p in parents), F.lit(0.0))) for k in range(categories)]
            total = sum(shares[1:], shares[0])
            u = uniform(seed + i, F.lit(x), F.col(ROW))
            seen, value = F.lit(0.0), F.lit(0)
            for s in shares[:-1]:
                seen = seen + s / total
                value = value + (u >= seen).cast("int")
            out = out.withColumn(x, value.cast("int"))
        else:
            out = out.withColumn(x, F.randn(seed + i) + sum((F.lit(float(weights[p][0])) * F.col(p) for p in parents), F.lit(0.0)))
    return out.select(ROW, *graph.nodes)


def simulate_censored(spark: SparkSession, n: int, seed: int, effects: list[float], censoring: float = 0.5) -> DataFrame:
    """Exponential survival times with log-hazards linear in normal covariates, and exponential censoring."""
    out = spark.range(n).withColumnRenamed("id", ROW)
    for i in range(len(effects)):
        out = out.withColumn(f"X{i + 1}", F.randn(seed + i))
    risk = F.exp(sum((F.lit(b) * F.col(f"X{i + 1}") for i, b in enumerate(effects)), F.lit(0.0)))
    out = out.withColumn("__t", -F.log(1 - uniform(seed, F.lit("t"), F.col(ROW))) / risk).withColumn("__c", -F.log(1 - uniform(seed, F.lit("c"), F.col(ROW))) / censoring)
    return out.withColumn("survival", F.least("__t", "__c")).withColumn("event", (F.col("__t") <= F.col("__c")).cast("int")).drop("__t", "__c")
