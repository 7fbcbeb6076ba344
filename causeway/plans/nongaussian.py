"""Searches that use non-Gaussian shape: ICA, LiNGAM, cyclic models, pairwise and skew orientation.

``fast_ica_table`` and ``ling`` take whole tables; ``lingam``, ``fang`` and ``orient_pairwise`` bounded samples of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.statistics import known
from causeway.operators.moments import covariance_matrix
from causeway.operators.scratch import drop, stored
from causeway.operators.tables import uniform
from causeway.plans.graphs import Graph

#: Rows of a sample.
SAMPLE_ROWS = 20_000


def sample_rows(df: DataFrame, columns: list[str], rows: int = SAMPLE_ROWS, seed: int = 42) -> np.ndarray:
    """At most ``rows`` complete rows, those with the smallest draws; the draw depends on the values."""
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).dropna()
    top = data.withColumn("__u", uniform(seed, *[F.col(f"`{c}`") for c in columns])).orderBy("__u").limit(rows).drop("__u").toArrow()
    return np.column_stack([top.column(c).to_numpy() for c in columns])


def fast_ica(x: np.ndarray, seed: int = 42, steps: int = 500, tolerance: float = 1e-7) -> np.ndarray:
    """The unmixing matrix of centred columns, by symmetric fixed-point steps with log-cosh contrast."""
    x = x - x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    white = vectors @ np.diag(1 / np.sqrt(values)) @ vectors.T
    z = x @ white
    w = np.random.default_rng(seed).standard_normal((x.shape[1],) * 2)

    def decorrelate(m: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(m)
        return u @ v

    w = decorrelate(w)
    for _ in range(steps):
        t = np.tanh(z @ w.T)
        new = decorrelate(t.T @ z / len(z) - np.diag((1 - t * t).mean(0)) @ w)
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < tolerance
        w = new
        if done:
            break
    return w @ white


def fast_ica_table(df: DataFrame, columns: list[str], seed: int = 42, steps: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """``fast_ica`` over all complete rows: each step is one pass of partial sums over a stored table."""
    rows = stored(df.select(*[known(f"`{c}`").alias(f"x{i}") for i, c in enumerate(columns)]).dropna(), "ica-rows")
    cov = covariance_matrix(rows, rows.columns)
    row = rows.agg(*[F.avg(c).alias(c) for c in rows.columns]).first()
    means, p = np.array([row[c] for c in rows.columns]), len(columns)
    values, vectors = np.linalg.eigh(cov.matrix)
    if values[0] <= 1e-12 * values[-1]:
        raise ValueError("linearly dependent columns")
    white = vectors @ np.diag(1 / np.sqrt(values)) @ vectors.T
    arrow = pa.schema([("i", pa.int32()), ("v", pa.float64())])

    def step(w: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, slope = np.zeros((p, p)), np.zeros(p)
            for b in batches:
                z = (np.column_stack([c.to_numpy() for c in b.columns]) - means) @ white
                t = np.tanh(z @ w.T)
                total += t.T @ z
                slope += (1 - t * t).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * p + p), pa.int32()), pa.array(np.concatenate([total.ravel(), slope]))], schema=arrow)

        out = np.zeros(p * p + p)
        for i, v in rows.mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[i] = v / cov.n
        u, _, v = np.linalg.svd(out[: p * p].reshape(p, p) - np.diag(out[p * p :]) @ w)
        return u @ v

    u, _, v = np.linalg.svd(np.random.default_rng(seed).standard_normal((p, p)))
    w = u @ v
    for _ in range(steps):
        new = step(w)
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < tolerance
        w = new
        if done:
            break
    drop(rows)
    return w @ white


@dataclass
class CyclicModel:
    """One of the linear models, cyclic or not, that an unmixing matrix allows: ``coefficients[i, j]`` is the effect of j on i."""

    names: list[str]
    coefficients: np.ndarray
    stable: bool

    def edges(self) -> list[tuple[str, str, float]]:
        i, j = np.nonzero(self.coefficients)
        return sorted((self.names[b], self.names[a], float(self.coefficients[a, b])) for a, b in zip(i.tolist(), j.tolist()))


def cyclic_models(unmixing: np.ndarray, names: list[str], threshold: float = 0.1) -> list[CyclicModel]:
    """All models whose rows are those of the unmixing matrix in some order without a zero on the diagonal.

    Rows are scaled to length 1; entries within ``threshold`` are zeros.  Rows
    are then divided by their diagonal.  A model is stable if all eigenvalues
    of its coefficients lie within the unit circle; where no two cycles meet,
    one model at most is stable.  Stable models come first.
    """
    w = unmixing / np.linalg.norm(unmixing, axis=1, keepdims=True)
    w = np.where(np.abs(w) > threshold, w, 0.0)
    p, out = len(names), []

    def place(taken: list[int]) -> None:
        at = len(taken)
        if at == p:
            rows = w[taken]
            b = np.eye(p) - rows / np.diag(rows)[:, None]
            np.fill_diagonal(b, 0)
            out.append(CyclicModel(list(names), b, bool(np.abs(np.linalg.eigvals(b)).max() < 1)))
            return
        for r in range(p):
            if r not in taken and w[r, at] != 0:
                place([*taken, r])

    place([])
    return sorted(out, key=lambda m: (not m.stable, float(np.abs(m.coefficients).sum())))


def ling(df: DataFrame, columns: list[str], threshold: float = 0.1, seed: int = 42) -> list[CyclicModel]:
    """Linear non-Gaussian models with cycles: independent components of the whole table, then all admissible orders of their rows.

    Scales differ between columns, so components are taken of standardized
    ones; coefficients are given in the columns' own units.
    """
    row = df.agg(*[F.stddev_samp(known(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    sizes = np.array([row[f"s{i}"] for i in range(len(columns))])
    w = fast_ica_table(df.select(*[(known(f"`{c}`") / float(s)).alias(c) for c, s in zip(columns, sizes)]), columns, seed)
    models = cyclic_models(w, columns, threshold)
    for m in models:
        m.coefficients = m.coefficients * sizes[:, None] / sizes[None, :]
    return models


def assignment(cost: np.ndarray) -> list[int]:
    """Hungarian method: for each row the column of the cheapest assignment."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row = match[j]
            free = ~used
            free[0] = False
            reduced = cost[row - 1, :] - u[row] - v[1:]
            better = free[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j
            j1 = int(np.where(free, least, np.inf).argmin())
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = j1
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def lingam(x: np.ndarray, names: list[str], threshold: float = 0.05, seed: int = 42) -> tuple[Graph, np.ndarray]:
    """Linear non-Gaussian acyclic model: ICA, rows permuted to a strong diagonal, an order that makes the rest lower triangular, weak edges dropped."""
    w = fast_ica(x, seed)
    rows = assignment((1 / np.maximum(np.abs(w), 1e-12)).T)
    w = w[rows]
    b = np.eye(len(names)) - w / np.diag(w)[:, None]
    order = _order(b)
    # Regress each variable on those before it.
    x = x - x.mean(0)
    out, coefficients = Graph(names), np.zeros_like(b)
    for k, i in enumerate(order):
        before = order[:k]
        if before:
            c = np.linalg.lstsq(x[:, before], x[:, i], rcond=None)[0]
            for j, v in zip(before, c):
                if abs(v) * x[:, j].std() / x[:, i].std() > threshold:
                    out.orient(names[j], names[i])
                    coefficients[i, j] = v
    return out, coefficients


def _order(b: np.ndarray) -> list[int]:
    """An order with small upper entries: exact for few variables, else by zeroing the smallest entries until it exists."""
    p = len(b)
    if p <= 7:
        return list(min(permutations(range(p)), key=lambda o: sum(b[o[i], o[j]] ** 2 for i in range(p) for j in range(i + 1, p))))
    held = b.copy()
    for k in np.argsort(np.abs(b), axis=None):
        left, order = list(range(p)), []
        while left:
            free = next((i for i in left if all(abs(held[i, j]) < 1e-12 for j in left if j != i)), None)
            if free is None:
                break
            order.append(free)
            left.remove(free)
        if not left:
            return order
        held[np.unravel_index(k, b.shape)] = 0
    return list(range(p))


def orient_pairwise(x: np.ndarray, names: list[str], skeleton: Graph, rule: str = "r3") -> Graph:
    """Directs each edge by the shapes of both variables.

    ``r3``: the direction whose residual and cause are less Gaussian in all.
    ``skew``: the sign of E[x y^2] - E[x^2 y] after making skews positive.
    ``robust_skew``: the same of log-cosh nonlinearities.  ``tanh``: E[x tanh(y) - tanh(x) y].
    """
    z = (x - x.mean(0)) / x.std(0)
    out = skeleton.undirected_copy()
    at = {n: i for i, n in enumerate(names)}
    negentropy = lambda v: (np.log(np.cosh((v - v.mean()) / v.std())).mean() - 0.3746764078432371) ** 2
    for a, b, _, _ in list(out.edges()):
        u, v = z[:, at[a]], z[:, at[b]]
        r = float(np.corrcoef(u, v)[0, 1])
        if rule == "r3":
            forward = negentropy(u) + negentropy(v - r * u)
            back = negentropy(v) + negentropy(u - r * v)
            first = forward > back
        else:
            u, v = u * np.sign((u**3).mean()), v * np.sign((v**3).mean())
            r = float((u * v).mean())
            if rule == "skew":
                first = r * ((u * u * v).mean() - (u * v * v).mean()) > 0
            elif rule == "robust_skew":
                g = lambda t: np.log(np.cosh(np.maximum(t, 0)))
                first = r * ((u * g(v)).mean() - (g(u) * v).mean()) < 0
            else:
                u, v = z[:, at[a]], z[:, at[b]]
                first = r * ((u * np.tanh(v)).mean() - (np.tanh(u) * v).mean()) > 0
        out.orient(*((a, b) if first else (b, a)))
    return out


def fang(x: np.ndarray, names: list[str], alpha: float = 0.05) -> Graph:
    """Adjacency search on correlations, then robust-skew orientation."""
    from causeway.operators.independence import FisherZ
    from causeway.operators.moments import Covariance
    from causeway.plans.search import adjacency_search

    g, _ = adjacency_search(FisherZ(Covariance(list(names), np.cov(x.T), len(x)), alpha))
    return orient_pairwise(x, names, g, "robust_skew")
