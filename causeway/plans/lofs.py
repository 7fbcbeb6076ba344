"""Orientation by non-Gaussian residuals on whole tables: regressions from one covariance, all residuals' shapes in one job.

A candidate is a variable with a set of parents.  Its residual is a linear
form of the columns, whose coefficients follow from the covariance matrix; a
score says how far the residual is from normal.  Scores that are means (skew,
kurtosis, log-cosh ...) are partial sums; the Anderson-Darling statistic needs
each residual's order, which is cut into buckets of about equal size, counted
and summed within them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.distributions import normal_cdf
from causeway.functions.statistics import known
from causeway.operators.moments import Covariance, covariance_matrix
from causeway.plans.graphs import TAIL, Graph

#: Buckets of one residual's order: so many at least, and rows of one.
LEAST_BUCKETS, BUCKET_ROWS = 8, 400_000
#: Sampled rows for each bucket, from which the buckets' bounds are taken.
SAMPLED = 50
#: Values of the columns that a task orders at a time.
CHUNK_VALUES = 1 << 21
#: Probabilities stay this far from 0 and 1.
EDGE = 1e-300


@dataclass(frozen=True)
class Candidate:
    """A variable and the parents that it is regressed on."""

    name: str
    parents: tuple[str, ...] = ()


def _forms(cov: Covariance, means: np.ndarray, candidates: list[Candidate]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (a column for each candidate) and offsets of standardized residuals."""
    weights = np.zeros((len(cov.names), len(candidates)))
    for k, c in enumerate(candidates):
        y, x = cov.index(c.name), [cov.index(p) for p in c.parents]
        weights[y, k] = 1
        if x:
            weights[x, k] = -np.linalg.lstsq(cov.matrix[np.ix_(x, x)], cov.matrix[x, y], rcond=None)[0]
    spread = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", weights, cov.matrix, weights), 0))
    weights = weights / np.where(spread > 0, spread, np.inf)
    return weights, -means @ weights


def _prepared(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Covariance, np.ndarray]:
    rows = df.select(*[known(f"`{c}`").alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    cov = covariance_matrix(rows, rows.columns)
    row = rows.agg(*[F.avg(c).alias(c) for c in rows.columns]).first()
    return rows, Covariance(list(columns), cov.matrix, cov.n), np.array([row[c] or 0.0 for c in rows.columns])


def _cuts(rows: DataFrame, weights: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Values (a row for each candidate) that cut each residual's order into buckets, from a sample of the rows: they only balance the buckets."""
    buckets = max(LEAST_BUCKETS, -(-n // BUCKET_ROWS))
    share = SAMPLED * buckets / max(n, 1)
    found = (rows if share >= 1 else rows.sample(share, 42)).toArrow()
    if not found.num_rows:
        return np.zeros((weights.shape[1], 0))
    v = np.column_stack([c.to_numpy() for c in found.columns]) @ weights + offsets
    return np.quantile(v, np.arange(1, buckets) / buckets, axis=0).T


def _runs(v: np.ndarray, m: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and their numbers (each value ``m`` times, or once)."""
    if m is None:
        v = np.sort(v)
    else:
        order = np.argsort(v)
        v, m = v[order], m[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return v[first], np.diff([*first, len(v)]) if m is None else np.add.reduceat(m, first)


def anderson_darling(df: DataFrame, columns: list[str], candidates: list[Candidate]) -> dict[Candidate, float]:
    """``A^2 (1 + 0.75 / n + 2.25 / n^2)`` of each candidate's residual, all in one job over the complete rows.

    Tasks order their residuals in chunks and cut them at the buckets' bounds,
    so what is shuffled are arrays of values, with numbers where values repeat;
    a bucket puts its arrays together.  A residual without spread has the
    statistic 0.
    """
    rows, cov, means = _prepared(df, columns)
    weights, offsets = _forms(cov, means, candidates)
    n, cuts = cov.n, _cuts(rows, weights, offsets, cov.n)
    chunk = max(10_000, CHUNK_VALUES // len(columns))
    parts = pa.schema([("k", pa.int32()), ("b", pa.int32()), ("v", pa.binary()), ("m", pa.binary())])

    def cut(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(held)
        for k in range(weights.shape[1]):
            v, m = _runs(np.round(x @ weights[:, k] + offsets[k], 12), None)
            at = [0, *np.searchsorted(v, cuts[k]), len(v)]
            full = [(b, i, j) for b, (i, j) in enumerate(zip(at, at[1:])) if j > i]
            numbers = [None if (m[i:j] == 1).all() else m[i:j].tobytes() for _, i, j in full]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(full), pa.int32()), pa.array([b for b, _, _ in full], pa.int32()), pa.array([v[i:j].tobytes() for _, i, j in full], pa.binary()), pa.array(numbers, pa.binary())], schema=parts)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
                size += batch.num_rows
            if size >= chunk:
                yield from cut(held)
                held, size = [], 0
        if held:
            yield from cut(held)

    def terms(table: pa.Table) -> pa.Table:
        v = [np.frombuffer(x.as_buffer()) for x in table.column("v")]
        m = [np.frombuffer(x.as_buffer(), np.int64) if x.is_valid else None for x in table.column("m")]
        once = all(x is None for x in m)
        v, m = _runs(np.concatenate(v), None if once else np.concatenate([np.ones(len(a), np.int64) if x is None else x for a, x in zip(v, m)]))
        own, far = (np.cumsum(m) - m).astype(float), np.maximum(normal_cdf(-np.abs(v)), EDGE)
        near = np.log1p(-far)
        low, high = np.where(v < 0, np.log(far), near) * m, np.where(v < 0, near, np.log(far)) * m
        # Places own + 1 ... own + m of the bucket: the sums of 2 i - 1 and of 2 (n - i) + 1; what lies before the bucket moves them by twice its number.
        inner = float((low * (2 * own + m) + high * (2 * (n - own) - m)).sum())
        return pa.table({"k": table.column("k")[:1].cast(pa.int32()), "b": table.column("b")[:1].cast(pa.int32()), "n": [int(m.sum())], "s": [inner], "t": [float((low - high).sum())]})

    # A row for each residual and bucket.
    sums = rows.mapInArrow(ordered, "k int, b int, v binary, m binary").groupBy("k", "b").applyInArrow(terms, "k int, b int, n long, s double, t double")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = {r.k: r.s for r in sums.select("k", (F.col("s") + 2.0 * before * F.col("t")).alias("s")).groupBy("k").agg(F.sum("s").alias("s")).collect()}
    flat = np.all(weights == 0, axis=0)
    return {c: 0.0 if flat[k] else float((-n - found[k] / n) * (1 + 0.75 / n + 2.25 / n**2)) for k, c in enumerate(candidates)}


#: Distances from a normal variable's mean, for scores that are means of a function of the standardized residual.
MEANS = {
    "skew": lambda v: v**3,
    "kurtosis": lambda v: v**4 - 3,
    "fifth": lambda v: v**5,
    "absolute": lambda v: np.abs(v) - np.sqrt(2 / np.pi),
    "exp": lambda v: np.exp(-(v**2) / 2) - np.sqrt(0.5),
    "logcosh": lambda v: np.log(np.cosh(v)) - 0.3745672075,
}


def mean_scores(df: DataFrame, columns: list[str], candidates: list[Candidate], score: str) -> dict[Candidate, float]:
    """The absolute mean distance of each candidate's residual, all in one pass."""
    rows, cov, means = _prepared(df, columns)
    weights, offsets = _forms(cov, means, candidates)
    of, schema = MEANS[score], pa.schema([("k", pa.int32()), ("s", pa.float64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weights.shape[1])
        for batch in batches:
            total += of(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) @ weights + offsets).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], schema=schema)

    found = {r.k: r.s for r in rows.mapInArrow(partial, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    return {c: abs(found.get(k, 0.0)) / max(cov.n, 1) for k, c in enumerate(candidates)}


def scores(df: DataFrame, columns: list[str], candidates: list[Candidate], score: str = "ad") -> dict[Candidate, float]:
    """Distances from normality of the candidates' residuals by one score: ``ad`` or a name in ``MEANS``."""
    wanted = list(dict.fromkeys(candidates))
    return anderson_darling(df, columns, wanted) if score == "ad" else mean_scores(df, columns, wanted, score)


def _subsets(names: list[str]) -> list[tuple[str, ...]]:
    return list(chain.from_iterable(combinations(names, k) for k in range(len(names) + 1)))


def rule1(df: DataFrame, skeleton: Graph, score: str = "ad", depth: int = 8) -> Graph:
    """Each variable's parents are the set of neighbours whose residual is farthest from normal; of ties the first, smaller sets first.

    Edges that neither end chooses stay undirected; both ways are a two-cycle.
    A variable with more neighbours than ``depth`` is refused: it has 2 ** neighbours candidates.
    """
    names = list(skeleton.nodes)
    near = {n: sorted(skeleton.neighbours(n)) for n in names}
    if crowded := [n for n in names if len(near[n]) > depth]:
        raise ValueError(f"more than {depth} neighbours: {', '.join(crowded)}")
    sets = {n: [Candidate(n, p) for p in _subsets(near[n])] for n in names if near[n]}
    found = scores(df, names, list(chain.from_iterable(sets.values())), score)
    chosen = {n: max(cs, key=lambda c: found[c]).parents for n, cs in sets.items()}
    return _directed(skeleton, chosen)


def _directed(skeleton: Graph, parents: dict[str, tuple[str, ...]]) -> Graph:
    out = Graph(list(skeleton.nodes))
    for a, b, _, _ in skeleton.edges():
        into_b, into_a = a in parents.get(b, ()), b in parents.get(a, ())
        if into_b:
            out.orient(a, b)
        elif into_a:
            out.orient(b, a)
        else:
            out.add(a, b, TAIL, TAIL)
    return out


def two_cycles(skeleton: Graph, parents: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """Edges that both ends choose."""
    return [(a, b) for a, b, _, _ in skeleton.edges() if a in parents.get(b, ()) and b in parents.get(a, ())]


def rule2(df: DataFrame, skeleton: Graph, score: str = "ad", depth: int = 6) -> Graph:
    """Each edge by itself: over all other parents that either end may have, the direction with the larger sum of both ends' scores."""
    names = list(skeleton.nodes)
    near = {n: sorted(skeleton.neighbours(n)) for n in names}
    if crowded := [n for n in names if len(near[n]) > depth]:
        raise ValueError(f"more than {depth} neighbours: {', '.join(crowded)}")
    wanted = [Candidate(n, p) for n in names for p in _subsets(near[n])]
    found, out = scores(df, names, wanted, score), Graph(names)
    for a, b, _, _ in skeleton.edges():

        def best(x: str, y: str) -> float:
            """x a parent of y, y none of x."""
            into = max(found[Candidate(y, p)] for p in _subsets(near[y]) if x in p)
            return into + max(found[Candidate(x, p)] for p in _subsets(near[x]) if y not in p)

        out.orient(*((a, b) if best(a, b) >= best(b, a) else (b, a)))
    return out


def rule3(df: DataFrame, skeleton: Graph, score: str = "ad") -> Graph:
    """Each edge by its two variables alone: x before y if regressing y on x gains more than the other way."""
    edges = [(a, b) for a, b, _, _ in skeleton.edges()]
    found = scores(df, list(skeleton.nodes), [c for a, b in edges for c in (Candidate(a), Candidate(b), Candidate(a, (b,)), Candidate(b, (a,)))], score)
    out = Graph(list(skeleton.nodes))
    for a, b in edges:
        gain_b, gain_a = found[Candidate(b, (a,))] - found[Candidate(b)], found[Candidate(a, (b,))] - found[Candidate(a)]
        out.orient(*((a, b) if gain_b > gain_a else (b, a)))
    return out
