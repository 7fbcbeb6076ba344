"""Time-course networks: lag graphs, update functions, simulated histories and searches by mutual information or boolean functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.ordering import lagged
from causeway.operators.tables import ROW


@dataclass
class LagGraph:
    """For each factor its parents, each with a lag of one or more."""

    parents: dict[str, list[tuple[str, int]]] = field(default_factory=dict)

    def add(self, child: str, parent: str, lag: int = 1) -> None:
        if lag < 1:
            raise ValueError("lags start at 1")
        self.parents.setdefault(parent, [])
        held = self.parents.setdefault(child, [])
        if (parent, lag) not in held:
            held.append((parent, lag))

    @property
    def factors(self) -> list[str]:
        return sorted(self.parents)

    @property
    def max_lag(self) -> int:
        return max([k for ps in self.parents.values() for _, k in ps], default=1)

    def to_text(self) -> str:
        return "".join(f"{c} <-- {p}:{k}\n" for c in self.factors for p, k in sorted(self.parents[c]))


def random_lag_graph(factors: int, max_lag: int, indegree: int, seed: int, previous_step: bool = True) -> LagGraph:
    """Each factor depends on its own previous value (if asked for) and on further ones drawn at random."""
    g = np.random.default_rng(seed)
    names = [f"G{i + 1}" for i in range(factors)]
    out = LagGraph({n: [(n, 1)] if previous_step else [] for n in names})
    for n in names:
        while len(out.parents[n]) < min(indegree, factors * max_lag):
            out.add(n, names[int(g.integers(factors))], int(g.integers(1, max_lag + 1)))
    return out


# Update functions: from the parents' values to the next one ------------------------------


@dataclass
class Linear:
    coefficients: list[float]
    intercept: float = 0.0

    def __call__(self, parents: np.ndarray) -> np.ndarray:
        return self.intercept + parents @ np.asarray(self.coefficients)


@dataclass
class Polynomial:
    """A sum of terms: a coefficient and the parents multiplied (with repetition)."""

    terms: list[tuple[float, list[int]]]

    def __call__(self, parents: np.ndarray) -> np.ndarray:
        return sum((c * np.prod(parents[:, at], 1) if at else np.full(len(parents), c) for c, at in self.terms), np.zeros(len(parents)))


@dataclass
class Boolean:
    """A truth table, the first parent being the highest bit."""

    table: list[bool]

    def __call__(self, parents: np.ndarray) -> np.ndarray:
        bits = (parents > 0).astype(int)
        at = bits @ (1 << np.arange(bits.shape[1])[::-1]) if bits.shape[1] else np.zeros(len(parents), int)
        return np.asarray(self.table, float)[at]


@dataclass
class BooleanGlass:
    """own + rate * (-own + regulation), not below a floor; own is the first parent, regulation 1 or -1 by a truth table over the others."""

    table: list[bool]
    rate: float = 0.1
    lower: float = -1.0
    basal: float = 0.0

    def __call__(self, parents: np.ndarray) -> np.ndarray:
        own = parents[:, 0]
        regulation = 2 * Boolean(self.table)(parents[:, 1:] - self.basal) - 1
        return np.maximum(own + self.rate * (-own + regulation), self.lower)


def simulate_histories(spark: SparkSession, graph: LagGraph, functions: dict[str, Callable], steps: int, cells: int, seed: int, noise: float = 0.05, dishes: int = 1, dish_sd: float = 0.0, initial_sd: float = 1.0) -> DataFrame:
    """``(dish, cell, _row, factors...)``: a recurrence of each cell, cells of a dish in one task; a dish has a factor of its own on starting values."""
    names, lag = graph.factors, graph.max_lag

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.random.default_rng([seed, int(key[0])])
        bump = 1 + dish_sd * g.standard_normal()
        history = np.zeros((steps + lag, cells, len(names)))
        history[:lag] = g.standard_normal((cells, len(names))) * initial_sd * bump
        at = {n: i for i, n in enumerate(names)}
        for t in range(lag, steps + lag):
            for n in names:
                parents = np.column_stack([history[t - k, :, at[p]] for p, k in graph.parents[n]]) if graph.parents[n] else np.zeros((cells, 0))
                history[t, :, at[n]] = functions[n](parents) + noise * g.standard_normal(cells)
        out = history[lag:]
        cell = np.tile(np.arange(cells), steps)
        return pd.DataFrame({"dish": int(key[0]), "cell": cell, ROW: np.repeat(np.arange(steps), cells), **{n: out[:, :, i].ravel() for i, n in enumerate(names)}})

    return spark.range(dishes).groupBy("id").applyInPandas(run, f"dish long, cell long, {ROW} long, " + ", ".join(f"{n} double" for n in names))


def measure(histories: DataFrame, factors: list[str], times: list[int], sd: float, seed: int, chips: int = 1) -> DataFrame:
    """Measured data: averages over the cells of a dish at given times, on each chip with an error."""
    means = histories.filter(F.col(ROW).isin(times)).groupBy("dish", ROW).agg(*[F.avg(n).alias(n) for n in factors])
    chip = means.crossJoin(F.broadcast(histories.sparkSession.range(chips).withColumnRenamed("id", "chip")))
    return chip.select("dish", "chip", ROW, *[(F.col(n) + sd * F.randn(seed + i)).alias(n) for i, n in enumerate(factors)])


# Searches -----------------------------------------------------------------------------------


def _joint(df: DataFrame, factors: list[str], lag: int) -> pd.DataFrame:
    """Distinct rows of all factors and their values ``lag`` rows back, with their counts: the statistics of every search here."""
    moved = lagged(df, {f"{n}__{lag}": (n, lag) for n in factors}).filter(F.col(ROW) >= lag)
    return moved.groupBy(*factors, *[f"{n}__{lag}" for n in factors]).agg(F.count("*").alias("n")).toPandas()


def _entropy(counts: pd.DataFrame, columns: list[str]) -> float:
    p = counts.groupby(columns)["n"].sum().to_numpy(float)
    p = p / p.sum()
    return float(-(p * np.log2(p)).sum())


def reveal(df: DataFrame, factors: list[str], max_parents: int = 3, lag: int = 1, tolerance: float = 1e-9) -> dict[str, list[list[str]]]:
    """For each factor the smallest sets of parents ``lag`` rows back whose mutual information equals the factor's entropy."""
    counts, out = _joint(df, factors, lag), {}
    for c in factors:
        own, out[c] = _entropy(counts, [c]), []
        for k in range(1, max_parents + 1):
            for ps in combinations(factors, k):
                cols = [f"{p}__{lag}" for p in ps]
                if own + _entropy(counts, cols) - _entropy(counts, [c, *cols]) >= own - tolerance:
                    out[c].append(list(ps))
            if out[c]:
                break
    return out


def boolean_search(df: DataFrame, factors: list[str], max_parents: int = 2, lag: int = 1, least: float = 1.0) -> dict[str, list[tuple[list[str], list[bool | None], float]]]:
    """For each factor the parents whose best truth table predicts at least a share of the rows: (parents, table, share); None where no row decides."""
    counts, out = _joint(df, factors, lag), {}
    total = counts["n"].sum()
    for c in factors:
        out[c] = []
        for k in range(1, max_parents + 1):
            for ps in combinations(factors, k):
                cols = [f"{p}__{lag}" for p in ps]
                cells = counts.assign(on=np.where(counts[c] > 0, counts["n"], 0)).groupby([*(counts[x] > 0 for x in cols)])[["on", "n"]].sum()
                right = np.maximum(cells["on"], cells["n"] - cells["on"]).sum() / total
                if right >= least:
                    seen = {tuple(map(bool, key if isinstance(key, tuple) else (key,))): bool(2 * r["on"] > r["n"]) for key, r in cells.iterrows()}
                    out[c].append((list(ps), [seen.get(b) for b in product((False, True), repeat=k)], float(right)))
            if out[c]:
                break
    return out


def perturbation_predictors(counts: pd.DataFrame, factors: list[str], max_parents: int = 3) -> dict[str, list[str]]:
    """Smallest sets of factors that differ wherever a factor differs between two rows (hitting sets by size); ``counts`` holds steady states, one row each."""
    out = {}
    for c in factors:
        others = [f for f in factors if f != c]
        pairs = [[f for f in others if a[f] != b[f]] for (_, a), (_, b) in combinations(counts.iterrows(), 2) if a[c] != b[c]]
        out[c] = next((list(s) for k in range(max_parents + 1) for s in combinations(others, k) if all(set(p) & set(s) for p in pairs)), [])
    return out


def revise_by_correlation(edges: dict[tuple[str, str], int], correlation: Callable[[str, str], float], factors: list[str], threshold: float = 0.6) -> dict[tuple[str, str], int]:
    """A regulatory model whose signed edges agree with observed correlations: wrong signs turned, unsupported edges dropped, strong unexplained pairs joined."""
    out = {}
    for (a, b), sign in edges.items():
        r = correlation(a, b)
        if abs(r) >= threshold:
            out[a, b] = int(np.sign(r)) if np.sign(r) != sign else sign
    for a, b in combinations(factors, 2):
        r = correlation(a, b)
        if abs(r) >= threshold and (a, b) not in out and (b, a) not in out:
            explained = any((a, c) in out and (c, b) in out for c in factors)
            if not explained:
                out[a, b] = int(np.sign(r))
    return out
