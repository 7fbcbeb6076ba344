"""Decomposable scores: ``local(i, parents)`` for the variable with number i; higher is better."""

from __future__ import annotations

from math import lgamma

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.statistics import known
from causeway.operators.independence import ChiSquare
from causeway.operators.moments import Covariance, covariance_matrix
from causeway.operators.regression import logistic
from causeway.operators.tables import categories, kind


class Score:
    """Base with a cache of local scores."""

    def __init__(self, names: list[str]) -> None:
        self.names = list(names)
        self._cache: dict[tuple[int, tuple[int, ...]], float] = {}

    def compute(self, i: int, parents: tuple[int, ...]) -> float:
        raise NotImplementedError

    def local(self, i: int, parents: list[int]) -> float:
        key = i, tuple(sorted(parents))
        if key not in self._cache:
            self._cache[key] = float(self.compute(*key))
        return self._cache[key]

    def difference(self, x: int, y: int, z: list[int]) -> float:
        """What the edge x to y adds to y's score given parents z."""
        return self.local(y, [*z, x]) - self.local(y, z)

    def total(self, parents: dict[int, list[int]]) -> float:
        return sum(self.local(i, p) for i, p in parents.items())


def sem_bic(cov: Covariance, i: int, parents: list[int], penalty: float = 2.0, floor: float = 0.0) -> float:
    """-n ln s2 - penalty k ln n, with k = 2p + 1 and the residual variance times n / (n - k)."""
    m, n, k = cov.matrix, cov.n, 2 * len(parents) + 1
    s2 = m[i, i]
    if parents:
        at = list(parents)
        b = m[at, i]
        s2 = s2 - b @ np.linalg.pinv(m[np.ix_(at, at)]) @ b
    s2 = max(s2 * n / max(n - k, 1), floor)
    return float("-inf") if s2 <= 0 else float(-n * np.log(s2) - penalty * k * np.log(n))


class SemBic(Score):
    """Gaussian BIC from a covariance matrix; ``floor`` bounds residual variances where parents determine a variable."""

    def __init__(self, cov: Covariance, penalty: float = 2.0, floor: float = 0.0) -> None:
        super().__init__(cov.names)
        self.cov, self.penalty, self.floor = cov, penalty, floor

    def compute(self, i, parents):
        return sem_bic(self.cov, i, list(parents), self.penalty, self.floor)


class CountScore(Score):
    """Base of scores on counts of codes."""

    def __init__(self, chi: ChiSquare) -> None:
        super().__init__(chi.names)
        self.chi = chi
        self.sizes = [len(chi.counts((c,))) for c in chi.names]

    def cells(self, i: int, parents: tuple[int, ...]) -> tuple[dict[tuple, dict], int]:
        rows = self.chi.counts((self.names[i], *[self.names[p] for p in parents]))
        out: dict[tuple, dict] = {}
        for v, *key, n in rows:
            out.setdefault(tuple(key), {})[v] = n
        return out, int(np.prod([self.sizes[p] for p in parents], dtype=float)) if parents else 1


class BDeu(CountScore):
    """Bayesian Dirichlet score with equivalent uniform priors and a structure prior on the number of parents."""

    def __init__(self, chi: ChiSquare, sample_prior: float = 1.0, structure_prior: float = 1.0) -> None:
        super().__init__(chi)
        self.sample_prior, self.structure_prior = sample_prior, structure_prior

    def compute(self, i, parents):
        cells, r = self.cells(i, parents)
        c = self.sizes[i]
        row, cell = self.sample_prior / r, self.sample_prior / (r * c)
        out = self._prior(len(parents))
        for counts in cells.values():
            out += lgamma(row) - lgamma(row + sum(counts.values())) + sum(lgamma(cell + n) - lgamma(cell) for n in counts.values())
        return out

    def _prior(self, k: int) -> float:
        p = len(self.names) - 1
        if self.structure_prior <= 0 or p < 1:
            return 0.0
        e = min(self.structure_prior / p, 0.999)
        return k * np.log(e) + (p - k) * np.log(1 - e)


class BDe(CountScore):
    """Bayesian Dirichlet score with a pseudo-count of 1 in every cell (K2's prior)."""

    def __init__(self, chi: ChiSquare, pseudo: float = 1.0) -> None:
        super().__init__(chi)
        self.pseudo = pseudo

    def compute(self, i, parents):
        cells, _ = self.cells(i, parents)
        c, a = self.sizes[i], self.pseudo
        return sum(lgamma(a * c) - lgamma(a * c + sum(n.values())) + sum(lgamma(a + k) - lgamma(a) for k in n.values()) for n in cells.values())


class DiscreteBic(CountScore):
    """Multinomial log-likelihood less a penalty on free parameters."""

    def __init__(self, chi: ChiSquare, penalty: float = 1.0) -> None:
        super().__init__(chi)
        self.penalty = penalty

    def compute(self, i, parents):
        cells, r = self.cells(i, parents)
        ll, n = 0.0, 0
        for counts in cells.values():
            total = sum(counts.values())
            n += total
            ll += sum(k * np.log(k / total) for k in counts.values())
        return 2 * ll - self.penalty * r * (self.sizes[i] - 1) * np.log(n)


class ConditionalGaussian(Score):
    """Mixed BIC: a Gaussian of the continuous variables for each combination of discrete ones.

    The statistics of a set (counts and sums of products by combination) come
    from one grouped aggregation and are kept.  Combinations of few rows use
    the pooled covariance.
    """

    def __init__(self, df: DataFrame, columns: list[str], penalty: float = 1.0) -> None:
        super().__init__(columns)
        self.df, self.penalty = df.select(*columns).dropna(), penalty
        self.kinds = [kind(df, c) for c in columns]
        self._stats: dict[tuple[int, ...], tuple[float, int]] = {}
        self.n = self.df.count()

    def _likelihood(self, at: tuple[int, ...]) -> tuple[float, int]:
        """Log-likelihood and degrees of freedom of the joint distribution of some variables."""
        if at in self._stats:
            return self._stats[at]
        disc = [self.names[i] for i in at if self.kinds[i] == "discrete"]
        cont = [self.names[i] for i in at if self.kinds[i] == "continuous"]
        p = len(cont)
        sums = [F.sum(known(a) * known(b)).alias(f"q{i}_{j}") for i, a in enumerate(cont) for j, b in enumerate(cont) if i <= j]
        rows = self.df.groupBy(*disc).agg(F.count("*").alias("n"), *[F.sum(known(a)).alias(f"s{i}") for i, a in enumerate(cont)], *sums).collect()
        ll, groups = 0.0, []
        for r in rows:
            if disc:
                ll += r.n * np.log(r.n / self.n)
            if p:
                q = np.zeros((p, p))
                for i in range(p):
                    for j in range(i, p):
                        q[i, j] = q[j, i] = r[f"q{i}_{j}"]
                s = np.array([r[f"s{i}"] for i in range(p)])
                groups.append((r.n, q - np.outer(s, s) / r.n))
        if p:
            pooled = sum(g for _, g in groups) / max(self.n, 1)
            for n, scatter in groups:
                sigma = scatter / n if n > p + 5 else pooled
                sign, logdet = np.linalg.slogdet(sigma)
                logdet = logdet if sign > 0 else np.linalg.slogdet(pooled + 1e-9 * np.eye(p))[1]
                ll += -n / 2 * (logdet + p * np.log(2 * np.pi) + p)
        k = len(rows) if disc else 1
        out = float(ll), (k - 1 if disc else 0) + k * (p * (p + 1) // 2 + p)
        self._stats[at] = out
        return out

    def compute(self, i, parents):
        whole, df = self._likelihood(tuple(sorted({i, *parents})))
        rest, df_rest = self._likelihood(tuple(sorted(parents))) if parents else (0.0, 0)
        return 2 * (whole - rest) - self.penalty * (df - df_rest) * np.log(self.n)


class MixedPolynomial(Score):
    """Mixed BIC of polynomial regressions within each combination of discrete parents; discrete children by their indicators."""

    def __init__(self, df: DataFrame, columns: list[str], degree: int = 3, penalty: float = 1.0) -> None:
        super().__init__(columns)
        self.df, self.degree, self.penalty = df.select(*columns).dropna(), degree, penalty
        self.kinds = [kind(df, c) for c in columns]

    def compute(self, i, parents):
        disc = [self.names[p] for p in parents if self.kinds[p] == "discrete"]
        cont = [self.names[p] for p in parents if self.kinds[p] == "continuous"]
        terms = [F.pow(known(c), F.lit(d)) for c in cont for d in range(1, self.degree + 1)]
        if self.kinds[i] == "continuous":
            targets = [known(self.names[i])]
        else:
            values = categories(self.df, self.names[i])
            targets = [(F.col(self.names[i]) == F.lit(v)).cast("double") for v in values[1:]] or [F.lit(0.0)]
        x = [F.lit(1.0), *terms]
        k = len(x)
        aggs = [F.sum(x[a] * x[b]).alias(f"q{a}_{b}") for a in range(k) for b in range(a, k)]
        for t, y in enumerate(targets):
            aggs += [F.sum(x[a] * y).alias(f"r{t}_{a}") for a in range(k)] + [F.sum(y * y).alias(f"y{t}")]
        ll = dof = 0.0
        total = 0
        for r in self.df.groupBy(*disc).agg(F.count("*").alias("n"), *aggs).collect():
            q = np.zeros((k, k))
            for a in range(k):
                for b in range(a, k):
                    q[a, b] = q[b, a] = r[f"q{a}_{b}"]
            total += r.n
            for t in range(len(targets)):
                v = np.array([r[f"r{t}_{a}"] for a in range(k)])
                rss = max(r[f"y{t}"] - v @ np.linalg.pinv(q) @ v, 1e-9)
                ll += -r.n / 2 * (np.log(2 * np.pi * rss / r.n) + 1)
                dof += min(k, r.n) + 1
        return 2 * ll - self.penalty * dof * np.log(max(total, 2))


class MixedBic(Score):
    """Logistic BIC of a discrete variable and linear BIC of a continuous one; discrete parents count by their codes (places in sorted order)."""

    def __init__(self, df: DataFrame, columns: list[str], penalty: float = 4.0) -> None:
        super().__init__(columns)
        rows = df.select(*columns).dropna()
        # A row for each category; the classes of the logistic regressions, so few.
        self.categories = {c: sorted(r[0] for r in rows.select(c).distinct().collect()) for c in columns if kind(df, c) == "discrete"}
        codes = {c: F.array_position(F.array(*[F.lit(v) for v in vs]), F.col(c)) - 1 for c, vs in self.categories.items()}
        self.df = rows.select(*[codes.get(c, F.col(c)).cast("double").alias(c) for c in columns])
        self.penalty, self.cov = penalty, covariance_matrix(self.df, columns)

    def compute(self, i, parents):
        name, n = self.names[i], self.cov.n
        if name not in self.categories:
            return sem_bic(self.cov, i, list(parents), self.penalty)
        classes = len(self.categories[name])
        ll = logistic(self.df, name, [self.names[p] for p in parents]).log_likelihood if classes > 1 else 0.0
        return 2 * ll - self.penalty * (classes - 1) * (len(parents) + 1) * np.log(n)


class GraphScore(Score):
    """Oracle from a known graph: an edge gains 1 where the two are d-connected given the parents, else loses 1."""

    def __init__(self, graph) -> None:
        super().__init__(graph.nodes)
        self.graph = graph

    def difference(self, x, y, z):
        from causeway.plans.graphs import d_separated

        return -1.0 if d_separated(self.graph, self.names[x], self.names[y], {self.names[i] for i in z}) else 1.0

    def compute(self, i, parents):
        out, held = 0.0, []
        for p in parents:
            out += self.difference(p, i, held)
            held.append(p)
        return out


class SumOfScores(Score):
    """Several data sets on the same variables, their scores averaged."""

    def __init__(self, scores: list[Score]) -> None:
        super().__init__(scores[0].names)
        self.scores = scores

    def compute(self, i, parents):
        return float(np.mean([s.local(i, list(parents)) for s in self.scores]))
