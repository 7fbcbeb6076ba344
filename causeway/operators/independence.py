"""Conditional-independence tests.

Each test answers from small sufficient statistics that a Spark job gathered:
a covariance matrix, counts of a contingency table, or fitted likelihoods.  A
test has ``names``, ``alpha``, ``p_value(x, y, z)`` and ``independent``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.distributions import chisq_quantile, chisq_tail, gamma_cdf, normal_cdf, t_cdf
from causeway.operators.count_tree import CountTree
from causeway.operators.moments import Covariance, covariance_matrix, partial_correlation
from causeway.operators.regression import cox, dummies, likelihood_ratio, logistic, ols
from causeway.operators.scratch import drop, stored
from causeway.operators.tables import kind


class IndependenceTest:
    """Base: independent if the p-value exceeds alpha."""

    def __init__(self, names: list[str], alpha: float) -> None:
        self.names, self.alpha = list(names), alpha

    def p_value(self, x: str, y: str, z: list[str]) -> float:
        raise NotImplementedError

    def independent(self, x: str, y: str, z: list[str] = ()) -> bool:
        return self.p_value(x, y, list(z)) > self.alpha

    def determines(self, z: list[str], y: str) -> bool:
        return False


class FisherZ(IndependenceTest):
    """Fisher's transform of the partial correlation."""

    def __init__(self, cov: Covariance, alpha: float = 0.05, generalized: bool = False) -> None:
        super().__init__(cov.names, alpha)
        self.cov, self.generalized = cov, generalized

    def p_value(self, x, y, z):
        r = partial_correlation(self.cov, x, y, z, self.generalized)
        while not np.isfinite(r) and z:  # a singular set: fewer variables
            z = z[:-1]
            r = partial_correlation(self.cov, x, y, z, self.generalized)
        if not np.isfinite(r) or abs(r) >= 1:
            return 0.0
        df = self.cov.n - 3 - len(z)
        return float(2 * (1 - normal_cdf(np.sqrt(max(df, 1)) * abs(np.arctanh(r)))))

    def determines(self, z, y):
        """Whether a variable has hardly any variance left given others."""
        from causeway.operators.moments import partial_variance

        return bool(z) and partial_variance(self.cov, y, list(z)) < 1e-10 * self.cov.matrix[self.cov.index(y), self.cov.index(y)]


class CorrelationT(FisherZ):
    """Student's t of the partial correlation with n - 2 degrees of freedom."""

    def p_value(self, x, y, z):
        r = partial_correlation(self.cov, x, y, z, self.generalized)
        if not np.isfinite(r) or abs(r) >= 1:
            return 0.0
        t = np.sqrt(self.cov.n - 2) * r / np.sqrt(1 - r * r)
        return float(2 * (1 - t_cdf(abs(t), self.cov.n - 2)))


class CramerT(FisherZ):
    """The density of a partial correlation integrated beyond the observed one."""

    def p_value(self, x, y, z):
        r = partial_correlation(self.cov, x, y, z, self.generalized)
        df = self.cov.n - len(z) - 2
        if not np.isfinite(r) or abs(r) >= 1:
            return 0.0
        return float(2 * (1 - t_cdf(abs(r) * np.sqrt(df / (1 - r * r)), df)))


class FullOrderCorrelation(FisherZ):
    """Fisher's Z of the correlation given all other variables, whatever z is."""

    def p_value(self, x, y, z):
        return super().p_value(x, y, [v for v in self.names if v not in (x, y)])


class ChiSquare(IndependenceTest):
    """Pearson's chi-square within each stratum of z, added up; rows and columns without cases don't count.

    ``counts(columns)`` gives a small frame of cell counts with a column ``n``.
    """

    def __init__(self, names: list[str], counts: Callable[[tuple[str, ...]], list[tuple]], alpha: float = 0.05, g_square: bool = False) -> None:
        super().__init__(names, alpha)
        self.counts, self.g_square = lru_cache(maxsize=10_000)(counts), g_square

    @classmethod
    def of(cls, df: DataFrame, columns: list[str], alpha: float = 0.05, g_square: bool = False) -> ChiSquare:
        """From a table: one pass for a tree of counts, which answers for every set of columns."""
        return cls(columns, CountTree(df, columns).counts, alpha, g_square)

    def statistic(self, x: str, y: str, z: list[str]) -> tuple[float, int]:
        strata: dict[tuple, dict[tuple, int]] = {}
        for *key, n in self.counts((x, y, *z)):
            strata.setdefault(tuple(key[2:]), {})[key[0], key[1]] = n
        total, df = 0.0, 0
        for cells in strata.values():
            rows, cols = {}, {}
            for (a, b), n in cells.items():
                rows[a] = rows.get(a, 0) + n
                cols[b] = cols.get(b, 0) + n
            whole = sum(rows.values())
            for a, r in rows.items():
                for b, c in cols.items():
                    o, e = cells.get((a, b), 0), r * c / whole
                    total += 2 * o * np.log(o / e) if self.g_square and o else (0.0 if self.g_square else (o - e) ** 2 / e)
            df += (len(rows) - 1) * (len(cols) - 1)
        return total, df

    def p_value(self, x, y, z):
        chi, df = self.statistic(x, y, z)
        return 1.0 if df == 0 else float(chisq_tail(chi, df))

    def determines(self, z, y, share: float = 1.0):
        """Whether one value of y makes ``share`` of the cases in every stratum of z."""
        strata: dict[tuple, list[int]] = {}
        for _, *key, n in self.counts((y, *z)):
            strata.setdefault(tuple(key), []).append(n)
        return all(max(v) >= share * sum(v) for v in strata.values())


class ScoreTest(IndependenceTest):
    """Independent if a score doesn't gain from the edge."""

    def __init__(self, score) -> None:
        super().__init__(score.names, 0.0)
        self.score = score

    def p_value(self, x, y, z):
        return float(self.difference(x, y, z))

    def difference(self, x, y, z):
        s, i = self.score, self.score.names.index
        return s.local(i(y), sorted([i(x), *map(i, z)])) - s.local(i(y), sorted(map(i, z)))

    def independent(self, x, y, z=()):
        return self.difference(x, y, list(z)) < 0


class DSeparation(IndependenceTest):
    """Answers from a known graph."""

    def __init__(self, graph) -> None:
        super().__init__(graph.nodes, 0.5)
        self.graph = graph

    def p_value(self, x, y, z):
        from causeway.plans.graphs import d_separated

        return 1.0 if d_separated(self.graph, x, y, set(z)) else 0.0


class Facts(IndependenceTest):
    """Answers from a list of independences (x, y, z)."""

    def __init__(self, names: list[str], facts: list[tuple[str, str, tuple[str, ...]]]) -> None:
        super().__init__(names, 0.5)
        self.facts = {(frozenset((x, y)), frozenset(z)) for x, y, z in facts}

    def p_value(self, x, y, z):
        return 1.0 if (frozenset((x, y)), frozenset(z)) in self.facts else 0.0


class Pooled(IndependenceTest):
    """Several tests of the same fact: Fisher's method, the share that finds independence, or all / any of them."""

    def __init__(self, tests: list[IndependenceTest], alpha: float = 0.05, how: str = "fisher") -> None:
        super().__init__(tests[0].names, alpha)
        self.tests, self.how = tests, how

    def p_value(self, x, y, z):
        ps = [t.p_value(x, y, list(z)) for t in self.tests]
        if self.how == "fisher":
            return float(chisq_tail(-2 * np.log(np.maximum(ps, 1e-300)).sum(), 2 * len(ps)))
        if self.how == "percent":
            return float(np.mean([p > t.alpha for p, t in zip(ps, self.tests)]))
        return max(ps) if self.how == "any" else min(ps)


class MixedRegression(IndependenceTest):
    """Likelihood-ratio tests of regressions over continuous, discrete and censored columns.

    Two censored columns are independent.  One of them: Cox regression of it.
    A discrete x: multinomial logistic regression of x.  Only y discrete: linear
    regression of x if ``prefer_linear``, else logistic of y.  Else linear.
    Rows that are complete on x, y and z count.
    """

    def __init__(self, df: DataFrame, columns: list[str], alpha: float = 0.05, prefer_linear: bool = False) -> None:
        super().__init__(columns, alpha)
        self.df, self.prefer_linear = df, prefer_linear
        self.kinds = {c: kind(df, c) for c in columns}

    def p_value(self, x, y, z):
        if self.kinds[x] == self.kinds[y] == "censored":
            return 1.0
        if self.kinds[y] == "censored" or (self.kinds[y] == "discrete" and self.kinds[x] == "continuous" and not self.prefer_linear):
            x, y = y, x
        data = self.df.dropna(subset=[x, y, *z])
        added, held = [], []
        for c, to in [(y, added), *[(c, held) for c in z]]:
            if self.kinds[c] == "censored":
                data = data.withColumn(f"{c}__time", F.col(f"`{c}`.time"))
                to.append(f"{c}__time")
            elif self.kinds[c] == "discrete":
                data, names = dummies(data, c)
                to += names
            else:
                to.append(c)
        if self.kinds[x] == "censored":
            data = data.withColumn("__cw_t", F.col(f"`{x}`.time")).withColumn("__cw_e", F.col(f"`{x}`.event"))
            fit = lambda cols: cox(data, "__cw_t", "__cw_e", cols).log_likelihood if cols else cox(data.withColumn("__cw_0", F.lit(0.0)), "__cw_t", "__cw_e", ["__cw_0"]).log_likelihood
            width = 1
        elif self.kinds[x] == "discrete":
            fit = lambda cols: logistic(data, x, cols).log_likelihood
            width = max(1, data.select(F.col(f"`{x}`")).distinct().count() - 1)
        else:

            def fit(cols):
                f = ols(data, x, cols, generalized=True)
                return -f.n / 2 * np.log(max(f.rss / f.n, 1e-300))

            width = 1
        return likelihood_ratio(fit(held + added), fit(held), width * len(added))[1]


class KernelTest(IndependenceTest):
    """Kernel test of conditional independence on a bounded sample: centred Gaussian kernels, residual kernels given z, gamma approximation of the null."""

    def __init__(self, sample: np.ndarray, names: list[str], alpha: float = 0.05, ridge: float = 1e-3, hsic_draws: int = 0, seed: int = 42) -> None:
        super().__init__(names, alpha)
        self.x = (sample - sample.mean(0)) / sample.std(0)
        self.ridge, self.draws, self.seed = ridge, hsic_draws, seed

    def _kernel(self, cols: list[int], width: float) -> np.ndarray:
        v = self.x[:, cols]
        d = ((v[:, None, :] - v[None, :, :]) ** 2).sum(2)
        return np.exp(-d / (2 * width * width * len(cols)))

    def p_value(self, x, y, z):
        i, j, k = self.names.index(x), self.names.index(y), [self.names.index(c) for c in z]
        n = len(self.x)
        width = 0.8 if n <= 200 else 0.5 if n <= 1200 else 0.3
        h = np.eye(n) - 1 / n
        kx, ky = h @ self._kernel([i, *k], width) @ h, h @ self._kernel([j], width) @ h
        if k:
            kz = h @ self._kernel(k, width) @ h
            r = self.ridge * np.linalg.inv(kz + self.ridge * np.eye(n))
            kx, ky = r @ kx @ r, r @ ky @ r
        stat = float((kx * ky).sum())
        if self.draws:
            g = np.random.default_rng(self.seed)
            null = [float((kx * ky[np.ix_(o, o)]).sum()) for o in (g.permutation(n) for _ in range(self.draws))]
            return (1 + sum(s >= stat for s in null)) / (1 + self.draws)
        mean, var = np.trace(kx) * np.trace(ky) / n, 2 * (kx * kx).sum() * (ky * ky).sum() / n**2
        shape, scale = mean**2 / var, var / mean
        return float(1 - gamma_cdf(shape, max(stat, 0) / scale))


class ConditionalCorrelation(IndependenceTest):
    """Correlation of kernel-regression residuals, on a bounded sample: the smallest Fisher p-value over polynomial bases, corrected for their number."""

    def __init__(self, sample: np.ndarray, names: list[str], alpha: float = 0.05, degree: int = 3) -> None:
        super().__init__(names, alpha)
        self.x, self.degree = (sample - sample.mean(0)) / sample.std(0), degree

    def _residual(self, i: int, k: list[int]) -> np.ndarray:
        v = self.x[:, i]
        if not k:
            return v
        z = self.x[:, k]
        d = ((z[:, None, :] - z[None, :, :]) ** 2).sum(2)
        width = 1.06 * len(v) ** (-1 / (4 + len(k)))
        w = np.exp(-d / (2 * width * width))
        np.fill_diagonal(w, 0)
        return v - (w @ v) / np.maximum(w.sum(1), 1e-12)

    def p_value(self, x, y, z):
        k = [self.names.index(c) for c in z]
        a, b = self._residual(self.names.index(x), k), self._residual(self.names.index(y), k)
        ps = []
        for p in range(1, self.degree + 1):
            for q in range(1, self.degree + 1):
                r = np.corrcoef(a**p, b**q)[0, 1]
                u, v = (a**p - (a**p).mean()) / (a**p).std(), (b**q - (b**q).mean()) / (b**q).std()
                spread = np.sqrt(max((u * u * v * v).mean(), 1e-12))
                ps.append(2 * (1 - normal_cdf(np.sqrt(len(a)) * abs(np.arctanh(np.clip(r, -0.999999, 0.999999))) / spread)))
        return float(min(1.0, min(ps) * len(ps)))


class _WholeTable(IndependenceTest):
    """Base of tests over all complete rows, with kernels as random Fourier features: cosines whose products' mean is a Gaussian kernel.  Sums of products of the features are all that is gathered.

    Rows that are equal in a test's columns are counted first, and their
    features made once.  ``like`` names a test of the same table and columns
    whose counted rows and sums are shared; ``release`` removes them.
    """

    #: Features of the variables tested, and of those conditioned on.
    OWN, GIVEN = 20, 200
    #: Rows whose features are made at a time; they stay in the processor's cache.
    BLOCK = 1_024

    def __init__(self, df: DataFrame, names: list[str], alpha: float = 0.05, seed: int = 42, like: _WholeTable | None = None) -> None:
        super().__init__(names, alpha)
        if like is not None:
            if (like.names, like.seed) != (names, seed):
                raise ValueError("only tests of the same columns and seed share sums")
            self.n, self.seed, self.rows, self.held, self.known = like.n, seed, like.rows, like.held, like.known
            return
        rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(names)]).dropna()
        found = rows.agg(F.count("*"), *[f(F.col(f"v{i}")) for i in range(len(names)) for f in (F.avg, F.stddev_pop)]).first()
        self.n, self.seed = int(found[0]), seed
        self.rows = rows.select(*[((F.col(f"v{i}") - F.lit(found[1 + 2 * i])) / F.lit(found[2 + 2 * i])).alias(f"v{i}") for i in range(len(names))])
        self.held: dict[tuple[int, ...], DataFrame] = {}
        self.known: dict[tuple, np.ndarray] = {}

    def release(self) -> None:
        """Remove the counted rows."""
        while self.held:
            drop(self.held.popitem()[1])

    def _counted(self, cols: list[int]) -> DataFrame:
        """Distinct rows of some columns, with their numbers."""
        at = tuple(sorted(cols))
        if at not in self.held:
            self.held[at] = stored(self.rows.groupBy(*[f"v{i}" for i in at]).agg(F.count("*").cast("double").alias("n")), "counted-rows")
        return self.held[at]

    def _features(self, label: str, cols: list[int], count: int, width: float) -> Callable[[np.ndarray], np.ndarray]:
        g = np.random.default_rng([self.seed, *label.encode(), *cols])
        w, b = g.standard_normal((len(cols), count)) / (width * np.sqrt(len(cols))), g.uniform(0, 2 * np.pi, count)
        return lambda v: np.cos(v[:, cols] @ w + b) * np.sqrt(2 / count)

    def _given(self, k: list[int]) -> Callable[[np.ndarray], np.ndarray]:
        wide, narrow = self._features("z", k, self.GIVEN // 2, 1.0), self._features("w", k, self.GIVEN // 2, 0.3)
        return lambda v: np.hstack([v[:, k], wide(v), narrow(v)])

    def _joint(self, i: int, j: int, k: list[int]) -> np.ndarray:
        """Mean products of 1, x, y, the features of x and of y, and those of z: one pass for both tests."""
        key = (i, j, *k)
        if key not in self.known:
            width = 0.8 if self.n <= 200 else 0.5 if self.n <= 1200 else 0.3
            fx, fy, fz = self._features("x", [i, *k], self.OWN, width), self._features("y", [j], self.OWN, width), self._given(k) if k else None
            self.known[key] = self._sums(lambda v: _ones(v[:, [i, j]], fx(v), fy(v), *([fz(v)] if fz else [])), [i, j, *k])
        return self.known[key]

    def _sums(self, features: Callable[[np.ndarray], np.ndarray], cols: list[int]) -> np.ndarray:
        """Mean products of features of a row, which depend on ``cols``: a partial matrix per task, added up by cell."""
        schema, counted, block, width = pa.schema([("cell", pa.int32()), ("value", pa.float64())]), self._counted(cols), self.BLOCK, len(self.names)
        at = [int(c[1:]) for c in counted.columns[:-1]]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for i in range(0, batch.num_rows, block):
                    part = batch.slice(i, block)
                    v = np.zeros((part.num_rows, width))
                    v[:, at] = np.column_stack([c.to_numpy() for c in part.columns[:-1]])
                    f = features(v)
                    f *= np.sqrt(part.column(len(at)).to_numpy())[:, None]
                    total = f.T @ f if total is None else total + f.T @ f
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], schema=schema)

        cells = counted.mapInArrow(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(cells.num_rows)
        out[cells.column("cell").to_numpy()] = cells.column("value").to_numpy()
        return out.reshape(int(np.sqrt(len(out))), -1) / self.n


def _ones(*parts: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(parts[0]), 1)), *parts])


class WholeKernelTest(_WholeTable):
    """``KernelTest`` over all rows of a table (gamma approximation)."""

    def p_value(self, x, y, z):
        i, j, k = self.names.index(x), self.names.index(y), [self.names.index(c) for c in z]
        d, s = self.OWN, self._joint(i, j, k)
        s = (s[3:, 3:] - np.outer(s[0, 3:], s[0, 3:])) * self.n
        own = s[: 2 * d, : 2 * d]
        if k:
            szz, szo = s[2 * d :, 2 * d :], s[2 * d :, : 2 * d]
            b = np.linalg.solve(szz + 1e-6 * self.n * np.eye(len(szz)), szo)
            own = own - szo.T @ b - b.T @ szo + b.T @ szz @ b
        xx, yy, xy = own[:d, :d], own[d:, d:], own[:d, d:]
        mean, var = np.trace(xx) * np.trace(yy) / self.n, 2 * (xx * xx).sum() * (yy * yy).sum() / self.n**2
        return float(1 - gamma_cdf(mean**2 / var, float((xy * xy).sum()) / (var / mean)))


class WholeConditionalCorrelation(_WholeTable):
    """``ConditionalCorrelation`` over all rows of a table: residuals of ridge regression on the features of z, then their joint moments."""

    def __init__(self, df: DataFrame, names: list[str], alpha: float = 0.05, seed: int = 42, degree: int = 3, like: _WholeTable | None = None) -> None:
        super().__init__(df, names, alpha, seed, like)
        self.degree = degree

    def p_value(self, x, y, z):
        i, j, k = self.names.index(x), self.names.index(y), [self.names.index(c) for c in z]
        fz, top = self._given(k) if k else None, 2 * self.degree
        beta = mean = None
        if k:
            s, own = self._joint(i, j, k), 3 + 2 * self.OWN
            s = s[np.ix_(at := [0, 1, 2, *range(own, len(s))], at)]
            mean = s[0, 1:]
            c = s[1:, 1:] - np.outer(mean, mean)
            beta = np.linalg.solve(c[2:, 2:] + 1e-6 * np.eye(len(c) - 2), c[2:, :2])

        def powers(v: np.ndarray) -> np.ndarray:
            r = v[:, [i, j]]
            if fz:
                r = r - mean[:2] - (fz(v) - mean[2:]) @ beta
            return np.hstack([r[:, :1] ** np.arange(top + 1), r[:, 1:] ** np.arange(top + 1)])

        m, ps = self._sums(powers, [i, j, *k])[: top + 1, top + 1 :], []
        for p in range(1, self.degree + 1):
            for q in range(1, self.degree + 1):
                ma, mb = m[p, 0], m[0, q]
                va, vb = m[2 * p, 0] - ma * ma, m[0, 2 * q] - mb * mb
                r = (m[p, q] - ma * mb) / np.sqrt(va * vb)
                # The mean of the product of both squares, multiplied out.
                square = sum(ca * cb * m[pa, qb] for ca, pa in ((1, 2 * p), (-2 * ma, p), (ma * ma, 0)) for cb, qb in ((1, 2 * q), (-2 * mb, q), (mb * mb, 0)))
                spread = np.sqrt(max(square / (va * vb), 1e-12))
                ps.append(2 * (1 - normal_cdf(np.sqrt(self.n) * abs(np.arctanh(np.clip(r, -0.999999, 0.999999))) / spread)))
        return float(min(1.0, min(ps) * len(ps)))


class Probabilistic(IndependenceTest):
    """Posterior probability of independence from Dirichlet marginal likelihoods of counts; independent from one half on."""

    def __init__(self, chi: ChiSquare, prior: float = 0.5) -> None:
        super().__init__(chi.names, 0.5)
        self.chi, self.prior = chi, prior

    def p_value(self, x, y, z):
        from math import lgamma

        def marginal(counts: dict, cells: int) -> float:
            a = 1.0 / cells
            n = sum(counts.values())
            return lgamma(1.0) - lgamma(1.0 + n) + sum(lgamma(a + c) - lgamma(a) for c in counts.values())

        rows = self.chi.counts((x, y, *z))
        xs, ys = len({r[0] for r in rows}), len({r[1] for r in rows})
        strata: dict[tuple, dict] = {}
        for *key, n in rows:
            strata.setdefault(tuple(key[2:]), {})[key[0], key[1]] = n
        dep = ind = 0.0
        for cells in strata.values():
            a, b = {}, {}
            for (u, v), n in cells.items():
                a[u], b[v] = a.get(u, 0) + n, b.get(v, 0) + n
            dep += marginal(cells, xs * ys)
            ind += marginal(a, xs) + marginal(b, ys)
        top = max(dep, ind)
        i, d = self.prior * np.exp(ind - top), (1 - self.prior) * np.exp(dep - top)
        return float(i / (i + d))


def fisher_z_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(x, y, r, z, p)`` for all pairs, from one covariance pass."""
    cov = covariance_matrix(df, columns)
    test = FisherZ(cov)
    rows = []
    for i, x in enumerate(columns):
        for y in columns[i + 1 :]:
            r = partial_correlation(cov, x, y, [])
            rows.append((x, y, float(r), float(np.sqrt(cov.n - 3) * np.arctanh(np.clip(r, -1 + 1e-16, 1 - 1e-16))), test.p_value(x, y, [])))
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double, z double, p double")


def bootstrap_fisher_z(cov_of: Callable[[int], Covariance], draws: int, alpha: float = 0.05) -> IndependenceTest:
    """Independent if most resampled covariances say so."""
    return Pooled([FisherZ(cov_of(k), alpha) for k in range(draws)], 0.5, "percent")


def chisq_threshold(alpha: float, df: int) -> float:
    return float(chisq_quantile(1 - alpha, df))


class RegressionTest(IndependenceTest):
    """The p-value of y's coefficient in the regression of x on y and z, from a covariance matrix; x and y swapped keeps it."""

    def __init__(self, cov: Covariance, alpha: float = 0.05) -> None:
        super().__init__(cov.names, alpha)
        self.cov = cov

    def p_value(self, x, y, z):
        from causeway.operators.regression import ols_from_covariance

        fit = ols_from_covariance(self.cov, x, [y, *z])
        return float(fit.p[0])


class PooledResiduals(IndependenceTest):
    """Fisher's Z of residuals on z taken in each data set by itself and concatenated: pooled partial covariances, weighed by rows."""

    def __init__(self, covs: list[Covariance], alpha: float = 0.05) -> None:
        super().__init__(covs[0].names, alpha)
        self.covs = covs

    def p_value(self, x, y, z):
        from causeway.operators.moments import partial_covariance, partial_variance

        n = sum(c.n for c in self.covs)
        xy = sum(c.n * partial_covariance(c, x, y, z) for c in self.covs)
        xx, yy = (sum(c.n * partial_variance(c, v, z) for c in self.covs) for v in (x, y))
        r = float(np.clip(xy / np.sqrt(xx * yy), -1 + 1e-16, 1 - 1e-16))
        return float(2 * (1 - normal_cdf(np.sqrt(max(n - 3 - len(z), 1)) * abs(np.arctanh(r)))))


class MultinomialWald(IndependenceTest):
    """Wald test of y's coefficients in a multinomial logistic regression of discrete x on y and z."""

    def __init__(self, df: DataFrame, columns: list[str], alpha: float = 0.05) -> None:
        super().__init__(columns, alpha)
        self.df = df
        self.kinds = {c: kind(df, c) for c in columns}

    def p_value(self, x, y, z):
        if self.kinds[x] != "discrete":
            x, y = y, x
        if self.kinds[x] != "discrete":
            fit = ols(self.df, x, [y, *z], generalized=True)
            return float(fit.p[1])
        data, added = self.df.dropna(subset=[x, y, *z]), []
        for c in (y, *z):
            if self.kinds[c] == "discrete":
                data, names = dummies(data, c)
            else:
                names = [c]
            added.append(names)
        fit = logistic(data, x, [n for names in added for n in names])
        own = slice(1, 1 + len(added[0]))
        stat = float(np.nansum((fit.coefficients[:, own] / fit.errors[:, own]) ** 2))
        return float(chisq_tail(stat, fit.coefficients[:, own].size))


class TrekSeparation(IndependenceTest):
    """Latent nodes are independent given others if their indicators' cross-covariance has no higher rank than those others allow."""

    def __init__(self, cov: Covariance, indicators: dict[str, list[str]], alpha: float = 0.05) -> None:
        super().__init__(list(indicators), alpha)
        self.cov, self.indicators = cov, indicators

    def p_value(self, x, y, z):
        from causeway.plans.sem import rank_test

        halves = [(self.indicators[c][: len(self.indicators[c]) // 2], self.indicators[c][len(self.indicators[c]) // 2 :]) for c in z]
        left = self.indicators[x] + [v for a, _ in halves for v in a]
        right = self.indicators[y] + [v for _, b in halves for v in b]
        return 1.0 if rank_test(self.cov, left, right, self.alpha) <= len(z) else 0.0

    def independent(self, x, y, z=()):
        return self.p_value(x, y, list(z)) > 0.5
