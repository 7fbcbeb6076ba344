"""Distribution functions in numpy, and as vectorised column functions.

scipy isn't needed: incomplete gamma and beta functions come from their series
and continued fractions, quantiles from bisection on the CDF.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def lngamma(x):
    """Natural logarithm of the gamma function."""
    return _lgamma(np.asarray(x, float))


def logbeta(p, q):
    return lngamma(p) + lngamma(q) - lngamma(np.add(p, q))


def gamma_cdf(a, x):
    """Regularised lower incomplete gamma function P(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(x.shape)
    pos = x > 0
    low = pos & (x < a + 1)
    high = pos & ~low
    if low.any():
        al, xl = a[low], x[low]
        term = 1 / al
        total, n = term.copy(), al.copy()
        for _ in range(10_000):
            n = n + 1
            term = term * xl / n
            total += term
            if (np.abs(term) < np.abs(total) * 1e-17).all():
                break
        out[low] = total * np.exp(-xl + al * np.log(xl) - lngamma(al))
    if high.any():
        ah, xh = a[high], x[high]
        tiny = 1e-300
        b = xh + 1 - ah
        c = np.full_like(b, 1 / tiny)
        d = 1 / np.where(b == 0, tiny, b)
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - ah)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[high] = 1 - h * np.exp(-xh + ah * np.log(xh) - lngamma(ah))
    return out if out.shape else float(out)


def beta_cdf(x, p, q):
    """Regularised incomplete beta function I_x(p, q)."""
    x, p, q = np.broadcast_arrays(np.asarray(x, float), np.asarray(p, float), np.asarray(q, float))
    x = np.clip(x, 0, 1)
    swap = x > (p + 1) / (p + q + 2)
    xx, pp, qq = np.where(swap, 1 - x, x), np.where(swap, q, p), np.where(swap, p, q)
    inner = (xx > 0) & (xx < 1)
    safe = np.where(inner, xx, 0.5)
    front = np.exp(pp * np.log(safe) + qq * np.log1p(-safe) - logbeta(pp, qq)) / pp
    tiny = 1e-300
    c = np.ones_like(safe)
    d = 1 - (pp + qq) * safe / (pp + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 5_000):
        for num in (m * (qq - m) * safe / ((pp + 2 * m - 1) * (pp + 2 * m)), -(pp + m) * (pp + qq + m) * safe / ((pp + 2 * m) * (pp + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if (np.abs(step - 1) < 1e-15).all():
            break
    part = np.where(inner, front * h, xx)
    out = np.where(swap, 1 - part, part)
    return out if out.shape else float(out)


def normal_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


def normal_pdf(x):
    return np.exp(-np.square(np.asarray(x, float)) / 2) / math.sqrt(2 * math.pi)


def chisq_cdf(x, df):
    return gamma_cdf(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def chisq_tail(x, df):
    """Upper tail, 1 where the degrees of freedom are 0."""
    df = np.asarray(df, float)
    return np.where(df <= 0, 1.0, 1 - chisq_cdf(np.maximum(x, 0), np.maximum(df, 1e-9)))


def t_cdf(x, df):
    x, df = np.asarray(x, float), np.asarray(df, float)
    tail = 0.5 * np.asarray(beta_cdf(df / (df + x * x), df / 2, 0.5))
    return np.where(x > 0, 1 - tail, tail)


def f_cdf(x, df1, df2):
    x = np.maximum(np.asarray(x, float), 0)
    return beta_cdf(df1 * x / (df1 * x + df2), np.asarray(df1, float) / 2, np.asarray(df2, float) / 2)


def binomial_cdf(k, n, p):
    k, n, p = np.asarray(k, float), np.asarray(n, float), np.asarray(p, float)
    return np.where(k >= n, 1.0, np.where(k < 0, 0.0, beta_cdf(1 - p, np.maximum(n - k, 1e-12), np.maximum(k + 1, 1e-12))))


def poisson_cdf(k, rate):
    k = np.floor(np.asarray(k, float))
    return np.where(k < 0, 0.0, 1 - np.asarray(gamma_cdf(np.maximum(k + 1, 1e-12), rate)))


def cauchy_cdf(x):
    return 0.5 + np.arctan(np.asarray(x, float)) / math.pi


def cauchy_pdf(x):
    return 1 / (math.pi * (1 + np.square(np.asarray(x, float))))


def beta_pdf(x, a, b):
    x = np.asarray(x, float)
    return np.where((x > 0) & (x < 1), np.exp((a - 1) * np.log(np.clip(x, 1e-300, 1)) + (b - 1) * np.log1p(-np.clip(x, 0, 1 - 1e-16)) - logbeta(a, b)), 0.0)


def gamma_pdf(x, a):
    x = np.asarray(x, float)
    return np.where(x > 0, np.exp((np.asarray(a) - 1) * np.log(np.maximum(x, 1e-300)) - x - lngamma(a)), 0.0)


def chisq_pdf(x, df):
    return gamma_pdf(np.asarray(x, float) / 2, np.asarray(df, float) / 2) / 2


def f_pdf(x, a, b):
    x = np.asarray(x, float)
    y = np.maximum(x, 1e-300)
    return np.where(x > 0, np.exp((a / 2) * np.log(a / b) + (a / 2 - 1) * np.log(y) - ((a + b) / 2) * np.log1p(a * y / b) - logbeta(a / 2, b / 2)), 0.0)


def t_pdf(x, df):
    x, df = np.asarray(x, float), np.asarray(df, float)
    return np.exp(lngamma((df + 1) / 2) - lngamma(df / 2)) / np.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)


def binomial_pmf(k, n, p):
    k, n, p = np.asarray(k, float), np.asarray(n, float), np.asarray(p, float)
    return np.exp(lngamma(n + 1) - lngamma(k + 1) - lngamma(n - k + 1)) * p**k * (1 - p) ** (n - k)


def poisson_pmf(k, rate):
    k, rate = np.asarray(k, float), np.asarray(rate, float)
    return np.exp(k * np.log(rate) - rate - lngamma(k + 1))


def _bisect(cdf: Callable, p, low, high):
    """Where an increasing ``cdf`` reaches ``p``; ``high`` is doubled as needed; NaN for what is no probability."""
    asked = np.asarray(p, float)
    ok = (asked >= 0) & (asked <= 1)
    p = np.where(ok, asked, 0.5)
    lo, hi = np.full(p.shape, float(low)), np.full(p.shape, float(high))
    for _ in range(1_100):
        short = np.asarray(cdf(hi)) < p
        if not short.any() or not np.isfinite(hi[short] if hi.shape else hi).all():
            break
        hi = np.where(short, hi * 2, hi)
    for _ in range(200):
        mid = (lo + hi) / 2
        below = np.asarray(cdf(mid)) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    out = np.where(ok, (lo + hi) / 2, np.nan)
    return out if out.shape else float(out)


def normal_quantile(p):
    """Inverse of the normal CDF; infinite at 0 and 1."""
    p = np.asarray(p, float)
    out = np.where(p < 0.5, -1.0, 1.0) * np.asarray(_bisect(lambda x: 1 - 0.5 * _erfc(x / math.sqrt(2)), np.maximum(p, 1 - p), 0.0, 40.0))
    out = np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, out))
    return out if out.shape else float(out)


def chisq_quantile(p, df):
    return _bisect(lambda x: chisq_cdf(x, df), p, 0.0, 10.0)


def gamma_quantile(a, p):
    return _bisect(lambda x: gamma_cdf(a, x), p, 0.0, 10.0)


def beta_quantile(p, a, b):
    return _bisect(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)


def f_quantile(p, df1, df2):
    return _bisect(lambda x: f_cdf(x, df1, df2), p, 0.0, 10.0)


def t_quantile(p, df):
    p = np.asarray(p, float)
    out = np.where(p < 0.5, -1.0, 1.0) * np.asarray(_bisect(lambda x: t_cdf(x, df), np.maximum(p, 1 - p), 0.0, 10.0))
    return out if out.shape else float(out)


def cauchy_quantile(p):
    return np.tan(math.pi * (np.asarray(p, float) - 0.5))


def _discrete_quantile(cdf: Callable, p, top: float | None):
    p = np.asarray(p, float)
    k = np.ceil(np.asarray(_bisect(lambda x: cdf(np.floor(x)), p, -1.0, 16.0 if top is None else top + 1)))
    k = np.where(np.asarray(cdf(k - 1)) >= p, k - 1, k)
    out = np.maximum(k, 0)
    return out if out.shape else float(out)


def binomial_quantile(p, n, q):
    return _discrete_quantile(lambda k: binomial_cdf(k, n, q), p, float(np.max(n)))


def poisson_quantile(p, rate):
    return _discrete_quantile(lambda k: poisson_cdf(k, rate), p, None)


def bivariate_normal_cdf(a: float, b: float, r: float) -> float:
    """P(X > a, Y > b) for standard normals with correlation r, by integrating the density over the correlation."""
    nodes, weights = np.polynomial.legendre.leggauss(64)
    upper = math.asin(max(-1.0, min(1.0, r)))
    s = np.sin(upper * (nodes + 1) / 2)
    inner = np.exp(-(a * a + b * b - 2 * a * b * s) / (2 * np.maximum(1 - s * s, 1e-300)))
    return float(normal_cdf(-a) * normal_cdf(-b) + upper / (4 * math.pi) * (weights * inner).sum())


def multinormal_prob(low, high, cov, draws: int = 200_000, seed: int = 42) -> float:
    """Probability of a box under a centred normal, by seeded Monte Carlo."""
    z = np.random.default_rng(seed).multivariate_normal(np.zeros(len(cov)), np.asarray(cov, float), draws)
    return float(((z >= low) & (z <= high)).all(1).mean())


def chisq_cutoff(alpha: float, df: int) -> float:
    """The value whose upper tail is ``alpha``."""
    return float(chisq_quantile(1 - alpha, df))


def z_for_alpha(alpha: float) -> float:
    """Two-sided normal cutoff."""
    return float(normal_quantile(1 - alpha / 2))


def integrate(f: Callable[[np.ndarray], np.ndarray], low: float, high: float, pieces: int = 100) -> float:
    """Composite Gauss-Legendre quadrature."""
    nodes, weights = np.polynomial.legendre.leggauss(8)
    edges = np.linspace(low, high, pieces + 1)
    half = (edges[1:] - edges[:-1]) / 2
    x = (edges[1:] + edges[:-1])[:, None] / 2 + half[:, None] * nodes
    return float((half[:, None] * weights * f(x)).sum())


def partial_correlation_pdf(r, n: int, k: int, rho: float = 0.0):
    """Density of a sample (partial) correlation of n rows given k variables, for a true value of 0 or by Fisher's transform otherwise."""
    r = np.asarray(r, float)
    df = n - k
    if rho == 0:
        return np.exp(-logbeta(0.5, (df - 2) / 2)) * (1 - r * r) ** ((df - 4) / 2)
    z = np.arctanh(r) - math.atanh(rho)
    return normal_pdf(z * math.sqrt(df - 3)) * math.sqrt(df - 3) / (1 - r * r)


#: Every function by name, with its number of arguments; all take and return arrays.
FUNCTIONS: dict[str, tuple[Callable, int]] = {
    f.__name__: (f, n)
    for f, n in (
        (normal_cdf, 1), (lngamma, 1), (logbeta, 2), (beta_cdf, 3), (binomial_cdf, 3), (cauchy_cdf, 1), (f_cdf, 3), (gamma_cdf, 2), (chisq_cdf, 2), (poisson_cdf, 2), (t_cdf, 2),
        (beta_quantile, 3), (binomial_quantile, 3), (cauchy_quantile, 1), (chisq_quantile, 2), (f_quantile, 3), (gamma_quantile, 2), (normal_quantile, 1), (poisson_quantile, 2), (t_quantile, 2),
        (beta_pdf, 3), (binomial_pmf, 3), (cauchy_pdf, 1), (chisq_pdf, 2), (f_pdf, 3), (gamma_pdf, 2), (normal_pdf, 1), (poisson_pmf, 2), (t_pdf, 2), (chisq_tail, 2),
    )
}


def column(name: str, *args: Column | float) -> Column:
    """A distribution function applied to columns; built-ins where they suffice, else Arrow batches through numpy."""
    cols = [a if isinstance(a, Column) else F.lit(float(a)) for a in args]
    if name == "cauchy_cdf":
        return F.lit(0.5) + F.atan(cols[0]) / F.lit(math.pi)
    if name == "cauchy_pdf":
        return F.lit(1 / math.pi) / (1 + cols[0] * cols[0])
    if name == "cauchy_quantile":
        return F.tan(F.lit(math.pi) * (cols[0] - 0.5))
    if name == "normal_pdf":
        return F.exp(-cols[0] * cols[0] / 2) / F.lit(math.sqrt(2 * math.pi))
    f, n = FUNCTIONS[name]
    if len(cols) != n:
        raise ValueError(f"{name} takes {n} arguments")

    def run(*series: pd.Series) -> pd.Series:
        values = [s.to_numpy(dtype=float, na_value=np.nan) for s in series]
        ok = np.logical_and.reduce([np.isfinite(v) for v in values]) if values else np.zeros(0, bool)
        out = np.full(len(ok), np.nan)
        if ok.any():
            out[ok] = f(*[v[ok] for v in values])
        return pd.Series(out)

    wrapped = {
        1: lambda a: run(a),
        2: lambda a, b: run(a, b),
        3: lambda a, b, c: run(a, b, c),
    }[n]
    wrapped.__annotations__ = {**dict.fromkeys("abc"[:n], pd.Series), "return": pd.Series}
    out = F.pandas_udf(wrapped, "double")(*[c.cast("double") for c in cols])
    return F.when(~F.isnan(out), out)


#: Samplers: arguments of numpy's generator by name.
SAMPLERS: dict[str, Callable[[np.random.Generator, list[np.ndarray], int], np.ndarray]] = {
    "bernoulli": lambda g, a, n: (g.random(n) < a[0]).astype(float),
    "poisson": lambda g, a, n: g.poisson(a[0], n).astype(float),
    "binomial": lambda g, a, n: g.binomial(a[0].astype(int), a[1], n).astype(float),
    "gamma": lambda g, a, n: g.gamma(a[0], a[1] if len(a) > 1 else 1.0, n),
    "beta": lambda g, a, n: g.beta(a[0], a[1], n),
    "chisq": lambda g, a, n: g.chisquare(a[0], n),
    "t": lambda g, a, n: g.standard_t(a[0], n),
    "f": lambda g, a, n: g.f(a[0], a[1], n),
    "cauchy": lambda g, a, n: g.standard_cauchy(n),
    "nakagami": lambda g, a, n: np.sqrt(g.gamma(a[0], a[1] / a[0], n)),
    "truncnormal": lambda g, a, n: a[0] + a[1] * np.asarray(normal_quantile(normal_cdf((a[2] - a[0]) / a[1]) + g.random(n) * (normal_cdf((a[3] - a[0]) / a[1]) - normal_cdf((a[2] - a[0]) / a[1])))),
}


def sample(name: str, seed: int, *args: Column | float) -> Column:
    """Draws from a distribution, one per row.

    Each row's draw is seeded by ``seed`` and a uniform number that Spark makes
    for its place, so a task that is tried again draws the same.
    """
    cols = [(a if isinstance(a, Column) else F.lit(float(a))).cast("double") for a in args]
    draw = SAMPLERS[name]

    def run(start: pd.Series, struct: pd.DataFrame) -> pd.Series:
        if not len(start):
            return pd.Series(np.zeros(0))
        g = np.random.default_rng([seed, int(start.iloc[0] * 2**53)])
        return pd.Series(draw(g, [struct[c].to_numpy(float) for c in struct.columns if c != "z"], len(start)))

    run.__annotations__ = {"start": pd.Series, "struct": pd.DataFrame, "return": pd.Series}
    packed = F.struct(*[c.alias(f"a{i}") for i, c in enumerate(cols)], F.lit(0).alias("z"))
    return F.pandas_udf(run, "double")(F.rand(seed), packed)
