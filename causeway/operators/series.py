"""Time-series operators on tables with a dense row number."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.distributions import column as dist
from causeway.functions.statistics import known
from causeway.operators.ordering import ecdf_ranks, lagged
from causeway.operators.moments import gram_matrix as gram
from causeway.operators.tables import ROW, variables


def lag_embed(df: DataFrame, lags: int, with_time: bool = False) -> DataFrame:
    """Columns X, X:1 .. X:k by rows back, without the first k rows; with ``time`` from 1 if asked for."""
    cols = variables(df)
    out = lagged(df, {f"{c}:{k}": (c, k) for k in range(1, lags + 1) for c in cols}).filter(F.col(ROW) >= lags)
    ordered = [*cols, *[f"{c}:{k}" for k in range(1, lags + 1) for c in cols]]
    out = out.select((F.col(ROW) - lags).alias(ROW), *[F.col(f"`{c}`") for c in ordered])
    return out.withColumn("time", F.col(ROW) + 1) if with_time else out


def lag_name(name: str) -> tuple[str, int]:
    """Base name and lag of ``X:k``."""
    base, _, k = name.partition(":")
    return base, int(k or 0)


def shift(df: DataFrame, shifts: list[int]) -> DataFrame:
    """Each column moved up by its shift, relative to the others; rows that lack a value are cut off."""
    low, high = min(shifts), max(shifts)
    cols = variables(df)
    n = df.count()
    out = lagged(df, {f"__cw_{i}": (c, -((high - low) - (s - low))) for i, (c, s) in enumerate(zip(cols, shifts))})
    return out.filter(F.col(ROW) < n - (high - low)).select(ROW, *[F.col(f"__cw_{i}").alias(c) for i, c in enumerate(cols)])


def difference(df: DataFrame, order: int = 1) -> DataFrame:
    """Differences of an order, without the first rows."""
    out = df
    for _ in range(order):
        cols = variables(out)
        moved = lagged(out, {f"__cw_{c}": (c, 1) for c in cols}).filter(F.col(ROW) >= 1)
        out = moved.select((F.col(ROW) - 1).alias(ROW), *[(F.col(f"`{c}`") - F.col(f"`__cw_{c}`")).alias(c) for c in cols])
    return out


@dataclass
class VectorAutoregression:
    """Coefficients of each target on all lags (and an intercept), and its residual variances."""

    targets: list[str]
    regressors: list[str]
    coefficients: np.ndarray
    residual_variance: np.ndarray


def fit_var(df: DataFrame, lags: int) -> VectorAutoregression:
    """Least squares of every column on all lagged columns, from one aggregation."""
    cols = variables(df)
    embedded = lag_embed(df, lags)
    right = [c for c in variables(embedded) if ":" in c]
    m = gram(embedded, [*right, *cols])
    k = len(right) + 1
    xx, xy, yy = m.matrix[:k, :k], m.matrix[:k, k:], np.diag(m.matrix)[k:]
    beta = np.linalg.pinv(xx) @ xy
    return VectorAutoregression(cols, right, beta.T, (yy - (beta * xy).sum(0)) / max(m.n - k, 1))


def residuals(df: DataFrame, lags: int) -> DataFrame:
    """Residuals of a vector autoregression, row by row."""
    model = fit_var(df, lags)
    embedded = lag_embed(df, lags)
    out = []
    for t, b in zip(model.targets, model.coefficients):
        fitted = F.lit(float(b[0]))
        for x, w in zip(model.regressors, b[1:]):
            fitted = fitted + F.lit(float(w)) * F.col(f"`{x}`")
        out.append((F.col(f"`{t}`") - fitted).alias(t))
    return embedded.select(ROW, *out)


def self_loop_coefficients(df: DataFrame) -> dict[str, float]:
    """Slope of each column on its own previous value."""
    cols = variables(df)
    moved = lagged(df, {f"__cw_{c}": (c, 1) for c in cols}).filter(F.col(ROW) >= 1)
    row = moved.agg(*[F.regr_slope(F.col(f"`{c}`"), F.col(f"`__cw_{c}`")).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def mean_squared_coefficient(df: DataFrame, lags: int) -> float:
    return float(np.square(fit_var(df, lags).coefficients[:, 1:]).mean())


def is_stable(df: DataFrame, lags: int) -> bool:
    """Whether all eigenvalues of the companion matrix lie within the unit circle."""
    model = fit_var(df, lags)
    p = len(model.targets)
    companion = np.zeros((p * lags, p * lags))
    companion[:p] = model.coefficients[:, 1:]
    companion[p:, :-p] = np.eye(p * (lags - 1))
    return bool((np.abs(np.linalg.eigvals(companion)) < 1).all())


def standardize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns less their mean, over their sample deviation; the constants come from one aggregation."""
    cols = columns or variables(df)
    row = df.agg(*[f(known(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    at = {c: i for i, c in enumerate(cols)}
    return df.select(*[((known(f"`{c}`") - F.lit(row[f"m{at[c]}"])) / F.lit(row[f"s{at[c]}"])).alias(c) if c in at else F.col(f"`{c}`") for c in df.columns])


def center(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or variables(df)
    row = df.agg(*[F.avg(known(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    at = {c: i for i, c in enumerate(cols)}
    return df.select(*[(known(f"`{c}`") - F.lit(row[f"m{at[c]}"])).alias(c) if c in at else F.col(f"`{c}`") for c in df.columns])


def nonparanormal(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Normal scores of truncated empirical CDFs, with each column's own mean and deviation."""
    cols = columns or variables(df)
    n = df.count()
    delta = 1 / (4 * n**0.25 * np.sqrt(np.pi * np.log(n)))
    row = df.agg(*[f(known(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    out = df
    for i, c in enumerate(cols):
        ranked = ecdf_ranks(out, c, "__cw_r")
        p = F.greatest(F.lit(float(delta)), F.least(F.lit(float(1 - delta)), F.col("__cw_r") / F.lit(float(n))))
        scored = ranked.withColumn("__cw_z", dist("normal_quantile", p))
        s = scored.agg(F.stddev_samp("__cw_z")).first()[0]
        out = scored.withColumn(c, F.col("__cw_z") / F.lit(s) * F.lit(row[f"s{i}"]) + F.lit(row[f"m{i}"])).drop("__cw_r", "__cw_z")
    return out.select(df.columns)


def lagged_crosstab(df: DataFrame, child: str, parent: str, lag: int) -> DataFrame:
    """Counts of (child, parent ``lag`` rows back)."""
    return lagged(df, {"__cw_p": (parent, lag)}).filter(F.col(ROW) >= lag).groupBy(F.col(child).alias("child"), F.col("__cw_p").alias("parent")).count()


def best_shifts(df: DataFrame, max_shift: int) -> tuple[list[int], float]:
    """Shifts of the columns that lower the average BIC of each column given all others, found greedily one column at a time."""
    from causeway.operators.scores import sem_bic
    from causeway.operators.moments import covariance_matrix

    cols = variables(df)
    best, low = [0] * len(cols), None

    def bic(shifts: list[int]) -> float:
        cov = covariance_matrix(shift(df, shifts), cols)
        return -float(np.mean([sem_bic(cov, i, [j for j in range(len(cols)) if j != i]) for i in range(len(cols))]))

    low = bic(best)
    for i in range(len(cols)):
        for s in range(max_shift + 1):
            tried = [*best[:i], s, *best[i + 1 :]]
            if (b := bic(tried)) < low:
                best, low = tried, b
    return best, low


def moving_window(df: DataFrame, column: str, rows: int, block: int = 1_000_000) -> DataFrame:
    """Mean over the last rows, with the block scheme of ``lagged``."""
    moved = lagged(df, {f"__cw_{k}": (column, k) for k in range(1, rows)}, block=block)
    total = sum((F.coalesce(F.col(f"__cw_{k}"), F.lit(0.0)) for k in range(1, rows)), F.col(column))
    return moved.withColumn("moving_mean", total / F.least(F.lit(rows), F.col(ROW) + 1)).select(*df.columns, "moving_mean")


def cumulative_within(df: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    """Running sum within groups."""
    return df.withColumn("running", F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
