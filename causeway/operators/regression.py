"""Regression from sufficient statistics.

Least squares needs one pass (sums of products); logistic and Cox regression
need one aggregation for each Newton step.  Nothing but small matrices reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.distributions import chisq_tail, normal_cdf, t_cdf
from causeway.functions.statistics import known
from causeway.operators.moments import Covariance, gram_matrix
from causeway.operators.ordering import cut_points, running
from causeway.operators.tables import categories


@dataclass
class LinearFit:
    """Coefficients with the intercept first (where there is one)."""

    names: list[str]
    coefficients: np.ndarray
    errors: np.ndarray
    t: np.ndarray
    p: np.ndarray
    rss: float
    r_squared: float
    n: int

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        value = F.lit(0.0)
        for c, b in zip(self.names, self.coefficients):
            value = value + (F.lit(float(b)) if c == "const" else F.lit(float(b)) * F.col(f"`{c}`"))
        return df.withColumn(name, value)


def ols(df: DataFrame, target: str, regressors: list[str], generalized: bool = False) -> LinearFit:
    """Least squares with an intercept over complete rows; values are centred first, so large means cost no digits."""
    columns = [*regressors, target]
    rows = df.select(*[known(f"`{c}`").alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    means = rows.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(columns))]).first()
    m = np.array([means[i] or 0.0 for i in range(len(columns))])
    g = gram_matrix(rows.select(*[(F.col(f"x{i}") - F.lit(float(v))).alias(f"x{i}") for i, v in enumerate(m)]), [f"x{i}" for i in range(len(columns))])
    k = len(regressors) + 1
    xx, xy, yy = g.matrix[:k, :k], g.matrix[:k, k], g.matrix[k, k]
    inverse = np.linalg.pinv(xx) if generalized else np.linalg.inv(xx)
    beta = inverse @ xy
    rss = max(float(yy - beta @ xy), 0.0)
    tss = float(yy - g.matrix[0, k] ** 2 / g.n)
    back = np.eye(k)
    back[0, 1:] = -m[:-1]
    beta, inverse = back @ beta, back @ inverse @ back.T
    beta[0] += m[-1]
    df_ = g.n - k
    errors = np.sqrt(np.maximum(np.diag(inverse), 0) * rss / df_)
    t = beta / np.where(errors == 0, np.nan, errors)
    return LinearFit(["const", *regressors], beta, errors, t, 2 * (1 - t_cdf(np.abs(t), df_)), rss, 1 - rss / tss if tss else float("nan"), g.n)


def ols_from_covariance(cov: Covariance, target: str, regressors: list[str]) -> LinearFit:
    """Least squares of centred variables, without an intercept."""
    at, y = [cov.index(r) for r in regressors], cov.index(target)
    inverse = np.linalg.inv(cov.matrix[np.ix_(at, at)])
    beta = inverse @ cov.matrix[at, y]
    residual = float(cov.matrix[y, y] - beta @ cov.matrix[at, y])
    df_ = cov.n - len(at) - 1
    errors = np.sqrt(np.diag(inverse) * residual / df_)
    t = beta / errors
    return LinearFit(list(regressors), beta, errors, t, 2 * (1 - t_cdf(np.abs(t), df_)), residual * (cov.n - 1), 1 - residual / cov.matrix[y, y], cov.n)


def two_stage_least_squares(cov: Covariance, target: str, regressors: list[str], instruments: list[str]) -> np.ndarray:
    """Coefficients of the regressors, by projection on the instruments."""
    x, z, y = ([cov.index(v) for v in vs] for vs in (regressors, instruments, [target]))
    m = cov.matrix
    project = m[np.ix_(x, z)] @ np.linalg.inv(m[np.ix_(z, z)])
    return np.linalg.solve(project @ m[np.ix_(z, x)], project @ m[np.ix_(z, y)])[:, 0]


@dataclass
class LogisticFit:
    names: list[str]
    classes: list
    coefficients: np.ndarray  # a row for each class beyond the first
    errors: np.ndarray
    p: np.ndarray
    log_likelihood: float
    n: int


def logistic(df: DataFrame, target: str, regressors: list[str], steps: int = 50, tolerance: float = 1e-9, ridge: float = 1e-9) -> LogisticFit:
    """Multinomial (for two classes binary) logistic regression by Newton's method over complete rows.

    Each step is one pass that adds up gradient and Hessian task by task.
    """
    rows = df.select(F.col(f"`{target}`").alias("y"), *[known(f"`{c}`").alias(f"x{i}") for i, c in enumerate(regressors)]).dropna()
    classes = categories(rows, "y")
    if len(classes) < 2:
        raise ValueError("the target has fewer than two classes")
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y")) - 1
    coded = rows.select(code.cast("int").alias("y"), *[f"x{i}" for i in range(len(regressors))])
    # Standardized regressors keep Newton's steps well scaled; results are scaled back.
    moments = coded.agg(F.count("*").alias("n"), *[f(f"x{i}").alias(f"{k}{i}") for i in range(len(regressors)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    m = np.array([moments[f"m{i}"] for i in range(len(regressors))], float)
    s = np.array([moments[f"s{i}"] or 1.0 for i in range(len(regressors))], float)
    k, p = len(classes) - 1, len(regressors) + 1
    beta, before = np.zeros((k, p)), -np.inf

    def step(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ll, grad, hess, n = 0.0, np.zeros(k * p), np.zeros((k * p, k * p)), 0
            for b in batches:
                y = b.column(0).to_numpy(zero_copy_only=False)
                x = np.column_stack([np.ones(len(y)), *[(b.column(i + 1).to_numpy(zero_copy_only=False) - m[i]) / s[i] for i in range(p - 1)]])
                eta = np.column_stack([np.zeros(len(y)), x @ beta.T])
                top = eta.max(1, keepdims=True)
                z = np.exp(eta - top)
                prob = z / z.sum(1, keepdims=True)
                ll += float((eta[np.arange(len(y)), y] - top[:, 0] - np.log(z.sum(1))).sum())
                hit = (y[:, None] == np.arange(1, k + 1)).astype(float)
                grad += ((hit - prob[:, 1:]).T @ x).ravel()
                for a in range(k):
                    for c in range(a, k):
                        w = prob[:, a + 1] * ((a == c) - prob[:, c + 1])
                        part = (x * w[:, None]).T @ x
                        hess[a * p : (a + 1) * p, c * p : (c + 1) * p] += part
                        if a != c:
                            hess[c * p : (c + 1) * p, a * p : (a + 1) * p] += part.T
                n += len(y)
            flat = np.concatenate([[ll, n], grad, hess.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

        flat = np.zeros(2 + k * p + (k * p) ** 2)
        for r in coded.mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            flat[r.i] = r.v
        return flat[0], flat[2 : 2 + k * p], flat[2 + k * p :].reshape(k * p, k * p), int(flat[1])

    for _ in range(steps):
        ll, grad, hess, n = step(beta)
        move = np.linalg.solve(hess + ridge * np.eye(k * p) * max(n, 1), grad).reshape(k, p)
        if abs(ll - before) < tolerance * (abs(ll) + 1):
            break
        before, beta = ll, beta + move
    scale = np.concatenate([[1.0], 1 / s])
    back = beta * scale
    back[:, 0] -= (beta[:, 1:] * (m / s)).sum(1)
    shift_matrix = np.eye(p) * scale
    shift_matrix[0, 1:] = -m / s
    variance = np.linalg.pinv(hess)
    errors = np.array([np.sqrt(np.maximum(np.diag(shift_matrix @ variance[a * p : (a + 1) * p, a * p : (a + 1) * p] @ shift_matrix.T), 0)) for a in range(k)])
    z = np.abs(back / np.where(errors == 0, np.nan, errors))
    return LogisticFit(["const", *regressors], classes, back, errors, 2 * (1 - normal_cdf(z)), float(ll), n)


@dataclass
class CoxFit:
    names: list[str]
    coefficients: np.ndarray
    errors: np.ndarray
    p: np.ndarray
    log_likelihood: float
    n: int


def cox(df: DataFrame, time: str, event: str, regressors: list[str], steps: int = 30, tolerance: float = 1e-4) -> CoxFit:
    """Proportional hazards with Efron's correction for ties, by Newton's method with halved steps.

    Rows are grouped by time first; sums over the rows still at risk are
    running sums over distinct times, from the latest.  Step sizes below
    ``tolerance`` (relative) end the search.
    """
    rows = df.select(known(f"`{time}`").alias("t"), F.col(f"`{event}`").cast("int").alias("e"), *[known(f"`{c}`").alias(f"x{i}") for i, c in enumerate(regressors)]).dropna()
    if rows.filter("t < 0").limit(1).count():
        raise ValueError("times must not be negative")
    p = len(regressors)
    centre = rows.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], F.count("*").alias("n")).first()
    beta, n = np.zeros(p), centre.n
    cuts = cut_points(rows, "t")

    def likelihood(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        xs = [F.col(f"x{i}") - F.lit(centre[f"m{i}"] or 0.0) for i in range(p)]
        eta = sum((F.lit(float(b)) * x for b, x in zip(beta, xs)), F.lit(0.0))
        w, dead = F.exp(eta), F.col("e") == 1
        pieces = {"w": w, **{f"w{i}": w * xs[i] for i in range(p)}, **{f"w{i}_{j}": w * xs[i] * xs[j] for i in range(p) for j in range(i, p)}}
        groups = rows.groupBy("t").agg(
            *[F.sum(v).alias(f"a_{k}") for k, v in pieces.items()],
            *[F.sum(F.when(dead, v).otherwise(0.0)).alias(f"d_{k}") for k, v in pieces.items()],
            F.sum(F.when(dead, eta).otherwise(0.0)).alias("s"),
            *[F.sum(F.when(dead, xs[i]).otherwise(0.0)).alias(f"s{i}") for i in range(p)],
            F.sum(F.col("e")).alias("m"),
        )
        risk = running(groups, "t", {f"r_{k}": F.col(f"a_{k}") for k in pieces}, descending=True, cuts=cuts).filter("m > 0")
        each = risk.withColumn("l", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).withColumn("f", F.col("l") / F.col("m"))
        left = {k: F.col(f"r_{k}") - F.col("f") * F.col(f"d_{k}") for k in pieces}
        out = [F.sum(F.log(left["w"])).alias("ll")]
        out += [F.sum(left[f"w{i}"] / left["w"]).alias(f"g{i}") for i in range(p)]
        out += [F.sum(left[f"w{i}_{j}"] / left["w"] - left[f"w{i}"] * left[f"w{j}"] / (left["w"] * left["w"])).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)]
        once = F.col("l") == 0
        out += [F.sum(F.when(once, F.col(c))).alias(c) for c in ["s", *[f"s{i}" for i in range(p)]]]
        a = b = each.agg(*out).first()
        if a.ll is None:
            return 0.0, np.zeros(p), np.eye(p)
        hess = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                hess[i, j] = hess[j, i] = a[f"h{i}_{j}"]
        return b.s - a.ll, np.array([b[f"s{i}"] - a[f"g{i}"] for i in range(p)]), hess

    ll, grad, hess = likelihood(beta)
    for _ in range(steps):
        move = np.linalg.solve(hess + 1e-12 * np.eye(p), grad)
        for _half in range(20):
            tried = likelihood(beta + move)
            if tried[0] >= ll or not np.isfinite(ll):
                break
            move = move / 2
        beta = beta + move
        small = np.abs(move).max() <= tolerance * (np.abs(beta).max() + 1e-12)
        ll, grad, hess = tried
        if small:
            break
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(hess)), 0))
    z = np.abs(beta / np.where(errors == 0, np.nan, errors))
    return CoxFit(list(regressors), beta, errors, 2 * (1 - normal_cdf(z)), float(ll), n)


def cox_lasso(df: DataFrame, time: str, event: str, regressors: list[str], penalty: float, steps: int = 100) -> np.ndarray:
    """Coefficients under an L1 penalty, by coordinate descent on the local quadratic of the partial likelihood at the unpenalised fit."""
    fit = cox(df, time, event, regressors)
    hess = np.linalg.pinv(np.diag(fit.errors**2))
    beta = np.zeros(len(regressors))
    for _ in range(steps):
        for i in range(len(beta)):
            pull = hess[i] @ (fit.coefficients - beta) + hess[i, i] * beta[i]
            beta[i] = np.sign(pull) * max(abs(pull) - penalty, 0) / hess[i, i]
    return beta


def likelihood_ratio(full: float, null: float, df_: int) -> tuple[float, float]:
    """Chi-square statistic and p-value; a negative or undefined statistic counts as 0."""
    chi = 2 * (full - null)
    chi = 0.0 if not np.isfinite(chi) or chi < 0 else chi
    return chi, float(chisq_tail(chi, df_))


def dummies(df: DataFrame, column: str, least: int = 3) -> tuple[DataFrame, list[str]]:
    """Indicator columns for the categories beyond the first, where there are ``least`` categories or more; else the column's code."""
    values = categories(df, column)
    if len(values) < least:
        name = f"{column}MULTINOM"
        return df.withColumn(name, F.when(F.col(f"`{column}`").isNotNull(), (F.col(f"`{column}`") == F.lit(values[-1])).cast("double"))), [name]
    names = [f"{column}MULTINOM.{v}" for v in values[1:]]
    return df.select("*", *[F.when(F.col(f"`{column}`").isNotNull(), (F.col(f"`{column}`") == F.lit(v)).cast("double")).alias(n) for v, n in zip(values[1:], names)]), names
