"""Statistics of one or two columns as aggregate expressions.

Formulas follow the surveyed library where they differ from Spark's own;
missing values (null or NaN) are skipped.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.ordering import average_ranks, order_statistics, value_counts


def known(x: Column | str) -> Column:
    """The value as a double, null where it is missing or NaN."""
    c = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(~F.isnan(c), c)


def mean(x):
    return F.avg(known(x))


def median(x):
    """The middle value, or the mean of the two middle ones."""
    return F.percentile(known(x), 0.5)


def minimum(x):
    return F.min(known(x))


def maximum(x):
    return F.max(known(x))


def value_range(x):
    return maximum(x) - minimum(x)


def count(x):
    return F.count(known(x))


def ssx(x):
    """Sum of squares about the mean."""
    return F.var_pop(known(x)) * count(x)


def sxy(x, y):
    """Sum of products about the means, over rows that have both."""
    return F.covar_pop(known(x), known(y)) * F.count(known(x) + known(y))


def variance(x):
    return F.var_samp(known(x))


def sd(x):
    return F.stddev_samp(known(x))


def covariance(x, y):
    return F.covar_samp(known(x), known(y))


def correlation(x, y):
    return F.corr(known(x), known(y))


def compressed_correlation(x, y):
    """Correlation in ten-thousandths, cut off towards 0."""
    return (correlation(x, y) * 10000).cast("smallint")


def skewness(x):
    """Third moment with divisor N - 1 over the population deviation's cube."""
    n = count(x)
    return F.skewness(known(x)) * n / (n - 1)


def kurtosis(x):
    """Fourth moment over the squared sample variance, less 3."""
    n = count(x)
    return (F.kurtosis(known(x)) + 3) * F.pow((n - 1) / n, F.lit(2)) - 3


def central_moment(x, m: Column, s: Column, order: int) -> Column:
    """Mean of the ``order``-th power of the standardized value; ``m`` and ``s`` are constants of the group."""
    return F.avg(F.pow((known(x) - m) / s, F.lit(order)))


def two_pass(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Statistics that need the mean and deviation first: average deviation, fifth and sixth moments, log-cosh, mean-absolute, exponential and entropy scores, by group."""
    by = by or []
    x = known(column)
    first = df.groupBy(*by).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    joined = df.join(first, by) if by else df.crossJoin(F.broadcast(first))
    z = (x - F.col("__m")) / F.col("__s")
    return joined.groupBy(*by).agg(
        F.avg(F.abs(x - F.col("__m"))).alias("average_deviation"),
        F.avg(F.pow(z, F.lit(5))).alias("fifth_moment"),
        F.avg(F.pow(z, F.lit(6))).alias("sixth_moment"),
        F.pow(F.avg(F.log(F.cosh(z))) - LOG_COSH_OF_NORMAL, F.lit(2)).alias("log_cosh_score"),
        F.pow(F.avg(F.abs(z)) - math.sqrt(2 / math.pi), F.lit(2)).alias("mean_absolute_score"),
        F.log(F.avg(F.exp(z))).alias("exp_score"),
        _max_entropy(z).alias("max_entropy_approx"),
    )


#: Fixed value: the mean of log cosh of a standard normal.
LOG_COSH_OF_NORMAL = 0.3746764078432371


def _max_entropy(z: Column) -> Column:
    """Normal entropy less the approximate negentropy of log-cosh and odd Gaussian-weighted moments."""
    k1, k2, gamma = 79.047, 7.4129, 0.37457  # fixed values of Hyvarinen's approximation
    negentropy = k1 * F.pow(F.avg(F.log(F.cosh(z))) - gamma, F.lit(2)) + k2 * F.pow(F.avg(z * F.exp(-z * z / 2)), F.lit(2))
    return F.lit(math.log(2 * math.pi) / 2 + 0.5) - negentropy


def quartile(df: DataFrame, column: str, q: int) -> float | None:
    """Quartile at place q/4 * (N + 1), between neighbours in proportion, and the ends beyond them."""
    n = df.select(count(column)).first()[0]
    if not n:
        return None
    place = q / 4 * (n + 1) - 1
    low, high = max(0, min(n - 1, math.floor(place))), max(0, min(n - 1, math.ceil(place)))
    at = order_statistics(df, column, [low, high])
    return at[low] + (place - math.floor(place)) * (at[high] - at[low])


def histogram_entropy(df: DataFrame, column: str, bins: int) -> float:
    """-sum p ln p over equal-width bins, with p = n / (bins - 1) as the surveyed library has it."""
    x = known(column)
    edge = df.select(F.min(x), F.max(x)).first()
    if edge[0] is None or edge[0] == edge[1]:
        return 0.0
    cell = ((x - edge[0]) / (edge[1] - edge[0]) * (bins - 1)).cast("int")
    p = F.col("n") / F.lit(bins - 1)
    return df.filter(x.isNotNull()).groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).agg(-F.sum(p * F.log(p))).first()[0]


def rank_correlation(df: DataFrame, x: str, y: str) -> float | None:
    """Spearman: the correlation of average ranks, over rows that have both."""
    both = df.select(known(x).alias("x"), known(y).alias("y")).dropna()
    ranked = average_ranks(average_ranks(both, "x", "rx"), "y", "ry")
    return ranked.select(F.corr("rx", "ry")).first()[0]


def kendalls_tau(df: DataFrame, x: str, y: str, most_cells: int = 256) -> float | None:
    """Tau-a: (concordant - discordant) / pairs, without a correction for ties.

    Pairs aren't listed.  Points become average ranks; a grid of rank cells
    gives the pairs of different rows and columns of cells from counts (at most
    ``most_cells`` squared of them reach the driver).  Pairs that share a row or
    a column of cells are counted within it by merging, so a strip of m distinct
    points costs m log(m)**2.
    """
    both = df.select(known(x).alias("x"), known(y).alias("y")).dropna()
    counted = both.groupBy("x", "y").agg(F.count("*").alias("n"))
    n, distinct = counted.agg(F.sum("n"), F.count("*")).first()
    if not n or n < 2:
        return None
    grid = max(1, min(most_cells, distinct // 1000))
    ranked = average_ranks(average_ranks(counted, "x", "rx"), "y", "ry").select((F.col("rx") * 2).cast("long").alias("rx"), (F.col("ry") * 2).cast("long").alias("ry"), "n")
    edge = ranked.agg(F.max("rx"), F.max("ry")).first()
    sx, sy = max(1, -(-(edge[0] + 1) // grid)), max(1, -(-(edge[1] + 1) // grid))
    cells = ranked.withColumn("cx", F.floor(F.col("rx") / sx).cast("int")).withColumn("cy", F.floor(F.col("ry") / sy).cast("int"))
    table = np.zeros((grid + 1, grid + 1))
    for r in cells.groupBy("cx", "cy").agg(F.sum("n").alias("n")).collect():
        table[r.cx, r.cy] = r.n
    right_up = np.cumsum(np.cumsum(table[::-1, ::-1], 0), 1)[::-1, ::-1]
    right_down = np.cumsum(np.cumsum(table[::-1, :], 0), 1)[::-1, :]
    total = 0.0
    for i in range(grid):
        for j in range(grid):
            total += table[i, j] * (right_up[i + 1, j + 1] - (right_down[i + 1, j - 1] if j else 0))

    # Pairs of one cell are in its column and in its row: rows leave them out.
    inside = sum(cells.groupBy(own).applyInPandas(_strip(other), "s double").agg(F.sum("s")).first()[0] or 0.0 for own, other in (("cx", None), ("cy", "cx")))
    return (total + inside) / (0.5 * n * (n - 1))


def _strip(without: str | None):
    def run(pdf):
        import pandas as pd

        every = [pdf, *([] if without is None else [part for _, part in pdf.groupby(without)])]
        sums = [concordance(*(part[c].to_numpy() for c in ("rx", "ry", "n"))) for part in every]
        return pd.DataFrame({"s": [sums[0] - sum(sums[1:])]})

    return run


def concordance(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Concordant less discordant pairs of distinct points of ``n`` copies each; ties are neither."""
    order = np.lexsort((y, x))
    x, y, n = x[order], y[order], n[order].astype(float)
    total, place = 0.0, np.arange(len(x))
    by_y = np.argsort(y, kind="stable")
    size = 1
    while size < len(x):
        # Blocks of two halves, each sorted by y: what of the left half is below and above each point of the right.
        at = by_y[np.argsort(place[by_y] // (2 * size), kind="stable")]
        block, left = at // (2 * size), (at // size) % 2 == 0
        w = np.where(left, n[at], 0.0)
        upto = np.cumsum(w)
        tied = np.concatenate([[0], np.cumsum((block[1:] != block[:-1]) | (y[at][1:] != y[at][:-1]))])
        starts = np.flatnonzero(np.concatenate([[True], tied[1:] != tied[:-1]]))
        ends = np.append(starts[1:], len(at)) - 1
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        number = np.cumsum(np.concatenate([[0], block[1:] != block[:-1]]))
        before, whole = (upto - w)[first][number], upto[last][number]
        below, above = (upto - w)[starts][tied] - before, whole - upto[ends][tied]
        total += float((np.where(left, 0.0, n[at]) * (below - above)).sum())
        size *= 2
    # Points of one x stand in the order of y, so their pairs were counted as concordant.
    new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    sums, squares = (np.add.reduceat(v, new) if len(new) else np.zeros(0) for v in (n, n * n))
    return total - float(((sums * sums - squares) / 2).sum())


def log_sum(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """``log_sum`` of each group: log of the sum of exponentials, without overflow; two aggregations."""
    by = by or []
    x = known(column)
    top = df.groupBy(*by).agg(F.max(x).alias("__m"))
    joined = df.join(top, by) if by else df.crossJoin(F.broadcast(top))
    return joined.groupBy(*by).agg((F.max("__m") + F.log(F.sum(F.exp(x - F.col("__m"))))).alias("log_sum"))


def empirical_cdf(df: DataFrame, column: str) -> DataFrame:
    """``(x, p)``: the share of values at most x."""
    n = df.select(count(column)).first()[0]
    return value_counts(df, column).select("x", ((F.col("below") + F.col("n")) / F.lit(n)).alias("p"))


def fdr(p_values: DataFrame, alpha: float, column: str = "p", negatively_correlated: bool = False) -> DataFrame:
    """``(p, k, ok)`` for each distinct p-value; k is its last place (from 1) in ascending order, ok whether it is within k / (m + 1) * alpha (over the harmonic sum of k for negative correlation)."""
    counts = value_counts(p_values, column)
    m = p_values.select(count(column)).first()[0]
    k = F.col("below") + F.col("n")
    harmonic = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(k, F.lit(100_000).cast("long"))), F.lit(0.0), lambda a, i: a + 1 / i) + F.when(k > 100_000, F.log(k / 100_000.0)).otherwise(0.0)
    limit = k / F.lit(m + 1) * alpha / (harmonic if negatively_correlated else F.lit(1.0))
    return counts.select(F.col("x").alias("p"), k.alias("k"), (F.col("x") <= limit).alias("ok"))


def fdr_cutoff(p_values: DataFrame, alpha: float, column: str = "p", negatively_correlated: bool = False) -> float:
    """The largest p-value within its limit; 0 if there is none."""
    return fdr(p_values, alpha, column, negatively_correlated).filter("ok").agg(F.max("p")).first()[0] or 0.0


def fdr_q(p_values: DataFrame, k: int, column: str = "p") -> float:
    """The level at which just the first k p-values pass: the k-th value's p * (m + 1) / k."""
    counts = value_counts(p_values, column)
    m = p_values.select(count(column)).first()[0]
    row = counts.filter((F.col("below") < k) & (F.col("below") + F.col("n") >= k)).first()
    return min(1.0, row.x * (m + 1) / k)


def roc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """``(score, tp, fp)``: positives and negatives at or above each distinct score, descending."""
    from causeway.operators.ordering import running

    grouped = df.select(known(score).alias("score"), F.col(positive).cast("int").alias("y")).dropna().groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return running(grouped, "score", {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)


def auc(df: DataFrame, score: str, positive: str) -> float | None:
    """Area under the ROC curve; pairs of equal scores count half."""
    points = roc(df, score, positive)
    row = points.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.sum("pos"), F.sum("neg")).first()
    return None if not row[1] or not row[2] else row[0] / (row[1] * row[2])


def anderson_darling(df: DataFrame, column: str) -> tuple[float, float, float]:
    """A-squared of normality, its small-sample correction and p-value; sums run over distinct values."""
    from causeway.functions.distributions import column as dist

    x = known(column)
    m, s, n = df.select(F.avg(x), F.stddev_samp(x), F.count(x)).first()
    counts = value_counts(df, column)
    p = dist("normal_cdf", (F.col("x") - F.lit(m)) / F.lit(s))
    p = F.greatest(F.least(p, F.lit(1 - 1e-16)), F.lit(1e-300))
    a, c = F.col("below"), F.col("n")
    # Over places below+1 .. below+n: the odd weights 2i-1 add up to n*(2*below+n); from the other end, to n*(2*(N-below)-n).
    total = counts.select((c * (2 * a + c) * F.log(p) + c * (2 * (F.lit(n) - a) - c) * F.log(1 - p)).alias("t")).agg(F.sum("t")).first()[0]
    squared = -n - total / n
    star = squared * (1 + 0.75 / n + 2.25 / n**2)
    return squared, star, anderson_darling_p(star)


def anderson_darling_p(star: float) -> float:
    """D'Agostino and Stephens' p-value of a corrected A-squared, fixed pieces.

    Documented quirk: the last piece's square takes over beyond 153, so that it
    is above 1 from 307 on and infinite where it exceeds a double, as in SQL.
    """
    if star < 0.2:
        return 1 - math.exp(-13.436 + 101.14 * star - 223.73 * star**2)
    if star < 0.34:
        return 1 - math.exp(-8.318 + 42.796 * star - 59.938 * star**2)
    if star < 0.6:
        return math.exp(0.9177 - 4.279 * star - 1.38 * star**2)
    with np.errstate(over="ignore"):
        return float(np.exp(1.2937 - 5.709 * star + 0.0186 * star**2))
