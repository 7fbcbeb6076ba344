"""Covariances and contingency tables: the sufficient statistics of everything above them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.statistics import known
from causeway.operators.tables import variables

#: Columns of one block of the cross-product; wider tables are taken block by block.
BLOCK_COLUMNS = 256


@dataclass
class Covariance:
    """A named symmetric matrix and its sample size; stands in for a table."""

    names: list[str]
    matrix: np.ndarray
    n: int

    def index(self, name: str) -> int:
        return self.names.index(name)

    def sub(self, names: list[str]) -> Covariance:
        at = [self.index(x) for x in names]
        return Covariance(list(names), self.matrix[np.ix_(at, at)], self.n)

    def correlation(self) -> Covariance:
        d = np.sqrt(np.diag(self.matrix))
        return Covariance(self.names, self.matrix / np.outer(d, d), self.n)


@dataclass
class Gram:
    """Sums of products of (1, x...) over complete rows."""

    names: list[str]
    matrix: np.ndarray
    n: int


def gram_matrix(df: DataFrame, columns: list[str]) -> Gram:
    """Sums of products, by one pass: a partial matrix per task, added up by cell.

    Rows with a missing value are left out.  Values are shifted by the first
    complete row, so large means don't cancel digits.
    """
    rows = df.select(*[known(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    p = len(columns)
    if p > BLOCK_COLUMNS:
        return _wide_gram(df, columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 1, p + 1))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[b.column(i).to_numpy(zero_copy_only=False) for i in range(p)]])
            total += x.T @ x
        i, j = np.triu_indices(p + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], names=["i", "j", "v"])

    out = np.zeros((p + 1, p + 1))
    for r in rows.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return Gram(columns, out, int(round(out[0, 0])))


def _wide_gram(df: DataFrame, columns: list[str]) -> Gram:
    """Pairs of column blocks, each a job of its own over two blocks' columns; complete on all columns."""
    whole = df.dropna(subset=columns)
    p = len(columns)
    out = np.zeros((p + 1, p + 1))
    half = BLOCK_COLUMNS // 2
    blocks = [range(a, min(p, a + half)) for a in range(0, p, half)]
    n = 0
    for a, x in enumerate(blocks):
        for y in blocks[a:]:
            at = sorted({*x, *y})
            g = gram_matrix(whole, [columns[k] for k in at])
            index = [0, *[k + 1 for k in at]]
            out[np.ix_(index, index)] = g.matrix
            n = g.n
    return Gram(columns, out, n)


def covariance_matrix(df: DataFrame, columns: list[str] | None = None, divisor: int = 1) -> Covariance:
    """Covariances over complete rows, divided by n - ``divisor``; two passes, so that large means cost no digits."""
    cols = columns or variables(df)
    row = df.agg(*[F.avg(known(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    shifted = df.select(*[(known(f"`{c}`") - F.lit(row[f"m{i}"] or 0.0)).alias(f"s{i}") for i, c in enumerate(cols)])
    g = gram_matrix(shifted, shifted.columns)
    mean = g.matrix[0, 1:] / max(g.n, 1)
    return Covariance(cols, (g.matrix[1:, 1:] - g.n * np.outer(mean, mean)) / max(g.n - divisor, 1), g.n)


def covariance_frame(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``(by..., var_i, var_j, value)`` for each pair i <= j, from one aggregation with map-side partials."""
    by = by or []
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    wide = df.groupBy(*by).agg(*[F.covar_samp(known(f"`{a}`"), known(f"`{b}`")).alias(f"v{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("var_i"), F.lit(b).alias("var_j"), F.col(f"v{k}").alias("value")) for k, (a, b) in enumerate(pairs)])
    return wide.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def pairwise_covariance(df: DataFrame, columns: list[str]) -> Covariance:
    """Each entry over the rows that have both, centred at each column's own mean over all its rows, divided by the number of those rows."""
    row = df.agg(*[F.avg(known(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centred = [known(f"`{c}`") - F.lit(row[f"m{i}"]) for i, c in enumerate(columns)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    values = df.agg(*[F.avg(centred[i] * centred[j]).alias(f"v{k}") for k, (i, j) in enumerate(pairs)], F.count("*").alias("n")).first()
    out = np.zeros((len(columns),) * 2)
    for k, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = values[f"v{k}"]
    return Covariance(columns, out, values.n)


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> Covariance:
    return covariance_matrix(df, columns).correlation()


def kendall_covariance(df: DataFrame, columns: list[str]) -> Covariance:
    """Correlations of a nonparanormal from Kendall's tau: sin(pi/2 tau)."""
    from causeway.functions.statistics import kendalls_tau

    out = np.eye(len(columns))
    for i in range(len(columns)):
        for j in range(i):
            out[i, j] = out[j, i] = np.sin(np.pi / 2 * (kendalls_tau(df, columns[i], columns[j]) or 0.0))
    return Covariance(columns, out, df.count())


def partial_covariance(cov: Covariance, x: str, y: str, z: list[str]) -> float:
    xy, zs = [cov.index(x), cov.index(y)], [cov.index(v) for v in z]
    m = cov.matrix
    if not zs:
        return float(m[xy[0], xy[1]])
    return float(m[xy[0], xy[1]] - m[xy[0], zs] @ np.linalg.solve(m[np.ix_(zs, zs)], m[zs, xy[1]]))


def partial_variance(cov: Covariance, x: str, z: list[str]) -> float:
    return partial_covariance(cov, x, x, z)


def partial_correlation(cov: Covariance, x: str, y: str, z: list[str], generalized: bool = False) -> float:
    """From the inverse of the sub-matrix; a singular one gives NaN, or its pseudo-inverse if asked for."""
    at = [cov.index(v) for v in (x, y, *z)]
    sub = cov.matrix[np.ix_(at, at)]
    try:
        p = np.linalg.pinv(sub) if generalized else np.linalg.inv(sub)
    except np.linalg.LinAlgError:
        return float("nan")
    return float(np.clip(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1]), -1, 1))


# Contingency tables -------------------------------------------------------


def contingency(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each combination over rows that have all values; absent cells are 0."""
    return df.dropna(subset=columns).groupBy(*[F.col(f"`{c}`").alias(c) for c in columns]).agg(F.count("*").alias("n"))


def marginal(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.groupBy(*columns).agg(F.sum("n").alias("n"))


def cube_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of all combinations over all subsets of the columns in one job; ``subset`` marks the columns summed over (bits)."""
    return df.dropna(subset=columns).cube(*columns).agg(F.count("*").alias("n"), F.grouping_id().alias("subset"))


def conditional_probabilities(df: DataFrame, child: str, parents: list[str], prior: float = 0.0) -> DataFrame:
    """``(parents..., child, n, p)``, with a symmetric pseudo-count for each category of the child."""
    cells = contingency(df, [*parents, child])
    k = df.select(child).dropna().distinct().count()
    totals = marginal(cells, parents).withColumnRenamed("n", "total") if parents else cells.agg(F.sum("n").alias("total"))
    joined = cells.join(totals, parents) if parents else cells.crossJoin(F.broadcast(totals))
    return joined.select(*parents, child, "n", ((F.col("n") + prior) / (F.col("total") + prior * k)).alias("p"))


def counts_array(df: DataFrame, columns: list[str], sizes: list[int]) -> np.ndarray:
    """Counts of integer codes as a dense array; bounded by the product of the sizes."""
    out = np.zeros(sizes, np.int64)
    for r in contingency(df, columns).collect():
        out[tuple(r[:-1])] = r[-1]
    return out


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """``(bin, low, high, n)`` of equal width; by Sturges' rule if no number is given."""
    x = known(f"`{column}`")
    row = df.agg(F.min(x), F.max(x), F.count(x)).first()
    low, high, n = row
    k = bins or max(1, int(np.ceil(np.log2(n) + 1)))
    width = (high - low) / k if high > low else 1.0
    cell = F.least(F.lit(k - 1), F.floor((x - low) / width)).cast("int")
    counts = df.filter(x.isNotNull()).groupBy(cell.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left").select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def entropy(df: DataFrame, columns: list[str], base: float = 2.0) -> float:
    """Joint entropy of discrete columns."""
    cells = contingency(df, columns)
    row = cells.agg(F.sum("n"), F.sum(F.col("n") * F.log("n"))).first()
    return 0.0 if not row[0] else float((np.log(row[0]) - row[1] / row[0]) / np.log(base))


def mutual_information(df: DataFrame, child: str, parents: list[str], lag: int = 0) -> float:
    """Entropy of the child plus that of the parents less the joint one, parents ``lag`` rows back."""
    from causeway.operators.ordering import lagged
    from causeway.operators.tables import ROW

    data = df
    if lag:
        data = lagged(df, {f"__cw_{p}": (p, lag) for p in parents}).filter(F.col(ROW) >= lag)
        parents = [f"__cw_{p}" for p in parents]
    return entropy(data, [child]) + entropy(data, parents) - entropy(data, [child, *parents])


def mixed_mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Nearest-neighbour estimate for two continuous samples or one discrete (integer) and one continuous, on a bounded sample."""
    n = len(x)
    digamma = lambda m: np.log(m) - 1 / (2 * m) - 1 / (12 * m**2)
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    joint = np.maximum(dx, dy)
    np.fill_diagonal(joint, np.inf)
    total = 0.0
    for i in range(n):
        near = np.sort(joint[i])[k - 1]
        kk = k if near > 0 else int((joint[i] == 0).sum())
        nx, ny = int((dx[i] <= near).sum()), int((dy[i] <= near).sum())
        total += digamma(kk) + np.log(n) - digamma(nx) - digamma(ny)
    return max(0.0, total / n)
