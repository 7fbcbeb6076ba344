"""Discretization, imputation and resampling."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.statistics import known
from causeway.operators.moments import Covariance
from causeway.operators.ordering import order_statistics, with_row_number
from causeway.operators.regression import ols
from causeway.operators.tables import ROW, kind, uniform, variables

# Discretization ------------------------------------------------------------------


def discretize(df: DataFrame, column: str, cutoffs: list[float], name: str | None = None) -> DataFrame:
    """Codes 0..k by left-closed bins; missing stays missing, infinities of either sign fall into the last bin."""
    x = known(f"`{column}`")
    cuts = sorted(set(cutoffs))
    splits = [float("-inf"), *cuts, float("inf")]
    out = Bucketizer(splits=splits, inputCol="__cw_x", outputCol="__cw_k", handleInvalid="keep").transform(df.withColumn("__cw_x", F.coalesce(x, F.lit(float("nan")))))
    infinite = F.abs(F.col("__cw_x")) == float("inf")
    code = F.when(x.isNull(), F.lit(None)).when(infinite, F.lit(len(cuts))).otherwise(F.col("__cw_k")).cast("int")
    return out.withColumn(name or column, code).drop("__cw_x", "__cw_k")


def interval_cutoffs(df: DataFrame, column: str, bins: int) -> list[float]:
    """Cutoffs of bins of equal width."""
    low, high = df.select(F.min(known(f"`{column}`")), F.max(known(f"`{column}`"))).first()
    return [low + (high - low) / bins * k for k in range(1, bins)]


def count_cutoffs(df: DataFrame, column: str, bins: int) -> list[float]:
    """Cutoffs of bins of equal counts: the values at sorted places (n div bins) * k."""
    n = df.select(F.count(known(f"`{column}`"))).first()[0]
    places = [(n // bins) * k for k in range(1, bins)]
    at = order_statistics(df, column, places)
    return [at[p] for p in places]


def equal_intervals(df: DataFrame, column: str, bins: int, name: str | None = None) -> DataFrame:
    return discretize(df, column, interval_cutoffs(df, column, bins), name)


def equal_counts(df: DataFrame, column: str, bins: int, name: str | None = None) -> DataFrame:
    return discretize(df, column, count_cutoffs(df, column, bins), name)


def discretize_all(df: DataFrame, bins: int, by_count: bool = False) -> DataFrame:
    """Every continuous column in bins."""
    out = df
    for c in variables(df):
        if kind(df, c) == "continuous":
            out = discretize(out, c, (count_cutoffs if by_count else interval_cutoffs)(df, c, bins))
    return out


def remap(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    """Discrete values by a table; values outside it become missing."""
    pairs = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return df.withColumn(column, pairs[F.col(f"`{column}`")])


# Missing values --------------------------------------------------------------------


def inject_missing(df: DataFrame, probabilities: dict[str, float], seed: int, key: str = ROW) -> DataFrame:
    """Values lost at random; which ones depends on the seed, the column and the row's key alone."""
    return df.select(*[F.when(uniform(seed, F.lit(c), F.col(key)) >= probabilities.get(c, 0.0), F.col(f"`{c}`")).alias(c) if c in probabilities else F.col(f"`{c}`") for c in df.columns])


def impute_mean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Means in continuous columns."""
    cols = columns or [c for c in variables(df) if kind(df, c) == "continuous"]
    row = df.agg(*[F.avg(known(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    at = {c: i for i, c in enumerate(cols)}
    return df.select(*[F.coalesce(known(f"`{c}`"), F.lit(row[f"m{at[c]}"])).alias(c) if c in at else F.col(f"`{c}`") for c in df.columns])


def impute_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The most frequent value (of ties the lowest) in discrete columns, the median in continuous ones."""
    out = df
    for c in columns or variables(df):
        if kind(df, c) == "continuous":
            value = df.select(F.percentile(known(f"`{c}`"), 0.5)).first()[0]
            out = out.withColumn(c, F.coalesce(known(f"`{c}`"), F.lit(value)))
        else:
            top = df.filter(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).count().orderBy(F.desc("count"), "v").first()
            if top is not None:
                out = out.withColumn(c, F.coalesce(F.col(f"`{c}`"), F.lit(top.v)))
    return out


def impute_regression(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Predictions from all other columns (means where those are missing), the column with most missing values first; fitted on complete rows."""
    cols = columns or [c for c in variables(df) if kind(df, c) == "continuous"]
    counts = df.agg(*[F.sum(known(f"`{c}`").isNull().cast("long")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    filled, out = impute_mean(df, cols), df
    for i in sorted(range(len(cols)), key=lambda i: (-(counts[f"n{i}"] or 0), i)):
        c, others = cols[i], [o for o in cols if o != cols[i]]
        if not counts[f"n{i}"]:
            continue
        fit = ols(df, c, others, generalized=True)
        means = filled.agg(*[F.avg(f"`{o}`").alias(f"m{k}") for k, o in enumerate(others)]).first()
        value = F.lit(float(fit.coefficients[0]))
        for k, (o, b) in enumerate(zip(others, fit.coefficients[1:])):
            value = value + F.lit(float(b)) * F.coalesce(known(f"`{o}`"), F.lit(means[f"m{k}"]))
        out = out.withColumn(c, F.coalesce(known(f"`{c}`"), value))
    return out


def impute_category(df: DataFrame, column: str, label: str = "Missing") -> DataFrame:
    """Missing values as a category of their own, in a column named with ``+``."""
    return df.withColumnRenamed(column, f"{column}+").withColumn(f"{column}+", F.coalesce(F.col(f"`{column}+`").cast("string"), F.lit(label)))


def impute_random(df: DataFrame, columns: list[str], seed: int, key: str = ROW) -> DataFrame:
    """Draws from the observed values: uniform over the range of continuous columns, by frequency of discrete ones."""
    out = df
    for c in columns:
        u = uniform(seed, F.lit(c), F.col(key))
        if kind(df, c) == "continuous":
            low, high = df.select(F.min(known(f"`{c}`")), F.max(known(f"`{c}`"))).first()
            draw = F.lit(low) + u * F.lit((high or 0) - (low or 0))
            out = out.withColumn(c, F.coalesce(known(f"`{c}`"), draw))
        else:
            rows = df.filter(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).count().orderBy("v").collect()
            total, seen, draw = sum(r["count"] for r in rows), 0, None
            for r in rows:
                seen += r["count"]
                test = u < seen / total
                draw = F.when(test, F.lit(r.v)) if draw is None else draw.when(test, F.lit(r.v))
            if draw is not None:
                out = out.withColumn(c, F.coalesce(F.col(f"`{c}`"), draw))
    return out


def noisy_zeroes(df: DataFrame, seed: int) -> DataFrame:
    """Standard normal noise in columns that are all zero."""
    cols = [c for c in variables(df) if kind(df, c) == "continuous"]
    row = df.agg(*[F.max(F.abs(known(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return df.select(*[F.randn(seed + cols.index(c)).alias(c) if c in cols and row[f"m{cols.index(c)}"] == 0 else F.col(f"`{c}`") for c in df.columns])


# Resampling -------------------------------------------------------------------------


def bootstrap(df: DataFrame, size: int, seed: int, replicates: int = 1) -> DataFrame:
    """Exactly ``size`` draws with replacement for each replicate, by row number; numbered anew."""
    n = df.count()
    draws = df.sparkSession.range(size * replicates).select((F.col("id") % size).alias("__cw_at"), F.floor(F.col("id") / size).cast("int").alias("replicate"), F.floor(uniform(seed, F.col("id")) * n).cast("long").alias("__cw_row"))
    return draws.join(df, F.col("__cw_row") == F.col(ROW)).select("replicate", *[F.col("__cw_at").alias(ROW) if c == ROW else F.col(f"`{c}`") for c in df.columns])


def subsample(df: DataFrame, size: int, seed: int, replicates: int = 1) -> DataFrame:
    """Exactly ``size`` rows without replacement for each replicate: those of the smallest draws."""
    from functools import reduce

    parts = []
    for r in range(replicates):
        drawn = df.withColumn("__cw_u", uniform(seed, F.lit(r), F.col(ROW)))
        parts.append(with_row_number(drawn, "__cw_u", [ROW], "__cw_k").filter(F.col("__cw_k") < size).select(F.lit(r).alias("replicate"), *[F.col(f"`{c}`") for c in df.columns]))
    return reduce(lambda a, b: a.union(b), parts)


def folds(df: DataFrame, k: int, seed: int) -> DataFrame:
    """Fold numbers of near-equal sizes, the first ones larger by one."""
    n = df.count()
    base, more = divmod(n, k)
    shuffled = with_row_number(df.withColumn("__cw_u", uniform(seed, F.col(ROW))), "__cw_u", [ROW], "__cw_k")
    edge = more * (base + 1)
    fold = F.when(F.col("__cw_k") < edge, F.floor(F.col("__cw_k") / (base + 1))).otherwise(more + F.floor((F.col("__cw_k") - edge) / max(base, 1)))
    return shuffled.withColumn("fold", fold.cast("int")).drop("__cw_u", "__cw_k")


def leave_one_out(df: DataFrame, most: int = 10_000) -> DataFrame:
    """Every row left out once; ``fold`` is the row left out.  Its size is that of the table squared, so tables over ``most`` rows are refused."""
    n = df.count()
    if n > most:
        raise ValueError(f"leave-one-out of {n} rows")
    return df.sparkSession.range(n).withColumnRenamed("id", "fold").join(df, F.col("fold") != F.col(ROW))


def complementary_pairs(df: DataFrame, pairs: int, seed: int) -> DataFrame:
    """Random halves: ``pair`` and ``half`` (0 or 1) of each row."""
    from functools import reduce

    parts = [folds(df, 2, seed + p).withColumn("pair", F.lit(p)).withColumnRenamed("fold", "half") for p in range(pairs)]
    return reduce(lambda a, b: a.union(b), parts)


def subsample_size(n: int) -> int:
    """floor(10 sqrt n), or three quarters where that isn't smaller."""
    b = int(10 * np.sqrt(n))
    return b if b < n else 3 * n // 4


def gaussian_like(spark, cov: Covariance, rows: int, seed: int) -> DataFrame:
    """Rows of a centred normal with a given covariance."""
    factor = np.linalg.cholesky(cov.matrix)
    base = spark.range(rows).select(F.col("id").alias(ROW), *[F.randn(seed + i).alias(f"__z{i}") for i in range(len(cov.names))])

    def mixed(i: int) -> Column:
        out = F.lit(0.0)
        for j in range(i + 1):
            out = out + F.lit(float(factor[i, j])) * F.col(f"__z{j}")
        return out.alias(cov.names[i])

    return base.select(ROW, *[mixed(i) for i in range(len(cov.names))])
