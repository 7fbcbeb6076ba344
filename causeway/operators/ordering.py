"""Global order on a distributed table: row numbers, running sums, lags, order statistics.

A window without partitions would bring all rows to one task.  Here the order
key is cut at approximate quantiles into buckets; each bucket is a window
partition, and the totals of the buckets before it, a table of at most
``BUCKETS`` rows, are added.  Every step is deterministic, so nothing needs to
be cached for two passes to agree.
"""

from __future__ import annotations

import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a global order; their boundaries are the only rows that reach the driver.
BUCKETS = 200
#: Rows of one bucket of a dense row number.
ROWS = 1_000_000


def cut_points(df: DataFrame, key: str, buckets: int = BUCKETS) -> list[float]:
    """Approximate quantiles of a numeric key, at most ``buckets`` - 1 of them."""
    number = F.col(f"`{key}`").cast("double")
    cuts = df.select(F.percentile_approx(F.when(~F.isnan(number), number), [(i + 1) / buckets for i in range(buckets - 1)], 10_000).alias("c")).first().c or []
    return sorted({c for c in cuts if c == c and abs(c) != float("inf")})


def _bucketed(df: DataFrame, key: str, buckets: int, cuts: list[float] | None = None) -> tuple[DataFrame, str]:
    """``df`` with a bucket number that grows with a numeric key; null and NaN keys come first."""
    name = f"__cw_b{uuid.uuid4().hex[:8]}"
    value = f"__cw_v{uuid.uuid4().hex[:8]}"
    number = F.col(f"`{key}`").cast("double")
    splits = [float("-inf"), *(cut_points(df, key, buckets) if cuts is None else cuts), float("inf")]
    with_value = df.withColumn(value, number)
    out = Bucketizer(splits=splits, inputCol=value, outputCol=name, handleInvalid="keep").transform(with_value)
    # NaN and null get the last number; they are to come first.
    return out.withColumn(name, F.when(number.isNull() | F.isnan(number), -1.0).otherwise(F.col(name))).drop(value), name


def running(df: DataFrame, key: str, sums: dict[str, Column], ties: list[str] | None = None, descending: bool = False, inclusive: bool = True, buckets: int = BUCKETS, cuts: list[float] | None = None) -> DataFrame:
    """``df`` with running sums over the order of ``key``, then of the columns in ``ties``.

    ``sums`` maps new columns to what they add up; with ``inclusive`` a row's
    own value counts.  Rows that tie in everything are ordered arbitrarily.
    ``cuts`` (from ``cut_points``) spares a pass where the keys are known.
    """
    cut, b = _bucketed(df, key, buckets, cuts)
    totals = cut.groupBy(b).agg(*[F.sum(c).alias(f"{n}__t") for n, c in sums.items()])
    over = Window.orderBy(F.col(b).desc() if descending else F.col(b)).rowsBetween(Window.unboundedPreceding, -1)
    # A row for each bucket: this window is small whatever the table.
    before = totals.select(F.col(b).alias(f"{b}k"), *[F.coalesce(F.sum(f"{n}__t").over(over), F.lit(0)).alias(f"{n}__o") for n in sums])
    order = [F.col(f"`{c}`").desc() if descending and c == key else F.col(f"`{c}`") for c in [key, *(ties or [])]]
    own = Window.partitionBy(b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = cut.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"{n}__r") for n, c in sums.items()]).join(F.broadcast(before), F.col(b) == F.col(f"{b}k"), "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"{n}__r") + F.coalesce(F.col(f"{n}__o"), F.lit(0))).alias(n) for n in sums])


def with_row_number(df: DataFrame, key: str, ties: list[str] | None = None, name: str = "_row", start: int = 0) -> DataFrame:
    """``df`` with a dense number in the order of ``key`` and ``ties``."""
    return running(df, key, {name: F.lit(1).cast("long")}, ties).withColumn(name, F.col(name) - 1 + start)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(x, n, below)``: each distinct non-missing value, its rows and the rows below it."""
    x = F.col(f"`{column}`").cast("double")
    counts = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("x").agg(F.count("*").alias("n"))
    return running(counts, "x", {"below": F.col("n")}, inclusive=False)


def order_statistics(df: DataFrame, column: str, positions: list[int]) -> dict[int, float]:
    """Values at 0-based places of the sorted non-missing values, exactly."""
    counts = value_counts(df, column)
    wanted = F.array(*[F.lit(int(p)).cast("long") for p in positions])
    hits = F.filter(wanted, lambda p: (p >= F.col("below")) & (p < F.col("below") + F.col("n")))
    return {int(r.p): r.x for r in counts.select("x", F.explode(hits).alias("p")).distinct().collect()}


def average_ranks(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """``df`` with 1-based ranks, ties averaged; null for missing values."""
    ranks = value_counts(df, column).select(F.col("x").alias("__cw_x"), (F.col("below") + (F.col("n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(f"`{column}`").cast("double") == F.col("__cw_x"), "left").drop("__cw_x")


def ecdf_ranks(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """``df`` with the number of values at most a row's own."""
    ranks = value_counts(df, column).select(F.col("x").alias("__cw_x"), (F.col("below") + F.col("n")).cast("double").alias(name))
    return df.join(ranks, F.col(f"`{column}`").cast("double") == F.col("__cw_x"), "left").drop("__cw_x")


def lagged(df: DataFrame, columns: dict[str, tuple[str, int]], row: str = "_row", block: int = ROWS) -> DataFrame:
    """``df`` with columns shifted along a dense row number: new name -> (column, rows back; negative: ahead).

    Each block of rows is a window partition that also holds the rows which
    its neighbours' shifts reach.
    """
    back = max([0, *(k for _, k in columns.values())])
    ahead = max([0, *(-k for _, k in columns.values())])
    home = F.floor(F.col(row) / block).cast("long")
    places = F.array_distinct(F.array(home, F.floor((F.col(row) + back) / block).cast("long"), F.floor((F.col(row) - ahead) / block).cast("long")))
    dealt = df.withColumn("__cw_home", home).withColumn("__cw_block", F.explode(places))
    over = Window.partitionBy("__cw_block").orderBy(row)
    shifted = [F.lag(f"`{c}`", k).over(over).alias(n) if k >= 0 else F.lead(f"`{c}`", -k).over(over).alias(n) for n, (c, k) in columns.items()]
    if back > block or ahead > block:
        raise ValueError("shifts must not exceed a block")
    return dealt.select("*", *shifted).filter("__cw_block = __cw_home").drop("__cw_home", "__cw_block")
