"""Sufficient statistics of unbounded tables, kept up to date by Structured Streaming.

The surveyed library has no streams; its statistics are sums, so they can be
kept incrementally: a streaming aggregation holds counts and sums of products,
from which covariances and contingency tests are read at any time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from causeway.functions.statistics import known
from causeway.operators.moments import Covariance


def running_moments(stream: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Counts, sums and sums of products of complete rows, by group; a streaming aggregation."""
    rows = stream.select(*(by or []), *[known(f"`{c}`").alias(f"x{i}") for i, c in enumerate(columns)]).dropna(subset=[f"x{i}" for i in range(len(columns))])
    k = range(len(columns))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in k], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i in k for j in k if i <= j])


def covariance_of(row, columns: list[str]) -> Covariance:
    """The covariance that a row of ``running_moments`` stands for."""
    p = len(columns)
    s, q = np.array([row[f"s{i}"] for i in range(p)]), np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            q[i, j] = q[j, i] = row[f"q{i}_{j}"]
    return Covariance(columns, (q - np.outer(s, s) / row["n"]) / (row["n"] - 1), row["n"])


def windowed_counts(stream: DataFrame, time: str, columns: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Contingency counts in tumbling windows, rows later than the watermark dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *columns).agg(F.count("*").alias("n"))


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Start a query into an in-memory table, for inspection and tests."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).start()
