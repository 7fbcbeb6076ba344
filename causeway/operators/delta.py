"""Tests that products of covariances vanish together, by the delta method.

A tetrad (a, b, c, d) is s_ab s_cd - s_ac s_bd; a sextad (a, b, c; d, e, f) is
the determinant of the covariances of its two triples.  Their joint covariance
follows from that of the covariances themselves: from fourth moments, which
one pass over the table gives, or, where there is a covariance or correlation
matrix alone, from normality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.distributions import chisq_tail
from causeway.functions.statistics import known
from causeway.operators.moments import Covariance

#: Columns whose fourth moments are taken together: their products' products fit a task.
COLUMNS = 40
#: A restriction: its value and its slope by each covariance (a pair of names in order).
Restriction = tuple[float, dict[tuple[str, str], float]]


@dataclass
class DeltaTest:
    """Chi-square tests of tetrads and sextads on a covariance matrix and the covariance of its entries."""

    cov: Covariance
    spread: Callable[[tuple[str, str], tuple[str, str]], float]

    def s(self, a: str, b: str) -> float:
        return float(self.cov.matrix[self.cov.index(a), self.cov.index(b)])

    def tetrad(self, a: str, b: str, c: str, d: str) -> Restriction:
        out: dict[tuple[str, str], float] = {}
        for x, y, slope in ((a, b, self.s(c, d)), (c, d, self.s(a, b)), (a, c, -self.s(b, d)), (b, d, -self.s(a, c))):
            out[_pair(x, y)] = out.get(_pair(x, y), 0.0) + slope
        return self.s(a, b) * self.s(c, d) - self.s(a, c) * self.s(b, d), out

    def sextad(self, a: str, b: str, c: str, d: str, e: str, f: str) -> Restriction:
        m = np.array([[self.s(x, y) for y in (d, e, f)] for x in (a, b, c)])
        slopes = np.cross(np.roll(m, -1, 0), np.roll(m, -2, 0))
        return float(m[0] @ slopes[0]), {_pair(x, y): float(slopes[i, j]) for i, x in enumerate((a, b, c)) for j, y in enumerate((d, e, f))}

    def joint(self, restrictions: list[Restriction], rank: int | None = None) -> tuple[float, int, float]:
        """``(chi-square, degrees of freedom, p)`` that all vanish.

        ``rank`` is how many of them are independent where that is known;
        else those are counted whose direction has a spread beyond rounding.
        """
        pairs = sorted({p for _, slopes in restrictions for p in slopes})
        values = np.array([v for v, _ in restrictions])
        slopes = np.array([[x.get(p, 0.0) for p in pairs] for _, x in restrictions])
        spread = np.array([[self.spread(p, q) for q in pairs] for p in pairs])
        sizes, directions = np.linalg.eigh(slopes @ spread @ slopes.T)
        held = sizes > 1e-10 * max(sizes[-1], 0) if sizes[-1] > 0 else np.zeros(len(sizes), bool)
        if rank is not None:
            held[: len(held) - rank] = False
        along = directions.T[held] @ values
        chi, df = float(self.cov.n * (along * along / sizes[held]).sum()), int(held.sum())
        return chi, df, float(chisq_tail(chi, df)) if df else 1.0

    def tetrads(self, *names: tuple[str, str, str, str]) -> tuple[float, int, float]:
        return self.joint([self.tetrad(*x) for x in names])

    def sextads(self, *names: tuple[str, ...]) -> tuple[float, int, float]:
        return self.joint([self.sextad(*x) for x in names])

    def one_factor(self, four: list[str]) -> float:
        """p-value that four variables have one common factor: their tetrads, of which two are independent."""
        a, b, c, d = four
        return self.tetrads((a, b, c, d), (a, b, d, c))[2]

    def two_factors(self, six: list[str]) -> float:
        """p-value that six variables have two common factors: all ten sextads, four of which are independent."""
        first, *rest = six
        splits = [((first, *two), tuple(x for x in rest if x not in two)) for two in combinations(rest, 2)]
        return self.joint([self.sextad(*x, *y) for x, y in splits], 4)[2]


def _pair(a: str, b: str) -> tuple[str, str]:
    return (a, b) if a <= b else (b, a)


def from_table(df: DataFrame, columns: list[str]) -> DeltaTest:
    """A test with the table's own fourth moments, over complete rows.

    One pass for means, one for the sums of products of all products of two
    columns, a partial matrix for each task; at most ``COLUMNS`` columns.
    Covariances have the divisor n - 1, fourth moments n.
    """
    if len(columns) > COLUMNS:
        raise ValueError(f"fourth moments of more than {COLUMNS} columns")
    whole = df.select(*[known(f"`{c}`").alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    row = whole.agg(*[F.avg(c).alias(c) for c in whole.columns]).first()
    means = np.array([row[c] or 0.0 for c in whole.columns])
    left, right = np.triu_indices(len(columns))
    i, j = np.triu_indices(len(left) + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(left) + 1, len(left) + 1))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - means
            products = np.column_stack([np.ones(len(x)), x[:, left] * x[:, right]])
            total += products.T @ products
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    sums = np.zeros((len(left) + 1, len(left) + 1))
    for r in whole.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r.i, r.j] = sums[r.j, r.i] = r.v
    n = int(round(sums[0, 0]))
    place = {_pair(columns[a], columns[b]): k + 1 for k, (a, b) in enumerate(zip(left.tolist(), right.tolist()))}
    matrix = np.zeros((len(columns),) * 2)
    matrix[left, right] = matrix[right, left] = sums[0, 1:] / max(n - 1, 1)
    at = {c: k for k, c in enumerate(columns)}
    second = lambda p: matrix[at[p[0]], at[p[1]]]
    return DeltaTest(Covariance(list(columns), matrix, n), lambda p, q: float(sums[place[p], place[q]] / max(n, 1) - second(p) * second(q)))


def from_covariance(cov: Covariance) -> DeltaTest:
    """A test on covariances of normal variables."""
    s = lambda a, b: float(cov.matrix[cov.index(a), cov.index(b)])
    return DeltaTest(cov, lambda p, q: s(p[0], q[0]) * s(p[1], q[1]) + s(p[0], q[1]) * s(p[1], q[0]))


def from_correlation(cov: Covariance) -> DeltaTest:
    """A test on correlations of normal variables, whose unit variances were estimated, too."""
    r = lambda a, b: float(cov.matrix[cov.index(a), cov.index(b)])

    def spread(p: tuple[str, str], q: tuple[str, str]) -> float:
        (e, f), (g, h) = p, q
        squares = r(e, g) ** 2 + r(e, h) ** 2 + r(f, g) ** 2 + r(f, h) ** 2
        return r(e, f) * r(g, h) * squares / 2 + r(e, g) * r(f, h) + r(e, h) * r(f, g) - r(e, f) * (r(f, g) * r(f, h) + r(e, g) * r(e, h)) - r(g, h) * (r(f, g) * r(e, g) + r(f, h) * r(e, h))

    return DeltaTest(cov, spread)
