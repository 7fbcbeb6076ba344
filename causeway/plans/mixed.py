"""Pairwise graphical models over continuous, discrete and right-censored survival columns, fitted on a whole table.

The loss is a sum of conditional likelihoods: a normal one for each continuous
column, a softmax for each discrete one, and a Cox partial likelihood (Efron's
correction for ties) for each survival column, whose parents are all other
columns.  Pairs carry group penalties of five kinds: continuous pairs (cc),
mixed pairs (cd), discrete pairs (dd), survival with continuous (sc) and with
discrete (sd).

Rows stay on the executors, packed into cells of bounded size, in a cell by
their combination of codes: rows of one combination share all indicators, so
their sums go over the continuous columns alone.  A step of the fit takes sums
over cells: the normal part needs the sums of products alone, taken once; the
softmax part one pass; the Cox part up to three, because risk sets reach over
cells: sums of weights, then of hazards (only in cells of three times or more),
then of gradients, in one pass with the softmax part.  A few numbers for each
cell reach the driver, which solves the small penalized quadratic that the sums
define (proximal Newton steps).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.statistics import known
from causeway.operators import tables
from causeway.operators.ordering import ROWS
from causeway.operators.scratch import drop, stored
from causeway.plans.graphs import TAIL, Graph

KINDS = ("cc", "cd", "dd", "sc", "sd")
#: Rows of a cell; at most 65,536.
CELL = 20_000
#: Rows of a combination of codes, on average over a cell, from which combinations are taken one by one.
SHARED = 16
#: Events of one time from which their sum is taken in closed form.
MANY_TIES = 1_000
#: Categories of one discrete column; more are refused.
MOST_CATEGORIES = 100


@dataclass
class Survival:
    """A right-censored column: its name, the column of times and the 0/1 column of events."""

    name: str
    time: str
    event: str


@dataclass
class Pair:
    """Two columns and the group of parameters that joins them."""

    a: str
    b: str
    kind: str
    at: np.ndarray
    weight: float


@dataclass
class Model:
    """A fitted model: parameters in one vector, and what its parts mean."""

    names: list[str]
    categories: dict[str, list]
    means: dict[str, float]
    deviations: dict[str, float]
    pairs: list[Pair]
    parameters: np.ndarray
    layout: "_Layout"
    objective: float
    gap: float
    n: int
    steps: int = 0

    def norm(self, pair: Pair) -> float:
        return float(np.linalg.norm(self.parameters[pair.at]))

    def graph(self) -> Graph:
        g = Graph(self.names)
        for x in self.pairs:
            if self.norm(x) > 0:
                g.add(x.a, x.b, TAIL, TAIL)
        return g

    def part(self, name: str) -> np.ndarray:
        """precision, intercept, beta, theta, phi, base, gamma or eta."""
        return self.layout.part(self.parameters, name)


@dataclass
class _Layout:
    """Where each parameter lies, and which of them each column's conditional distribution uses."""

    p: int
    levels: list[int]
    r: int
    at: dict[str, np.ndarray] = field(default_factory=dict)
    size: int = 0

    def __post_init__(self) -> None:
        p, q, r = self.p, sum(self.levels), self.r
        for name, shape in (("precision", (p,)), ("intercept", (p,)), ("beta", (p, p)), ("theta", (p, q)), ("phi", (q, q)), ("base", (q,)), ("gamma", (p, r)), ("eta", (q, r))):
            if name == "beta":
                out = self._symmetric(p, [(i, i + 1) for i in range(p)])
            elif name == "phi":
                out = self._symmetric(q, [(a, b) for a, b in zip(self.cuts, self.cuts[1:])])
            else:
                out = self._new(int(np.prod(shape))).reshape(shape)
            self.at[name] = out

    @property
    def cuts(self) -> list[int]:
        return np.concatenate([[0], np.cumsum(self.levels)]).astype(int).tolist()

    def _new(self, n: int) -> np.ndarray:
        self.size += n
        return np.arange(self.size - n, self.size)

    def _symmetric(self, n: int, own: list[tuple[int, int]]) -> np.ndarray:
        """A place for each pair of different blocks, the same one on both sides; -1 within a block."""
        block = np.repeat(np.arange(len(own)), [b - a for a, b in own])
        i, j = np.nonzero(block[:, None] < block[None, :])
        out = np.full((n, n), -1)
        out[i, j] = out[j, i] = self._new(len(i))
        return out

    def part(self, v: np.ndarray, name: str) -> np.ndarray:
        at = self.at[name]
        return np.where(at >= 0, v[at], 0.0)

    def normal(self, s: int) -> np.ndarray:
        """Places of a continuous column's coefficients of (1, continuous, indicators)."""
        return np.concatenate([[self.at["intercept"][s]], self.at["beta"][s], self.at["theta"][s]])

    def softmax(self, j: int) -> np.ndarray:
        """Places of a discrete column's coefficients, a column for each of its categories."""
        own = slice(self.cuts[j], self.cuts[j + 1])
        return np.vstack([self.at["base"][None, own], self.at["theta"][:, own], self.at["phi"][:, own]])

    def cox(self, k: int) -> np.ndarray:
        return np.concatenate([self.at["gamma"][:, k], self.at["eta"][:, k]])


# Preparation ----------------------------------------------------------------------------


@dataclass
class _Data:
    cells: DataFrame
    n: int
    gram: np.ndarray
    hits: np.ndarray
    events: list[int]
    layout: _Layout
    categories: dict[str, list]
    means: dict[str, float]
    deviations: dict[str, float]


def _packed(rows: pa.Table, k: int, cell: int, p: int, q: int, r: int) -> dict:
    """A cell: its rows in the order of their codes, each combination and its size, and the place of each row's time among the cell's times."""
    n, column = rows.num_rows, lambda c, kind: rows.column(c).to_numpy().astype(kind)
    x, y = [column(f"x{i}", np.float64) for i in range(p)], [column(f"y{j}", np.uint8) for j in range(q)]
    order = np.lexsort(y) if q else np.arange(n)
    codes = np.array([v[order] for v in y]).reshape(q, n)
    start = np.flatnonzero(np.concatenate([[True], (codes[:, 1:] != codes[:, :-1]).any(0)]))
    out = {"k": k, "cell": cell, "n": n, "u": 0, "x": np.array([v[order] for v in x]).tobytes(), "y": codes[:, start].T.astype(np.int32).tobytes(), "m": np.diff([*start, n]).astype(np.int32).tobytes(), "t": b"", "g": b"", "e": b""}
    if r:
        t = column("t", np.float64)
        new = np.concatenate([[True], t[1:] != t[:-1]])
        out |= {"u": int(new.sum()), "t": t[new].tobytes(), "g": (np.cumsum(new) - 1)[order].astype(np.uint16).tobytes(), "e": column("e", np.int8)[order].tobytes()}
    return out


def _packer(k: int, p: int, q: int, r: int):
    """Batches, in the order of times if there are any, to cells numbered in the order of partitions and rows."""
    most = CELL

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            while rows >= most:
                table = pa.Table.from_batches(held)
                yield pa.RecordBatch.from_pylist([_packed(table.slice(0, most), k, number, p, q, r)], schema=_ARROW)
                number, held, rows = number + 1, table.slice(most).to_batches(), rows - most
        if rows:
            yield pa.RecordBatch.from_pylist([_packed(pa.Table.from_batches(held), k, number, p, q, r)], schema=_ARROW)

    return pack


_CELLS = "k int, cell long, n int, u int, x binary, y binary, m binary, t binary, g binary, e binary"
_ARROW = pa.schema([(c, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for c, t in (f.split() for f in _CELLS.split(", "))])


def prepare(df: DataFrame, continuous: list[str], discrete: list[str], survival: list[Survival]) -> _Data:
    """Complete rows, standardized and coded, in cells; for each survival column once more in the order of its times.

    Rows with a missing value in any of the columns are left out.  Constant
    continuous columns are refused, as are times below 0 and events that are
    neither 0 nor 1.
    """
    p, q, r = len(continuous), len(discrete), len(survival)
    categories = {c: tables.categories(df, c, MOST_CATEGORIES) for c in discrete}
    codes = [F.array_position(F.array(*map(F.lit, categories[c])), F.col(f"`{c}`")).cast("int") - 1 if categories[c] else F.lit(None).cast("int") for c in discrete]
    columns = [known(f"`{c}`").alias(f"x{i}") for i, c in enumerate(continuous)] + [F.when(c >= 0, c).alias(f"y{j}") for j, c in enumerate(codes)]
    columns += [c for k, s in enumerate(survival) for c in (known(f"`{s.time}`").alias(f"t{k}"), F.col(f"`{s.event}`").cast("int").alias(f"e{k}"))]
    rows = df.select(*columns).dropna()
    row = rows.agg(F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], *[F.stddev_samp(f"x{i}").alias(f"s{i}") for i in range(p)], *[f for k in range(r) for f in (F.sum(f"e{k}").alias(f"d{k}"), F.min(f"t{k}").alias(f"low{k}"), F.count_if(~F.col(f"e{k}").isin(0, 1)).alias(f"odd{k}"))]).first()
    if not row.n:
        raise ValueError("no complete row")
    for i, c in enumerate(continuous):
        if not row[f"s{i}"]:
            raise ValueError(f"{c} is constant")
    for k, s in enumerate(survival):
        if row[f"low{k}"] < 0 or row[f"odd{k}"]:
            raise ValueError(f"{s.name}: times must not be negative, and events are 0 or 1")
    scaled = rows.select(*[((F.col(f"x{i}") - row[f"m{i}"]) / row[f"s{i}"]).alias(f"x{i}") for i in range(p)], *[c for c in rows.columns if c[0] != "x"])
    wanted = [f"x{i}" for i in range(p)] + [f"y{j}" for j in range(q)]
    if r:
        cores, parts = df.sparkSession.sparkContext.defaultParallelism, []
        # Range partitions hold consecutive times; rows of one time may lie in several, by their hash.
        n = max(1, min(-(-row.n // CELL), max(cores, -(-row.n // ROWS))))
        for k in range(r):
            own = scaled.select(*wanted, F.col(f"t{k}").alias("t"), F.col(f"e{k}").alias("e"))
            ordered = own.withColumn("_hash", F.xxhash64(*own.columns)).repartitionByRange(n, "t", "_hash").sortWithinPartitions("t")
            parts.append(ordered.drop("_hash").mapInArrow(_packer(k, p, q, r), _CELLS))
        packed = parts[0]
        for x in parts[1:]:
            packed = packed.unionByName(x)
    else:
        packed = scaled.select(*wanted).mapInArrow(_packer(0, p, q, 0), _CELLS)
    layout = _Layout(p, [len(categories[c]) for c in discrete], r)
    data = _Data(stored(packed, "mixed-cells"), row.n, np.empty(0), np.empty(0), [int(row[f"d{k}"] or 0) for k in range(r)], layout, categories, {c: row[f"m{i}"] for i, c in enumerate(continuous)}, {c: row[f"s{i}"] for i, c in enumerate(continuous)})
    m = 1 + p + sum(layout.levels)

    def of(k: int, c: int, cell: _Cell, *times: bytes) -> Iterator[tuple[int, np.ndarray]]:
        if k == 0:
            yield -1, cell.products(np.ones(cell.z.shape[1])).ravel()
        if r:
            yield k, cell.total(np.frombuffer(times[2], np.int8)[None].astype(np.float64))[0]

    found = _sums(data, of)
    data.gram = found[-1].reshape(m, m) / row.n
    data.hits = np.array([found[k] for k in range(r)])
    return data


class _Cell:
    """A cell's design (1, continuous, indicators), a column for each row.

    Rows of one combination of codes lie together, and their indicators are
    held once.  Where combinations are nearly as many as rows, indicators are
    held like continuous columns instead.
    """

    def __init__(self, layout: _Layout, n: int, x: bytes, y: bytes, m: bytes) -> None:
        sizes, q = np.frombuffer(m, np.int32), len(layout.levels)
        codes, marks = np.frombuffer(y, np.int32).reshape(len(sizes), q), np.zeros((len(sizes), sum(layout.levels)))
        for j, a in enumerate(layout.cuts[:-1]):
            marks[np.arange(len(sizes)), a + codes[:, j]] = 1
        z = [np.ones((1, n)), np.frombuffer(x, np.float64).reshape(layout.p, n)]
        if len(sizes) * SHARED > n:
            z, marks, sizes = [*z, np.repeat(marks, sizes, axis=0).T], np.zeros((1, 0)), np.array([n])
        self.z, self.marks, self.sizes = np.vstack(z), marks, sizes
        ends = np.cumsum(sizes)
        self.groups = list(zip(ends - sizes, ends))

    def linear(self, c: np.ndarray) -> np.ndarray:
        """c'z of each row, for each column of ``c``."""
        wide = len(self.z)
        return c[:wide].T @ self.z + np.repeat((self.marks @ c[wide:]).T, self.sizes, axis=1)

    def total(self, w: np.ndarray) -> np.ndarray:
        """The sum of w z over the rows, for each line of ``w``."""
        own = np.array([w[:, a:b] @ self.z[:, a:b].T for a, b in self.groups])
        return np.hstack([own.sum(0), own[:, :, 0].T @ self.marks])

    def products(self, w: np.ndarray) -> np.ndarray:
        """The sum of w z z' over the rows."""
        heavy = self.z * w
        own = np.array([heavy[:, a:b] @ self.z[:, a:b].T for a, b in self.groups])
        cross = own[:, 0].T @ self.marks
        return np.vstack([np.hstack([own.sum(0), cross]), np.hstack([cross.T, (self.marks * own[:, :1, 0]).T @ self.marks])])


def _unpacked(layout: _Layout, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(k, number, cell, its times, places among them, events)`` of each cell, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            k, c, n, x, y, m, *times = (col[i].as_py() for col in b.columns)
            yield k, c, _Cell(layout, n, x, y, m), *times


def _sums(data: _Data, of) -> dict[int, np.ndarray]:
    """Sums over all cells of the numbered vectors that ``of`` makes of a cell; a partial sum for each task."""
    layout, arrow = data.layout, pa.schema([("j", pa.int32()), ("i", pa.int32()), ("v", pa.float64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for cell in _unpacked(layout, batches):
            for j, v in of(*cell):
                totals[j] = totals[j] + v if j in totals else v
        for j, v in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), j), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], schema=arrow)

    out = {}
    for j, i, v in data.cells.select("k", "cell", "n", "x", "y", "m", "t", "g", "e").mapInArrow(partial, "j int, i int, v double").groupBy("j", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(j, {})[i] = v
    return {j: np.array([v[i] for i in range(len(v))]) for j, v in out.items()}


# The three kinds of conditional likelihood ------------------------------------------------


def _normal_part(data: _Data, v: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> float:
    """Mean negative log likelihoods of the continuous columns, from the sums of products.

    With precision b and the linear part u = c'z, a row's term is
    b x^2 / 2 - x u + u^2 / (2 b) - log(b) / 2, convex in (b, c).
    """
    loss, g = 0.0, data.gram
    for s in range(data.layout.p):
        at, b_at = data.layout.normal(s), data.layout.at["precision"][s]
        own = np.flatnonzero(at >= 0)
        at, b = at[own], v[b_at]
        if b <= 0:
            return np.inf
        gs, gc = g[own, 1 + s], g[np.ix_(own, own)]
        c = v[at]
        u = gc @ c
        cgc = float(c @ u)
        loss += -np.log(b) / 2 + b * g[1 + s, 1 + s] / 2 - float(gs @ c) + cgc / (2 * b)
        grad[b_at] += -1 / (2 * b) + g[1 + s, 1 + s] / 2 - cgc / (2 * b * b)
        grad[at] += u / b - gs
        hess[b_at, b_at] += 1 / (2 * b * b) + cgc / b**3
        hess[np.ix_(at, at)] += gc / b
        hess[b_at, at] -= u / (b * b)
        hess[at, b_at] -= u / (b * b)
    return loss


def _softmax_sums(layout: _Layout, v: np.ndarray):
    """What a cell adds to the discrete columns' likelihoods: for each column its log sums, shares and second moments of shares."""
    coefficients = [np.where(at >= 0, v[at], 0.0) for at in map(layout.softmax, range(len(layout.levels)))]

    def of(cell: _Cell) -> np.ndarray:
        out = []
        for c in coefficients:
            share = cell.linear(c)
            top = share.max(0)
            share = np.exp(share - top)
            total = share.sum(0)
            share /= total
            out += [[float(np.log(total).sum() + top.sum())], cell.total(share).ravel()]
            out += [cell.products(share[a] * share[b]).ravel() for a in range(len(share)) for b in range(a + 1, len(share))]
        return np.concatenate(out)

    return of


def _softmax_part(data: _Data, v: np.ndarray, found: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> float:
    """Mean negative log likelihoods of the discrete columns from their sums.

    The linear parts of the rows' own categories are sums of products.  Shares
    add up to 1, so the curvature is made of pairs of different categories.
    """
    layout, loss, start = data.layout, 0.0, 0
    m = 1 + layout.p + sum(layout.levels)

    def following(*shape: int) -> np.ndarray:
        nonlocal start
        start += int(np.prod(shape))
        return found[start - int(np.prod(shape)) : start].reshape(shape) / data.n

    for j, k in enumerate(layout.levels):
        at, hit = layout.softmax(j), data.gram[:, 1 + layout.p + layout.cuts[j] :][:, :k]
        logs, share, h = following(1)[0], following(k, m), np.zeros((m, k, m, k))
        for a in range(k):
            for b in range(a + 1, k):
                both = following(m, m)
                h[:, a, :, b] = h[:, b, :, a] = -both
                h[:, a, :, a] += both
                h[:, b, :, b] += both
        at, used = at.ravel(), at.ravel() >= 0
        loss += logs - float(v[at[used]] @ hit.ravel()[used])
        np.add.at(grad, at[used], (share.T - hit).ravel()[used])
        np.add.at(hess, np.ix_(at[used], at[used]), h.reshape(m * k, m * k)[np.ix_(used, used)])
    return loss


def _efron(s0: np.ndarray, dead: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each time: sums over its events l of 1 / left, (l / m) / left and log(left), where left = risk - l / m of the events' weight."""
    at = np.repeat(np.arange(len(m)), m)
    share = (np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)) / m[at]
    left = s0[at] - share * dead[at]
    add = lambda x: np.bincount(at, x, len(m))
    return add(1 / left), add(share / left), add(np.log(left))


def _efron_of_one(s0: float, dead: float, m: int) -> tuple[float, float, float]:
    """The same of one time with any number of events.

    In units of dead / m the terms are those of a - l, a = m * s0 / dead.  The
    last ones are added up; before them, where terms are smooth, their sums
    are integrals with the Euler-Maclaurin terms of both ends.
    """
    if m <= MANY_TIES or dead <= 0:
        return tuple(float(x[0]) for x in _efron(np.array([s0]), np.array([dead]), np.array([m])))
    unit, far = dead / m, m - 100
    a = s0 / unit
    near = a - np.arange(far, m)
    u, b = far / a, a - far
    inverse = -np.log1p(-u) + (1 / a - 1 / b) / 2 + (1 / b**2 - 1 / a**2) / 12 - (1 / b**4 - 1 / a**4) / 120 + float((1 / near).sum())
    # Logarithms of 1 - l / a.
    logs = a * (-(1 - u) * np.log1p(-u) - u) - np.log1p(-u) / 2 - (1 / b - 1 / a) / 12 + (1 / b**3 - 1 / a**3) / 360 + float(np.log(near / a).sum())
    return inverse / unit, (a * inverse - m) / dead, logs + m * np.log(s0)


class _Risk:
    """Weights of a cell's rows, and their sums over the rows of each of its times."""

    def __init__(self, cell: _Cell, t: bytes, g: bytes, e: bytes, beta: np.ndarray) -> None:
        self.times, self.group, self.e = np.frombuffer(t, np.float64), np.frombuffer(g, np.uint16).astype(np.intp), np.frombuffer(e, np.int8).astype(np.float64)
        self.w = np.exp(cell.linear(np.concatenate([[0.0], beta])[:, None])[0])
        add = lambda v: np.bincount(self.group, v, len(self.times)) if len(self.times) > 1 else np.array([v.sum()])
        self.sums, self.dead, self.m = add(self.w), add(self.w * self.e), add(self.e).astype(np.int64)

    def inner(self, after: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hazards, their tie parts and losses of the times that no other cell can hold."""
        s0 = after + np.cumsum(self.sums[::-1])[::-1]
        inside = slice(1, max(len(self.times) - 1, 1))
        return _efron(s0[inside], self.dead[inside], self.m[inside])


def _per_cell(data: _Data, of, columns: str, where: str = "true") -> list:
    """A row of numbers for each cell, in the order of survival columns and cells."""
    layout, names = data.layout, ["k", "cell", *columns.split()]
    kinds = [pa.int32(), pa.int64(), *[pa.float64()] * (len(names) - 2)]
    schema = "k int, cell long" + "".join(f", {c} double" for c in names[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(k, c, *of(k, c, *rest)) for k, c, *rest in _unpacked(layout, batches)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

    return sorted(data.cells.filter(where).select("k", "cell", "n", "x", "y", "m", "t", "g", "e").mapInArrow(run, schema).collect())


def _cox_hazards(data: _Data, betas: list[np.ndarray]) -> tuple[float, dict, dict]:
    """Loss of the survival columns, but for the events' linear parts, and for each cell what lies after and before it.

    Rows of one time may lie in several cells: each cell reports the sums of
    its first and last time, which are put together here.
    """

    def weigh(k, c, cell, *times):
        x = _Risk(cell, *times, betas[k])
        return x.sums.sum(), len(x.times), *[f for i in (0, -1) for f in (x.times[i], x.sums[i], x.dead[i], float(x.m[i]))]

    first = _per_cell(data, weigh, "w u t0 w0 d0 m0 t1 w1 d1 m1")
    edges, after, loss = {}, {}, 0.0
    for k in range(len(betas)):
        total = 0.0
        for row in reversed([x for x in first if x.k == k]):
            after[k, row.cell] = total
            one = row.t0 == row.t1
            for t, w, d, m in ((row.t1, row.w1, row.d1, row.m1), *(() if one else ((row.t0, row.w, row.d0, row.m0),))):
                held = edges.setdefault((k, t), [0.0, 0.0, 0.0])
                # Cells come from the last to the first: the risk set of a time is what its first cell adds to all after it.
                held[0], held[1], held[2] = total + (row.w if one else w), held[1] + d, held[2] + m
            total += row.w
    hazard = {}
    for (k, t), (s0, d, m) in edges.items():
        h, ties, logs = _efron_of_one(s0, d, int(m))
        hazard[k, t] = (h, ties)
        loss += logs / max(data.events[k], 1)

    def hazards(k, c, cell, *times):
        h, _, logs = _Risk(cell, *times, betas[k]).inner(after[k, c])
        return h.sum(), logs.sum()

    second = {(x.k, x.cell): x for x in _per_cell(data, hazards, "h logs", "u > 2")} if any(x.u > 2 for x in first) else {}
    so_far, known_by = {}, {}
    for a in first:
        h, logs = (second[a.k, a.cell].h, second[a.k, a.cell].logs) if a.u > 2 else (0.0, 0.0)
        last = known_by.get(a.k, (None, 0.0))
        at_first = last[1] if last[0] == a.t0 else last[1] + hazard[a.k, a.t0][0]
        at_last = at_first if a.t0 == a.t1 else at_first + h + hazard[a.k, a.t1][0]
        known_by[a.k] = (a.t1, at_last)
        so_far[a.k, a.cell] = (at_first, at_last, hazard[a.k, a.t0][1], hazard[a.k, a.t1][1])
        loss += logs / max(data.events[a.k], 1)
    return loss, after, so_far


def _cox_sums(betas: list[np.ndarray], after: dict, so_far: dict):
    """What a cell adds to the curvature of a survival column's likelihood; its first line is the gradient but for the events."""

    def of(k: int, c: int, cell: _Cell, *times: bytes) -> np.ndarray:
        x = _Risk(cell, *times, betas[k])
        h, ties, _ = x.inner(after[k, c])
        at_first, at_last, tie_first, tie_last = so_far[k, c]
        risk, tie = np.full(len(x.times), at_last), np.full(len(x.times), tie_last)
        risk[0], tie[0] = at_first, tie_first
        risk[1 : 1 + len(h)], tie[1 : 1 + len(h)] = at_first + np.cumsum(h), ties
        return cell.products(x.w * (risk[x.group] - x.e * tie[x.group])).ravel()

    return of


def _cox_part(data: _Data, v: np.ndarray, loss: float, found: dict[int, np.ndarray], grad: np.ndarray, hess: np.ndarray) -> float:
    """Partial likelihoods of the survival columns from their sums, each by the number of its events.

    The curvature is that of the weights with hazards held fixed, which is at
    least the true one.
    """
    m = 1 + data.layout.p + sum(data.layout.levels)
    for k in range(data.layout.r):
        at, pull, events = data.layout.cox(k), found[k].reshape(m, m), max(data.events[k], 1)
        loss -= float(v[at] @ data.hits[k, 1:]) / events
        grad[at] += (pull[0, 1:] - data.hits[k, 1:]) / events
        hess[np.ix_(at, at)] += pull[1:, 1:] / events
    return loss


def smooth(data: _Data, v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The loss without penalties, its gradient and a curvature that is at least its own."""
    grad, hess = np.zeros(len(v)), np.zeros((len(v), len(v)))
    loss = _normal_part(data, v, grad, hess)
    if not np.isfinite(loss):
        return loss, grad, hess
    layout = data.layout
    discrete = _softmax_sums(layout, v) if layout.levels else None
    if layout.r:
        betas = [v[layout.cox(k)] for k in range(layout.r)]
        cox_loss, after, so_far = _cox_hazards(data, betas)
        survival = _cox_sums(betas, after, so_far)

    def of(k: int, c: int, cell: _Cell, *times: bytes) -> Iterator[tuple[int, np.ndarray]]:
        if discrete and k == 0:
            yield -1, discrete(cell)
        if times[0]:
            yield k, survival(k, c, cell, *times)

    found = _sums(data, of) if layout.levels or layout.r else {}
    if layout.levels:
        loss += _softmax_part(data, v, found[-1], grad, hess)
    if layout.r:
        loss += _cox_part(data, v, cox_loss, found, grad, hess)
    return loss, grad, hess


# Fitting ----------------------------------------------------------------------------------


def _scaled(penalty: float, factor: float) -> float:
    """An infinite factor rules a pair out whatever its penalty; a large number stands for it, as zero times infinity is none."""
    return 1e12 if factor == float("inf") else penalty * factor


def _pairs(data: _Data, continuous: list[str], discrete: list[str], survival: list[Survival]) -> list[Pair]:
    """All penalized groups; a discrete column weighs the root of the sum of its p (1 - p), all others 1."""
    layout, out = data.layout, []
    share = np.diag(data.gram)[1 + layout.p :]
    own = [slice(a, b) for a, b in zip(layout.cuts, layout.cuts[1:])]
    weight = [float(np.sqrt((share[s] * (1 - share[s])).sum())) for s in own]
    for i, a in enumerate(continuous):
        out += [Pair(a, continuous[j], "cc", layout.at["beta"][i, [j]], 1.0) for j in range(i + 1, layout.p)]
        out += [Pair(a, d, "cd", layout.at["theta"][i, own[j]], weight[j]) for j, d in enumerate(discrete)]
    for i, a in enumerate(discrete):
        out += [Pair(a, discrete[j], "dd", layout.at["phi"][own[i], own[j]].ravel(), weight[i] * weight[j]) for j in range(i + 1, len(discrete))]
    for k, s in enumerate(survival):
        out += [Pair(a, s.name, "sc", layout.at["gamma"][[i], k], 1.0) for i, a in enumerate(continuous)]
        out += [Pair(a, s.name, "sd", layout.at["eta"][own[j], k], 1.0) for j, a in enumerate(discrete)]
    return out


def _null(data: _Data) -> np.ndarray:
    """The best parameters without any pair: each column by itself."""
    layout, v = data.layout, np.zeros(data.layout.size)
    v[layout.at["precision"]] = 1 / np.diag(data.gram)[1 : 1 + layout.p]
    v[layout.at["base"]] = np.log(np.maximum(np.diag(data.gram)[1 + layout.p :], 1e-300))
    return v


def _penalty(v: np.ndarray, groups: list[tuple[np.ndarray, float]]) -> float:
    return float(sum(w * np.linalg.norm(v[at]) for at, w in groups))


def _proximal(v: np.ndarray, step: float, groups: list[tuple[np.ndarray, float]]) -> np.ndarray:
    out = v.copy()
    for at, w in groups:
        norm = np.linalg.norm(v[at])
        out[at] = v[at] * max(0.0, 1 - step * w / norm) if norm > 0 else 0.0
    return out


def _gap(v: np.ndarray, grad: np.ndarray, groups: list[tuple[np.ndarray, float]]) -> float:
    """The largest violation of the optimality conditions: gradient + penalty's slope is 0, or a zero group's gradient within its penalty."""
    rest, worst = np.ones(len(v), bool), 0.0
    for at, w in groups:
        rest[at] = False
        norm = np.linalg.norm(v[at])
        worst = max(worst, float(np.linalg.norm(grad[at] + w * v[at] / norm)) if norm > 0 else max(0.0, float(np.linalg.norm(grad[at])) - w))
    return max(worst, float(np.abs(grad[rest]).max(initial=0)))


def _quadratic(v: np.ndarray, grad: np.ndarray, hess: np.ndarray, groups: list[tuple[np.ndarray, float]], steps: int = 20_000, tolerance: float = 1e-11) -> np.ndarray:
    """The minimum of the penalized quadratic around ``v``, by accelerated proximal steps with restarts."""
    top = float(np.linalg.eigvalsh(hess)[-1]) + 1e-9
    now = y = v
    momentum = 1.0
    for _ in range(steps):
        new = _proximal(y - (grad + hess @ (y - v)) / top, 1 / top, groups)
        if (y - new) @ (new - now) > 0:
            momentum = 1.0
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        moved = float(np.abs(new - now).max())
        y, now, momentum = new + (momentum - 1) / grown * (new - now), new, grown
        if moved < tolerance:
            break
    return now


def fit(df: DataFrame, continuous: list[str], discrete: list[str], survival: list[Survival] | None = None, penalties: dict[str, float] | None = None, steps: int = 50, tolerance: float = 1e-6, priors: dict[tuple[str, str], float] | None = None) -> Model:
    """The penalized maximum of the pseudolikelihood over all complete rows.

    ``penalties`` holds a number for each of the kinds cc, cd, dd, sc and sd
    (missing ones are 0).  ``priors`` scales the penalty of single pairs, named
    in either order: below 1 where other knowledge speaks for a pair, above 1
    where it speaks against it, infinite where it rules it out.  Steps end when the optimality conditions hold
    within ``tolerance`` (``Model.gap``).
    """
    survival, penalties = survival or [], penalties or {}
    data = prepare(df, continuous, discrete, survival)
    pairs = _pairs(data, continuous, discrete, survival)
    scale = {frozenset(k): v for k, v in (priors or {}).items()}
    if unknown := [k for k in scale if not any(k == {x.a, x.b} for x in pairs)]:
        raise ValueError(f"no such pair: {', '.join(' - '.join(sorted(k)) for k in unknown)}")
    groups = [(x.at, _scaled(penalties.get(x.kind, 0.0) * x.weight, scale.get(frozenset((x.a, x.b)), 1.0))) for x in pairs]
    v = _null(data)
    loss, grad, hess = smooth(data, v)
    taken = 0
    while taken < steps and _gap(v, grad, groups) > tolerance:
        taken += 1
        move = _quadratic(v, grad, hess, groups) - v
        promised = float(grad @ move) + _penalty(v + move, groups) - _penalty(v, groups)
        size = 1.0
        for _ in range(30):
            tried = smooth(data, v + size * move)
            if np.isfinite(tried[0]) and tried[0] + _penalty(v + size * move, groups) <= loss + _penalty(v, groups) + 1e-4 * size * promised + 1e-13:
                break
            size /= 2
        else:
            break
        v, (loss, grad, hess) = v + size * move, tried
    drop(data.cells)
    names = [*continuous, *discrete, *[s.name for s in survival]]
    return Model(names, data.categories, data.means, data.deviations, pairs, v, data.layout, loss + _penalty(v, groups), _gap(v, grad, groups), data.n, taken)


def entry_penalties(df: DataFrame, continuous: list[str], discrete: list[str], survival: list[Survival] | None = None) -> list[tuple[str, str, str, float]]:
    """``(a, b, kind, penalty)``: for each pair the penalty below which it enters the model without pairs."""
    survival = survival or []
    data = prepare(df, continuous, discrete, survival)
    grad = smooth(data, _null(data))[1]
    drop(data.cells)
    return [(x.a, x.b, x.kind, float(np.linalg.norm(grad[x.at]) / x.weight) if x.weight > 0 else 0.0) for x in _pairs(data, continuous, discrete, survival)]
