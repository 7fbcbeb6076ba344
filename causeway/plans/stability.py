"""Resampled searches, stability selection, the mixed graphical model, clustering and diverse selection."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.ordering import cut_points
from causeway.plans.graphs import TAIL, Graph

# Resampling ---------------------------------------------------------------------------

#: Edge marks; of marks with equal votes the first wins.
MARKS = ["---", "-->", "<--", "<->", "o->", "<-o", "o-o"]


def resampled_edges(samples: DataFrame, columns: list[str], search: Callable[[pd.DataFrame], Graph], key: str = "replicate") -> DataFrame:
    """``(key, n1, n2, mark)``: one search per replicate, each in a task of its own.

    ``samples`` holds the rows of all replicates; a replicate must fit in a task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = search(pdf[columns])
        rows = [(pdf[key].iloc[0], *sorted(e.split(" ")[::2]), _turned(e)) for e in g.edge_texts()]
        return pd.DataFrame(rows, columns=[key, "n1", "n2", "mark"])

    return samples.groupBy(key).applyInPandas(run, f"{key} int, n1 string, n2 string, mark string")


def _turned(e: str) -> str:
    """The mark with the nodes in order of name."""
    a, m, b = e.split(" ")
    return m if a < b else m[::-1].translate(str.maketrans("<>", "><"))


def edge_votes(edges: DataFrame, replicates: int) -> DataFrame:
    """``(n1, n2, mark, n, share)``, with ``none`` for the replicates without the edge."""
    counts = edges.groupBy("n1", "n2", "mark").agg(F.count("*").alias("n"))
    none = counts.groupBy("n1", "n2").agg((F.lit(replicates) - F.sum("n")).alias("n")).filter("n > 0").select("n1", "n2", F.lit("none").alias("mark"), "n")
    return counts.union(none).withColumn("share", F.col("n") / replicates)


def consensus(votes: DataFrame, least: int = 0) -> DataFrame:
    """Each pair's most frequent mark, of ties the first in the order of marks, if it isn't ``none`` and has enough votes."""
    rank = F.array_position(F.array(*[F.lit(m) for m in [*MARKS, "none"]]), F.col("mark"))
    best = votes.groupBy("n1", "n2").agg(F.max_by(F.struct("mark", "n"), F.struct("n", -rank)).alias("b"))
    return best.select("n1", "n2", "b.mark", "b.n").filter((F.col("mark") != "none") & (F.col("n") >= least))


def instability(edges: DataFrame, replicates: int, pairs: int, by: list[str] | None = None) -> DataFrame:
    """Sum of 2 theta (1 - theta) over pairs, divided by their number; theta is the share of replicates with an edge."""
    by = by or []
    theta = edges.select(*by, "replicate", "n1", "n2").distinct().groupBy(*by, "n1", "n2").agg((F.count("*") / replicates).alias("theta"))
    return theta.groupBy(*by).agg((F.sum(2 * F.col("theta") * (1 - F.col("theta"))) / pairs).alias("instability"))


def stars(samples: DataFrame, columns: list[str], search: Callable[[pd.DataFrame, float], Graph], levels: list[float], beta: float = 0.05) -> tuple[float, DataFrame]:
    """The last level, from sparse to dense as listed, up to which instability stays within ``beta``; all levels and replicates in one job."""
    spark = samples.sparkSession
    grid = spark.createDataFrame([(x,) for x in levels], "level double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        level = float(pdf["level"].iloc[0])
        g = search(pdf[columns], level)
        return pd.DataFrame([(level, int(pdf["replicate"].iloc[0]), *sorted((a, b))) for a, b, _, _ in g.edges()], columns=["level", "replicate", "n1", "n2"])

    edges = samples.crossJoin(F.broadcast(grid)).groupBy("level", "replicate").applyInPandas(run, "level double, replicate int, n1 string, n2 string")
    n = samples.select("replicate").distinct().count()
    scored = instability(edges, n, len(columns) * (len(columns) - 1) // 2, ["level"])
    found = {r.level: r.instability for r in scored.collect()}
    best, worst = levels[0], 0.0
    for x in levels:
        worst = max(worst, found.get(x, 0.0))
        if worst > beta:
            break
        best = x
    return best, scored


# Mixed graphical model ------------------------------------------------------------------


@dataclass
class MixedModel:
    """Parameters of a pairwise model over standardized continuous and coded discrete variables."""

    continuous: list[str]
    discrete: list[str]
    levels: list[int]
    beta: np.ndarray  # continuous - continuous
    theta: np.ndarray  # continuous rows, indicator columns
    phi: np.ndarray  # indicator - indicator
    loss: float

    def graph(self, least: float = 1e-6) -> Graph:
        g = Graph([*self.continuous, *self.discrete])
        cut = np.concatenate([[0], np.cumsum(self.levels)])
        for i, a in enumerate(self.continuous):
            for j in range(i):
                if abs(self.beta[i, j]) > least:
                    g.add(a, self.continuous[j], TAIL, TAIL)
            for k, d in enumerate(self.discrete):
                if np.abs(self.theta[i, cut[k] : cut[k + 1]]).sum() > least:
                    g.add(a, d, TAIL, TAIL)
        for k, d in enumerate(self.discrete):
            for m in range(k):
                if np.abs(self.phi[cut[k] : cut[k + 1], cut[m] : cut[m + 1]]).sum() > least:
                    g.add(d, self.discrete[m], TAIL, TAIL)
        return g


def mixed_graphical_model(data: pd.DataFrame, discrete: list[str], penalties: tuple[float, float, float], steps: int = 500, tolerance: float = 1e-5) -> MixedModel:
    """Pseudolikelihood with group penalties (continuous pairs, mixed pairs, discrete pairs), by accelerated proximal gradient with backtracking."""
    continuous = [c for c in data.columns if c not in discrete]
    x = data[continuous].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0) if len(continuous) else np.zeros((len(data), 0))
    codes = [pd.Categorical(data[c]).codes for c in discrete]
    levels = [int(c.max()) + 1 for c in codes]
    n, p, q = len(data), len(continuous), sum(levels)
    cut = np.concatenate([[0], np.cumsum(levels)]).astype(int)
    d = np.zeros((n, q))
    for k, c in enumerate(codes):
        d[np.arange(n), cut[k] + c] = 1
    own = np.zeros((q, q), bool)
    for k in range(len(levels)):
        own[cut[k] : cut[k + 1], cut[k] : cut[k + 1]] = True

    def unpack(t: np.ndarray):
        at = np.cumsum([p * p, p, p, p * q, q * q])
        return t[: at[0]].reshape(p, p), t[at[0] : at[1]], t[at[1] : at[2]], t[at[2] : at[3]].reshape(p, q), t[at[3] : at[4]].reshape(q, q), t[at[4] :]

    def smooth(t: np.ndarray) -> tuple[float, np.ndarray]:
        beta, log_d, a, theta, phi, b = unpack(t)
        bs = np.where(np.eye(p, dtype=bool), 0, (beta + beta.T) / 2)
        ps = np.where(own, 0, (phi + phi.T) / 2)
        prec = np.exp(log_d)
        mean = a + x @ bs / prec + d @ theta.T / prec
        r = mean - x
        loss = float((-n / 2 * log_d).sum() + (prec / 2 * (r * r).sum(0)).sum())
        g_mean = r * prec
        g_b = x.T @ (g_mean / prec)
        g_theta = (g_mean / prec).T @ d
        g_log = -n / 2 + prec / 2 * (r * r).sum(0) - (g_mean * (x @ bs + d @ theta.T) / prec).sum(0)
        eta = b + x @ theta + d @ ps
        g_eta = np.zeros_like(eta)
        for k in range(len(levels)):
            e = eta[:, cut[k] : cut[k + 1]]
            top = e.max(1, keepdims=True)
            z = np.exp(e - top)
            s = z.sum(1, keepdims=True)
            hit = d[:, cut[k] : cut[k + 1]]
            loss += float((np.log(s[:, 0]) + top[:, 0] - (e * hit).sum(1)).sum())
            g_eta[:, cut[k] : cut[k + 1]] = z / s - hit
        g_theta = g_theta + x.T @ g_eta
        g_phi = d.T @ g_eta
        g_b = np.where(np.eye(p, dtype=bool), 0, (g_b + g_b.T) / 2)
        g_phi = np.where(own, 0, (g_phi + g_phi.T) / 2)
        return loss / n, np.concatenate([g_b.ravel(), g_log, g_mean.sum(0), g_theta.ravel(), g_phi.ravel(), g_eta.sum(0)]) / n

    def shrink(t: np.ndarray, step: float) -> np.ndarray:
        t = t.copy()
        beta, _, _, theta, phi, _ = unpack(t)
        np.copyto(beta, np.sign(beta) * np.maximum(np.abs(beta) - step * penalties[0], 0))
        for k in range(len(levels)):
            part = theta[:, cut[k] : cut[k + 1]]
            norm = np.sqrt((part * part).sum(1, keepdims=True))
            part *= np.maximum(0, 1 - step * penalties[1] / np.maximum(norm, 1e-12))
            for m in range(len(levels)):
                if k != m:
                    block = phi[cut[k] : cut[k + 1], cut[m] : cut[m + 1]]
                    block *= max(0.0, 1 - step * penalties[2] / max(float(np.sqrt((block * block).sum())), 1e-12))
        return t

    t = np.zeros(p * p + 2 * p + p * q + q * q + q)
    y, old, momentum, step = t, t, 1.0, 1.0
    for _ in range(steps):
        f, g = smooth(y)
        while True:
            new = shrink(y - step * g, step)
            diff = new - y
            f_new = smooth(new)[0]
            if f_new <= f + float(g @ diff) + float(diff @ diff) / (2 * step) + 1e-12 or step < 1e-10:
                break
            step /= 2
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = new + (momentum - 1) / grown * (new - old)
        moved = float(np.abs(new - old).max())
        old, momentum = new, grown
        if moved < tolerance:
            break
    beta, _, _, theta, phi, _ = unpack(old)
    return MixedModel(continuous, discrete, levels, np.where(np.eye(p, dtype=bool), 0, (beta + beta.T) / 2), theta, np.where(own, 0, (phi + phi.T) / 2), smooth(old)[0])


# Clustering -----------------------------------------------------------------------------


def lloyd_step(points: DataFrame, vector: str, centers: list[list[float]]) -> DataFrame:
    """``(cluster, size, center)`` after one assignment to the nearest centre (of ties the first), without a join."""
    distance = lambda c: F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    distances = F.array(*[distance(c) for c in centers])
    nearest = points.select(F.col(vector).alias("v"), distances.alias("ds")).select("v", (F.array_position("ds", F.array_min("ds")) - 1).cast("int").alias("cluster"))
    k = len(centers[0])
    sums = nearest.groupBy("cluster").agg(F.count("*").alias("size"), *[F.avg(F.element_at("v", i + 1).cast("double")).alias(f"m{i}") for i in range(k)])
    return sums.select("cluster", "size", F.array(*[f"m{i}" for i in range(k)]).alias("center"))


def kmeans(points: DataFrame, vector: str, centers: list[list[float]], steps: int = 20) -> list[list[float]]:
    """Lloyd's iterations until centres stay; an empty cluster keeps its centre."""
    now = [list(map(float, c)) for c in centers]
    for _ in range(steps):
        after = list(now)
        for r in lloyd_step(points, vector, now).collect():
            after[r.cluster] = list(r.center)
        if np.abs(np.array(after) - np.array(now)).max() < 1e-12:
            break
        now = after
    return now


# Diverse selection ----------------------------------------------------------------------


def diverse_top(intensity: list[tuple[str, float]], correlation: Callable[[str, str], float], k: int, radius: float) -> list[str]:
    """Greedy: the most intense variable that correlates with none chosen by ``radius`` or more, until there are k."""
    out: list[str] = []
    for name, _ in sorted(intensity, key=lambda x: (-x[1], x[0])):
        if all(abs(correlation(name, o)) < radius for o in out):
            out.append(name)
            if len(out) == k:
                break
    return out


def nearest_in_category(df: DataFrame, value: str, category: str, buckets: int = 200) -> DataFrame:
    """``nearest``: the distance to the closest other value of the row's category, from its neighbours in sorted order.

    Windows are within buckets of values, so that a category may hold any share
    of the rows; the least and greatest value of each category's buckets give
    the neighbours across them.
    """
    cuts = cut_points(df, value, buckets)
    x, b = F.col(value), f"__cw_b{uuid.uuid4().hex[:8]}"
    cut = df.withColumn(b, F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= x)))
    inner, outer = Window.partitionBy(category, b).orderBy(value), Window.partitionBy(category).orderBy(b)
    # A row for each category and bucket.
    ends = cut.filter(x.isNotNull()).groupBy(category, b).agg(F.min(x).alias("low"), F.max(x).alias("high"))
    ends = ends.select(F.col(category).alias(f"{b}c"), F.col(b).alias(f"{b}b"), F.lag("high").over(outer).alias(f"{b}below"), F.lead("low").over(outer).alias(f"{b}above"))
    met = cut.join(ends, F.col(category).eqNullSafe(F.col(f"{b}c")) & (F.col(b) == F.col(f"{b}b")), "left")
    below, above = x - F.coalesce(F.lag(value).over(inner), F.col(f"{b}below")), F.coalesce(F.lead(value).over(inner), F.col(f"{b}above")) - x
    return met.withColumn("nearest", F.least(F.coalesce(below, above), F.coalesce(above, below))).select(*df.columns, "nearest")


# Complementary pairs --------------------------------------------------------------------


def complementary_selection(halves: DataFrame, columns: list[str], search: Callable[[pd.DataFrame], Graph], pairs: int, least: float = 0.7) -> tuple[DataFrame, float]:
    """Edges found in at least a share of all halves of random pairs, and the bound on the expected number of false ones: q**2 / ((2 least - 1) p), q edges a half, p pairs of variables."""
    keyed = halves.withColumn("replicate", F.col("pair") * 2 + F.col("half"))
    edges = resampled_edges(keyed, columns, search)
    counts = edges.select("replicate", "n1", "n2").distinct().groupBy("n1", "n2").agg((F.count("*") / (2 * pairs)).alias("share"))
    found = edges.select("replicate", "n1", "n2").distinct().count() / (2 * pairs)
    p = len(columns) * (len(columns) - 1) / 2
    return counts.filter(F.col("share") >= least), found**2 / ((2 * least - 1) * p)


def steps(samples: DataFrame, columns: list[str], discrete: list[str], levels: list[float], limit: float = 0.05) -> tuple[tuple[float, float, float], DataFrame]:
    """Penalties of a mixed graphical model by edge type: for continuous, mixed and discrete pairs the smallest level up to which, from the largest down, their instability stays within the limit."""
    kinds = {c: "d" if c in discrete else "c" for c in columns}
    spark = samples.sparkSession
    grid = spark.createDataFrame([(float(x),) for x in sorted(levels, reverse=True)], "level double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        level = float(pdf["level"].iloc[0])
        g = mixed_graphical_model(pdf[columns], discrete, (level, level, level)).graph()
        rows = [(level, int(pdf["replicate"].iloc[0]), *sorted((a, b)), "".join(sorted((kinds[a], kinds[b])))) for a, b, _, _ in g.edges()]
        return pd.DataFrame(rows, columns=["level", "replicate", "n1", "n2", "type"])

    edges = samples.crossJoin(F.broadcast(grid)).groupBy("level", "replicate").applyInPandas(run, "level double, replicate int, n1 string, n2 string, type string")
    n = samples.select("replicate").distinct().count()
    c, d = len(columns) - len(discrete), len(discrete)
    pairs = {"cc": max(c * (c - 1) // 2, 1), "cd": max(c * d, 1), "dd": max(d * (d - 1) // 2, 1)}
    theta = edges.groupBy("level", "type", "n1", "n2").agg((F.count("*") / n).alias("theta")).groupBy("level", "type").agg(F.sum(2 * F.col("theta") * (1 - F.col("theta"))).alias("total"))
    found = {(r.level, r.type): r.total / pairs[r.type] for r in theta.collect()}
    chosen = []
    for t in ("cc", "cd", "dd"):
        best = max(levels)
        for x in sorted(levels, reverse=True):
            if found.get((x, t), 0.0) > limit:
                break
            best = x
        chosen.append(float(best))
    return tuple(chosen), theta
