"""Graph comparison: edge frames joined, confusion counts, accuracy statistics, and the comparison harness."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.scratch import drop, stored
from causeway.plans.graphs import ARROW, TAIL, Graph, dag_to_pattern

# On frames -----------------------------------------------------------------------------


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with their nodes in order, marks with them."""
    swap = F.col("n1") > F.col("n2")
    return edges.select(F.least("n1", "n2").alias("n1"), F.greatest("n1", "n2").alias("n2"), F.when(swap, F.col("end2")).otherwise(F.col("end1")).alias("end1"), F.when(swap, F.col("end1")).otherwise(F.col("end2")).alias("end2"))


def compare_edges(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adjacency and arrowhead counts from one full outer join on node pairs."""
    t, e = canonical(truth), canonical(estimate).withColumnsRenamed({"end1": "e1", "end2": "e2"})
    both = t.join(e, ["n1", "n2"], "full")
    one = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0).cast("long")))
    head = lambda c: F.coalesce(c == ARROW, F.lit(False))
    return both.agg(
        one(F.col("end1").isNotNull() & F.col("e1").isNotNull()).alias("adj_tp"),
        one(F.col("end1").isNull()).alias("adj_fp"),
        one(F.col("e1").isNull()).alias("adj_fn"),
        (one(head(F.col("end1")) & head(F.col("e1"))) + one(head(F.col("end2")) & head(F.col("e2")))).alias("arrow_tp"),
        (one(~head(F.col("end1")) & head(F.col("e1"))) + one(~head(F.col("end2")) & head(F.col("e2")))).alias("arrow_fp"),
        (one(head(F.col("end1")) & ~head(F.col("e1"))) + one(head(F.col("end2")) & ~head(F.col("e2")))).alias("arrow_fn"),
    )


def adjacencies_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Adjacencies of one frame that another lacks."""
    return canonical(a).join(canonical(b).select("n1", "n2"), ["n1", "n2"], "left_anti")


def common_edges(frames: list[DataFrame]) -> DataFrame:
    """Edges, marks included, that are in every frame."""
    from functools import reduce

    every = reduce(lambda a, b: a.union(b), [canonical(f).distinct() for f in frames])
    return every.groupBy("n1", "n2", "end1", "end2").count().filter(F.col("count") == len(frames)).drop("count")


#: Neighbours of a node in one block; pairs of blocks are the units of work.
NEIGHBOURS = 1_000


def _triangles(both: DataFrame, degrees: DataFrame) -> DataFrame:
    """``(a, b, c)``: all six orders of every three nodes that are adjacent to each other; pairs are formed at the ends with fewer neighbours only, so they grow with edges ** 1.5 at most."""
    d = both.join(degrees.withColumnsRenamed({"b": "n1", "d": "d1"}), "n1").join(degrees.withColumnsRenamed({"b": "n2", "d": "d2"}), "n2")
    up = d.filter((F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("n1") < F.col("n2")))).select("n1", "n2")
    ends = up.select("n1", F.col("n2").alias("x")).join(up.select("n1", F.col("n2").alias("y")), "n1").filter("x < y")
    found = ends.join(both.select(F.col("n1").alias("x"), F.col("n2").alias("y")), ["x", "y"], "left_semi")
    orders = F.array(*[F.struct(F.col(i).alias("a"), F.col(j).alias("b"), F.col(k).alias("c")) for i, j, k in permutations(("n1", "x", "y"))])
    return found.select(F.explode(orders).alias("t")).select("t.*")


def unshielded_triples(edges: DataFrame) -> DataFrame:
    """``(a, b, c)``, a < c: pairs of a middle node's neighbours, less adjacent ones.

    A node's neighbours are dealt out in blocks, and each pair of blocks is
    joined by itself, so a node of many neighbours is no task's alone.  Which
    pairs are adjacent is looked up beforehand for each neighbour and block, so
    that triples are never shuffled.
    """
    spark = edges.sparkSession
    both = edges.select("n1", "n2").filter("n1 <> n2")
    both = stored(both.union(both.select(F.col("n2").alias("n1"), F.col("n1").alias("n2"))).distinct(), "adjacencies")
    degrees = both.groupBy(F.col("n2").alias("b")).agg(F.count("*").alias("d"))
    blocks = degrees.select("b", F.ceil(F.col("d") / NEIGHBOURS).cast("int").alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks").cast("long")).cast("int")
    dealt = both.select(F.col("n1").alias("a"), F.col("n2").alias("b")).join(blocks, "b").withColumn("i", block("a"))
    shields = _triangles(both, degrees).join(blocks, "b").groupBy("a", "b", block("c").alias("j")).agg(F.collect_list("c").alias("shielded"))
    left = dealt.withColumn("j", F.explode(F.sequence("i", F.col("blocks") - 1))).join(shields, ["a", "b", "j"], "left").select("a", "b", "i", "j", "shielded")
    right = dealt.select(F.col("a").alias("c"), "b", F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), "i")).alias("i"))
    # The work is the number of pairs, not the bytes read: the parts must not be put together by their size.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(parts, "b", "i", "j").join(right.repartition(parts, "b", "i", "j"), ["b", "i", "j"])
    kept = pairs.filter("(i < j or a < c) and (shielded is null or not array_contains(shielded, c))")
    return kept.select(F.least("a", "c").alias("a"), "b", F.greatest("a", "c").alias("c"))


def ancestor_pairs(edges: DataFrame, longest: int = 50) -> DataFrame:
    """``(ancestor, node)`` by doubling joins of the directed edges, to a fixed point."""
    now = edges.filter((F.col("end1") == TAIL) & (F.col("end2") == ARROW)).select(F.col("n1").alias("ancestor"), F.col("n2").alias("node"))
    now = stored(now.union(edges.filter((F.col("end2") == TAIL) & (F.col("end1") == ARROW)).select("n2", "n1")).distinct(), "ancestors")
    count = now.count()
    for _ in range(max(1, int(np.ceil(np.log2(longest)))) + 1):
        # Written, not cached: a round reads what the last one wrote, which then goes.
        more = stored(now.union(now.select("ancestor", F.col("node").alias("m")).join(now.select(F.col("ancestor").alias("m"), "node"), "m").select("ancestor", "node")).distinct(), "ancestors")
        after = more.count()
        drop(now)
        now = more
        if after == count:
            break
        count = after
    return now


# On graphs -----------------------------------------------------------------------------


def confusion(truth: Graph, estimate: Graph) -> dict[str, tuple[int, int, int, int]]:
    """(tp, fp, fn, tn) of adjacencies and of arrowheads."""
    names = truth.nodes
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    adj, arrow = [0, 0, 0, 0], [0, 0, 0, 0]
    for a, b in pairs:
        t, e = truth.adjacent(a, b), estimate.adjacent(a, b)
        adj[0 if t and e else 1 if e else 2 if t else 3] += 1
        for x, y in ((a, b), (b, a)):
            t, e = truth.mark(x, y) == ARROW, estimate.mark(x, y) == ARROW
            arrow[0 if t and e else 1 if e else 2 if t else 3] += 1
    return {"adjacency": tuple(adj), "arrow": tuple(arrow)}


def _ratio(a: float, b: float) -> float:
    return a / b if b else float("nan")


def _mcc(tp: int, fp: int, fn: int, tn: int) -> float:
    return _ratio(tp * tn - fp * fn, float(np.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))))


def structural_distance(truth: Graph, estimate: Graph) -> int:
    """Edges to add, remove or change."""
    out = 0
    for i, a in enumerate(truth.nodes):
        for b in truth.nodes[i + 1 :]:
            out += (truth.mark(a, b), truth.mark(b, a)) != (estimate.mark(a, b), estimate.mark(b, a))
    return out


def _of(kind: str, f: Callable[[int, int, int, int], float]):
    return lambda t, e: f(*confusion(t, e)[kind])


def _count_marks(marks: tuple[str, str]):
    return lambda t, e: float(sum({(x, y), (y, x)} & {marks} != set() for _, _, x, y in e.edges()))


STATISTICS: dict[str, Callable[[Graph, Graph], float]] = {
    "AP": _of("adjacency", lambda tp, fp, fn, tn: _ratio(tp, tp + fp)), "AR": _of("adjacency", lambda tp, fp, fn, tn: _ratio(tp, tp + fn)),
    "AHP": _of("arrow", lambda tp, fp, fn, tn: _ratio(tp, tp + fp)), "AHR": _of("arrow", lambda tp, fp, fn, tn: _ratio(tp, tp + fn)),
    "F1Adj": _of("adjacency", lambda tp, fp, fn, tn: _ratio(2 * tp, 2 * tp + fp + fn)), "F1Arrow": _of("arrow", lambda tp, fp, fn, tn: _ratio(2 * tp, 2 * tp + fp + fn)),
    "McAdj": _of("adjacency", _mcc), "McArrow": _of("arrow", _mcc),
    "ATP": _of("adjacency", lambda tp, fp, fn, tn: tp), "AFP": _of("adjacency", lambda tp, fp, fn, tn: fp), "AFN": _of("adjacency", lambda tp, fp, fn, tn: fn), "ATN": _of("adjacency", lambda tp, fp, fn, tn: tn),
    "AHTP": _of("arrow", lambda tp, fp, fn, tn: tp), "AHFP": _of("arrow", lambda tp, fp, fn, tn: fp), "AHFN": _of("arrow", lambda tp, fp, fn, tn: fn),
    "AFPR": _of("adjacency", lambda tp, fp, fn, tn: _ratio(fp, fp + tn)), "ATPR": _of("adjacency", lambda tp, fp, fn, tn: _ratio(tp, tp + fn)),
    "TNR": _of("adjacency", lambda tp, fp, fn, tn: _ratio(tn, tn + fp)),
    "SHD": lambda t, e: float(structural_distance(t, e)), "SHDPattern": lambda t, e: float(structural_distance(dag_to_pattern(t), e)),
    "NumEdges": lambda t, e: float(e.number_of_edges()), "NumEdgesTrue": lambda t, e: float(t.number_of_edges()), "MaxDegree": lambda t, e: float(e.max_degree()),
    "NumDirected": lambda t, e: float(sum(e.directed(a, b) or e.directed(b, a) for a, b, _, _ in e.edges())), "NumUndirected": lambda t, e: float(sum(e.undirected(a, b) for a, b, _, _ in e.edges())), "NumBidirected": lambda t, e: float(sum(e.bidirected(a, b) for a, b, _, _ in e.edges())),
    "NumPartiallyOriented": _count_marks(("o", ">")), "NumNondirected": _count_marks(("o", "o")), "NumColliders": lambda t, e: float(sum(e.collider(a, b, c) for a, b, c in e.unshielded())),
    "GraphExactlyRight": lambda t, e: float(t == e), "TwoCycles": lambda t, e: float(sum(e.bidirected(a, b) for a, b, _, _ in e.edges())),
}


def _marks(g: Graph, mark: str) -> set[tuple[str, str]]:
    """(a, b) where the mark at b is the given one."""
    return {(x, y) for a, b, _, _ in g.edges() for x, y in ((a, b), (b, a)) if g.mark(x, y) == mark}


def _in_cycles(g: Graph) -> set[str]:
    return {n for n in g.nodes if any(n in g.descendants([c]) for c in g.children(n))} | {n for a, b, _, _ in g.edges() if g.bidirected(a, b) for n in (a, b)}


def _two_cycles(g: Graph) -> set[frozenset]:
    return {frozenset((a, b)) for a, b, _, _ in g.edges() if g.bidirected(a, b)}


def _shares(f: Callable[[Graph], set]) -> tuple[Callable, Callable]:
    """Precision and recall of a set that a graph has."""
    return (lambda t, e: _ratio(len(f(t) & f(e)), len(f(e)))), (lambda t, e: _ratio(len(f(t) & f(e)), len(f(t))))


STATISTICS["TP"], STATISTICS["TR"] = _shares(lambda g: _marks(g, TAIL))
STATISTICS["NICP"], STATISTICS["NICR"] = _shares(_in_cycles)
STATISTICS["2CP"], STATISTICS["2CR"] = _shares(_two_cycles)
STATISTICS["2CTP"] = lambda t, e: float(len(_two_cycles(t) & _two_cycles(e)))
STATISTICS["2CFP"] = lambda t, e: float(len(_two_cycles(e) - _two_cycles(t)))
STATISTICS["2CFN"] = lambda t, e: float(len(_two_cycles(t) - _two_cycles(e)))
STATISTICS["%AMB"] = lambda t, e: _ratio(len(e.ambiguous) / 2, sum(1 for _ in e.unshielded()))
STATISTICS["%Bi"] = lambda t, e: _ratio(len(_two_cycles(e)), e.number_of_edges())


@dataclass
class Comparison:
    """A grid of simulations, algorithms and statistics.

    Each (simulation, run, algorithm) is a cell of its own.  Searches that
    need only a small data set run in one task per cell on the executors.
    """

    simulations: dict[str, Callable[[int], tuple[Graph, pd.DataFrame]]]
    algorithms: dict[str, Callable[[pd.DataFrame], Graph]]
    statistics: list[str] = field(default_factory=lambda: ["AP", "AR", "AHP", "AHR", "F1Adj", "SHD"])
    runs: int = 10
    utility: dict[str, float] = field(default_factory=dict)

    def cells(self, spark: SparkSession) -> DataFrame:
        """``(simulation, algorithm, run, statistic, value)``; ``E`` is the elapsed time."""
        simulations, algorithms, names = self.simulations, self.algorithms, self.statistics

        def run(pdfs):
            for pdf in pdfs:
                out = []
                for s, a, r in zip(pdf.simulation, pdf.algorithm, pdf.run):
                    truth, data = simulations[s](int(r))
                    began = time.time()
                    found = algorithms[a](data)
                    took = time.time() - began
                    reference = dag_to_pattern(truth) if truth.acyclic() and not truth.latent else truth
                    out += [(s, a, int(r), n, float(STATISTICS[n](truth if n == "SHDPattern" else reference, found))) for n in names]
                    out.append((s, a, int(r), "E", took))
                yield pd.DataFrame(out, columns=["simulation", "algorithm", "run", "statistic", "value"])

        grid = spark.createDataFrame([(s, a, r) for s in simulations for a in algorithms for r in range(self.runs)], "simulation string, algorithm string, run int")
        n = len(simulations) * len(algorithms) * self.runs
        return grid.repartition(min(n, 1000), "simulation", "algorithm", "run").mapInPandas(run, "simulation string, algorithm string, run int, statistic string, value double")

    def tables(self, cells: DataFrame) -> DataFrame:
        """Average, deviation and worst case of each statistic."""
        return cells.filter(~F.isnan("value")).groupBy("simulation", "algorithm", "statistic").agg(F.avg("value").alias("average"), F.stddev_samp("value").alias("deviation"), F.min("value").alias("worst"))

    def ranking(self, cells: DataFrame) -> DataFrame:
        """Algorithms by weighed sums of average statistics, the best first."""
        weights = F.create_map(*[F.lit(v) for kv in (self.utility or dict.fromkeys(self.statistics, 1.0)).items() for v in kv])
        return self.tables(cells).groupBy("algorithm").agg(F.sum(F.col("average") * F.coalesce(weights[F.col("statistic")], F.lit(0.0))).alias("utility")).orderBy(F.desc("utility"), "algorithm")
