"""Exact top-k search by exhaustive term-at-a-time accumulation (operator 11).

A vector is a row of integer weights; a component's position is its term.
Candidates lie in blocks of bounded size.  Within a block each term has a
postings list, the places and weights of the candidates that hold it.  A query
is a sparse row: for each of its terms, its weight times the posted weights is
scattered into a dense array of scores, one for each candidate of the block.
Once all terms are in, the array is partitioned around its k-th highest score
and the block's best places are sent on; a window merges the blocks' lists.

Every query meets every block, since the search is exhaustive; a pair of
blocks is one group of rows.  Queries stream past a block's postings, so a task holds
one block of candidates and no queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import column, drop_path, id_column, map_rows, written

#: Candidates of a block, whose postings a task holds, and the fewest that make a block of their own.
CANDIDATES, FEWEST = 16_384, 512
#: Queries of a block: one task takes them past one block of candidates.
QUERIES = 16_384
#: Sums that stay below this are added in 64 bits.
EXACT = 1 << 62


def quantized(vector: Column, scale: int = 256) -> Column:
    """Whole weights ``floor(scale * x)``; null for vectors that are null or hold a null or non-finite component.

    A weight beyond 32 bits is refused (the cast fails), as its scores might
    not fit a long.
    """
    sound = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    weight = lambda x: F.floor(x.cast("double") * scale)
    whole = F.transform(vector, lambda x: F.when(F.abs(weight(x)) < 1 << 31, weight(x).cast("int")).otherwise(F.raise_error("a weight beyond 32 bits").cast("int")))
    return F.when(sound, whole)


class _Postings:
    """The postings of one block of candidates: for each term, who holds it and how much."""

    def __init__(self, weights: list[np.ndarray], copies: np.ndarray) -> None:
        lengths = np.array([len(w) for w in weights], np.int64)
        flat = np.concatenate([*weights, np.empty(0, np.int32)]).astype(np.int64)
        term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = np.repeat(np.arange(len(weights)), lengths)
        held = np.flatnonzero(flat)
        held = held[np.argsort(term[held], kind="stable")]
        self.n, self.copies = len(weights), copies
        self.most = int(np.abs(flat).max(initial=0))
        bounds = np.searchsorted(term[held], np.arange(int(lengths.max(initial=0)) + 1))
        self.lists = [(slice(None) if b - a == self.n else place[held[a:b]], flat[held[a:b]]) for a, b in zip(bounds, bounds[1:])]
        self.scores = np.empty(self.n, np.int64)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best candidates, earlier places first where scores tie; ``own`` (or -1) is left out."""
        if self.most * int(np.abs(query.astype(np.int64)).sum()) >= EXACT:
            raise ArithmeticError("a score beyond 62 bits")
        scores = self.scores
        scores[:] = 0
        for t in np.flatnonzero(query[: len(self.lists)]).tolist():
            places, weights = self.lists[t]
            scores[places] += weights * int(query[t])
        open_ = np.ones(self.n, bool) if own >= 0 else None
        if open_ is not None:
            open_[own] = False
            places = np.flatnonzero(open_)
        else:
            places = np.arange(self.n)
        held = scores[places]
        if len(held) > k:
            least = np.partition(held, len(held) - k)[len(held) - k]
            above = np.flatnonzero(held > least)
            ties = np.flatnonzero(held == least)[: k - len(above)]
            at = np.concatenate([above, ties])
        else:
            at = np.arange(len(held))
        at = at[np.lexsort((at, -held[at]))]
        return places[at], held[at]


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``queries`` (a condition on ``vec_id``) selects, its k best rows.

    The score is the inner product of the whole weights ``floor(scale * x)``,
    over the components that both vectors have.  Candidates are all rows but
    the query's own; equal scores rank by the smaller id, null ids last; fewer
    than k candidates give fewer rows.  Vectors that are null or hold null or
    non-finite components take no part, on either side.  Rows of the same id
    and weights are kept once with their number: each is a candidate of the
    other, and each query among them has its own k rows, so such a query
    counts every rank as often as it has copies.  An empty vector has the score 0 with every row.  An
    empty table, or one without queries, gives an empty result.  Columns other
    than these two are not read.
    """
    spark = vectors.sparkSession
    sound = vectors.select(id_column(vectors, vec_id).alias("vec_id"), quantized(column(vector), scale).alias("w")).filter("w is not null")
    rows = written(sound.groupBy("vec_id", "w").agg(F.count("*").alias("copies")).withColumn("asks", F.coalesce(queries, F.lit(False))), "topk-vectors")
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // CANDIDATES), min(partitions, n // FEWEST))
    query_blocks = max(1, -(-asking // QUERIES))
    # A row's block follows from its id and weights, so a task that is tried again deals them alike.
    block, query_block = F.pmod(F.xxhash64("vec_id", "w"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("w", "vec_id"), F.lit(query_blocks)).cast("int")
    candidates = rows.select(F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), block.alias("c"), F.lit(0).alias("side"), "vec_id", "w", "copies")
    asked = rows.filter("asks").select(query_block.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"), F.lit(1).alias("side"), "vec_id", "w", "copies")
    dealt = candidates.unionByName(asked).repartition(F.col("q"), F.col("c")).sortWithinPartitions("q", "c", "side", F.col("vec_id").asc_nulls_last(), "w")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        group, held, ids, copies, index, places = None, [], [], [], None, {}
        for batch in batches:
            out = []
            q, c, side, own, n_copies = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
            weights = batch.column(4)
            bounds, values = weights.offsets.to_numpy(), weights.values.to_numpy()
            for i in range(batch.num_rows):
                w = values[bounds[i] : bounds[i + 1]]
                if (q[i], c[i]) != group:
                    group, held, ids, copies, index, places = (q[i], c[i]), [], [], [], None, {}
                if side[i] == 0:
                    held.append(w.copy())
                    ids.append(own[i])
                    copies.append(n_copies[i])
                    continue
                if not held:
                    continue
                if index is None:
                    index = _Postings(held, np.array(copies, np.int64))
                    places = {(d, x.tobytes()): p for p, (d, x) in enumerate(zip(ids, held))}
                mine = places.get((own[i], w.tobytes()), -1)
                # One row is the query's own; its further copies stay candidates.
                alone = mine >= 0 and copies[mine] == 1
                at, scores = index.top(w, mine if alone else -1, k)
                out += [(own[i], w.tobytes(), n_copies[i], ids[p], int(s), int(copies[p] - (p == mine))) for p, s in zip(at.tolist(), scores.tolist())]
            yield out

    found = map_rows(dealt, search, "query_id long, query_w binary, asked long, vec_id long, score long, copies long")
    # Blocks' lists hold k rows each, so what is merged for a query is bounded by its blocks.
    order = Window.partitionBy("query_id", "query_w").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    ranked = found.select("*", before).filter(F.col("before") < k)
    each = ranked.select("*", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(k)))).alias("rank"))
    out = written(each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("asked"))).alias("copy")).drop("copy"), "topk")
    drop_path(spark, rows._scratch_path)
    return out
