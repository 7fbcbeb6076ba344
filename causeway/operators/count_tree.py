"""Counts of many sets of discrete columns from one pass over a table.

The root is the table of distinct rows with their number.  Every set of
columns that is asked for is summed from the smallest set at hand that holds
it: sets with few cells are kept on the driver, larger ones as stored tables,
so a search's many contingency tables cost one scan of the table and then sums
over ever smaller ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.moments import contingency
from causeway.operators.scratch import drop, stored

#: Cells of a set that the driver holds; sets with more stay tables.
DRIVER_CELLS = 1_000_000


@dataclass
class _Node:
    """The counts of one set of columns: on the driver, or a stored table."""

    columns: tuple[str, ...]
    cells: int
    held: dict[tuple, int] | None = None
    table: DataFrame | None = None


class CountTree:
    """Counts of sets of columns over the rows that have all of them.

    ``scans`` counts passes over the table itself: one, however many sets
    are asked for.  Stored tables are dropped by ``close`` (or at the end of a
    ``with`` block).  An empty table has no cells in any set.
    """

    def __init__(self, df: DataFrame, columns: list[str], driver_cells: int = DRIVER_CELLS) -> None:
        self.columns, self.driver_cells, self.scans, self.sums = list(columns), driver_cells, 1, 0
        self._nodes: dict[frozenset, _Node] = {}
        self._spark, self._kinds = df.sparkSession, {c: df.schema[c].dataType.simpleString() for c in columns}
        self._add(tuple(columns), contingency(df, list(columns)))

    def __enter__(self) -> CountTree:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for node in self._nodes.values():
            if node.table is not None:
                drop(node.table)
        self._nodes.clear()

    def _add(self, columns: tuple[str, ...], counts: DataFrame) -> _Node:
        table = stored(counts, "count-tree")
        cells = table.count()
        if cells <= self.driver_cells:
            node = _Node(columns, cells, held={tuple(r[:-1]): r[-1] for r in table.select(*[F.col(f"`{c}`") for c in columns], "n").collect()})
            drop(table)
        else:
            node = _Node(columns, cells, table=table)
        self._nodes[frozenset(columns)] = node
        return node

    def _summed(self, source: _Node, columns: tuple[str, ...]) -> _Node:
        self.sums += 1
        if source.table is not None:
            return self._add(columns, source.table.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.sum("n").alias("n")))
        at, out = [source.columns.index(c) for c in columns], {}
        for key, n in source.held.items():
            part = tuple(key[i] for i in at)
            out[part] = out.get(part, 0) + n
        node = self._nodes[frozenset(columns)] = _Node(columns, len(out), held=out)
        return node

    def _node(self, columns: tuple[str, ...]) -> _Node:
        wanted = frozenset(columns)
        if unknown := wanted - set(self.columns):
            raise ValueError(f"not in the tree: {', '.join(sorted(unknown))}")
        if wanted not in self._nodes:
            source = min((x for k, x in self._nodes.items() if wanted <= k), key=lambda x: (x.cells, len(x.columns), x.columns))
            self._summed(source, tuple(c for c in self.columns if c in wanted))
        return self._nodes[wanted]

    def counts(self, columns: tuple[str, ...]) -> list[tuple]:
        """``(values ..., n)`` of each combination that occurs, values in the order of ``columns``; for sets that the driver may hold."""
        node = self._node(tuple(columns))
        if node.held is None:
            raise ValueError(f"{node.cells} cells: take them as a table")
        at = [node.columns.index(c) for c in columns]
        return [(*(key[i] for i in at), n) for key, n in node.held.items()]

    def table(self, columns: list[str]) -> DataFrame:
        """The same as a DataFrame, whatever its size.  Read before ``close`` what a stored one gives."""
        node, names = self._node(tuple(columns)), [F.col(f"`{c}`") for c in columns]
        if node.table is not None:
            return node.table.select(*names, "n")
        return self._spark.createDataFrame(self.counts(tuple(columns)), ", ".join(f"`{c}` {self._kinds[c]}" for c in columns) + ", n long")

    def grow(self, size: int) -> None:
        """All sets of up to ``size`` columns, smaller ones from larger ones, so that a search finds them."""
        for k in range(min(size, len(self.columns)), 0, -1):
            for c in combinations(self.columns, k):
                self._node(c)
