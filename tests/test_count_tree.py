"""Counts of many sets of columns from one pass."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from causeway.operators.count_tree import CountTree
from causeway.operators.independence import ChiSquare
from causeway.operators.moments import contingency

NAMES = ["a", "b", "c", "x y"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(int(a), "uvw"[b], bool(c), int(d)) for a, b, c, d in zip(rng.integers(0, 4, 500), rng.integers(0, 3, 500), rng.integers(0, 2, 500), rng.integers(0, 9, 500))]
    return out + [(None, "u", True, 1), (1, None, True, 1)]


@pytest.mark.parametrize("cells", [1_000_000, 30, 0])
def test_same_as_counting(spark, rows, cells):
    df = spark.createDataFrame(rows, "a int, b string, c boolean, `x y` int")
    whole = [r for r in rows if None not in r]
    with CountTree(df, NAMES, cells) as tree:
        for k in range(1, 5):
            for names in combinations(reversed(NAMES), k):
                at = [NAMES.index(n) for n in names]
                wanted = Counter(tuple(r[i] for i in at) for r in whole)
                found = tree.table(list(names))
                assert found.columns == [*names, "n"] and {tuple(r[:-1]): r[-1] for r in found.collect()} == wanted
                if len(wanted) <= cells:
                    assert {tuple(key): n for *key, n in tree.counts(names)} == wanted
                else:
                    with pytest.raises(ValueError, match="as a table"):
                        tree.counts(names)
        assert tree.scans == 1
        assert tree.table(["a", "b"]).schema["a"].dataType == df.schema["a"].dataType
        with pytest.raises(ValueError, match="not in the tree: z"):
            tree.counts(("a", "z"))


def test_sums_from_the_smallest_set(spark, rows):
    df = spark.createDataFrame(rows, "a int, b string, c boolean, `x y` int")
    with CountTree(df, NAMES) as tree:
        tree.grow(3)
        before = tree.sums
        assert before == 14 and tree.counts(("a",)) and tree.sums == before
    with CountTree(df.limit(0), NAMES) as tree:
        assert tree.counts(("a", "b")) == [] and tree.table(["a"]).count() == 0


def test_search_statistics(spark, rows):
    df = spark.createDataFrame(rows, "a int, b string, c boolean, `x y` int").dropna()
    test = ChiSquare.of(df, NAMES)
    plain = ChiSquare(NAMES, lambda cols: [tuple(r) for r in contingency(df, list(cols)).collect()])
    for x, y, z in (("a", "b", []), ("a", "x y", ["c"]), ("b", "c", ["a", "x y"])):
        assert test.statistic(x, y, z) == pytest.approx(plain.statistic(x, y, z))
