"""Clusters of indicators by vanishing tetrads and sextads: pure clusters of one factor each, and clusters of two factors.

Everything here works on a ``DeltaTest``, so on a table's second and fourth
moments (or a covariance matrix alone); the table is read before the search.
"""

from __future__ import annotations

from itertools import combinations

from causeway.operators.delta import DeltaTest
from causeway.operators.independence import FisherZ


class _Constraints:
    """Which tetrads and sextads vanish at a level; each is tested once."""

    def __init__(self, test: DeltaTest, alpha: float) -> None:
        self.test, self.alpha = test, alpha
        self.marginal = FisherZ(test.cov, alpha)
        self.known: dict = {}

    def _held(self, key: tuple, p) -> bool:
        if key not in self.known:
            self.known[key] = p() > self.alpha
        return self.known[key]

    def correlated(self, names) -> bool:
        """Whether no two of them are uncorrelated."""
        return all(not self._held(("pair", frozenset(x)), lambda x=x: 1.0 if self.marginal.independent(*x, []) else 0.0) for x in combinations(names, 2))

    def tetrad(self, a: str, b: str, c: str, d: str) -> bool:
        """Whether s_ab s_cd = s_ac s_bd."""
        sides = frozenset((frozenset((frozenset((a, b)), frozenset((c, d)))), frozenset((frozenset((a, c)), frozenset((b, d))))))
        return self._held(("tetrad", sides), lambda: self.test.tetrads((a, b, c, d))[2])

    def one_factor(self, four) -> bool:
        return self._held(("four", frozenset(four)), lambda: self.test.one_factor(sorted(four)))

    def two_factors(self, six) -> bool:
        return self._held(("six", frozenset(six)), lambda: self.test.two_factors(sorted(six)))


def _apart(c: _Constraints, names: list[str]) -> set[frozenset]:
    """Pairs that no single factor can be behind.

    x and y have no common parent if x with two others and y makes a
    one-factor four, y with two others and x does so too, and yet the
    products across x, y and one of each don't agree.
    """
    out = set()
    for x, y in combinations(names, 2):
        if not c.correlated((x, y)):
            out.add(frozenset((x, y)))
            continue
        rest = [n for n in names if n not in (x, y)]
        with_both = [two for two in combinations(rest, 2) if c.correlated((x, y, *two)) and c.one_factor((x, y, *two))]
        # Each two is a candidate for either side; the sides must not share a variable.
        if any(not set(p) & set(q) and any(not c.tetrad(x, u, v, y) for u in p for v in q) for p in with_both for q in with_both):
            out.add(frozenset((x, y)))
    return out


def _cliques(names: list[str], apart: set[frozenset]) -> list[list[str]]:
    """All largest sets of variables of which no two are apart."""
    near = {a: {b for b in names if b != a and frozenset((a, b)) not in apart} for a in names}
    out: list[list[str]] = []

    def grow(now: set[str], open_: set[str], done: set[str]) -> None:
        if not open_ and not done:
            out.append(sorted(now))
            return
        pivot = max(open_ | done, key=lambda n: (len(near[n] & open_), n))
        for n in sorted(open_ - near[pivot]):
            grow(now | {n}, open_ & near[n], done & near[n])
            open_, done = open_ - {n}, done | {n}

    grow(set(), set(names), set())
    return out


def _impurities(c: _Constraints, clusters: list[list[str]]) -> dict[str, int]:
    """How many broken constraints each variable takes part in: fours of one cluster, and twos of two clusters."""
    bad: dict[str, int] = {}
    for x in clusters:
        for four in combinations(x, 4):
            if not c.one_factor(four):
                for n in four:
                    bad[n] = bad.get(n, 0) + 1
    for x, y in combinations(clusters, 2):
        for three, other in ((t, o) for one, two in ((x, y), (y, x)) for t in combinations(one, 3) for o in two):
            if c.correlated((*three, other)) and not c.one_factor((*three, other)):
                for n in (*three, other):
                    bad[n] = bad.get(n, 0) + 1
        for (a, b), (d, e) in ((p, q) for p in combinations(x, 2) for q in combinations(y, 2)):
            # The products that keep the clusters' pairs apart must agree.
            if not c.tetrad(a, d, e, b):
                for n in (a, b, d, e):
                    bad[n] = bad.get(n, 0) + 1
    return bad


def purified(c: _Constraints, clusters: list[list[str]], least: int) -> list[list[str]]:
    """Without the variables that break most constraints, one after the other, until none is broken."""
    held = [sorted(x) for x in clusters]
    while bad := _impurities(c, held):
        worst = max(bad, key=lambda n: (bad[n], n))
        held = [y for x in held if len(y := [n for n in x if n != worst]) >= least]
    return held


def build_pure_clusters(test: DeltaTest, alpha: float = 0.01, least: int = 3) -> list[list[str]]:
    """Disjoint clusters of indicators, each of one factor of its own, without impure indicators.

    Variables that no factor can join are found first; the largest sets
    without such a pair become clusters, larger ones first, ties by name, and
    are then purified.  Variables uncorrelated with all others are in none.
    """
    c, names = _Constraints(test, alpha), sorted(test.cov.names)
    names = [n for n in names if any(c.correlated((n, o)) for o in names if o != n)]
    apart, chosen, taken = _apart(c, names), [], set()
    for clique in sorted(_cliques(names, apart), key=lambda x: (-len(x), x)):
        left = [n for n in clique if n not in taken]
        if len(left) >= least:
            chosen.append(left)
            taken |= set(left)
    return sorted(purified(c, chosen, least))


def two_factor_clusters(test: DeltaTest, alpha: float = 0.01, least: int = 6) -> list[list[str]]:
    """Clusters of indicators of the same two factors.

    Five correlated variables are pure if their sextads with any sixth one
    vanish, and one factor alone isn't behind them.  A cluster grows by variables with which
    all its fives stay pure; smaller ones than ``least`` are left out.
    """
    c, names = _Constraints(test, alpha), sorted(test.cov.names)
    known: dict[frozenset, bool] = {}

    def pure(five: frozenset) -> bool:
        if five not in known:
            known[five] = c.correlated(sorted(five)) and all(c.two_factors((*five, o)) for o in names if o not in five) and not all(c.one_factor(x) for x in combinations(sorted(five), 4))
        return known[five]

    left, out = list(names), []
    for start in combinations(names, 5):
        if not set(start) <= set(left) or not pure(frozenset(start)):
            continue
        cluster = list(start)
        for n in left:
            if n not in cluster and all(pure(frozenset((*four, n))) for four in combinations(cluster, 4)):
                cluster.append(n)
        if len(cluster) >= least:
            out.append(sorted(cluster))
            left = [n for n in left if n not in cluster]
    return out
