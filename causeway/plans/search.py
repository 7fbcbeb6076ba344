"""Structure search on small sufficient statistics.

Searches take an independence test or a score; both answer from aggregates
that Spark has already gathered, so the graph rules here run on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush
from itertools import combinations

import numpy as np

from causeway.operators.independence import FisherZ, IndependenceTest
from causeway.operators.scores import Score
from causeway.plans.graphs import ARROW, CIRCLE, TAIL, Graph, Knowledge, apply_knowledge, dag_to_pattern, meek

Sepsets = dict[frozenset, frozenset]


# Adjacency searches -----------------------------------------------------------


def adjacency_search(test: IndependenceTest, depth: int = -1, knowledge: Knowledge | None = None, stable: bool = True, deterministic: bool = False, fdr: float | None = None, initial: Graph | None = None) -> tuple[Graph, Sepsets]:
    """Fast adjacency search: edges go at the first set of neighbours that separates their ends, sets by growing size.

    With ``stable`` the neighbours are those at the start of each size, so the
    order of nodes doesn't matter.  With ``fdr`` the cutoff of each size is
    that of its p-values' false-discovery rate.  With ``deterministic`` sets
    that determine a node are skipped.
    """
    names = test.names
    if initial is None:
        g = Graph(names)
        for a, b in combinations(names, 2):
            if not (knowledge and knowledge.no_edge(a, b)):
                g.add(a, b, TAIL, TAIL)
    else:
        g = initial.undirected_copy()
    sepsets: Sepsets = {}
    size = 0
    while depth < 0 or size <= depth:
        frozen = {n: set(g.neighbours(n)) for n in names}
        tried, removals = False, []
        for a in names:
            for b in sorted(frozen[a] if stable else set(g.neighbours(a))):
                if not g.adjacent(a, b) or (knowledge and (knowledge.is_required(a, b) or knowledge.is_required(b, a))):
                    continue
                around = sorted(((frozen[a] if stable else set(g.neighbours(a))) - {b}) - {n for n in names if knowledge and knowledge.is_required(a, n)})
                if len(around) < size:
                    continue
                tried = True
                for z in combinations(around, size):
                    if deterministic and (test.determines(list(z), a) or test.determines(list(z), b)):
                        continue
                    if fdr is not None:
                        removals.append((test.p_value(a, b, list(z)), a, b, z))
                    elif test.independent(a, b, list(z)):
                        g.remove(a, b)
                        sepsets[frozenset((a, b))] = frozenset(z)
                        break
        if fdr is not None and removals:
            ps = sorted(r[0] for r in removals)
            cutoff = max([p for k, p in enumerate(ps, 1) if p <= k / (len(ps) + 1) * fdr], default=0.0)
            for p, a, b, z in sorted(removals, reverse=True):
                if p > cutoff and g.adjacent(a, b):
                    g.remove(a, b)
                    sepsets[frozenset((a, b))] = frozenset(z)
        if not tried:
            break
        size += 1
    return g, sepsets


def _separating_sets(test: IndependenceTest, g: Graph, a: str, c: str, depth: int) -> list[tuple[frozenset, float]]:
    """Sets of neighbours of either end that separate two nodes, with their p-values."""
    out = {}
    for n in (a, c):
        around = [m for m in g.neighbours(n) if m not in (a, c)]
        for k in range((len(around) if depth < 0 else min(depth, len(around))) + 1):
            for z in combinations(around, k):
                if test.independent(a, c, list(z)):
                    out[frozenset(z)] = test.p_value(a, c, list(z))
    return sorted(out.items(), key=lambda x: (-x[1], sorted(x[0])))


def orient_colliders(g: Graph, sepsets: Sepsets, knowledge: Knowledge | None = None) -> None:
    """a -> b <- c for unshielded triples whose middle isn't in the set that separated the ends."""
    may = lambda a, b: knowledge is None or not (knowledge.is_forbidden(a, b) or knowledge.is_required(b, a))
    for a, b, c in list(g.unshielded()):
        z = sepsets.get(frozenset((a, c)))
        if z is not None and b not in z and may(a, b) and may(c, b) and not g.directed(b, a) and not g.directed(b, c):
            g.orient(a, b)
            g.orient(c, b)


def pc(test: IndependenceTest, depth: int = -1, knowledge: Knowledge | None = None, stable: bool = True, rule: str = "sepset", **fas) -> Graph:
    """PC and its relatives: adjacency search, colliders, implied orientations.

    ``rule`` decides colliders: ``sepset`` by the set found first; ``conservative``
    if no separating set has the middle (and noncolliders if all have it, else
    the triple is ambiguous); ``majority`` by most separating sets; ``max`` by
    the set of the highest p-value.
    """
    g, sepsets = adjacency_search(test, depth, knowledge, stable, **fas)
    apply_knowledge(g, knowledge)
    if rule == "sepset":
        orient_colliders(g, sepsets, knowledge)
    else:
        colliders = []
        for a, b, c in list(g.unshielded()):
            found = _separating_sets(test, g, a, c, depth)
            with_b = sum(b in z for z, _ in found)
            if rule == "max":
                if found and b not in found[0][0]:
                    colliders.append((-found[0][1], a, b, c))
            elif found and with_b == 0 or rule == "majority" and 2 * with_b < len(found):
                colliders.append((0.0, a, b, c))
            elif found and (with_b == len(found) or rule == "majority" and 2 * with_b > len(found)):
                pass
            else:
                g.ambiguous |= {(a, b, c), (c, b, a)}
        for _, a, b, c in sorted(colliders):
            may = lambda x, y: knowledge is None or not (knowledge.is_forbidden(x, y) or knowledge.is_required(y, x))
            if may(a, b) and may(c, b) and not g.directed(b, a) and not g.directed(b, c):
                g.orient(a, b)
                g.orient(c, b)
    return meek(g, knowledge)


def pc_stable(test, **kw):
    return pc(test, stable=True, **kw)


def cpc(test, **kw):
    return pc(test, rule="conservative", **kw)


def pc_majority(test, **kw):
    return pc(test, rule="majority", **kw)


def pc_max(test, **kw):
    return pc(test, rule="max", **kw)


def pcd(test, **kw):
    """PC for data with deterministic relations."""
    return pc(test, deterministic=True, **kw)


def pc_fdr(test, level: float = 0.05, **kw):
    return pc(test, fdr=level, **kw)


# Latent variables ---------------------------------------------------------------


def _circles(g: Graph) -> Graph:
    return Graph(g.nodes, [(a, b, CIRCLE, CIRCLE) for a, b, _, _ in g.edges()])


def possible_d_sep(g: Graph, a: str, longest: int = -1) -> set[str]:
    """Nodes on paths from a on which every inner triple is a collider or a triangle."""
    seen, out, todo = set(), set(), [(a, n, 1) for n in g.neighbours(a)]
    while todo:
        p, n, d = todo.pop()
        if (p, n) in seen or (0 <= longest < d):
            continue
        seen.add((p, n))
        out.add(n)
        todo += [(n, m, d + 1) for m in g.neighbours(n) if m not in (p, a) and (g.collider(p, n, m) or g.adjacent(p, m))]
    return out - {a}


def fci(test: IndependenceTest, depth: int = -1, knowledge: Knowledge | None = None, possible_dsep: bool = True, complete: bool = True, rule: str = "sepset", longest: int = -1, skeleton: tuple[Graph, Sepsets] | None = None) -> Graph:
    """FCI: a partial ancestral graph that allows for latent common causes.

    Without ``possible_dsep`` it is the fast variant that skips the second
    removal stage.  ``rule`` is as in ``pc``.
    """
    g, sepsets = skeleton or adjacency_search(test, depth, knowledge, True)
    g = _circles(g)
    if possible_dsep:
        first = g.copy()
        _collide(first, test, sepsets, rule, depth)
        for a, b, _, _ in list(g.edges()):
            for x, y in ((a, b), (b, a)):
                if not g.adjacent(a, b):
                    break
                held = sorted(possible_d_sep(first, x, longest) - {y})
                for k in range((len(held) if depth < 0 else min(depth, len(held))) + 1):
                    z = next((z for z in combinations(held, k) if test.independent(x, y, list(z))), None)
                    if z is not None:
                        g.remove(a, b)
                        sepsets[frozenset((a, b))] = frozenset(z)
                        break
    _collide(g, test, sepsets, rule, depth)
    _knowledge_marks(g, knowledge)
    return orient_pag(g, sepsets, complete)


def _collide(g: Graph, test: IndependenceTest, sepsets: Sepsets, rule: str, depth: int) -> None:
    for a, b, c in list(g.unshielded()):
        z = sepsets.get(frozenset((a, c)))
        if rule != "sepset":
            found = _separating_sets(test, g, a, c, depth)
            if rule == "max" and found:
                z = found[0][0]
            elif rule in ("conservative", "majority") and found:
                share = sum(b in s for s, _ in found) / len(found)
                z = frozenset() if share == 0 or (rule == "majority" and share < 0.5) else frozenset({b})
        if z is not None and b not in z:
            g.set_mark(a, b, ARROW)
            g.set_mark(c, b, ARROW)


def _knowledge_marks(g: Graph, knowledge: Knowledge | None) -> None:
    if not knowledge:
        return
    for a, b, _, _ in list(g.edges()):
        for x, y in ((a, b), (b, a)):
            if knowledge.is_required(x, y):
                g.orient(x, y)
            elif knowledge.is_forbidden(x, y):
                g.set_mark(y, x, ARROW)


def _uncovered_paths(g: Graph, a: str, b: str, ok: Callable[[str, str], bool], longest: int = 12):
    """Paths between two nodes whose steps are all allowed and whose neighbours-but-one aren't adjacent."""
    todo = [[a]]
    while todo:
        path = todo.pop()
        if path[-1] == b:
            if len(path) > 2:
                yield path
            continue
        if len(path) > longest:
            continue
        for n in g.neighbours(path[-1]):
            if n not in path and ok(path[-1], n) and (len(path) < 2 or not g.adjacent(path[-2], n)):
                todo.append([*path, n])


def orient_pag(g: Graph, sepsets: Sepsets, complete: bool = True) -> Graph:
    """Zhang's orientation rules 1 to 4, and with ``complete`` 5 to 10, to a fixed point."""
    changed = True

    def put(a: str, b: str, mark: str) -> None:
        nonlocal changed
        if g.mark(a, b) == CIRCLE:
            g.set_mark(a, b, mark)
            changed = True

    possibly = lambda x, y: g.mark(y, x) != ARROW and g.mark(x, y) != TAIL
    while changed:
        changed = False
        for b in g.nodes:
            for a in g.neighbours(b):
                for c in g.neighbours(b):
                    if a == c:
                        continue
                    # 1: an arrow into b that can't collide goes on.
                    if g.mark(a, b) == ARROW and g.mark(c, b) == CIRCLE and not g.adjacent(a, c):
                        put(b, c, ARROW)
                        put(c, b, TAIL)
                    # 2: along a directed path of two edges.
                    if g.adjacent(a, c) and g.mark(a, c) == CIRCLE and (g.directed(a, b) and g.mark(b, c) == ARROW or g.mark(a, b) == ARROW and g.directed(b, c)):
                        put(a, c, ARROW)
                    # 3: a fourth node with circles to both ends of a collider.
                    if g.collider(a, b, c) and not g.adjacent(a, c):
                        for d in g.neighbours(b):
                            if g.adjacent(a, d) and g.adjacent(c, d) and g.mark(a, d) == CIRCLE and g.mark(c, d) == CIRCLE and g.mark(d, b) == CIRCLE:
                                put(d, b, ARROW)
        _discriminating(g, sepsets, put)
        if not complete:
            continue
        for a, b, _, _ in list(g.edges()):
            # 5: circle paths that close a circle have tails.
            if g.mark(a, b) == CIRCLE == g.mark(b, a):
                both = lambda x, y: g.mark(x, y) == CIRCLE == g.mark(y, x)
                for path in _uncovered_paths(g, a, b, both):
                    if not g.adjacent(a, path[-2]) and not g.adjacent(b, path[1]):
                        for x, y in [*zip(path, path[1:]), (a, b)]:
                            put(x, y, TAIL)
                            put(y, x, TAIL)
                        break
        for b in g.nodes:
            for a in g.neighbours(b):
                for c in g.neighbours(b):
                    if a == c:
                        continue
                    # 6 and 7: tails go on.
                    if g.undirected(a, b) and g.mark(c, b) == CIRCLE:
                        put(c, b, TAIL)
                    if g.mark(b, a) == TAIL and g.mark(a, b) == CIRCLE and g.mark(c, b) == CIRCLE and not g.adjacent(a, c):
                        put(c, b, TAIL)
                    # 8: a -> b -> c, or a -o b -> c, with a o-> c.
                    if g.adjacent(a, c) and g.mark(c, a) == CIRCLE and g.mark(a, c) == ARROW and g.directed(b, c) and g.mark(b, a) == TAIL and g.mark(a, b) in (ARROW, CIRCLE):
                        put(c, a, TAIL)
        for a in g.nodes:
            for c in g.neighbours(a):
                if not (g.mark(c, a) == CIRCLE and g.mark(a, c) == ARROW):
                    continue
                # 9: an uncovered possibly directed path around.
                if any(not g.adjacent(p[1], c) for p in _uncovered_paths(g, a, c, possibly) if len(p) > 3):
                    put(c, a, TAIL)
                    continue
                # 10: two parents of c reached by such paths that part at once.
                for b, d in combinations([x for x in g.parents(c) if x != a], 2):
                    starts = lambda t: [a_p[1] for a_p in _uncovered_paths(g, a, t, possibly)] + ([t] if g.adjacent(a, t) and possibly(a, t) else [])
                    if any(m != w and not g.adjacent(m, w) for m in starts(b) for w in starts(d)):
                        put(c, a, TAIL)
                        break
    return g


def _discriminating(g: Graph, sepsets: Sepsets, put: Callable[[str, str, str], None]) -> None:
    """Rule 4: a path ... a, b, c on which all nodes between its start and b collide and are parents of c decides b."""
    for b in g.nodes:
        for c in g.neighbours(b):
            if g.mark(c, b) != CIRCLE:
                continue
            for a in g.neighbours(b):
                if a == c or not g.adjacent(a, c) or not g.directed(a, c) or g.mark(b, a) != ARROW:
                    continue
                seen, todo = {a, b, c}, [[a]]
                while todo:
                    path = todo.pop(0)
                    end = next((d for d in g.neighbours(path[-1]) if d not in seen and g.mark(d, path[-1]) == ARROW and not g.adjacent(d, c)), None)
                    if end is not None:
                        z = sepsets.get(frozenset((end, c)), frozenset())
                        if b in z:
                            put(c, b, TAIL)
                            put(b, c, ARROW)
                        else:
                            for x, y in ((a, b), (c, b), (b, c)):
                                put(x, y, ARROW)
                        break
                    for d in g.neighbours(path[-1]):
                        if d not in seen and g.mark(d, path[-1]) == ARROW and g.mark(path[-1], d) == ARROW and g.directed(d, c):
                            seen.add(d)
                            todo.append([*path, d])


def rfci(test, **kw):
    return fci(test, possible_dsep=False, **kw)


def cfci(test, **kw):
    return fci(test, rule="conservative", **kw)


def fci_max(test, **kw):
    return fci(test, rule="max", **kw)


def gfci(test: IndependenceTest, score: Score, knowledge: Knowledge | None = None, rule: str = "sepset", complete: bool = True) -> Graph:
    """FCI whose adjacencies start from a score search."""
    pattern = fges(score, knowledge=knowledge)
    g, sepsets = pattern.undirected_copy(), {}
    for a, b, _, _ in list(pattern.edges()):
        for x, y in ((a, b), (b, a)):
            common = [n for n in g.neighbours(x) if n != y]
            found = next((z for k in range(len(common) + 1) for z in combinations(common, k) if g.adjacent(a, b) and test.independent(a, b, list(z)) and any(pattern.adjacent(m, y) and pattern.adjacent(m, x) for m in pattern.neighbours(x))), None)
            if found is not None and g.adjacent(a, b):
                g.remove(a, b)
                sepsets[frozenset((a, b))] = frozenset(found)
    for a, b, c in g.unshielded():
        if frozenset((a, c)) not in sepsets:
            found = _separating_sets(test, g, a, c, -1)
            if found:
                sepsets[frozenset((a, c))] = found[0][0]
            elif pattern.directed(a, b) and pattern.directed(c, b):
                sepsets[frozenset((a, c))] = frozenset()
            else:
                sepsets[frozenset((a, c))] = frozenset({b})
    return fci(test, knowledge=knowledge, possible_dsep=False, complete=complete, rule=rule, skeleton=(g, sepsets))


# Score search ------------------------------------------------------------------


def fges(score: Score, knowledge: Knowledge | None = None, max_degree: int = -1, faithful: bool = True, initial: Graph | None = None, targets: set[str] | None = None) -> Graph:
    """Greedy equivalence search: insertions by falling gain, then deletions, over patterns.

    With ``faithful``, pairs without a gain on their own are never joined.
    With ``targets`` only pairs with a target, or next to one, are.
    """
    names = score.names
    at = {n: i for i, n in enumerate(names)}
    g = (initial or Graph(names)).copy()
    allowed = {frozenset(p) for p in combinations(names, 2) if not (knowledge and knowledge.no_edge(*p)) and (not faithful or max(score.difference(at[p[0]], at[p[1]], []), score.difference(at[p[1]], at[p[0]], [])) > 0)}
    if targets is not None:
        near = targets | {n for p in allowed if p & targets for n in p}
        allowed = {p for p in allowed if p <= near}

    def na(x: str, y: str) -> list[str]:
        """Neighbours of y by undirected edges that are adjacent to x."""
        return [n for n in g.neighbours(y) if g.undirected(n, y) and g.adjacent(n, x)]

    def gain_insert(x: str, y: str) -> list[tuple[float, str, str, tuple]]:
        if knowledge and knowledge.is_forbidden(x, y):
            return []
        shared, parents = na(x, y), g.parents(y)
        free = [n for n in g.neighbours(y) if g.undirected(n, y) and not g.adjacent(n, x) and n != x]
        out = []
        for k in range(min(len(free), 4) + 1):
            for t in combinations(free, k):
                s = set(shared) | set(t)
                if not g.clique(s):
                    continue
                d = score.difference(at[x], at[y], [at[n] for n in s | set(parents)])
                if d > 0:
                    out.append((-d, x, y, t))
        return out

    def gain_delete(x: str, y: str) -> list[tuple[float, str, str, tuple]]:
        if knowledge and knowledge.is_required(x, y):
            return []
        shared, parents = na(x, y), [p for p in g.parents(y) if p != x]
        out = []
        for k in range(min(len(shared), 4) + 1):
            for h in combinations(shared, k):
                rest = set(shared) - set(h)
                if not g.clique(rest):
                    continue
                d = -score.difference(at[x], at[y], [at[n] for n in rest | set(parents)])
                if d >= 0:
                    out.append((-d, x, y, h))
        return out

    def rebuild() -> None:
        nonlocal g
        reverted = g.undirected_copy()
        for a, b, c in g.unshielded():
            if g.directed(a, b) and g.directed(c, b):
                reverted.orient(a, b)
                reverted.orient(c, b)
        g = meek(apply_knowledge(reverted, knowledge), knowledge)

    heap: list = []

    def refill(nodes: set[str]) -> None:
        for y in nodes:
            for x in names:
                if x != y and frozenset((x, y)) in allowed and not g.adjacent(x, y):
                    for e in gain_insert(x, y):
                        heappush(heap, e)

    refill(set(names))
    while heap:
        d, x, y, t = heappop(heap)
        if g.adjacent(x, y) or (0 <= max_degree and (g.degree(x) >= max_degree or g.degree(y) >= max_degree)):
            continue
        s = set(na(x, y)) | set(t)
        if any(not g.undirected(n, y) or g.adjacent(n, x) for n in t) or not g.clique(s):
            continue
        now = score.difference(at[x], at[y], [at[n] for n in s | set(g.parents(y))])
        if abs(now + d) > 1e-9:
            if now > 0:
                heappush(heap, (-now, x, y, t))
            continue
        if g.semi_directed_path(y, {x}, s):
            continue
        before = {n: (frozenset(g.parents(n)), frozenset(g.neighbours(n))) for n in names}
        g.orient(x, y)
        for n in t:
            g.orient(n, y)
        rebuild()
        refill({n for n in names if before[n] != (frozenset(g.parents(n)), frozenset(g.neighbours(n)))} | {x, y})
    while True:
        best = min((e for a, b, _, _ in list(g.edges()) for x, y in ((a, b), (b, a)) if g.directed(x, y) or g.undirected(x, y) for e in gain_delete(x, y)), default=None)
        if best is None or best[0] >= 0:
            return g
        _, x, y, h = best
        g.remove(x, y)
        for n in h:
            if g.undirected(y, n):
                g.orient(y, n)
            if g.adjacent(x, n) and g.undirected(x, n):
                g.orient(x, n)
        rebuild()


def fges_mb(score: Score, target: str, **kw) -> Graph:
    """The part of a greedy search around a target: it and its Markov blanket."""
    g = fges(score, targets={target}, **kw)
    return g.subgraph({target, *_possible_blanket(g, target)})


def _possible_blanket(g: Graph, n: str) -> set[str]:
    out = set(g.neighbours(n))
    for c in g.neighbours(n):
        if g.mark(n, c) == ARROW or g.undirected(n, c):
            out |= {p for p in g.neighbours(c) if g.directed(p, c)}
    return out - {n}


def gpc(test: IndependenceTest, score: Score, knowledge: Knowledge | None = None, depth: int = -1) -> Graph:
    """PC whose adjacency search starts from a score search's."""
    g, sepsets = adjacency_search(test, depth, knowledge, True, initial=fges(score, knowledge))
    apply_knowledge(g, knowledge)
    for a, b, c in g.unshielded():
        if frozenset((a, c)) not in sepsets and (found := _separating_sets(test, g, a, c, depth)):
            sepsets[frozenset((a, c))] = found[0][0]
    orient_colliders(g, sepsets, knowledge)
    return meek(g, knowledge)


def ccd(test: IndependenceTest, depth: int = -1) -> Graph:
    """Cyclic discovery: adjacency, colliders, and noncolliders underlined; cycles are not excluded."""
    g, sepsets = adjacency_search(test, depth)
    out = _circles(g)
    for a, b, c in out.unshielded():
        z = sepsets.get(frozenset((a, c)))
        if z is not None and b in z:
            out.underlines.add((a, b, c))
        elif z is not None:
            out.orient(a, b)
            out.orient(c, b)
    return out


def inverse_correlation(cov, threshold: float) -> Graph:
    """Edges whose scaled precision exceeds a threshold."""
    p = np.linalg.pinv(cov.matrix)
    d = np.sqrt(np.diag(p))
    r = np.abs(p / np.outer(d, d))
    return Graph(cov.names, [(a, b, TAIL, TAIL) for (i, a), (j, b) in combinations(enumerate(cov.names), 2) if r[i, j] > threshold])


def glasso(s: np.ndarray, penalty: float, steps: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """Precision matrix under an L1 penalty, by block coordinate descent."""
    p = len(s)
    w = s + penalty * np.eye(p)
    betas = np.zeros((p, p))
    for _ in range(steps):
        before = w.copy()
        for j in range(p):
            rest = [k for k in range(p) if k != j]
            v, target, beta = w[np.ix_(rest, rest)], s[rest, j], betas[j, rest]
            for _ in range(steps):
                old = beta.copy()
                for k in range(p - 1):
                    pull = target[k] - v[k] @ beta + v[k, k] * beta[k]
                    beta[k] = np.sign(pull) * max(abs(pull) - penalty, 0) / v[k, k]
                if np.abs(beta - old).max(initial=0) < tolerance:
                    break
            betas[j, rest] = beta
            w[rest, j] = w[j, rest] = v @ beta
        if np.abs(w - before).max() < tolerance:
            break
    return np.linalg.inv(w)


# Markov blankets ----------------------------------------------------------------


def grow_shrink(test: IndependenceTest, target: str) -> list[str]:
    held: list[str] = []
    changed = True
    while changed:
        changed = False
        for n in test.names:
            if n != target and n not in held and not test.independent(target, n, held):
                held.append(n)
                changed = True
    for n in list(held):
        rest = [m for m in held if m != n]
        if test.independent(target, n, rest):
            held.remove(n)
    return sorted(held)


def iamb(test: IndependenceTest, target: str, interleaved: bool = False) -> list[str]:
    """Grows by the strongest association first; ``interleaved`` shrinks after each addition."""
    held: list[str] = []

    def shrink() -> bool:
        gone = False
        for n in list(held):
            if test.independent(target, n, [m for m in held if m != n]):
                held.remove(n)
                gone = True
        return gone

    for _ in range(4 * len(test.names)):
        best = min(((test.p_value(target, n, held), n) for n in test.names if n != target and n not in held), default=None)
        if best is None or best[0] > test.alpha:
            break
        held.append(best[1])
        if interleaved:
            shrink()
            if best[1] not in held:
                break
    shrink()
    return sorted(held)


def inter_iamb(test, target):
    return iamb(test, target, interleaved=True)


def iamb_pc(test: IndependenceTest, target: str) -> list[str]:
    """Growing as IAMB does, shrinking by all subsets."""
    return [n for n in iamb(test, target) if not _separable(test, target, n, iamb(test, target))]


def _separable(test: IndependenceTest, a: str, b: str, held: list[str], depth: int = 3) -> bool:
    rest = [m for m in held if m not in (a, b)]
    return any(test.independent(a, b, list(z)) for k in range(min(depth, len(rest)) + 1) for z in combinations(rest, k))


def mmpc(test: IndependenceTest, target: str, depth: int = 3, symmetric: bool = True) -> list[str]:
    """Max-min parents and children."""

    def one(t: str) -> list[str]:
        held: list[str] = []
        while True:
            left = [n for n in test.names if n != t and n not in held]
            weakest = {n: max(test.p_value(t, n, list(z)) for k in range(min(depth, len(held)) + 1) for z in combinations(held, k)) for n in left}
            best = min(weakest, key=lambda n: (weakest[n], n), default=None)
            if best is None or weakest[best] > test.alpha:
                break
            held.append(best)
        return [n for n in held if not _separable(test, t, n, held, depth)]

    found = one(target)
    return sorted(n for n in found if not symmetric or target in one(n))


def mmmb(test: IndependenceTest, target: str, depth: int = 3) -> list[str]:
    """Max-min Markov blanket: parents and children, and spouses that become dependent given a child."""
    near = mmpc(test, target, depth)
    out = set(near)
    for c in near:
        for s in mmpc(test, c, depth):
            if s == target or s in out:
                continue
            rest = [n for n in test.names if n not in (target, s)]
            z = next((z for k in range(min(depth, len(rest)) + 1) for z in combinations(rest, k) if test.independent(target, s, list(z))), None)
            if z is not None and not test.independent(target, s, sorted({*z, c})):
                out.add(s)
    return sorted(out)


def hiton_mb(test: IndependenceTest, target: str, depth: int = 3) -> list[str]:
    """Parents and children by interleaved additions and removals, then spouses as in ``mmmb``."""
    order = sorted((test.p_value(target, n, []), n) for n in test.names if n != target)
    held: list[str] = []
    for p, n in order:
        if p <= test.alpha:
            held.append(n)
            held = [m for m in held if not _separable(test, target, m, held, depth)]
    spouses = set(mmmb(test, target, depth))
    return sorted(set(held) | spouses)


def mmhc(test: IndependenceTest, score: Score, depth: int = 3, patience: int = 10) -> Graph:
    """Hill climbing over DAGs whose edges lie in the max-min skeleton.

    Graphs seen before are taboo; the climb goes on over ``patience`` moves
    that raise the score no further, as equivalent graphs have equal scores.
    """
    names, at = score.names, {n: i for i, n in enumerate(score.names)}
    near = {n: set(mmpc(test, n, depth)) for n in names}
    local = lambda n, parents: score.local(at[n], [at[p] for p in parents])
    g = Graph(names)
    now = best = 0.0
    found, seen, stale = g, {frozenset()}, 0
    while stale <= patience:
        moves = []
        for a in names:
            for b in near[a]:
                pa = g.parents(b)
                if not g.adjacent(a, b):
                    moves.append((local(b, [*pa, a]) - local(b, pa), a, b, "add"))
                elif g.directed(a, b):
                    drop = local(b, [p for p in pa if p != a]) - local(b, pa)
                    moves.append((drop, a, b, "remove"))
                    moves.append((drop + local(a, [*g.parents(a), b]) - local(a, g.parents(a)), a, b, "turn"))
        for gain, a, b, what in sorted(moves, key=lambda m: (-m[0], *m[1:])):
            h = g.copy()
            h.remove(a, b)
            if what != "remove":
                h.orient(*((a, b) if what == "add" else (b, a)))
            key = frozenset(h.edges())
            if key not in seen and h.acyclic():
                break
        else:
            break
        seen.add(key)
        g, now = h, now + gain
        found, best, stale = (g, now, 0) if now > best + 1e-9 else (found, best, stale + 1)
    return dag_to_pattern(found)


def markov_blanket_search(test: IndependenceTest, target: str, depth: int = -1) -> Graph:
    """PC restricted to a target's possible Markov blanket: adjacencies two steps out, oriented, then cut to the blanket."""
    first, _ = adjacency_search(test, depth)
    near = {target, *first.neighbours(target)}
    for n in first.neighbours(target):
        near |= set(first.neighbours(n))
    part = type(test).__new__(type(test))
    part.__dict__.update(test.__dict__)
    part.names = [n for n in test.names if n in near]
    g = pc(part, depth)
    return g.subgraph({target, *_possible_blanket(g, target)})


# Time series --------------------------------------------------------------------


def lagged_knowledge(names: list[str]) -> Knowledge:
    """Tiers by lag: nothing points back in time."""
    from causeway.operators.series import lag_name

    deepest = max(lag_name(n)[1] for n in names)
    return Knowledge({n: deepest - lag_name(n)[1] for n in names})


def time_series_pc(cov, alpha: float = 0.05) -> Graph:
    """PC over lagged columns, with edges the same at every lag."""
    from causeway.operators.series import lag_name

    g = pc(FisherZ(cov, alpha), knowledge=lagged_knowledge(cov.names))
    deepest = max(lag_name(n)[1] for n in cov.names)
    return _repeated(g, deepest)


def time_series_fci(cov, alpha: float = 0.05) -> Graph:
    return fci(FisherZ(cov, alpha), knowledge=lagged_knowledge(cov.names))


def time_series_fges(score: Score) -> Graph:
    return fges(score, knowledge=lagged_knowledge(score.names))


def _repeated(g: Graph, deepest: int) -> Graph:
    from causeway.operators.series import lag_name

    out = g.copy()
    for a, b, x, y in list(g.edges()):
        (pa, la), (pb, lb) = lag_name(a), lag_name(b)
        for k in range(1, deepest + 1 - max(la, lb)):
            u, v = f"{pa}:{la + k}", f"{pb}:{lb + k}"
            if u in out.marks and v in out.marks:
                out.add(u, v, x, y)
    return out


def lag_search(spark_frame, lags: range, alpha: float = 0.05) -> tuple[int, Graph]:
    """The number of lags whose vector autoregression has the least BIC, and the search at it."""
    from causeway.operators.moments import covariance_matrix
    from causeway.operators.scores import sem_bic
    from causeway.operators.series import lag_embed

    best = None
    for k in lags:
        embedded = lag_embed(spark_frame, k)
        names = [c for c in embedded.columns if c != "_row"]
        cov = covariance_matrix(embedded, names)
        past = [i for i, n in enumerate(names) if ":" in n]
        score = sum(sem_bic(cov, i, past, 1.0) for i, n in enumerate(names) if ":" not in n) / cov.n
        if best is None or score > best[0]:
            best = (score, k, cov)
    return best[1], time_series_pc(best[2], alpha)


def images(scores: list[Score], **kw) -> Graph:
    """One pattern for several data sets: the greedy search on the average of their scores."""
    from causeway.operators.scores import SumOfScores

    return fges(SumOfScores(scores), **kw)


def mimbuild(cov, clusters: list[list[str]], penalty: float = 2.0) -> Graph:
    """A pattern over the latent factors of clusters, with their indicators below them."""
    from causeway.operators.scores import SemBic
    from causeway.plans.sem import latent_correlations

    latent = latent_correlations(cov, clusters)
    g = fges(SemBic(latent, penalty))
    g.latent = set(latent.names)
    for name, cluster in zip(latent.names, clusters):
        for c in cluster:
            g.add_node(c)
            g.orient(name, c)
    return g


def overlapping(graphs_: list[Graph]) -> Graph:
    """What several partial ancestral graphs on overlapping variables agree on: adjacencies that no graph with both nodes lacks, marks that all of them share; unseen pairs stay open."""
    nodes = list(dict.fromkeys(n for g in graphs_ for n in g.nodes))
    out = Graph(nodes)
    for a, b in combinations(nodes, 2):
        seen = [g for g in graphs_ if a in g.marks and b in g.marks]
        if not seen:
            if not any(a in g.marks and not g.marks[a] or b in g.marks and not g.marks[b] for g in graphs_):
                out.add(a, b, CIRCLE, CIRCLE)
        elif all(g.adjacent(a, b) for g in seen):
            at_b, at_a = {g.mark(a, b) for g in seen} - {CIRCLE}, {g.mark(b, a) for g in seen} - {CIRCLE}
            out.add(a, b, at_a.pop() if len(at_a) == 1 else CIRCLE, at_b.pop() if len(at_b) == 1 else CIRCLE)
    return out
