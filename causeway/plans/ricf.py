"""Maximum likelihood of mixed graphs: directed edges, correlated errors and undirected edges, from one covariance.

Residual iterative conditional fitting takes the variables in turn.  Given
everyone else's residuals, a variable's own effects and error covariances are
the coefficients of a regression on its parents and on pseudo-variables, the
residuals of its spouses scaled by the inverse of the others' error
covariance.  All of it is algebra on the covariance matrix, so the table is
read once whatever the number of rounds.  Variables on undirected edges are
fitted before by iterative proportional scaling of their concentration matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from causeway.operators.moments import Covariance
from causeway.plans.graphs import Graph
from causeway.plans.sem import _fit_statistics


@dataclass
class RicfFit:
    """Effects, error covariances, concentrations of the undirected part, what they imply, and how well it fits."""

    names: list[str]
    effects: np.ndarray  # [i, j]: of j on i
    errors: np.ndarray
    concentrations: np.ndarray
    implied: np.ndarray
    rounds: int
    chi_square: float
    degrees: int
    p: float
    bic: float
    rmsea: float
    cfi: float


def concentration_fit(s: np.ndarray, pairs: list[tuple[int, int]], rounds: int = 1000, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """``(covariance, concentration)`` of greatest likelihood whose concentrations are zero but at ``pairs``.

    Each variable in turn is regressed on its neighbours within the fitted
    covariance of the others, which keeps the sample's covariances at the
    pairs and zeros elsewhere.
    """
    w, p = s.copy(), len(s)
    near = [sorted({b for a, b in pairs if a == i} | {a for a, b in pairs if b == i}) for i in range(p)]
    for _ in range(rounds):
        before = w.copy()
        for i in range(p):
            rest = [j for j in range(p) if j != i]
            beta = np.zeros(p)
            if near[i]:
                beta[near[i]] = np.linalg.solve(w[np.ix_(near[i], near[i])], s[near[i], i])
            w[rest, i] = w[i, rest] = w[np.ix_(rest, rest)] @ beta[rest]
        if np.abs(w - before).max() < tolerance * np.abs(s).max():
            break
    k = np.linalg.inv(w)
    at = np.eye(p, dtype=bool)
    for a, b in pairs:
        at[a, b] = at[b, a] = True
    return w, np.where(at, k, 0.0)


def ricf(cov: Covariance, g: Graph, rounds: int = 2000, tolerance: float = 1e-9) -> RicfFit:
    """Fit ``g`` over its nodes, which are columns of ``cov``.

    Edges may be directed, bidirected (correlated errors) or undirected.
    Refused: nodes that are missing from ``cov``, directed cycles, an effect
    and a correlated error between the same two variables (not identified),
    and undirected edges at nodes that arrows point at.
    """
    names = list(g.nodes)
    if missing := [n for n in names if n not in cov.names]:
        raise ValueError(f"not in the covariance matrix: {', '.join(missing)}")
    at, p = {n: i for i, n in enumerate(names)}, len(names)
    s = cov.sub(names).matrix
    parents = [[at[x] for x in g.parents(n)] for n in names]
    spouses = [[at[x] for x in g.neighbours(n) if g.bidirected(x, n)] for n in names]
    lines = [(at[a], at[b]) for a in names for b in names if a < b and g.undirected(a, b)]
    for i in range(p):
        if set(parents[i]) & set(spouses[i]):
            raise ValueError(f"an effect and a correlated error between {names[i]} and another variable")
    _order(names, parents)
    on_line = sorted({i for x in lines for i in x})
    if bad := [names[i] for i in on_line if parents[i] or spouses[i]]:
        raise ValueError(f"arrows into undirected parts: {', '.join(bad)}")
    effects, errors, concentrations = np.zeros((p, p)), np.diag(np.diag(s)).astype(float), np.zeros((p, p))
    if lines:
        place = {i: k for k, i in enumerate(on_line)}
        inner = np.ix_(on_line, on_line)
        errors[inner], concentrations[inner] = concentration_fit(s[inner], [(place[a], place[b]) for a, b in lines])
    free = [i for i in range(p) if i not in on_line]
    taken = 0
    for taken in range(1, rounds + 1):
        before = np.concatenate([effects.ravel(), errors.ravel()])
        for i in free:
            pa, sp = parents[i], spouses[i]
            rest = [j for j in range(p) if j != i]
            if sp:
                residual = np.eye(p)[rest] - effects[rest]
                scaled = np.linalg.inv(errors[np.ix_(rest, rest)])
                forms = np.vstack([np.eye(p)[pa], (scaled @ residual)[[rest.index(j) for j in sp]]])
            else:
                forms = np.eye(p)[pa]
            own = np.zeros(len(pa) + len(sp))
            if len(own):
                own = np.linalg.solve(forms @ s @ forms.T, forms @ s[:, i])
            effects[i, pa] = own[: len(pa)]
            errors[i, :] = errors[:, i] = 0
            errors[i, sp] = errors[sp, i] = own[len(pa) :]
            left = np.eye(p)[i] - own @ forms if len(own) else np.eye(p)[i]
            errors[i, i] = left @ s @ left
            if sp:
                errors[i, i] += errors[i, rest] @ scaled @ errors[rest, i]
        after = np.concatenate([effects.ravel(), errors.ravel()])
        # Without spouses one round is exact.
        if np.abs(after - before).max() <= tolerance * max(np.abs(after).max(), 1e-300) or not any(spouses):
            break
    inverse = np.linalg.inv(np.eye(p) - effects)
    implied = inverse @ errors @ inverse.T
    free_parameters = p + sum(map(len, parents)) + sum(map(len, spouses)) // 2 + len(lines)
    return RicfFit(names, effects, errors, concentrations, implied, taken, *_fit_statistics(s, implied, cov.n, free_parameters))


def _order(names: list[str], parents: list[list[int]]) -> list[int]:
    out: list[int] = []
    while len(out) < len(names):
        ready = [i for i in range(len(names)) if i not in out and set(parents[i]) <= set(out)]
        if not ready:
            raise ValueError("a directed cycle")
        out += ready
    return out


def likelihood_gap(fit: RicfFit, s: np.ndarray, g: Graph) -> float:
    """The largest slope of the log likelihood by any free parameter, in units of the variables' spreads; 0 at a maximum."""
    p = len(fit.names)
    k = np.linalg.inv(fit.implied)
    outer = k @ (s - fit.implied) @ k
    inverse = np.linalg.inv(np.eye(p) - fit.effects)
    by_errors, by_effects = inverse.T @ outer @ inverse, 2 * inverse.T @ outer @ fit.implied
    size, worst = np.sqrt(np.diag(s)), 0.0
    for i, a in enumerate(fit.names):
        worst = max(worst, abs(by_errors[i, i]) * size[i] ** 2)
        for j, b in enumerate(fit.names):
            if i != j and g.adjacent(a, b):
                if g.directed(b, a):
                    worst = max(worst, abs(by_effects[i, j]) * size[i] / size[j])
                elif g.bidirected(a, b):
                    worst = max(worst, abs(by_errors[i, j]) * size[i] * size[j])
    return worst

