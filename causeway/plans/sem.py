"""Structural equation models on covariance matrices: estimation, fit, scoring, text forms."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass
from itertools import combinations

import numpy as np

from causeway.functions.distributions import chisq_tail, normal_cdf, t_cdf
from causeway.operators.independence import FisherZ
from causeway.operators.moments import Covariance
from causeway.operators.regression import ols_from_covariance
from causeway.plans.graphs import Graph


@dataclass
class SemFit:
    """Coefficients by edge, error variances by node, and how well they fit."""

    graph: Graph
    coefficients: dict[tuple[str, str], float]
    errors: dict[tuple[str, str], float]
    p_values: dict[tuple[str, str], float]
    variances: dict[str, float]
    chi_square: float
    df: int
    p: float
    bic: float
    rmsea: float
    cfi: float

    def implied(self) -> np.ndarray:
        return implied_covariance(self.graph, self.coefficients, self.variances)


def implied_covariance(g: Graph, coefficients: dict[tuple[str, str], float], variances: dict[str, float], covariances: dict[tuple[str, str], float] | None = None) -> np.ndarray:
    at = {n: i for i, n in enumerate(g.nodes)}
    b, psi = np.zeros((len(at),) * 2), np.diag([variances[n] for n in g.nodes]).astype(float)
    for (x, y), w in coefficients.items():
        b[at[y], at[x]] = w
    for (x, y), w in (covariances or {}).items():
        psi[at[x], at[y]] = psi[at[y], at[x]] = w
    inverse = np.linalg.inv(np.eye(len(at)) - b)
    return inverse @ psi @ inverse.T


def _fit_statistics(sample: np.ndarray, implied: np.ndarray, n: int, parameters: int) -> tuple[float, int, float, float, float, float]:
    p = len(sample)
    sign, logdet = np.linalg.slogdet(implied)
    f = logdet + np.trace(sample @ np.linalg.inv(implied)) - np.linalg.slogdet(sample)[1] - p
    chi, df = max(0.0, (n - 1) * float(f)), p * (p + 1) // 2 - parameters
    null = (n - 1) * float(np.log(np.diag(sample)).sum() - np.linalg.slogdet(sample)[1])
    null_df = p * (p - 1) // 2
    cfi = 1 - max(chi - df, 0) / max(null - null_df, chi - df, 1e-12)
    rmsea = float(np.sqrt(max(chi - df, 0) / (max(df, 1) * (n - 1))))
    return chi, df, float(chisq_tail(chi, df)), chi - df * float(np.log(n)), rmsea, cfi


def fit_dag(cov: Covariance, g: Graph) -> SemFit:
    """Maximum likelihood of a DAG without latent nodes: each node's regression on its parents."""
    coefficients, errors, ps, variances = {}, {}, {}, {}
    for n in g.nodes:
        parents = g.parents(n)
        if not parents:
            variances[n] = float(cov.matrix[cov.index(n), cov.index(n)])
            continue
        f = ols_from_covariance(cov, n, parents)
        for p, b, e, pv in zip(parents, f.coefficients, f.errors, f.p):
            coefficients[p, n], errors[p, n], ps[p, n] = float(b), float(e), float(pv)
        variances[n] = f.rss / (cov.n - 1)
    sample = cov.sub(g.nodes).matrix
    implied = implied_covariance(g, coefficients, variances)
    return SemFit(g, coefficients, errors, ps, variances, *_fit_statistics(sample, implied, cov.n, len(coefficients) + len(g.nodes)))


def fit_latent(cov: Covariance, g: Graph, steps: int = 500, restarts: int = 3, seed: int = 42) -> SemFit:
    """Maximum likelihood with latent nodes or correlated errors, by gradient steps on the discrepancy from random starts; the first indicator of a latent is fixed at 1."""
    measured = [n for n in g.nodes if n not in g.latent]
    sample = cov.sub(measured).matrix
    edges = [(a, b) if g.directed(a, b) else (b, a) for a, b, _, _ in g.edges() if g.directed(a, b) or g.directed(b, a)]
    pairs = [(a, b) for a, b, _, _ in g.edges() if g.bidirected(a, b)]
    fixed = {}
    for latent in g.latent:
        own = [c for c in g.children(latent) if c not in g.latent]
        if own:
            fixed[latent, own[0]] = 1.0
    free = [e for e in edges if e not in fixed]
    at = [g.nodes.index(n) for n in measured]
    random = np.random.default_rng(seed)

    def model(theta: np.ndarray) -> np.ndarray:
        coefficients = {**fixed, **dict(zip(free, theta))}
        variances = dict(zip(g.nodes, np.exp(theta[len(free) : len(free) + len(g.nodes)])))
        return implied_covariance(g, coefficients, variances, dict(zip(pairs, theta[len(free) + len(g.nodes) :])))[np.ix_(at, at)]

    def loss(theta: np.ndarray) -> float:
        try:
            m = model(theta)
            sign, logdet = np.linalg.slogdet(m)
            return float("inf") if sign <= 0 else float(logdet + np.trace(np.linalg.solve(m, sample)))
        except np.linalg.LinAlgError:
            return float("inf")

    best, best_loss = None, float("inf")
    for _ in range(restarts):
        theta = np.concatenate([random.uniform(0.3, 1, len(free)), np.zeros(len(g.nodes)), np.zeros(len(pairs))])
        now, hess = loss(theta), np.eye(len(theta))
        grad = _gradient(loss, theta)
        for _ in range(steps):  # BFGS
            direction, size = -hess @ grad, 1.0
            while size > 1e-10 and not loss(theta + size * direction) < now - 1e-4 * size * abs(float(grad @ direction)):
                size /= 2
            if size <= 1e-10:
                break
            move = size * direction
            theta = theta + move
            after = _gradient(loss, theta)
            y, now = after - grad, loss(theta)
            grad = after
            if (sy := float(move @ y)) > 1e-12:
                r = 1 / sy
                left = np.eye(len(theta)) - r * np.outer(move, y)
                hess = left @ hess @ left.T + r * np.outer(move, move)
            if np.abs(grad).max() < 1e-7:
                break
        if now < best_loss:
            best, best_loss = theta, now
    coefficients = {**fixed, **{e: float(v) for e, v in zip(free, best)}}
    variances = {n: float(np.exp(v)) for n, v in zip(g.nodes, best[len(free) :])}
    return SemFit(g, coefficients, {}, {}, variances, *_fit_statistics(sample, model(best), cov.n, len(best)))


def _gradient(f, x: np.ndarray, step: float = 1e-6) -> np.ndarray:
    return np.array([(f(x + step * e) - f(x - step * e)) / (2 * step) for e in np.eye(len(x))])


def standardized(fit: SemFit) -> dict[tuple[str, str], float]:
    sd = np.sqrt(np.diag(fit.implied()))
    at = {n: i for i, n in enumerate(fit.graph.nodes)}
    return {(x, y): w * float(sd[at[x]] / sd[at[y]]) for (x, y), w in fit.coefficients.items()}


def total_effect(fit: SemFit, x: str, y: str) -> float:
    """The sum over directed paths of the products of their coefficients."""
    at = {n: i for i, n in enumerate(fit.graph.nodes)}
    b = np.zeros((len(at),) * 2)
    for (u, v), w in fit.coefficients.items():
        b[at[v], at[u]] = w
    return float(np.linalg.inv(np.eye(len(at)) - b)[at[y], at[x]])


def update(fit: SemFit, evidence: dict[str, float], target: str) -> tuple[float, float]:
    """Mean and variance of a centred node given values of others."""
    s = fit.implied()
    at = {n: i for i, n in enumerate(fit.graph.nodes)}
    z = [at[n] for n in evidence]
    w = np.linalg.solve(s[np.ix_(z, z)], s[z, at[target]])
    return float(w @ np.array(list(evidence.values()))), float(s[at[target], at[target]] - w @ s[z, at[target]])


def quartet_test(cov: Covariance, a: str, b: str, c: str, d: str) -> tuple[float, float]:
    """The difference s_ab s_cd - s_ac s_bd and Wishart's p-value that it vanishes."""
    i = [cov.index(v) for v in (a, b, c, d)]
    s = cov.matrix[np.ix_(i, i)]
    diff = s[0, 1] * s[2, 3] - s[0, 2] * s[1, 3]
    n = cov.n
    inner = np.linalg.det(s[np.ix_([0, 3], [0, 3])]) * np.linalg.det(s[np.ix_([1, 2], [1, 2])]) * (n + 1) / ((n - 1) * (n - 2)) - np.linalg.det(s) / (n - 2)
    spread = np.sqrt(max(inner, 1e-300))
    return float(diff), float(2 * (1 - normal_cdf(abs(diff) / spread)))


def quartet_vanishes(cov: Covariance, names: list[str], alpha: float = 0.05) -> bool:
    """Whether all three differences of covariance products of four variables vanish."""
    a, b, c, d = names
    return all(quartet_test(cov, *v)[1] > alpha for v in ((a, b, c, d), (a, b, d, c), (a, c, d, b)))


def one_factor_clusters(cov: Covariance, alpha: float = 0.05, least: int = 3) -> list[list[str]]:
    """Pure clusters of indicators of one factor.

    Three correlated variables are pure if together with any fourth one their
    differences vanish; so no fourth tells them to be of two factors.  A
    cluster grows from pure three by variables that leave all its threes pure.
    """
    test, names = FisherZ(cov, alpha), list(cov.names)
    known: dict[frozenset, bool] = {}

    def pure(three: frozenset) -> bool:
        if three not in known:
            known[three] = not any(test.independent(a, b, []) for a, b in combinations(sorted(three), 2)) and all(quartet_vanishes(cov, [*sorted(three), o], alpha) for o in names if o not in three)
        return known[three]

    left, out = list(names), []
    for start in combinations(names, 3):
        if not set(start) <= set(left) or not pure(frozenset(start)):
            continue
        cluster = list(start)
        for n in left:
            if n not in cluster and all(pure(frozenset((*two, n))) for two in combinations(cluster, 2)):
                cluster.append(n)
        if len(cluster) >= least:
            out.append(sorted(cluster))
            left = [n for n in left if n not in cluster]
    return out


def purify(cov: Covariance, clusters: list[list[str]], alpha: float = 0.05) -> list[list[str]]:
    """Clusters without the indicators that break most such constraints within them or across two of them."""
    held = [list(c) for c in clusters]
    while True:
        bad: dict[str, int] = {}
        for c in held:
            for q in combinations(c, 4):
                if not quartet_vanishes(cov, list(q), alpha):
                    for n in q:
                        bad[n] = bad.get(n, 0) + 1
        for c, d in combinations(held, 2):
            for p, q in ((p, q) for p in combinations(c, 2) for q in combinations(d, 2)):
                if quartet_test(cov, p[0], q[0], p[1], q[1])[1] <= alpha and quartet_test(cov, p[0], q[0], q[1], p[1])[1] <= alpha:
                    for n in (*p, *q):
                        bad[n] = bad.get(n, 0) + 1
        if not bad:
            return held
        worst = max(bad, key=lambda n: (bad[n], n))
        held = [[n for n in c if n != worst] for c in held]


def latent_correlations(cov: Covariance, clusters: list[list[str]]) -> Covariance:
    """Correlations of the clusters' factors from cross-cluster covariances and one-factor loadings."""
    loadings = []
    for c in clusters:
        s = cov.sub(c).matrix
        est = [np.sqrt(max(s[i, j] * s[i, k] / s[j, k], 1e-12)) * 1.0 for i in range(len(c)) for j, k in [next(((j, k) for j, k in combinations([x for x in range(len(c)) if x != i], 2)), (i, i))]]
        loadings.append(np.array(est))
    k = len(clusters)
    out = np.eye(k)
    for a, b in combinations(range(k), 2):
        s = cov.matrix[np.ix_([cov.index(n) for n in clusters[a]], [cov.index(n) for n in clusters[b]])]
        out[a, b] = out[b, a] = float(np.clip((s / np.outer(loadings[a], loadings[b])).mean(), -0.999, 0.999))
    return Covariance([f"L{i + 1}" for i in range(k)], out, cov.n)


def factor_analysis(cov: Covariance, factors: int, steps: int = 200) -> np.ndarray:
    """Loadings by iterated principal factors, rotated by varimax."""
    r = cov.correlation().matrix
    h = 1 - 1 / np.diag(np.linalg.pinv(r))
    for _ in range(steps):
        m = r.copy()
        np.fill_diagonal(m, h)
        values, vectors = np.linalg.eigh(m)
        top = np.argsort(values)[::-1][:factors]
        loads = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
        new = (loads**2).sum(1).clip(0, 0.995)
        if np.abs(new - h).max() < 1e-8:
            break
        h = new
    rotation = np.eye(factors)
    for _ in range(100):
        rotated = loads @ rotation
        u, s, v = np.linalg.svd(loads.T @ (rotated**3 - rotated * (rotated**2).mean(0)))
        rotation = u @ v
    return loads @ rotation


def rank_test(cov: Covariance, x: list[str], y: list[str], alpha: float = 0.05) -> int:
    """The least rank of a cross-covariance that Bartlett's test of canonical correlations doesn't reject."""
    sx, sy = cov.sub(x).matrix, cov.sub(y).matrix
    sxy = cov.matrix[np.ix_([cov.index(n) for n in x], [cov.index(n) for n in y])]
    r2 = np.sort(np.clip(np.linalg.eigvals(np.linalg.solve(sx, sxy) @ np.linalg.solve(sy, sxy.T)).real, 0, 1 - 1e-12))[::-1][: min(len(x), len(y))]
    for k in range(len(r2)):
        stat = -(cov.n - (len(x) + len(y) + 3) / 2) * float(np.log(1 - r2[k:]).sum())
        if float(chisq_tail(stat, (len(x) - k) * (len(y) - k))) > alpha:
            return k
    return len(r2)


def coefficient_test(fit: SemFit, edge: tuple[str, str], n: int) -> float:
    """Two-sided p-value of a coefficient."""
    t = abs(fit.coefficients[edge] / fit.errors[edge])
    return float(2 * (1 - t_cdf(t, n - 2)))


def to_xml(fit: SemFit) -> str:
    root = ET.Element("sem")
    for n in fit.graph.nodes:
        ET.SubElement(root, "node", name=n, variance=repr(fit.variances[n]), latent=str(n in fit.graph.latent).lower())
    for (a, b), w in sorted(fit.coefficients.items()):
        ET.SubElement(root, "edge", causeNode=a, effectNode=b, value=repr(w))
    return ET.tostring(root, encoding="unicode")


def from_xml(text: str) -> tuple[Graph, dict[tuple[str, str], float], dict[str, float]]:
    root = ET.fromstring(text)
    g = Graph([n.get("name") for n in root.iter("node")])
    g.latent = {n.get("name") for n in root.iter("node") if n.get("latent") == "true"}
    coefficients = {(e.get("causeNode"), e.get("effectNode")): float(e.get("value")) for e in root.iter("edge")}
    for a, b in coefficients:
        g.orient(a, b)
    return g, coefficients, {n.get("name"): float(n.get("variance")) for n in root.iter("node")}


def to_lavaan(g: Graph) -> str:
    return "\n".join(f"{n} ~ {' + '.join(g.parents(n))}" for n in g.nodes if g.parents(n)) + "\n"
