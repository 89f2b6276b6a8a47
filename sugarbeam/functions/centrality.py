"""Load, flow, walk and spectral statistics of forests, whose paths are unique, so that most have closed forms in the sizes of the parts that a node or
an edge divides."""

from __future__ import annotations

import numpy as np


def _parts(n: int, edges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root, below, tree) of each node: the root of its tree, the size of what hangs on it, itself included, and the size of its tree. Edges lead from
    parents to children, which have greater numbers."""
    root, below = np.arange(n), np.ones(n, int)
    for a, b in sorted(edges):
        root[b] = root[a]
    for a, b in sorted(edges, key=lambda e: -e[1]):
        below[a] += below[b]
    return root, below, below[root]


def loads(n: int, edges: list[tuple[int, int]]) -> np.ndarray:
    """Share of the ordered pairs of other nodes of its tree whose path leads through a node."""
    root, below, tree = _parts(n, edges)
    squares = np.where(root == np.arange(n), 0, (tree - below) ** 2).astype(float)
    for a, b in edges:
        squares[a] += below[b] ** 2
    pairs = (tree - 1.0) ** 2 - squares
    return pairs / np.maximum((tree - 1) * (tree - 2), 1)


def edge_flows(n: int, edges: list[tuple[int, int]]) -> np.ndarray:
    """Current through an edge of a tree of at least three nodes, summed over all pairs of nodes, over (n - 1)(n - 2)."""
    _, below, _ = _parts(n, edges)
    return np.array([below[b] * (n - below[b]) for _, b in edges]) / ((n - 1) * (n - 2))


def katz(n: int, edges: list[tuple[int, int]], alpha: float = 0.1) -> np.ndarray:
    """1 and `alpha` times the parent's value, scaled to length 1."""
    x = np.ones(n)
    for a, b in sorted(edges):
        x[b] += alpha * x[a]
    return x / np.linalg.norm(x)


def return_spread(n: int, edges: list[tuple[int, int]]) -> np.ndarray:
    """Standard deviation of the time in which a random walk on a tree comes back to a node. Loops make all degrees equal, so the mean is n everywhere."""
    step = np.zeros((n, n))
    for a, b in edges:
        step[a, b] = step[b, a] = 1
    deg = step.sum(axis=1)
    step = (step + np.diag(deg.max() - deg)) / deg.max()
    # The fundamental matrix gives the mean times to reach any node from all others at once.
    z = np.linalg.inv(np.eye(n) - step + 1 / n)
    reach = n * (np.diag(z) - z)  # from row to column; 0 on the diagonal
    total = reach.sum(axis=0) + n
    return np.sqrt(np.maximum(2 * total - n * (n + 1), 0))


def assortativity(degrees: np.ndarray, edges: list[tuple[int, int]]) -> float:
    """Correlation of the degrees at the ends of edges; NaN where they do not differ."""
    a, b = degrees[[e[0] for e in edges]], degrees[[e[1] for e in edges]]
    x, y = np.concatenate([a, b]).astype(float), np.concatenate([b, a]).astype(float)
    spread = x.var()
    return float(((x - x.mean()) * (y - y.mean())).mean() / spread) if spread > 0 else np.nan


def spectrum(n: int, edges: list[tuple[int, int]], degrees: np.ndarray) -> tuple[float, float]:
    """(gap, sum of p log p) of the symmetric part of the step matrix that leads along edges or stays, each row over its degree and one: 1 minus the
    second largest of the eigenvalues by size, and the leading vector's sizes as shares."""
    step = np.eye(n)
    for a, b in edges:
        step[a, b] = 1
    step /= (degrees + 1)[:, None]
    values, vectors = np.linalg.eigh((step + step.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")
    p = np.abs(vectors[:, order[0]])
    p = p[p > 1e-12] / p.sum()
    return float(1 - min(values[order[:2]])), float((p * np.log(p)).sum())


def spread_of(name: str, values: np.ndarray) -> dict[str, float]:
    """Greatest, least, mean and variance; NaN of nothing."""
    if not len(values):
        return dict.fromkeys([f"{name}Max", f"{name}Min", f"{name}Avg", f"{name}Var"], np.nan)
    return {f"{name}Max": values.max(), f"{name}Min": values.min(), f"{name}Avg": values.mean(), f"{name}Var": values.var()}


def statistics(n: int, edges: list[tuple[int, int]], degrees: np.ndarray) -> dict[str, float]:
    """All of this module for one forest. What is defined on trees only is NaN for several trees, and so for one node. No subset of a
    forest's nodes has n neighbours each, so the core and corona of that order are empty."""
    none = np.zeros(0)
    out: dict[str, float] = {"size_corona": 0, "size_core": 0}
    if n == 1:
        out |= {"max_deg_leaves": 0, "mean_deg_leaves": 0, "deg_assort": 0.0, "egap": 0.0, "entropyStation": 0.0}
        return out | spread_of("eigen", np.ones(1)) | spread_of("load", np.zeros(1)) | spread_of("flow", none) | spread_of("flow_edge", none) | spread_of("secorder", none)
    leaves = sum(int(degrees[b] == 1) for _, b in edges)
    whole = len(edges) == n - 1
    load = loads(n, edges)
    gap, entropy = spectrum(n, edges, degrees)
    out |= {"max_deg_leaves": leaves, "mean_deg_leaves": leaves, "deg_assort": assortativity(degrees, edges) if edges else np.nan, "egap": gap, "entropyStation": entropy}
    out |= spread_of("eigen", katz(n, edges)) | spread_of("load", load) | spread_of("flow", load if whole and n > 2 else none)
    return out | spread_of("flow_edge", edge_flows(n, edges) if whole and n > 2 else none) | spread_of("secorder", return_spread(n, edges) if whole else none)
