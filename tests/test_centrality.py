"""Statistics of forests against dense matrices and paths walked one by one."""

import numpy as np
import pytest

from sugarbeam.functions import centrality as ce
from sugarbeam.functions import structure


def _tree(n, rng):
    return [(int(rng.integers(0, k)), k) for k in range(1, n)]


def _dense(n, edges):
    a = np.zeros((n, n))
    for x, y in edges:
        a[x, y] = a[y, x] = 1
    return a


def _path(a, s, t, seen=()):
    if s == t:
        return [t]
    for k in np.flatnonzero(a[s]):
        if k not in seen:
            rest = _path(a, int(k), t, (*seen, s))
            if rest:
                return [s, *rest]
    return []


@pytest.mark.parametrize("n", [3, 4, 7, 12])
def test_loads_and_flows_of_trees(n):
    rng = np.random.default_rng(n)
    edges = _tree(n, rng)
    a = _dense(n, edges)
    pinv = np.linalg.pinv(np.diag(a.sum(axis=1)) - a)
    load, flow, node = np.zeros(n), np.zeros(len(edges)), np.zeros(n)
    for s in range(n):
        for t in range(n):
            if s == t:
                continue
            for v in _path(a, s, t)[1:-1]:
                load[v] += 1
            if s < t:
                volt = pinv[:, s] - pinv[:, t]
                flow += [abs(volt[x] - volt[y]) for x, y in edges]
                through = np.abs(a * (volt[:, None] - volt[None, :])).sum(axis=1) / 2
                through[[s, t]] = 0
                node += through
    assert ce.loads(n, edges) == pytest.approx(load / ((n - 1) * (n - 2)))
    assert ce.loads(n, edges) == pytest.approx(2 * node / ((n - 1) * (n - 2)))
    assert ce.edge_flows(n, edges) == pytest.approx(flow / ((n - 1) * (n - 2)))


@pytest.mark.parametrize("n", [2, 3, 6, 11])
def test_return_times_by_second_moments(n):
    edges = _tree(n, np.random.default_rng(n))
    a = _dense(n, edges)
    deg = a.sum(axis=1)
    p = (a + np.diag(deg.max() - deg)) / deg.max()
    for j in range(n):
        q = p.copy()
        q[:, j] = 0  # steps that do not end the walk
        m = np.linalg.solve(np.eye(n) - q, np.ones(n))
        second = np.linalg.solve(np.eye(n) - q, 1 + 2 * q @ m)
        assert ce.return_spread(n, edges)[j] == pytest.approx(np.sqrt(second[j] - m[j] ** 2), abs=1e-6)


def test_katz_and_assortativity():
    edges = _tree(9, np.random.default_rng(2))
    a = np.zeros((9, 9))
    for x, y in edges:
        a[x, y] = 1
    x = np.linalg.solve(np.eye(9) - 0.1 * a.T, np.ones(9))
    assert ce.katz(9, edges) == pytest.approx(x / np.linalg.norm(x))
    deg = (a + a.T).sum(axis=1).astype(int)
    ends = np.array([(deg[x], deg[y]) for e in edges for x, y in (e, e[::-1])])
    assert ce.assortativity(deg, edges) == pytest.approx(np.corrcoef(ends.T)[0, 1])
    assert np.isnan(ce.assortativity(np.array([1, 1]), [(0, 1)]))


def test_all_statistics():
    one, chain, two = structure.shape("Gal"), structure.shape("Gal(b1-4)Glc"), structure.shape("{Fuc(a1-2)}Gal(b1-4)GlcNAc")
    assert len(one) == len(chain) == len(two) == 49
    assert chain["loadMax"] == 1 and chain["flowMax"] == 1 and chain["flow_edgeMax"] == 1 and chain["max_deg_leaves"] == 1
    assert one["eigenMax"] == 1 and np.isnan(one["flowMax"]) and one["egap"] == 0
    assert np.isnan(two["secorderMax"]) == (two["dens"] != two["N"] - 1)
