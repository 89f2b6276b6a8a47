"""Communities, flows and spanning forests by rounds of joins, against forms in memory."""

import numpy as np
import pytest

from sugarbeam.operators import graphs, multivariate, networks


def planted(rng, groups: int, size: int, inner: float, outer: float) -> list[tuple[str, str]]:
    n = groups * size
    return [(f"v{i:03}", f"v{j:03}") for i in range(n) for j in range(i + 1, n) if rng.random() < (inner if i // size == j // size else outer)]


def quality(edges: list[tuple[str, str]], label: dict) -> float:
    """Modularity by its definition over pairs of nodes."""
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    a = np.zeros((len(nodes),) * 2)
    for x, y in edges:
        a[at[x], at[y]] += 1
        a[at[y], at[x]] += 1
    k, m = a.sum(0), a.sum()
    same = np.array([[label[x] == label[y] for y in nodes] for x in nodes])
    return float(((a - np.outer(k, k) / m) * same).sum() / m)


def test_communities_are_as_good_as_those_of_moves_one_by_one(spark):
    rng = np.random.default_rng(1)
    nets = {"a": planted(rng, 3, 8, 0.8, 0.05) + [("v000", "v001")] * 3, "c": [("x", "y")], "d": [(f"p{i}", f"p{i + 1}") for i in range(9)]}
    edges = spark.createDataFrame([(n, a, b) for n, es in nets.items() for a, b in es] + [("a", None, "v001")], "network string, src string, dst string")
    got = graphs.communities(edges)
    label: dict = {}
    for r in got.collect():
        label.setdefault(r.network, {})[r.node] = r.community
    told = {r.network: r.q for r in graphs.modularity(edges.where("src IS NOT NULL"), got).collect()}
    for n, es in nets.items():
        assert set(label[n]) == {x for e in es for x in e}
        assert all(c == min(v for v in label[n] if label[n][v] == c) for c in label[n].values())
        q = quality(es, label[n])
        assert q == pytest.approx(told[n]) and q >= quality(es, multivariate.louvain(es)) * 0.98 - 1e-12
    assert graphs.communities(edges.limit(0)).count() == 0


def test_maximum_flow_equals_augmenting_paths_and_conserves_flow(spark):
    rng = np.random.default_rng(2)
    nets = {}
    nets["a"] = [(f"n{i}", f"n{j}", float(rng.integers(0, 9)) / 2) for i in range(9) for j in range(9) if i != j and rng.random() < 0.4]
    nets["c"] = [("n0", "n1", 3.0), ("n0", "n1", 1.0), ("n1", "n2", 2.5), ("n2", "n2", 9.0), ("n3", "n8", 1.0), ("n1", "n0", 5.0)]
    edges = spark.createDataFrame([(n, *e) for n, es in nets.items() for e in es], "network string, src string, dst string, capacity double")
    pairs = spark.createDataFrame([(n, t) for n in nets for t in ("n2", "n8")], "network string, sink string")
    value, on = graphs.maximum_flow(edges, "n0", pairs)
    value = {(r.network, r.sink): r.flow for r in value.collect()}
    on = [tuple(r) for r in on.collect()]
    for n, es in nets.items():
        cap: dict = {}
        for u, v, c in es:
            cap[u, v] = cap.get((u, v), 0.0) + c
        for t in ("n2", "n8"):
            assert value[n, t] == pytest.approx(networks.max_flow(es, "n0", t)[0], abs=1e-9)
            mine = {(u, v): f for a, b, u, v, f in on if (a, b) == (n, t)}
            assert all(0 <= f <= cap[e] + 1e-9 for e, f in mine.items())
            net: dict = {}
            for (u, v), f in mine.items():
                net[u], net[v] = net.get(u, 0) - f, net.get(v, 0) + f
            assert net.get(t, 0) == pytest.approx(value[n, t], abs=1e-9) and all(abs(x) < 1e-9 for v, x in net.items() if v not in ("n0", t))


def test_spanning_forest_merges_and_cuts(spark):
    rng = np.random.default_rng(4)
    names = [f"s{i:02}" for i in range(9)]
    at = np.round(rng.random((9, 2)), 1)  # with ties
    far = {(a, b): float(np.round(np.hypot(*(at[i] - at[j])), 2)) for i, a in enumerate(names) for j, b in enumerate(names) if i < j}
    pairs = spark.createDataFrame([(a, b, d) for (a, b), d in far.items()] + [("z0", "z1", 0.5), ("z1", "z0", 0.4), ("z0", "s00", None)], "a string, b string, d double")
    forest = graphs.spanning_forest(pairs)
    rows = [tuple(r) for r in forest.collect()]
    want = multivariate.single_linkage(names, lambda a, b: far[min(a, b), max(a, b)])
    assert len(rows) == 9 and ("z0", "z1", 0.4) in rows
    assert sorted(d for a, _, d in rows if a[0] == "s") == sorted(d for _, _, d in want)
    got = sorted(tuple(r) for r in graphs.merges(forest).where("a < 't'").collect())
    assert got == sorted(want)
    for h in (-1.0, 0.3):
        up = {n: n for n in names}
        for a, b, d in want:
            if d <= h:
                up = {n: a if c == b else c for n, c in up.items()}
        cut = {r.node: r.cluster for r in graphs.clusters(forest, spark.createDataFrame([(n,) for n in names], "node string"), h).collect()}
        assert cut == up
    assert graphs.spanning_forest(pairs.limit(0)).count() == graphs.merges(forest.limit(0)).count() == 0
