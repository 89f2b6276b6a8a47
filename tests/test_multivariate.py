import numpy as np
import pytest

from sugarbeam.functions import special
from sugarbeam.operators import multivariate as mv


def test_hotelling_of_one_feature_is_the_t_test():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(8, 1)), rng.normal(1, 1, size=(7, 1))
    f, p = mv.hotelling_t2(x, y, 0)
    sp = (7 * x.var(ddof=1) + 6 * y.var(ddof=1)) / 13
    t = (x.mean() - y.mean()) / np.sqrt(sp * (1 / 8 + 1 / 7))
    assert f == pytest.approx(t * t) and p == pytest.approx(float(special.t_two_sided(t, 13.0)))
    d = rng.normal(0.5, 1, size=(9, 1))
    f, p = mv.hotelling_paired(d, 0)
    assert f == pytest.approx((d.mean() / (d.std(ddof=1) / 3)) ** 2)
    assert mv.hotelling_paired(d[:1])[1] == 1.0


def test_mahalanobis_scales_out():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 3)), rng.normal(1, 1, size=(30, 3))
    a = np.diag([1.0, 10.0, 0.1])
    assert mv.mahalanobis_distance(x, y) == pytest.approx(mv.mahalanobis_distance(x @ a, y @ a), rel=1e-6)
    assert mv.mahalanobis_variance(x, y, 1, 50) > 0


def test_least_squares_recovers_coefficients():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(200), rng.normal(size=(200, 2))])
    b, p = mv.least_squares(x, x @ [1.0, 2.0, 0.0] + rng.normal(size=200) * 0.1)
    assert b == pytest.approx([1, 2, 0], abs=0.05) and p[1] < 1e-10 < p[2]


def test_partial_correlation_removes_the_common_cause():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(300, 1))
    x, y = c[:, 0] + rng.normal(size=300) * 0.3, c[:, 0] + rng.normal(size=300) * 0.3
    assert abs(mv.partial_correlation(x, y, c)[0]) < 0.2 < mv.partial_correlation(x, y, np.zeros((300, 0)))[0]


def test_procrustes_and_instances():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(10, 4))
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    assert mv.procrustes(a, 3 * a @ q + 1) == pytest.approx(1)
    z = mv.dirichlet_clr(np.array([10.0, 20.0, 70.0]), 64, 1)
    assert z.shape == (64, 3) and np.abs(z.sum(axis=1)).max() < 1e-9 and z.mean(axis=0).argmax() == 2


def test_communities_and_linkage():
    ring = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(i)]
    got = mv.louvain([*ring("a"), *ring("b"), ("a0", "b0")])
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and got["a0"] != got["b0"] and mv.louvain([]) == {}
    at = {"x": 0.0, "y": 1.0, "z": 5.0}
    assert mv.single_linkage(["x", "y", "z"], lambda a, b: abs(at[a] - at[b])) == [("x", "y", 1.0), ("x", "z", 4.0)]


def test_site_models_use_all_line_items(spark):
    from sugarbeam.plans import registry

    sf = "/root/testdata/sf0.001"
    line = spark.read.parquet(f"{sf}/lineitem.parquet").toPandas()
    got = {(r.site, r.term): r for r in registry.QUERIES["site_models"](spark, sf).collect()}
    assert len(got) == 30
    for s in range(5):
        d = line[line["l_suppkey"] % 5 == s]
        c, h, n = (d["l_returnflag"] == "R").to_numpy(float), d["l_quantity"].to_numpy(float), d["l_linenumber"].to_numpy(float)
        b, p = mv.least_squares(np.stack([np.ones(len(d)), c, h, c * h, n, c * n], axis=1), np.log(d["l_extendedprice"].to_numpy(float)))
        for i, t in enumerate(["intercept", "condition", "H", "condition:H", "N", "condition:N"]):
            assert abs(got[f"p{s}", t].coefficient - b[i]) < 1e-8 and abs(got[f"p{s}", t].p - p[i]) < 1e-6


def test_sets_and_flows_use_all_brands_and_parts(spark, monkeypatch):
    from sugarbeam.plans import fixtures as fx
    from sugarbeam.plans import registry

    sf, seen = "/root/testdata/sf0.001", []
    monkeypatch.setattr(mv, "by_set", lambda d: seen.append(d) or d)
    registry.QUERIES["hotelling_sets"](spark, sf)
    assert seen[0].select("feature").distinct().count() == spark.read.parquet(f"{sf}/part.parquet").select("p_brand").distinct().count() == 25
    monkeypatch.setattr(registry.nw, "maximum_flows", lambda e, *a: e)
    part = spark.read.parquet(f"{sf}/part.parquet").toPandas()
    want = {k: round(sum(d.loc[d["p_size"] % 3 != 0, "p_retailprice"]), 2) for k, d in part.groupby(part["p_partkey"] % 50)} | {0: 10.0}
    edges = registry.QUERIES["network_maximum_flow"](spark, sf).collect()
    at = lambda n: want.get(int(n[1:]), 0.1)
    assert edges and all(abs(e.capacity - (at(e.src) + at(e.dst)) / 2) < 0.01 for e in edges)
    assert fx.classes(spark, sf).count() == 50
