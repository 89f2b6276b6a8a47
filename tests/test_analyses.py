"""Whole analyses against NumPy, known values and cases worked out by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sugarbeam.functions import special, strings, structure
from sugarbeam.functions.forest import Forest, Imputer
from sugarbeam.operators import annotation as an
from sugarbeam.operators import biosynthesis as bio
from sugarbeam.operators import expression as ex
from sugarbeam.operators import multivariate as mv
from sugarbeam.operators import networks as nw


def _long(spark, x, groups, names=None):
    names = names or [f"f{i}" for i in range(len(x))]
    rows = [(names[i], f"s{j}", groups[j], float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "feature string, sample string, grp int, value double")


def test_forest_learns_and_imputer_fills():
    rng = np.random.default_rng(1)
    x = rng.random((300, 3))
    y = np.where(x[:, 0] > 0.5, 2.0, 1.0) + x[:, 1]
    assert np.abs(Forest(x, y, 10).predict(x) - y).mean() < 0.05
    full = np.outer(rng.random(80) + 1, [1.0, 2.0, 3.0, 4.0])
    holes = full.copy()
    holes[::7, 2] = np.nan
    got = Imputer(holes, trees=10).apply(holes)
    assert not np.isnan(got).any() and np.array_equal(got[~np.isnan(holes)], full[~np.isnan(holes)])
    assert np.abs(got - full)[np.isnan(holes)].max() < 0.4 < np.abs(full - np.median(full[:, 2]))[np.isnan(holes)].max()


def test_imputed_table_equals_the_matrix(spark):
    rng = np.random.default_rng(2)
    x = rng.random((30, 5)) + 0.1
    x[rng.random(x.shape) < 0.2] = 0.0
    got = ex.impute_forest(_long(spark, x, [0, 0, 1, 1, 1])).toPandas().pivot(index="feature", columns="sample", values="value")
    order = spark.createDataFrame([(f"f{i}",) for i in range(30)], "feature string").orderBy(F.xxhash64("feature", F.lit(0)), "feature").toPandas()["feature"].tolist()
    m = np.where(x == 0, np.nan, x)
    model = Imputer(m[[int(f[1:]) for f in order]])
    want = pd.DataFrame(model.apply(m) + 1e-6, index=[f"f{i}" for i in range(30)], columns=[f"s{j}" for j in range(5)]).loc[got.index, got.columns]
    assert np.allclose(got.to_numpy(), want.to_numpy())
    assert ex.impute_forest(_long(spark, np.zeros((0, 2)), [0, 1])).count() == 0


def test_distributions_have_known_values():
    # Tables of the studentized range at 0.05, of Student's t and of normal quantiles.
    assert special.range_upper(3.877, 3, 10)[0] == pytest.approx(0.05, abs=5e-4) and special.range_upper(3.578, 3, 20)[0] == pytest.approx(0.05, abs=5e-4)
    assert special.two_sided_quantile(0.05, 10) == pytest.approx(2.228139, abs=1e-5) and special.two_sided_quantile(0.05) == pytest.approx(1.959964, abs=1e-5)
    assert special.bayes_factor(20, 0.05) == pytest.approx(np.exp(2.100922**2 / 2) * 20**-0.25, rel=1e-5)
    assert special.jab_prior(20, "balanced") == pytest.approx(0.3963, abs=1e-4)


def test_differential_finds_what_differs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (40, 12))
    x[:4, 6:] += 6
    x[4] = 1.0
    x[5] = rng.normal(0, 1e-3, 12)
    got = {r.feature: r for r in ex.differential(_long(spark, x, [0] * 6 + [1] * 6)).collect()}
    assert len(got) == 40 and all(got[f"f{i}"].significant for i in range(4)) and sum(r.significant for r in got.values()) <= 6
    assert got["f4"].p == got["f5"].p == 1 and got["f5"].effect == 0 and got["f0"].log2fc == pytest.approx(x[0, 6:].mean() - x[0, :6].mean())
    assert all(0 <= r.levene <= 1 and 0 <= r.equivalence <= 1 for r in got.values()) and got["f0"].equivalence == 1


def test_equivalence_p(spark):
    x = np.array([[1.0, 2.0, 3.0, 4.0, 1.1, 2.1, 3.1, 4.1]])
    p = ex.tost_p(_long(spark, x, [0] * 4 + [1] * 4)).first().p
    # difference 0.1, pooled deviation 1.290994, error 0.912871: t of the nearer bound is (0.1 - 0.258199) / 0.912871 = -0.1733 on 6 degrees
    want = 1 - float(special.t_two_sided(0.173299, 6.0)) / 2
    assert p == pytest.approx(1 - want, abs=1e-4)


def test_variance_shares_and_grouping(spark):
    rng = np.random.default_rng(4)
    names = ["Neu5Ac(a2-3)Gal", "Neu5Ac(a2-6)Gal", "Fuc(a1-2)Gal", "Fuc(a1-3)Gal"]
    base = np.array([0.0, 3.0, 0.0, -3.0])
    x = np.concatenate([np.ones((4, 3)), 2.0 ** (base[:, None] + rng.normal(0, 0.01, (4, 5)))], axis=1)
    d = _long(spark, x, [0] * 3 + [1] * 5, names)
    groups = spark.createDataFrame([(n, n[:3]) for n in names], "feature string, group string")
    r = ex.variance_shares(d, groups).first()
    y = np.log2((x[:, 3:] + 1e-8) / (1 + 1e-8))
    for g in ("Neu", "Fuc"):
        at = [n.startswith(g) for n in names]
        y[at] -= y[at].mean()
    f, s = y.mean(axis=1), y.mean(axis=0)
    ssf, sss = 5 * (f**2).sum(), 4 * (s**2).sum()
    msr = ((y**2).sum() - ssf - sss) / 12
    vf, vs = max((ssf / 2 - msr) / 5, 0), max((sss / 4 - msr) / 4, 0)
    assert r.intra == pytest.approx(vf / (vf + vs + msr)) and r.inter == pytest.approx(vs / (vf + vs + msr), abs=1e-9) and r.intra > 0.9
    name, got = ex.select_grouping(d)
    assert name == "sia_fuc" and {(x.feature, x.group) for x in got.collect()} == {(n, "Sia" if "Neu" in n else "Fuc") for n in names}


def test_partial_correlations_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (4, 12))
    x[1] = x[0] + rng.normal(0, 0.2, 12)
    got = {(r.x, r.y): (r.r, r.p) for r in ex.partial_correlations(_long(spark, x, [0] * 12), 0.2).collect()}
    names, order = [f"f{i}" for i in range(4)], sorted(f"s{j}" for j in range(12))
    v = {n: x[i][[int(s[1:]) for s in order]] for i, n in enumerate(names)}
    controls = {a: [b for b in names if b != a and abs(np.corrcoef(v[a], v[b])[0, 1]) > 0.2][:2] for a in names}
    for a, b in got:
        use = sorted({*controls[a], *controls[b]} - {a, b})
        z = np.array([v[u] for u in use]).T if use else np.zeros((12, 0))
        assert got[a, b] == pytest.approx(mv.partial_correlation(v[a], v[b], z, 0.25))
    assert len(got) == 6


def test_levels_components_and_paths(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y"), ("a", "c", "x"), ("p", "q", "z")], "src string, dst string, diffs string")
    assert {r.node: r.level for r in nw.longest_levels(e).collect()} == {"a": 0, "b": 1, "c": 2, "p": 0, "q": 1}
    assert {r.node: r.label for r in nw.connected(e).collect()} == {"a": "a", "b": "a", "c": "a", "p": "p", "q": "p"}
    with pytest.raises(RuntimeError):
        nw.longest_levels(spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a")], "src string, dst string"), 5)
    flow = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 2.0), ("a", "c", 1.0)], "src string, dst string, flow double")
    v = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 5.0)], "node string, abundance double")
    assert bio.flow_path(flow, v, "a", "c") == [("a", "b"), ("b", "c")]
    with pytest.raises(ValueError):
        bio.flow_path(flow, v, "c", "a")


def test_prune_keeps_the_only_way_in(spark):
    e = spark.createDataFrame([("r", "ra"), ("ra", "rab"), ("r", "rx"), ("ra", "rxy")], "src string, dst string").withColumn("diffs", F.lit("d"))
    v = spark.createDataFrame([("r", 0, 5.0), ("ra", 1, 0.0), ("rab", 0, 4.0), ("rx", 1, 0.0), ("rxy", 1, 2.0)], "node string, virtual int, abundance double")
    # ra is the only way to rab, so it stays; rx leads nowhere and goes; rxy is a virtual stub.
    assert {r.node for r in bio.prune(v, e).collect()} == {"r", "ra", "rab"}


def test_text_and_structure_functions():
    assert strings.nth_from_end("Gal(b1-3)[Fuc(a1-4)]GlcNAc(b1-3)Gal", "GlcNAc", 1) == 20 and strings.nth_from_end("Gal(b1-3)[Fuc(a1-4)]GlcNAc(b1-3)Gal", "GlcNAc", 1, True) == 9
    assert strings.nth_from_end("aa", "b", 1) == -1 and strings.unrolled_repeat("Gal") == ("Gal", False)
    assert structure.matches("GalOS(b1-4)GlcNAc", "Gal3S(b1-4)GlcNAc") and not structure.matches("Gal6S(b1-4)GlcNAc", "Gal3S(b1-4)GlcNAc")
    assert structure.linkage_number("a1-3") == 3 and structure.linkage_number("a1-?") == float("inf")
    s = structure.shape("Gal")
    assert s["N"] == 1 and np.isnan(s["diameter"]) and s["avgDeg"] == 0
    # root 0, its linkage 1 and leaf 2, linkage 3 and leaf 4: the root reaches all, in 1, 2, 1 and 2 steps
    s = structure.shape("Gal(b1-4)[Fuc(a1-3)]GlcNAc")
    assert s["diameter"] == 4 and s["branching"] == 0 and s["nbrLeaves"] == 2 and s["harmMax"] == 1.5 and s["betweenessMax"] == pytest.approx(1 / 12)


def test_annotation_sets_and_duplicates(spark):
    d = spark.createDataFrame([("Neu5Ac(a2-3)Gal(b1-4)GlcNAc",), ("Neu5Gc(a2-3)Gal(b1-4)GlcNAc",), (None,)], "glycan string")
    got = {(r.glycan[:6], r.motif): r.n for r in an.annotate(d, ["exhaustive", "terminal", "custom"], [("x", "Gal(b1-4)GlcNAc", []), ("p", "rGal-GlcNAc", [])]).collect()}
    assert got["Neu5Ac", "Sia"] == got["Neu5Gc", "Sia"] == got["Neu5Ac", "Gal"] == got["Neu5Ac", "x"] == got["Neu5Ac", "Terminal_Neu5Ac(a2-3)"] == 1
    with pytest.raises(ValueError):
        an.annotate(d, ["nothing"])
    m = spark.createDataFrame([("LacNAc", "s1", 0, 1.0), ("LacNAc", "s2", 1, 2.0), ("Gal(b1-4)GlcNAc", "s1", 0, 1.0), ("Gal(b1-4)GlcNAc", "s2", 1, 2.0), ("Fuc", "s1", 0, 9.0), ("Fuc", "s2", 1, 2.0)], "motif string, sample string, grp int, value double")
    assert {r.motif for r in an.deduplicated(m).collect()} == {"Gal(b1-4)GlcNAc", "Fuc"}
    known = spark.createDataFrame([("LacNAc", "Gal(b1-4)GlcNAc")], "motif string, sequence string")
    assert {r.motif for r in an.deduplicated(m, known).collect()} == {"LacNAc", "Fuc"}


def test_representatives_and_insight(spark):
    d = spark.createDataFrame([("Gal(b1-4)GlcNAc",), ("Fuc(a1-2)Gal(b1-4)GlcNAc",), ("Xyl(b1-2)Man",)], "glycan string")
    e = spark.createDataFrame([("Gal(b1-4)GlcNAc", 1e-4, 1e-3), ("Xyl", 0.9, 0.9)], "motif string, p double, adjusted double")
    assert [r.glycan for r in an.representatives(an.fragment_counts(d, 2), e).collect()] == ["Fuc(a1-2)Gal(b1-4)GlcNAc"]
    known = spark.createDataFrame([("Gal(b1-4)GlcNAc", f"s{i}", "p1", "G1") for i in range(6)], "glycan string, species string, phylum string, id string")
    r = an.insight(d, known, [("lac", "Gal(b1-4)GlcNAc", [])]).first()
    assert r.species == [f"s{i}" for i in range(6)] and r.phyla == ["p1"] and r.motifs == ["lac"] and r.ids == ["G1"]
