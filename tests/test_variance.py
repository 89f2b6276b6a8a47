"""Restricted likelihood against dense matrices and a grid, on balanced and unbalanced tables."""

import numpy as np
import pytest

from sugarbeam.operators import expression as ex
from sugarbeam.operators import variance as va


def _cells(missing, seed=3, features=9, samples=6):
    rng = np.random.default_rng(seed)
    u, v = rng.normal(0, 1.5, samples), rng.normal(0, 0.7, features)
    return [(f"f{i}", f"s{j}", f"g{i % 2}", float(2 * (i % 2) + u[j] + v[i] + rng.normal(0, 0.5))) for i in range(features) for j in range(samples) if not missing or (i * 5 + j * 3) % 7 > 1]


def _dense(rows):
    """(feature ratio, sample ratio) -> -2 log restricted likelihood, from the whole covariance matrix."""
    f, s, g, y = (np.array(c) for c in zip(*rows, strict=True))
    same = lambda a: (a[:, None] == a[None, :]).astype(float)
    x = np.stack([(g == k).astype(float) for k in sorted(set(g))], axis=1)

    def at(a, b):
        v = np.eye(len(y)) + a * same(f) + b * same(s)
        i = np.linalg.inv(v)
        xx = x.T @ i @ x
        r = y - x @ np.linalg.solve(xx, x.T @ i @ y)
        n = len(y) - x.shape[1]
        rest = r @ i @ r / n
        return n * np.log(rest) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1], rest

    return at


@pytest.mark.parametrize("missing", [False, True])
def test_likelihood_and_its_best(spark, missing):
    rows = _cells(missing)
    d = spark.createDataFrame(rows, "feature string, sample string, group string, x double")
    t, dense = va.sums(d), _dense(rows)
    for a, b in ((0.0, 0.0), (0.3, 2.0), (5.0, 0.1)):
        assert t.minus_two_log(a, b) == pytest.approx(dense(a, b), rel=1e-9)
    vf, vs, rest = va.components(d)
    best = dense(vf / rest, vs / rest)[0]
    grid = [dense(vf / rest * p, vs / rest * q)[0] for p in np.exp(np.linspace(-2, 2, 21)) for q in np.exp(np.linspace(-2, 2, 21))]
    assert best <= min(grid) + 1e-6 and rest == pytest.approx(dense(vf / rest, vs / rest)[1])


def test_balanced_tables_have_the_mean_squares(spark):
    rows = _cells(False)
    y = np.array([r[3] for r in rows]).reshape(9, 6)
    for k in (0, 1):
        y[k::2] -= y[k::2].mean()
    rest = y - y.mean(axis=1, keepdims=True) - y.mean(axis=0) + y.mean()
    msr = (rest**2).sum() / (8 * 5)
    mss = 9 * ((y.mean(axis=0) - y.mean()) ** 2).sum() / 5
    got = va.components(spark.createDataFrame(rows, "feature string, sample string, group string, x double"))
    assert got[1] == pytest.approx((mss - msr) / 9, rel=0.1) and got[2] == pytest.approx(msr, rel=0.1)


def test_tables_without_variance(spark):
    schema = "feature string, sample string, group string, x double"
    assert va.components(spark.createDataFrame([], schema)) == (0.0, 0.0, 0.0)
    assert va.components(spark.createDataFrame([("a", "s", "g", None), ("b", None, "g", 1.0), ("c", "s", "g", 0.5)], schema)) == (0.0, 0.0, 0.0)


def test_shares_of_changes(spark):
    rng = np.random.default_rng(6)
    base, shift = rng.normal(0, 1.0, 8), rng.normal(0, 0.5, 6)
    rows = [(f"f{i}", f"s{j}", 1, float(2 ** (base[i] + shift[j] + rng.normal(0, 0.2)))) for i in range(8) for j in range(6) if (i + j) % 5]
    rows += [(f"f{i}", "c", 0, 1.0) for i in range(8)]
    d = spark.createDataFrame(rows, "feature string, sample string, grp int, value double")
    groups = spark.createDataFrame([(f"f{i}", "one") for i in range(8)], "feature string, group string")
    intra, inter = ex.likelihood_shares(d, groups)
    dense = _dense([(f, s, "one", float(np.log2((v + 1e-8) / (1 + 1e-8)))) for f, s, g, v in rows if g == 1])
    rest = 1 - intra - inter
    best = dense(intra / rest, inter / rest)[0]
    assert 0 < intra < 1 and 0 < inter < 1 and all(best <= dense(intra / rest * p, inter / rest * q)[0] + 1e-6 for p in (0.8, 1, 1.2) for q in (0.8, 1, 1.2))
    assert ex.likelihood_shares(d.where("grp > 1"), groups) == (0.0, 0.0)
