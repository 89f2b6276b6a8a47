"""Permutation tests in blocks and the exact chances of rhythms against forms in memory."""

import itertools

import numpy as np
import pandas as pd
import pytest

from sugarbeam.operators import diversity, series


def plain(names: list[str], group: dict, d: dict, stat: str, permutations: int, seed: int) -> tuple[float, float]:
    pairs = list(itertools.combinations(range(len(names)), 2))
    x = np.array([d[names[i], names[j]] for i, j in pairs])
    x = pd.Series(x).rank().to_numpy() if stat == "anosim" else x
    label = np.array([group[n] for n in names])
    i, j = np.array(pairs).T
    k, n = len(set(label)), len(names)

    def value(g: np.ndarray) -> float:
        same = g[i] == g[j]
        if stat == "anosim":
            return round((x[~same].mean() - x[same].mean()) / (len(x) / 2), 12)
        return round((x[~same].sum() / (k - 1)) / (x[same].sum() / (n - k)), 12)

    real = value(label)
    return real, float(np.mean([value(label[np.random.default_rng([seed, r]).permutation(n)]) >= real for r in range(1, permutations + 1)]))


@pytest.mark.parametrize("stat", ["anosim", "permanova"])
def test_permutations_in_blocks_equal_those_in_memory(spark, monkeypatch, stat):
    monkeypatch.setattr(diversity, "BLOCK", 4)
    rng = np.random.default_rng(6)
    names = [f"s{i:02}" for i in range(11)]
    group = {n: i % 3 for i, n in enumerate(names)}
    at = {n: rng.normal(group[n] * 0.7, 1, 2) for n in names}
    d = {(a, b): float(np.round(np.hypot(*(at[a] - at[b])), 1)) for a, b in itertools.combinations(names, 2)}
    pairs = spark.createDataFrame([(a, b, group[a], group[b], v) for (a, b), v in d.items()], "a string, b string, ga int, gb int, d double")
    row = diversity.permuted(pairs, stat, 99, 5).first()
    real, p = plain(names, group, d, stat, 99, 5)
    assert row.stat == pytest.approx(real, abs=1e-9) and row.p == pytest.approx(p)


@pytest.mark.parametrize("sizes", [(1, 1, 1, 1), (2, 2, 1), (3, 2), (1, 2, 3), (6,)])
def test_chances_of_rhythms_are_those_of_all_orders(sizes):
    g = np.repeat(np.arange(len(sizes)), sizes)
    i, j = np.triu_indices(len(g), 1)
    apart = g[i] != g[j]
    seen = np.array([int((np.array(y)[j] > np.array(y)[i])[apart].sum()) for y in itertools.permutations(range(len(g)))])
    assert series.rhythm_null(sizes) == pytest.approx([(seen >= k).mean() for k in range(int(apart.sum()) + 1)])


def test_rhythms_report_their_chance(spark):
    rows = [("up", f"t{i}", float(i), float(np.cos(2 * np.pi * i / 6) + i * 1e-3)) for i in range(12)] + [("flat", f"t{i}", float(i), 1.0) for i in range(12)]
    got = {r.feature: r for r in series.rhythm(spark.createDataFrame(rows, "feature string, sample string, time double, value double"), [6]).collect()}
    assert got["up"].period == 6 and got["up"].p < 1e-4 and got["flat"].p == 1.0
