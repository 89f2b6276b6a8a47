"""The step-up correction over ranges of p-values against NumPy."""

import numpy as np
import pytest

from sugarbeam.operators import testing


def by_hand(p: list[float]) -> dict[float, float]:
    """Adjusted value of each distinct p-value."""
    x = np.sort(np.array(p))
    ratio = x * len(x) / np.arange(1, len(x) + 1)
    adjusted = np.minimum(np.minimum.accumulate(ratio[::-1])[::-1], 1.0)
    return {float(v): float(adjusted[np.searchsorted(x, v)]) for v in x}


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_step_up_equals_the_sorted_form_with_ties_nulls_and_groups(spark, ranges):
    rng = np.random.default_rng(3)
    groups = {"a": np.round(rng.random(300) ** 3, 2).tolist(), None: [1.0] * 50 + [0.001] * 3, "c": [0.04], "d": rng.random(40).tolist()}
    rows = [(g, float(p)) for g, ps in groups.items() for p in ps] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, p double")
    got = {(r.g, r.p): r.adjusted for r in testing.step_up(df, "p", ["g"], ranges).collect()}
    want = {(g, p): v for g, ps in groups.items() for p, v in by_hand(ps).items()}
    assert got == want
    whole = {r.p: r.adjusted for r in testing.step_up(df, "p", [], ranges).collect()}
    assert whole == by_hand([p for _, p in rows if p is not None])


def test_corrections_keep_rows_nulls_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.01), (3, None), (4, 0.5)], "id int, p double")
    got = {r.id: r.adjusted for r in testing.benjamini_hochberg(df).collect()}
    assert got == {1: 0.015, 2: 0.015, 3: None, 4: 0.5}
    two = {r.id: r.adjusted for r in testing.two_stage(df).collect()}
    assert two[3] is None and all(two[i] >= p for i, p in ((1, 0.01), (2, 0.01), (4, 0.5)))
    assert testing.benjamini_hochberg(df.limit(0)).count() == testing.correct_multiple_testing(df.limit(0)).count() == 0


def test_no_window_of_the_correction_takes_all_rows(spark):
    df = spark.range(1000).selectExpr("id", "id / 1000D AS p")
    for plan in (testing.benjamini_hochberg(df), testing.correct_multiple_testing(df)):
        assert "SinglePartition" not in "".join(x for x in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "Window" in x)


def test_average_ranks_equal_those_of_all_values(spark):
    import pandas as pd

    x = np.round(np.random.default_rng(8).random(400), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(400, None)], "id int, x double")
    got = {r.id: r.r for r in testing.average_ranks(df, "x", "r").collect()}
    assert got.pop(400) is None and [got[i] for i in range(400)] == pd.Series(x).rank().tolist()
