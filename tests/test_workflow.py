"""Whole analyses against the same steps in pandas."""

import math
import statistics

import pandas as pd
import pytest

from sugarbeam.functions.motifs import motif_list
from sugarbeam.operators import annotation as an
from sugarbeam.operators import workflow as wf
from sugarbeam.plans.sequences import SEQUENCES

TEXTS = ["Gal(b1-3)GalNAc", "Neu5Ac(a2-3)Gal(b1-3)GalNAc", "Fuc(a1-2)Gal(b1-3)GalNAc", "Gal(b1-4)GlcNAc(b1-6)[Gal(b1-3)]GalNAc"]
SAMPLES = ["a1", "a2", "a3", "b1", "b2", "b3"]


def _values():
    return {t: [round(1.0 + 7 * i + (3 + i) * k + 5 * ((i * k * k) % 4), 3) for k in range(6)] for i, t in enumerate(TEXTS)}


def _steps(counts):
    """(shares, logs) of the motifs, a column of values a sample: winsorizing moves one value at each end."""
    rows = {}
    for t, v in _values().items():
        o = sorted(v)
        rows[t] = [min(max(x, o[1]), o[-2]) for x in v]
    total = [sum(r[k] for r in rows.values()) for k in range(6)]
    rows = {t: [100 * x / total[k] for k, x in enumerate(r)] for t, r in rows.items()}
    by = {m: [sum(rows[t][k] * n for (t, x), n in counts.items() if x == m) for k in range(6)] for m in {m for _, m in counts}}
    sums = [sum(r[k] for r in by.values()) for k in range(6)]
    shares = {m: [100 * x / sums[k] for k, x in enumerate(r)] for m, r in by.items()}
    log = {m: [math.log2(x + 1e-7) for x in r] for m, r in by.items()}
    mean = [statistics.fmean(r[k] for r in log.values()) for k in range(6)]
    return shares, {m: [x - mean[k] for k, x in enumerate(r)] for m, r in log.items()}


def test_one_call_from_a_wide_table_to_tested_motifs(spark):
    wide = spark.createDataFrame([(t, *v) for t, v in _values().items()], "glycan string, " + ", ".join(f"{s} double" for s in SAMPLES))
    counts = {("Neu5Ac(a2-3)Gal(b1-3)GalNAc", "Terminal_Neu5Ac(a2-3)"): 1, ("Fuc(a1-2)Gal(b1-3)GalNAc", "Terminal_Fuc(a1-2)"): 1, ("Gal(b1-3)GalNAc", "Terminal_Gal(b1-3)"): 1, (TEXTS[3], "Terminal_Gal(b1-3)"): 1, (TEXTS[3], "Terminal_Gal(b1-4)"): 1}
    shares, logs = _steps(counts)
    got = {r.feature: r for r in wf.differential_expression(wide, SAMPLES[:3], SAMPLES[3:], features=["terminal"], impute=False).collect()}
    assert got.keys() == shares.keys()
    for m, r in got.items():
        a, b = logs[m][:3], logs[m][3:]
        assert r["mean"] == pytest.approx(statistics.fmean(shares[m])) and r["log2fc"] == pytest.approx(statistics.fmean(b) - statistics.fmean(a), abs=1e-9)
        if statistics.variance(logs[m]) > 0.02:
            pooled = math.sqrt((statistics.variance(a) + statistics.variance(b)) / 2)
            assert r["effect"] == pytest.approx((statistics.fmean(b) - statistics.fmean(a)) / pooled, rel=1e-6) and 0 < r["p"] <= r["adjusted"] <= 1


def test_paired_and_sequences(spark):
    wide = spark.createDataFrame(pd.DataFrame([(t, *v) for t, v in _values().items()], columns=["glycan", *SAMPLES]))
    out = wf.differential_expression(wide, SAMPLES[:3], SAMPLES[3:], paired=True, impute=False).toPandas()
    assert set(out["feature"]) == set(TEXTS) and out["p"].between(0, 1).all()
    with pytest.raises(ValueError, match="paired"):
        wf.differential_expression(wide, SAMPLES[:2], SAMPLES[3:], paired=True)
    with pytest.raises(ValueError, match="no transformation"):
        wf.prepared(wide, transform="x")


def test_known_motifs_through_the_index_equal_all_pairs(spark):
    d = spark.createDataFrame([(t,) for t in [*SEQUENCES, None, SEQUENCES[0]]], "glycan string")
    got = {(r.glycan, r.motif): r.n for r in wf.annotated(d, ["known"]).collect()}
    want = {}
    for r in an.motif_counts(d, motif_list()).collect():
        want[r.glycan, r.motif] = max(r.n, want.get((r.glycan, r.motif), 0))
    assert got == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "feature string, sample string, grp int, value double")
    assert wf.differential_expression(none, features=["terminal"]).count() == 0
