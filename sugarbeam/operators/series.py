"""Trends over time, correlations and principal components of features."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sugarbeam.functions import special


def parse_sample(df: DataFrame, id_column: str = "ID") -> DataFrame:
    """Add sample, time and replicate from identifiers such as L1_d14_2; the time's first character is its unit."""
    parts = F.split(id_column, "_")
    return df.withColumns({"sample": parts[0], "time": F.substring(parts[1], F.lit(2), F.length(parts[1])).cast("double"), "replicate": parts[2]})


def slopes(df: DataFrame) -> DataFrame:
    """(feature, n, slope, intercept, r2): least squares of value on time."""
    return df.groupBy("feature").agg(F.regr_count("value", "time").alias("n"), F.regr_slope("value", "time").alias("slope"), F.regr_intercept("value", "time").alias("intercept"), F.regr_r2("value", "time").alias("r2"))


def change_over_time(df: DataFrame) -> DataFrame:
    """slopes with the two-sided p-value of each."""
    s = slopes(df)
    t = F.sqrt(F.col("r2") * (F.col("n") - 2) / F.greatest(1 - F.col("r2"), F.lit(1e-300)))
    return s.withColumn("p", special.t_p(t, (F.col("n") - 2).cast("double")))


def polynomial(df: DataFrame, degree: int) -> DataFrame:
    """(feature, coefficients, f): polynomial fits and the one-way analysis of variance of values against residuals."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["time"].to_numpy(float), pdf["value"].to_numpy(float)
        c = np.polyfit(x, y, degree)
        r = y - np.polyval(c, x)
        both = np.concatenate([y, r])
        ssb = len(y) * ((y.mean() - both.mean()) ** 2 + (r.mean() - both.mean()) ** 2)
        ssw = ((y - y.mean()) ** 2).sum() + ((r - r.mean()) ** 2).sum()
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "coefficients": [c.tolist()], "f": [ssb / (ssw / (2 * len(y) - 2)) if ssw else np.nan]})

    return df.groupBy("feature").applyInPandas(fit, "feature string, coefficients array<double>, f double")


def average_ranks(df: DataFrame) -> DataFrame:
    """value replaced by its average rank inside its feature."""
    r = F.rank().over(Window.partitionBy("feature").orderBy("value")) + (F.count(F.lit(1)).over(Window.partitionBy("feature", "value")) - 1) / 2
    return df.withColumn("value", r.cast("double"))


def correlations(a: DataFrame, b: DataFrame, rank: bool = True) -> DataFrame:
    """(x, y, r, n): correlation of each feature of a with each of b over shared samples; Spearman's with `rank`."""
    a, b = (average_ranks(d) if rank else d for d in (a, b))
    left = a.select(F.col("feature").alias("x"), "sample", F.col("value").alias("u"))
    right = b.select(F.col("feature").alias("y"), "sample", F.col("value").alias("v"))
    return left.join(right, "sample").groupBy("x", "y").agg(F.corr("u", "v").alias("r"), F.count("*").alias("n"))


def correlation_groups(pairs: DataFrame, above: float) -> DataFrame:
    """(x, y) of features that correlate above the threshold, each pair once."""
    return pairs.where((F.col("r") > above) & (F.col("x") < F.col("y"))).select("x", "y")


@functools.lru_cache(64)
def rhythm_null(sizes: tuple[int, ...]) -> np.ndarray:
    """Chances of J or more pairs in order, for J from 0 to all pairs, of values without ties in random order over groups of tied times of these sizes.

    Generating functions, one group after the other: placing a group of m among n earlier ones multiplies by (1 - q^(n + i)) / (1 - q^i) for i up to m,
    each factor a shifted difference or a running sum over steps of i, scaled to chances as it goes.
    """
    out, n = np.ones(1), 0
    for m in sizes:
        for i in range(1, m + 1):
            size = len(out) + n
            up = np.zeros(max(size, len(out)) + i)
            up[: len(out)] = out
            up[n + i : n + i + len(out)] -= out
            rows = -(-len(up) // i)
            sums = np.zeros(rows * i)
            sums[: len(up)] = up
            out = np.cumsum(sums.reshape(rows, i), axis=0).ravel()[:size] * (i / (n + i))
        n += m
    return np.clip(np.cumsum(out[::-1])[::-1], 0.0, 1.0)


def rhythm(df: DataFrame, periods: list[int], interval: float = 1.0) -> DataFrame:
    """(feature, period, phase, tau, s, p): for each feature the cosine waveform whose order its values follow best, by Kendall's S over all pairs of
    samples; periods count steps of `interval`. p is the two-sided chance of S in random order of values without ties, exact from the null
    table of the waveform's ties, which a task makes once for each vector of sizes; it is not corrected for the choice of the waveform."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["time", "sample"])
        y, t = pdf["value"].to_numpy(float), pdf["time"].to_numpy(float)
        i, j = np.triu_indices(len(y), 1)
        sy = np.sign(y[j] - y[i])
        rows = []
        for period in periods:
            for phase in range(period):
                w = np.cos(2 * np.pi * (t - phase * interval) / (period * interval))
                sw = np.sign(np.round(w[j] - w[i], 9))
                m = np.abs(sw).sum()
                s = float((sy * sw).sum())
                rows.append((s / m if m else 0.0, -period, -phase, s))
        tau, p, ph, s = max(rows)
        # Tied groups are those that the signs of differences make: neighbours in order that do not differ.
        w = np.sort(np.cos(2 * np.pi * (t + ph * interval) / (-p * interval)))
        cut = np.flatnonzero(np.round(np.diff(w), 9) > 0) + 1
        sizes = tuple(sorted(np.diff([0, *cut, len(w)]).tolist()))
        tail = rhythm_null(sizes)
        chance = min(1.0, 2 * float(tail[min(int(np.ceil((abs(s) + len(tail) - 1) / 2)), len(tail) - 1)]))
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "period": [-p], "phase": [-ph * interval], "tau": [tau], "s": [s], "p": [chance]})

    return df.groupBy("feature").applyInPandas(best, "feature string, period int, phase double, tau double, s double, p double")


def principal_components(df: DataFrame, k: int = 2) -> DataFrame:
    """(sample, component, score): standardized features, centred. Each task adds up its features' outer products over samples, and the sums meet in the
    cluster; the few eigenvectors of the sample-by-sample matrix are found on the driver, since samples are few while features are many."""
    w = Window.partitionBy("feature")
    sd = F.stddev_pop("value").over(w)
    z = df.withColumn("z", F.when(sd > 0, (F.col("value") - F.avg("value").over(w)) / sd).otherwise(F.lit(0.0)))
    names = [r["sample"] for r in df.select("sample").distinct().orderBy("sample").collect()]
    at = {n: i for i, n in enumerate(names)}

    def run(batches):
        total = np.zeros((len(at), len(at)))
        for pdf in batches:
            for held in pdf["x"]:
                i, x = np.array([at[c["sample"]] for c in held]), np.array([c["z"] for c in held])
                total[np.ix_(i, i)] += np.outer(x, x)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    rows = z.groupBy("feature").agg(F.collect_list(F.struct("sample", "z")).alias("x")).select("x")
    got = rows.mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    m = np.zeros((len(names), len(names)))
    m[got["i"], got["j"]] = got["s"]
    val, vec = np.linalg.eigh(m)
    rows = []
    for c in range(min(k, len(names))):
        v = vec[:, -1 - c] * np.sqrt(max(val[-1 - c], 0))
        v = v * (1 if v[np.argmax(np.abs(v))] > 0 else -1)
        rows += [(n, c + 1, float(x)) for n, x in zip(names, v, strict=True)]
    return df.sparkSession.createDataFrame(rows, "sample string, component int, score double")
