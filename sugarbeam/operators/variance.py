"""Variance components of a table of features by samples, by restricted likelihood."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most numbers that the sums of a table may have, which is what reaches the driver.
MOST_SUMS = 20_000_000
#: Range of the logs of variance ratios that are looked at.
LEAST, MOST = -16.0, 16.0


@dataclass(frozen=True)
class Sums:
    """What the likelihood needs of a table, for each number m of cells that a feature can have (first axis): `together`, how often two samples are in
    one feature; `rows`, features' sums by sample; `squares` of features' sums; by group `cells` of the samples, `totals` and `features`. And of
    all features the sums by sample and the sum of squares."""

    m: np.ndarray
    together: np.ndarray  # m x samples x samples
    rows: np.ndarray  # m x samples
    squares: np.ndarray  # m
    cells: np.ndarray  # m x groups x samples
    totals: np.ndarray  # m x groups
    features: np.ndarray  # m x groups
    columns: np.ndarray  # samples
    all_squares: float

    def minus_two_log(self, feature: float, sample: float) -> tuple[float, float]:
        """(-2 log restricted likelihood less a constant, residual variance) at these ratios of the features' and samples' variance to the rest."""
        w = feature / (1 + feature * self.m)
        left = 1 - w * self.m
        zz = np.diag(np.einsum("mii->i", self.together)) - np.tensordot(w, self.together, 1)
        zy = self.columns - w @ self.rows
        xz = np.tensordot(left, self.cells, 1)
        xx = np.diag((self.features * (self.m * left)[:, None]).sum(axis=0))
        xy = left @ self.totals
        yy = self.all_squares - w @ self.squares
        inner = np.eye(len(zz)) + sample * zz
        solved = sample * np.linalg.solve(inner, np.column_stack([xz.T, zy]))
        xx, xy, yy = xx - xz @ solved[:, :-1], xy - xz @ solved[:, -1], yy - zy @ solved[:, -1]
        n = (self.features * self.m[:, None]).sum() - len(xx)
        rest = max(yy - xy @ np.linalg.solve(xx, xy), 1e-300) / n
        count = self.features.sum(axis=1)
        return float(n * np.log(rest) + count @ np.log1p(feature * self.m) + np.linalg.slogdet(inner)[1] + np.linalg.slogdet(xx)[1]), float(rest)


def sums(df: DataFrame) -> Sums | None:
    """The Sums of (feature, sample, group, x), one row a cell; rows with nulls do not count. Features are rows of their cells, added up in tasks; the sums alone reach
    the driver, and their number has a bound. None for a table without cells."""
    d = df.where("feature IS NOT NULL AND sample IS NOT NULL AND x IS NOT NULL AND `group` IS NOT NULL")
    samples, groups = (sorted(r[0] for r in d.select(k).distinct().limit(MOST_SUMS).collect()) for k in ("sample", "group"))
    if not samples:
        return None
    s, k = {v: i for i, v in enumerate(samples)}, {v: i for i, v in enumerate(groups)}
    wide = d.groupBy("feature", "group").agg(F.collect_list(F.struct("sample", "x")).alias("cells")).withColumn("m", F.size("cells"))
    sizes = sorted(r[0] for r in wide.select("m").distinct().collect())
    if len(sizes) * len(s) * (len(s) + len(k)) > MOST_SUMS:
        raise ValueError(f"{len(s)} samples, {len(k)} groups and {len(sizes)} sizes of features have more sums than MOST_SUMS")
    at = {m: i for i, m in enumerate(sizes)}
    shapes = [(len(sizes), len(s), len(s)), (len(sizes), len(s)), (len(sizes),), (len(sizes), len(k), len(s)), (len(sizes), len(k)), (len(sizes), len(k)), (len(s),), (1,)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(shape) for shape in shapes]
        for pdf in batches:
            for group, cells, m in zip(pdf["group"], pdf["cells"], pdf["m"], strict=True):
                i, g = at[m], k[group]
                j, x = np.array([s[c["sample"]] for c in cells]), np.array([c["x"] for c in cells])
                row = np.zeros(len(s))
                row[j] = 1
                total[0][i] += np.outer(row, row)
                total[1][i] += x.sum() * row
                total[2][i] += x.sum() ** 2
                total[3][i, g] += row
                total[4][i, g] += x.sum()
                total[5][i, g] += 1
                total[6][j] += x
                total[7] += (x * x).sum()
        flat = np.concatenate([t.ravel() for t in total])
        place = np.flatnonzero(flat)
        yield pd.DataFrame({"k": place, "v": flat[place]})

    flat = np.zeros(sum(int(np.prod(shape)) for shape in shapes))
    for r in wide.select("group", "cells", "m").mapInPandas(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        flat[r["k"]] = r["v"]
    ends = np.cumsum([int(np.prod(shape)) for shape in shapes])[:-1]
    parts = [p.reshape(shape) for p, shape in zip(np.split(flat, ends), shapes, strict=True)]
    return Sums(np.array(sizes, float), *parts[:7], float(parts[7][0]))


def least_of(f: Callable[[float], float], low: float, high: float, steps: int = 32) -> float:
    """Where f is least between low and high: the best of a grid, narrowed by the golden section."""
    grid = np.linspace(low, high, steps + 1)
    k = int(np.argmin([f(x) for x in grid]))
    a, b = grid[max(k - 1, 0)], grid[min(k + 1, steps)]
    ratio = (np.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    while b - a > 1e-7:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    return (a + b) / 2


def components(df: DataFrame, sweeps: int = 60) -> tuple[float, float, float]:
    """(features, samples, rest): variances of random effects of features and of samples and of what is left, where groups have fixed means, of
    (feature, sample, group, x); cells may be missing.

    One pass over the table; then the restricted likelihood is searched along one ratio after the other until neither moves. A ratio whose best
    is at the lower end is 0. A table without cells, or with no more cells than groups, has zeros.
    """
    t = sums(df)
    if t is None or (t.features * t.m[:, None]).sum() <= t.features.shape[1] or t.all_squares == 0:
        return 0.0, 0.0, 0.0
    at, low, high = [0.0, 0.0], LEAST, MOST
    for _ in range(sweeps):
        before = list(at)
        for k in (0, 1):
            at[k] = least_of(lambda v, k=k: t.minus_two_log(*np.exp([v if j == k else at[j] for j in (0, 1)]))[0], low, high)
        if max(abs(a - b) for a, b in zip(at, before, strict=True)) < 1e-6:
            break
    ratios = [0.0 if a < LEAST + 0.01 else float(np.exp(a)) for a in at]
    rest = t.minus_two_log(*ratios)[1]
    return ratios[0] * rest, ratios[1] * rest, rest
