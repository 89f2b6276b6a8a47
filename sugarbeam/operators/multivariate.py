"""Grouped linear algebra: each group of features is a small matrix that one Arrow batch holds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugarbeam.functions import special


def _matrices(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Samples by features for groups 0 and 1."""
    wide = pdf.pivot_table(index=["grp", "sample"], columns="feature", values="value", fill_value=0.0).sort_index()
    grp = wide.index.get_level_values("grp")
    x = wide.to_numpy(float)
    return x[grp == 0], x[grp == 1]


def mahalanobis_distance(x: np.ndarray, y: np.ndarray) -> float:
    """Distance of the means in the pooled covariance, by its pseudo-inverse."""
    n, m = len(x), len(y)
    cov = lambda a: np.atleast_2d(np.cov(a, rowvar=False)) if len(a) > 1 else np.zeros((a.shape[1],) * 2)
    pooled = ((n - 1) * cov(x) + (m - 1) * cov(y)) / max(n + m - 2, 1)
    d = x.mean(axis=0) - y.mean(axis=0)
    return float(np.sqrt(max(d @ np.linalg.pinv(pooled) @ d, 0)))


def mahalanobis_variance(x: np.ndarray, y: np.ndarray, seed: int, rounds: int = 1000) -> float:
    """Variance of the distance over resampled samples."""
    rng = np.random.default_rng(seed)
    got = [mahalanobis_distance(x[rng.integers(0, len(x), len(x))], y[rng.integers(0, len(y), len(y))]) for _ in range(rounds)]
    return float(np.var(got))


def hotelling_t2(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """(F, p) of two samples of vectors, with a ridge on the pooled covariance."""
    n, m, p = len(x), len(y), x.shape[1]
    pooled = ((n - 1) * np.atleast_2d(np.cov(x, rowvar=False)) + (m - 1) * np.atleast_2d(np.cov(y, rowvar=False))) / (n + m - 2) + ridge * np.eye(p)
    d = x.mean(axis=0) - y.mean(axis=0)
    t2 = n * m / (n + m) * float(d @ np.linalg.solve(pooled, d))
    free = n + m - p - 1
    if free <= 0:
        return float("nan"), 1.0
    f = t2 * free / (p * (n + m - 2))
    return f, float(special.f_upper(f, p, free))


def hotelling_paired(diff: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """(F, p) of the one-sample statistic on paired differences."""
    n, p = diff.shape
    if n <= p:
        return float("nan"), 1.0
    d = diff.mean(axis=0)
    t2 = n * float(d @ np.linalg.solve(np.atleast_2d(np.cov(diff, rowvar=False)) + ridge * np.eye(p), d))
    f = t2 * (n - p) / (p * (n - 1))
    return f, float(special.f_upper(f, p, n - p))


def by_set(df: DataFrame, set_column: str = "set", rounds: int = 1000) -> DataFrame:
    """(set, distance, variance, f, p) of sets of features of (set, feature, sample, grp, value)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _matrices(pdf)
        f, p = hotelling_t2(x, y) if min(len(x), len(y)) > 1 else (float("nan"), 1.0)
        return pd.DataFrame({"set": [str(pdf[set_column].iloc[0])], "distance": [mahalanobis_distance(x, y)], "variance": [mahalanobis_variance(x, y, 42, rounds)], "f": [f], "p": [p]})

    return df.groupBy(set_column).applyInPandas(run, "set string, distance double, variance double, f double, p double")


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, two-sided p) of a Gaussian linear model; terms that others determine get a p of 1."""
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ x.T @ y
    free = len(y) - np.linalg.matrix_rank(x)
    if free <= 0:
        return b, np.ones(len(b))
    r = y - x @ b
    se = np.sqrt(np.maximum(np.diag(inverse) * (r @ r) / free, 0))
    t = np.divide(b, se, out=np.zeros_like(b), where=se > 1e-12)
    return b, np.where(se > 1e-12, special.t_two_sided(t, float(free)), 1.0)


def normal_equations(xx: np.ndarray, xy: np.ndarray, yy: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """least_squares from the sums X'X, X'y and y'y of n rows."""
    inverse = np.linalg.pinv(xx)
    b = inverse @ xy
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    free = n - np.linalg.matrix_rank(xx / np.outer(scale, scale), tol=1e-10, hermitian=True)
    if free <= 0:
        return b, np.ones(len(b))
    se = np.sqrt(np.maximum(np.diag(inverse) * max(yy - 2 * b @ xy + b @ xx @ b, 0.0) / free, 0))
    t = np.divide(b, se, out=np.zeros_like(b), where=se > 1e-12)
    return b, np.where(se > 1e-12, special.t_two_sided(t, float(free)), 1.0)


def site_models(df: DataFrame, terms: list[str]) -> DataFrame:
    """(site, term, coefficient, p): abundance by condition, composition counts and their interactions at each site of
    (site, condition, value, <terms>...). Rows are summed into normal equations, so a site may have any number of them."""

    c, y = F.col("condition").cast("double"), F.col("value").cast("double")
    x = {"intercept": F.lit(1.0), "condition": c}
    for t in terms:
        x |= {t: F.col(t).cast("double"), f"condition:{t}": c * F.col(t).cast("double")}
    k, names, cols = len(x), list(x), list(x.values())
    sums = [F.sum(cols[i] * cols[j]).alias(f"xx{i}_{j}") for i in range(k) for j in range(i, k)]
    d = df.groupBy("site").agg(*sums, *(F.sum(v * y).alias(f"xy{i}") for i, v in enumerate(cols)), F.sum(y * y).alias("yy"), F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        xx = np.array([[r[f"xx{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
        b, p = normal_equations(xx, np.array([r[f"xy{i}"] for i in range(k)], float), float(r["yy"]), int(r["n"]))
        return pd.DataFrame({"site": str(r["site"]), "term": names, "coefficient": b, "p": p})

    return d.groupBy("site").applyInPandas(run, "site string, term string, coefficient double, p double")


def ridge_residuals(y: np.ndarray, controls: np.ndarray, alpha: float) -> np.ndarray:
    """y less its ridge fit on centred controls; the intercept stays in."""
    z = controls - controls.mean(axis=0)
    b = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean())) if z.shape[1] else np.zeros(0)
    return y - controls @ b


def ranks(x: np.ndarray) -> np.ndarray:
    return pd.Series(x).rank().to_numpy()


def partial_correlation(x: np.ndarray, y: np.ndarray, controls: np.ndarray, alpha: float = 0.25) -> tuple[float, float]:
    """Spearman's correlation of the residuals, and its two-sided p."""
    a, b = ranks(ridge_residuals(x, controls, alpha)), ranks(ridge_residuals(y, controls, alpha))
    if a.std() == 0 or b.std() == 0:
        return 0.0, 1.0
    r = float(np.corrcoef(a, b)[0, 1])
    n = len(x)
    return r, float(special.t_two_sided(r * np.sqrt((n - 2) / max(1 - r * r, 1e-300)), n - 2.0)) if n > 2 else 1.0


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks inside each row."""
    less, same = (x[:, :, None] > x[:, None, :]).sum(2), (x[:, :, None] == x[:, None, :]).sum(2)
    return less + (same + 1) / 2


def partial_correlations(x: np.ndarray, y: np.ndarray, controls: np.ndarray, alpha: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """partial_correlation for many pairs at once: x and y are pairs by samples, controls pairs by samples by the most controls of a pair, with columns
    of zeros for those that a pair lacks; they get a weight of 0."""
    z = controls - controls.mean(axis=1, keepdims=True)
    inverse = np.linalg.inv(np.einsum("pnk,pnl->pkl", z, z) + alpha * np.eye(z.shape[2]))
    ranked = []
    for v in (x, y):
        b = np.einsum("pkl,pnl,pn->pk", inverse, z, v - v.mean(axis=1, keepdims=True), optimize=True)
        ranked.append(average_ranks(v - np.einsum("pnk,pk->pn", controls, b)))
    a, b = (r - r.mean(axis=1, keepdims=True) for r in ranked)
    sa, sb = (a * a).sum(1), (b * b).sum(1)
    n = x.shape[1]
    flat = (sa == 0) | (sb == 0)
    r = np.where(flat, 0.0, (a * b).sum(1) / np.sqrt(np.where(flat, 1.0, sa * sb)))
    if n <= 2:
        return r, np.ones(len(r))
    p = special.t_two_sided(r * np.sqrt((n - 2) / np.maximum(1 - r * r, 1e-300)), n - 2.0)
    return r, np.where(flat, 1.0, p)


def dirichlet_clr(values: np.ndarray, instances: int, seed: int) -> np.ndarray:
    """instances x features: centred log ratios of draws from the posterior of one sample's composition."""
    draws = np.random.default_rng(seed).dirichlet(values + 0.5, instances)
    logs = np.log2(np.maximum(draws, 1e-300))
    return logs - logs.mean(axis=1, keepdims=True)


def technical_instances(df: DataFrame, instances: int = 128, seed: int = 42) -> DataFrame:
    """(feature, sample, grp, instance, value): Monte Carlo instances of each sample, for tests that average over them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("feature")
        got = dirichlet_clr(pdf["value"].to_numpy(float), instances, seed + sum(map(ord, str(pdf["sample"].iloc[0]))))
        n = len(pdf)
        return pd.DataFrame({"feature": np.tile(pdf["feature"].to_numpy(), instances), "sample": pdf["sample"].iloc[0], "grp": pdf["grp"].iloc[0], "instance": np.repeat(np.arange(instances), n), "value": got.ravel()})

    return df.groupBy("sample").applyInPandas(run, "feature string, sample string, grp int, instance int, value double")


def monte_carlo(df: DataFrame, instances: int = 128, seed: int = 42) -> DataFrame:
    """(feature, p, adjusted, effect): Welch tests and corrections in each instance, averaged over instances."""
    from sugarbeam.operators import testing as te

    d = technical_instances(df, instances, seed).withColumn("feature", F.concat_ws("\t", "instance", "feature"))
    t = te.welch(d).join(te.cohen_d(d).select("feature", "effect"), "feature")
    t = t.withColumn("p", F.coalesce(F.nanvl(special.t_p(F.col("t"), F.col("df")), F.lit(1.0)), F.lit(1.0)))
    parts = F.split("feature", "\t", 2)
    t = te.two_stage(t.withColumn("instance", parts[0]).withColumn("feature", parts[1]), by=["instance"])
    return t.groupBy("feature").agg(F.avg("p").alias("p"), F.avg("adjusted").alias("adjusted"), F.avg("effect").alias("effect"))


def procrustes(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation of two configurations of samples after centring, scaling and the best rotation."""
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return float(np.linalg.svd((a / na).T @ (b / nb), compute_uv=False).sum()) if na and nb else 0.0


def louvain(edges: list[tuple[str, str]], seed: int = 0) -> dict[str, int]:
    """Communities of an undirected graph by moving nodes while modularity grows, then merging."""
    nodes = sorted({x for e in edges for x in e})
    member = {n: i for i, n in enumerate(nodes)}
    weight: dict[tuple[int, int], float] = {}
    for a, b in edges:
        for k in ((member[a], member[b]), (member[b], member[a])):
            weight[k] = weight.get(k, 0.0) + 1.0
    label = list(range(len(nodes)))
    total = sum(weight.values())
    rng = np.random.default_rng(seed)
    while total:
        size = max(label, default=-1) + 1
        near: list[dict[int, float]] = [{} for _ in range(size)]
        for (a, b), w in weight.items():
            near[a][b] = near[a].get(b, 0.0) + w
        degree = [sum(n.values()) for n in near]
        comm, mass, moved = list(range(size)), list(degree), False
        for _ in range(20):
            step = False
            for i in rng.permutation(size).tolist():
                links: dict[int, float] = {}
                for j, w in near[i].items():
                    if j != i:
                        links[comm[j]] = links.get(comm[j], 0.0) + w
                mass[comm[i]] -= degree[i]
                gain = lambda c: links.get(c, 0.0) - degree[i] * mass[c] / total  # noqa: B023, E731
                best = max(sorted({comm[i], *links}), key=gain)
                best = best if gain(best) > gain(comm[i]) + 1e-12 else comm[i]
                mass[best] += degree[i]
                step |= best != comm[i]
                comm[i] = best
            moved |= step
            if not step:
                break
        names = {c: k for k, c in enumerate(sorted(set(comm)))}
        label = [names[comm[x]] for x in label]
        merged: dict[tuple[int, int], float] = {}
        for (a, b), w in weight.items():
            k = (names[comm[a]], names[comm[b]])
            merged[k] = merged.get(k, 0.0) + w
        weight = merged
        if not moved:
            break
    return dict(zip(nodes, label, strict=True))


def single_linkage(names: list[str], distance: Callable[[str, str], float]) -> list[tuple[str, str, float]]:
    """Merges (a, b, height) of the nearest clusters, named by their smallest member; distances are few, one for each pair of labels."""
    pairs = sorted((distance(a, b), a, b) for i, a in enumerate(names) for b in names[i + 1 :])
    up = {n: n for n in names}

    def top(x: str) -> str:
        while up[x] != x:
            x = up[x]
        return x

    out = []
    for d, a, b in pairs:
        x, y = sorted((top(a), top(b)))
        if x != y:
            up[y] = x
            out.append((x, y, d))
    return out
