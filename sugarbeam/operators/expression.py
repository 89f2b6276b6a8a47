"""Differential analysis end to end: imputation, log ratios, filters, tests, corrections and groupings of long tables
(feature, sample, grp, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sugarbeam.functions import special
from sugarbeam.functions.forest import Imputer
from sugarbeam.operators import abundance as ab
from sugarbeam.operators import annotation as an
from sugarbeam.operators import diversity as dv
from sugarbeam.operators import testing as te
from sugarbeam.operators import variance as va
from sugarbeam.sources.store import checkpointed

#: Features that the imputing forests are fitted on: those with the smallest name hash, if there are more.
FIT_FEATURES = 2_000


def impute_forest(df: DataFrame, rounds: int = 5, rows: int = FIT_FEATURES, trees: int = 20, seed: int = 0) -> DataFrame:
    """Zeros replaced by what forests over the other samples predict; every value grows by 1e-6.

    The forests are fitted on at most `rows` features (all, if there are no more), which is what reaches the driver together with one number
    for each of their cells; every feature is then filled in its own task by the same steps. Nulls count as zeros; a feature without
    any value takes the medians of the samples.
    """
    names = [r["sample"] for r in df.select("sample").distinct().orderBy("sample").collect()]
    cell = F.struct("sample", F.when(F.col("value") != 0, F.col("value")).alias("value"), "grp")
    wide = df.groupBy("feature").agg(F.collect_list(cell).alias("cells"))
    place = {n: i for i, n in enumerate(names)}

    def matrix(cells) -> np.ndarray:
        out = np.full((len(cells), len(names)), np.nan)
        for i, row in enumerate(cells):
            for c in row:
                v = c["value"]
                out[i, place[c["sample"]]] = np.nan if v is None else v
        return out

    fit = wide.orderBy(F.xxhash64("feature", F.lit(seed)), "feature").limit(rows).collect()
    model = Imputer(matrix([r["cells"] for r in fit]), rounds, trees=trees, seed=seed) if fit and names else None

    def run(batches):
        for pdf in batches:
            full = model.apply(matrix(pdf["cells"])) + 1e-6
            out = [(f, c["sample"], c["grp"], float(full[i, place[c["sample"]]])) for i, (f, cells) in enumerate(zip(pdf["feature"], pdf["cells"], strict=True)) for c in cells]
            yield pd.DataFrame(out, columns=["feature", "sample", "grp", "value"])

    types = dict(df.dtypes)
    return checkpointed(wide.mapInPandas(run, f"feature string, sample string, grp {types['grp']}, value double")) if model else df


def reference_scores(df: DataFrame, paired: bool = False) -> DataFrame:
    """(feature, correlation, variance, score): how good a reference of additive log ratios each feature is.

    variance is the difference of the two groups' variances of log2 values (of the pairs' differences, if `paired`; of all values in one
    group). The Procrustes correlation of the ratios with centred log ratios is 1 for every reference: both are the logs less one
    number for each sample, which its centring takes away; only noise, which is not added here, lowers it. The best has the
    greatest score, correlation / variance.
    """
    log = df.where("value > 0").withColumn("x", F.log2("value"))
    if paired:
        d = log.groupBy("feature", "pair").agg((F.max(F.when(F.col("grp") == 0, F.col("x"))) - F.max(F.when(F.col("grp") == 1, F.col("x")))).alias("d"))
        v = d.groupBy("feature").agg(F.var_samp("d").alias("variance"))
    else:
        a, b = (F.var_samp(F.when(F.col("grp") == g, F.col("x"))) for g in (0, 1))
        v = log.groupBy("feature").agg(F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))).alias("variance"))
    return v.select("feature", F.lit(1.0).alias("correlation"), "variance", F.when(F.col("variance") > 0, 1 / F.col("variance")).alias("score"))


def log_ratios(df: DataFrame, least_correlation: float = 0.9, most_variance: float = 0.1, paired: bool = False) -> tuple[DataFrame, str]:
    """(table, how): additive log ratios against the best reference, or centred ones where that is not good enough."""
    best = reference_scores(df, paired).orderBy(F.desc_nulls_last("score"), "feature").first()
    if best is None or best["variance"] is None or best["variance"] > most_variance or best["correlation"] < least_correlation:
        return ab.clr(df), "centred"
    return ab.alr(df, best["feature"]), best["feature"]


def tost_p(df: DataFrame, margin: float = 0.2) -> DataFrame:
    """(feature, p): the larger p of the two one-sided tests at `margin` pooled deviations."""
    e = te.equivalence(df, margin)
    upper = lambda t, sign: F.when(sign * F.col(t) > 0, special.t_p(F.col(t), F.col("df")) / 2).otherwise(1 - special.t_p(F.col(t), F.col("df")) / 2)
    return e.select("feature", F.greatest(upper("t_low", 1), upper("t_high", -1)).alias("p"))


def differential(df: DataFrame, raw: DataFrame | None = None, paired: bool = False, alpha: float | None = None, least_variance: float = 0.02) -> DataFrame:
    """(feature, mean, log2fc, p, adjusted, significant, levene, effect, equivalence) of group 1 against group 0 of transformed values.

    Features whose variance is at most `least_variance` are not tested: p, adjusted, levene and equivalence 1, effect 0. alpha follows from the
    number of samples unless it is given. levene is corrected in two stages; equivalence, for features with p above alpha, too.
    mean is that of `raw` (as df if there is none). Rows by adjusted and p.
    """
    df = checkpointed(df)  # each test reads it
    raw = df if raw is None else raw
    alpha = special.alpha_n(max(df.select("sample").distinct().count(), 1)) if alpha is None else alpha
    kept = ab.by_variance(df, least_variance)
    d = df.join(kept.where("kept").select("feature"), "feature", "left_semi")
    mean = raw.groupBy("feature").agg(F.avg("value").alias("mean"))
    t = te.correct_multiple_testing(te.differential(d, paired).select("feature", "log2fc", "p", "effect"), alpha=alpha)
    lev = te.levene(d)
    lev = lev.withColumn("p", F.coalesce(F.nanvl(special.f_p(F.col("f"), F.col("d1"), F.col("d2")), F.lit(1.0)), F.lit(1.0)))
    lev = te.two_stage(lev).select("feature", F.col("adjusted").alias("levene"))
    same = tost_p(d).join(t.where(F.col("p") > alpha).select("feature"), "feature", "left_semi").where("p is not null")
    same = te.two_stage(same).select("feature", F.col("adjusted").alias("equivalence"))
    tested = t.join(lev, "feature").join(same, "feature", "left").withColumn("equivalence", F.coalesce("equivalence", F.lit(1.0)))
    means = df.groupBy("feature").agg(*(F.avg(F.when(F.col("grp") == g, F.col("value"))).alias(f"m{g}") for g in (0, 1)))
    one = F.lit(1.0)
    rest = kept.where(~F.coalesce("kept", F.lit(False))).select("feature").join(means, "feature")
    rest = rest.select("feature", (F.col("m1") - F.col("m0")).alias("log2fc"), one.alias("p"), F.lit(0.0).alias("effect"), one.alias("adjusted"), F.lit(False).alias("significant"), one.alias("levene"), one.alias("equivalence"))
    out = tested.unionByName(rest).join(mean, "feature", "left")
    return out.select("feature", "mean", "log2fc", "p", "adjusted", "significant", "levene", "effect", "equivalence").orderBy("adjusted", "p", "feature")


def sets_of(df: DataFrame, above: float = 0.9) -> DataFrame:
    """(feature, set): features in connected sets of the correlation network above the threshold, named by their first feature."""
    from sugarbeam.operators import networks as nw
    from sugarbeam.operators import series as se

    pairs = se.correlations(df, df, rank=False).where((F.col("x") < F.col("y")) & (F.col("r") > above))
    sets = nw.connected(pairs.select(F.col("x").alias("src"), F.col("y").alias("dst")))
    return df.select("feature").distinct().join(sets.select(F.col("node").alias("feature"), "label"), "feature", "left").select("feature", F.coalesce("label", "feature").alias("set"))


def changes(df: DataFrame, groups: DataFrame, paired: bool = False) -> DataFrame:
    """(feature, sample, x, group): log2 changes of group 1's values over their pairs, or over the feature's mean in group 0. groups: (feature, group)."""
    small = 1e-8
    if paired:
        d = df.groupBy("feature", "pair").agg(*(F.max(F.when(F.col("grp") == g, F.col("value"))).alias(f"x{g}") for g in (0, 1))).where("x0 is not null and x1 is not null")
        d = d.select("feature", F.col("pair").cast("string").alias("sample"), F.log2(F.abs((F.col("x1") + small) / (F.col("x0") + small))).alias("x"))
    else:
        base = df.where("grp = 0").groupBy("feature").agg(F.avg("value").alias("base"))
        d = df.where("grp = 1").join(base, "feature").select("feature", "sample", F.log2(F.abs((F.col("value") + small) / (F.col("base") + small))).alias("x"))
    return d.join(groups, "feature")


def likelihood_shares(df: DataFrame, groups: DataFrame, paired: bool = False) -> tuple[float, float]:
    """(intra, inter): shares of the variance of `changes` that features and samples have, by restricted likelihood with fixed means of groups; cells
    may be missing. (0, 0) where nothing varies."""
    features, samples, rest = va.components(changes(df, groups, paired))
    total = features + samples + rest
    return (features / total, samples / total) if total else (0.0, 0.0)


def variance_shares(df: DataFrame, groups: DataFrame, paired: bool = False) -> DataFrame:
    """(intra, inter): shares of the variance of log2 changes that features inside groups and samples have, once the groups' means are gone.

    Variance components of `changes` are those of the two-way layout of features and samples without repeats, by mean squares, which is
    for tables without missing cells; see likelihood_shares.
    """
    d = changes(df, groups, paired)
    d = d.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("group")))
    all_ = d.agg(F.avg("x").alias("m"), F.countDistinct("feature").alias("f"), F.countDistinct("sample").alias("s"), F.countDistinct("group").alias("k"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    rows = d.groupBy("feature").agg(F.avg("x").alias("a")).agg(F.sum(F.col("a") * F.col("a")).alias("fa"))
    cols = d.groupBy("sample").agg(F.avg("x").alias("b")).agg(F.sum(F.col("b") * F.col("b")).alias("sb"))
    t = all_.crossJoin(rows).crossJoin(cols)
    ssf, sss = F.col("s") * F.col("fa") - F.col("s") * F.col("f") * F.col("m") * F.col("m"), F.col("f") * F.col("sb") - F.col("s") * F.col("f") * F.col("m") * F.col("m")
    tot = F.col("ss") - F.col("s") * F.col("f") * F.col("m") * F.col("m")
    msf, mss = ssf / F.greatest(F.col("f") - F.col("k"), F.lit(1)), sss / F.greatest(F.col("s") - 1, F.lit(1))
    msr = F.greatest(tot - ssf - sss, F.lit(0.0)) / F.greatest((F.col("f") - 1) * (F.col("s") - 1), F.lit(1))
    t = t.select(msr.alias("r"), F.greatest((msf - msr) / F.col("s"), F.lit(0.0)).alias("vf"), F.greatest((mss - msr) / F.col("f"), F.lit(0.0)).alias("vs"))
    total = F.col("r") + F.col("vf") + F.col("vs")
    return t.select((F.col("vf") / total).alias("intra"), (F.col("vs") / total).alias("inter"))


def select_grouping(df: DataFrame, paired: bool = False) -> tuple[str, DataFrame]:
    """(name, (feature, group)): the grouping of the sequences by sialic acid and fucose, by core or by type whose features vary most inside
    groups against samples; one group for all if none is good enough or has a group of a single feature."""
    f = df.select("feature").distinct()
    x = F.col("feature")
    ways: dict[str, Column] = {"sia_fuc": an.sia_fuc_group(x)}
    ends = f.agg(F.max(x.endswith("GalNAc")).alias("o"), F.max(x.endswith("GlcNAc(b1-4)GlcNAc")).alias("n")).first()
    if ends["o"]:
        ways["core"] = an.core_group(x)
    elif ends["n"]:
        ways["type"] = an.n_group(x)
    best = None
    for name, how in ways.items():
        groups = f.select("feature", how.alias("group"))
        if groups.groupBy("group").count().where("count < 2").limit(1).count():
            continue
        intra, inter = likelihood_shares(df, groups, paired)
        if best is None or intra - inter > best[0]:
            best = (intra - inter, name, groups, intra, inter)
    if best and (best[3] > 3 * best[4] or (best[3] > best[4] and best[3] > 0.1)):
        return best[1], best[2]
    return "all", f.select("feature", F.lit("group1").alias("group"))


def ma_categories(df: DataFrame, fold_above: float = 1.0, p_below: float = 0.05) -> DataFrame:
    """Add category (up, down, none) to rows (feature, mean, log2fc, adjusted): what lies far from the middle of a plot of change against mean."""
    hit = (F.abs("log2fc") > fold_above) & (F.col("adjusted") < p_below)
    return df.withColumn("category", F.when(hit & (F.col("log2fc") > 0), "up").when(hit, "down").otherwise("none"))


def glycanova(df: DataFrame, least_variance: float = 0.02, alpha: float | None = None) -> DataFrame:
    """(feature, f, p, adjusted, significant, omega2) of one-way analyses of variance over grp; features of little variance are not tested."""
    alpha = special.alpha_n(df.select("sample").distinct().count()) if alpha is None else alpha
    a = te.anova(df).join(ab.by_variance(df, least_variance).select("feature", "kept"), "feature")
    t = a.where("kept").withColumn("p", F.coalesce(F.nanvl(special.f_p(F.col("f"), F.col("d1"), F.col("d2")), F.lit(1.0)), F.lit(1.0)))
    t = te.correct_multiple_testing(t, alpha=alpha).select("feature", "f", "p", "adjusted", "significant", "omega2")
    rest = a.where("not kept").select("feature", F.lit(0.0).alias("f"), F.lit(1.0).alias("p"), F.lit(1.0).alias("adjusted"), F.lit(False).alias("significant"), "omega2")
    return t.unionByName(rest).orderBy("adjusted", "p", "feature")


def tukey(df: DataFrame) -> DataFrame:
    """(feature, a, b, difference, q, p): honest significant differences of each pair of groups a < b of each feature, by the studentized range."""
    g = df.groupBy("feature", "grp").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    s = te.anova(df).select("feature", (F.col("ssw") / F.col("d2")).alias("ms"), "d2", (F.col("d1") + 1).alias("k"))
    x, y = (g.select("feature", F.col("grp").alias(n), F.col("n").alias(f"n{n}"), F.col("m").alias(f"m{n}")) for n in ("a", "b"))
    d = x.join(y, "feature").where("a < b").join(s, "feature").withColumn("difference", F.col("mb") - F.col("ma"))
    q = F.abs("difference") / F.sqrt(F.col("ms") / 2 * (1 / F.col("na") + 1 / F.col("nb")))
    d = d.withColumn("q", q)
    return d.select("feature", "a", "b", "difference", "q", special.range_p(F.col("q"), F.col("k"), F.col("d2")).alias("p"))


def rhythm_p(tau: Column, n: Column) -> Column:
    """Two-sided normal p of Kendall's S = tau * n (n - 1) / 2 of n values without ties, with its continuity correction."""
    most = n * (n - 1) / 2
    s = F.abs(tau) * most
    spread = F.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    return F.least(special.normal_p(F.greatest(s - 1, F.lit(0.0)) / spread), F.lit(1.0))


def biodiversity(counts: DataFrame, transformed: DataFrame, permutations: int = 999) -> DataFrame:
    """(metric, p, effect, adjusted) of two groups: Welch tests of richness, Shannon and Simpson indices of `counts`, and the permutation
    tests ANOSIM and PERMANOVA of the distances of `transformed`."""
    long = dv.alpha(counts).select("sample", "grp", F.col("richness").cast("double").alias("richness"), "shannon", "simpson").unpivot(["sample", "grp"], ["richness", "shannon", "simpson"], "feature", "value")
    w = te.welch(long).join(te.cohen_d(long).select("feature", "effect"), "feature")
    a = w.select(F.concat(F.lit("alpha_"), "feature").alias("metric"), F.coalesce(F.nanvl(special.t_p(F.col("t"), F.col("df")), F.lit(1.0)), F.lit(1.0)).alias("p"), "effect")
    d = dv.distances(transformed)
    b = [dv.permuted(d, s, permutations).select(F.lit(f"beta_{s}").alias("metric"), "p", F.col("stat").alias("effect")) for s in ("anosim", "permanova")]
    return te.correct_multiple_testing(a.unionByName(b[0]).unionByName(b[1]))


def roc_by_group(df: DataFrame) -> DataFrame:
    """(grp, feature, auc): the feature that tells each group from all others best, by the chance that a member's value is the greater (or
    the smaller); ties by name. One pass ranks each feature for all groups."""
    w = Window.partitionBy("feature").orderBy("value")
    r = df.withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy("feature", "value")) - 1) / 2)
    a = r.groupBy("feature", "grp").agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    a = a.withColumn("all", F.sum("n").over(Window.partitionBy("feature")))
    auc = (F.col("s") - F.col("n") * (F.col("n") + 1) / 2) / (F.col("n") * (F.col("all") - F.col("n")))
    a = a.where("`all` > n").withColumn("auc", F.greatest(auc, 1 - auc))
    return a.groupBy("grp").agg(F.min_by(F.struct("feature", "auc"), F.struct((-F.round("auc", 12)).alias("k"), F.col("feature").alias("f"))).alias("b")).select("grp", "b.feature", "b.auc")


def multi_feature_score(df: DataFrame, strength: float = 1.0) -> tuple[list[str], float]:
    """(features, auc): the features that a lasso logistic regression of the groups over samples keeps, and the area under the curve of a ridge
    regression on them. Samples are rows of one vector each; fits run in the cluster."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    from sugarbeam.operators.networks import numbered_names

    ids = numbered_names(df, "feature")
    rows = df.join(ids, "feature").groupBy("sample", F.col("grp").cast("double").alias("label")).agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("x"))
    rows = checkpointed(rows.select("label", F.transform("x", lambda c: c["value"]).alias("x")))
    n = rows.count()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=1 / (strength * n), standardization=False, maxIter=200).fit(rows.select("label", array_to_vector("x").alias("features")))
    keep = [i for i, w in enumerate(lasso.coefficients.toArray()) if abs(w) > 1e-5]
    if not keep:
        return [], 0.5
    data = rows.select("label", array_to_vector(F.transform(F.lit(keep), lambda i: F.get("x", i))).alias("features"))
    ridge = LogisticRegression(elasticNetParam=0.0, regParam=1 / (strength * n), standardization=False, maxIter=200).fit(data)
    names = [r["feature"] for r in ids.where(F.col("id").isin(keep)).orderBy("id").collect()]
    return names, float(BinaryClassificationEvaluator().evaluate(ridge.transform(data)))


def model_table(models: DataFrame, alpha: float = 0.05) -> DataFrame:
    """models (site, term, coefficient, p) with `adjusted` and `significant`, corrected over the sites of each term."""
    d = te.two_stage(models, by=["term"])
    w = Window.partitionBy("term")
    many = F.avg((F.col("adjusted") < alpha).cast("double")).over(w) > 0.9
    n = F.count(F.lit(1)).over(w)
    d = d.withColumn("_many", many).withColumn("_n", n)
    d = d.withColumn("adjusted", F.when(F.col("_many"), F.least(F.col("p") * F.col("_n"), F.lit(1.0))).otherwise(F.col("adjusted")))
    return d.withColumn("significant", F.col("adjusted") < F.when(F.col("_many"), 0.05 / F.col("_n")).otherwise(alpha)).drop("_many", "_n")


#: Features of a block of the matrix of pairs, and pairs that are worked on at once.
BLOCK = 64
PAIRS = 256


def _block_pairs(vectors: DataFrame, run, schema: str) -> DataFrame:
    """run(rows, i, j) for each pair i <= j of blocks of features; rows (feature, id, ...) are those of both blocks. A block goes to as many tasks as there
    are blocks, and a task holds two."""
    blocks = vectors.agg(F.max("id")).first()[0]
    blocks = 0 if blocks is None else blocks // BLOCK + 1
    own = F.floor(F.col("id") / BLOCK)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks, 1) - 1).cast("long")))
    dealt = vectors.withColumn("_other", other).withColumn("i", F.least(own, "_other")).withColumn("j", F.greatest(own, "_other")).drop("_other")
    return dealt.groupBy("i", "j").applyInPandas(lambda key, pdf: run(pdf, int(key[0]), int(key[1])), schema)


def _index_pairs(pdf: pd.DataFrame, i: int, j: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """(rows by feature, u, v): places of the pairs u < v of one block with the other, or of a block with itself."""
    pdf = pdf.sort_values("feature").reset_index(drop=True)
    block = pdf["id"].to_numpy() // BLOCK
    u, v = np.triu_indices(len(pdf), 1)
    keep = (block[u] != block[v]) if i != j else np.ones(len(u), bool)
    return pdf, u[keep], v[keep]


def partial_correlations(df: DataFrame, threshold: float = 0.2, alpha: float = 0.25) -> DataFrame:
    """(x, y, r, p) of each pair x < y: Spearman's correlation of what ridge regressions on other features leave of them. The controls of a feature
    are the first of those whose correlation with it exceeds the threshold, a fifth of the samples at most and five at most.

    Features are cut into blocks, and each pair of blocks is one group: it first finds which features correlate, then, with the controls' values in
    each feature's row, the partial correlations of its pairs, as products of matrices for many pairs at once.
    """
    from sugarbeam.operators import multivariate as mv
    from sugarbeam.operators.networks import numbered_names

    most = min(df.select("sample").distinct().count() // 5, 5)
    vec = df.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "value"))), lambda c: c["value"]).alias("v"))
    vec = checkpointed(vec.join(numbered_names(vec, "feature"), "feature"))

    def close(pdf: pd.DataFrame, i: int, j: int) -> pd.DataFrame:
        pdf, u, v = _index_pairs(pdf, i, j)
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        x = x - x.mean(axis=1, keepdims=True)
        size = np.sqrt((x * x).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            r = (x @ x.T / np.outer(size, size))[u, v]
        keep = np.abs(r) > threshold  # of features that do not vary it is no number
        names = pdf["feature"].to_numpy()
        return pd.DataFrame({"x": np.concatenate([names[u[keep]], names[v[keep]]]), "y": np.concatenate([names[v[keep]], names[u[keep]]])})

    near = _block_pairs(vec, close, "x string, y string")
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy("y"))).where(F.col("k") <= most)
    held = near.join(vec.select(F.col("feature").alias("y"), F.col("v").alias("w")), "y").groupBy(F.col("x").alias("feature")).agg(F.array_sort(F.collect_list(F.struct("y", "w"))).alias("controls"))
    rows = checkpointed(vec.join(held, "feature", "left"))

    def run(pdf: pd.DataFrame, i: int, j: int) -> pd.DataFrame:
        pdf, u, v = _index_pairs(pdf, i, j)
        names, x = pdf["feature"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(float)
        own = [{c["y"]: c["w"] for c in cs} if cs is not None else {} for cs in pdf["controls"]]
        out = []
        for s in range(0, len(u), PAIRS):
            a, b = u[s : s + PAIRS], v[s : s + PAIRS]
            z = np.zeros((len(a), x.shape[1], max(2 * most, 1)))
            for k, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                got = {n: w for n, w in {**own[p], **own[q]}.items() if n not in (names[p], names[q])}
                for c, n in enumerate(sorted(got)):
                    z[k, :, c] = got[n]
            r, chance = mv.partial_correlations(x[a], x[b], z, alpha)
            out.append(pd.DataFrame({"x": names[a], "y": names[b], "r": r, "p": chance}))
        return pd.concat(out) if out else pd.DataFrame(columns=["x", "y", "r", "p"])

    return _block_pairs(rows, run, "x string, y string, r double, p double")
