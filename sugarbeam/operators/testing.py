"""Tests, effect sizes and corrections for many features at once, by conditional aggregates and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sugarbeam.functions import special
from sugarbeam.sources.store import checkpointed


def group_moments(df: DataFrame) -> DataFrame:
    """(feature, mean, n0, m0, v0, n1, m1, v1): count, mean and variance of each feature in groups 0 and 1, and the mean of all."""
    each = [F.avg("value").alias("mean")]
    for g in (0, 1):
        x = F.when(F.col("grp") == g, F.col("value"))
        each += [F.count(x).alias(f"n{g}"), F.avg(x).alias(f"m{g}"), F.var_samp(x).alias(f"v{g}")]
    return df.groupBy("feature").agg(*each)


def _pooled_effect() -> Column:
    sd = F.sqrt(F.try_divide((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1"), F.col("n0") + F.col("n1") - 2))
    return (F.col("m1") - F.col("m0")) / F.greatest(sd, F.lit(1e-6))


def _welch() -> tuple[Column, Column]:
    s0, s1 = F.try_divide(F.col("v0"), F.col("n0")), F.try_divide(F.col("v1"), F.col("n1"))
    # Groups without spread have no statistic, which is null.
    return F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(s0 + s1)), F.try_divide((s0 + s1) * (s0 + s1), F.try_divide(s0 * s0, F.col("n0") - 1) + F.try_divide(s1 * s1, F.col("n1") - 1))


def cohen_d(df: DataFrame) -> DataFrame:
    """(feature, effect, variance): standardized difference of group 1 and group 0 with pooled deviation (at least 1e-6)."""
    m = group_moments(df).withColumn("effect", _pooled_effect())
    n0, n1, d = F.col("n0"), F.col("n1"), F.col("effect")
    return m.select("feature", "effect", ((n0 + n1) / (n0 * n1) + d * d / (2 * (n0 + n1))).alias("variance"))


def paired_differences(df: DataFrame) -> DataFrame:
    """(feature, pair, value): group 1 less group 0 of each pair."""
    a, b = (F.max(F.when(F.col("grp") == g, F.col("value"))) for g in (0, 1))
    return df.groupBy("feature", "pair").agg((b - a).alias("value")).where("value is not null")


def cohen_d_paired(df: DataFrame) -> DataFrame:
    d = paired_differences(df).groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    effect = F.try_divide("m", "sd")
    return d.select("feature", effect.alias("effect"), (1 / F.col("n") + effect * effect / (2 * F.col("n"))).alias("variance"))


def welch(df: DataFrame) -> DataFrame:
    """(feature, difference, t, df): Welch's statistic of group 1 against group 0."""
    t, dof = _welch()
    return group_moments(df).select("feature", (F.col("m1") - F.col("m0")).alias("difference"), t.alias("t"), dof.alias("df"))


def paired_t(df: DataFrame) -> DataFrame:
    d = paired_differences(df).groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("difference"), F.stddev_samp("value").alias("sd"))
    return d.select("feature", "difference", F.try_divide(F.col("difference"), F.col("sd") / F.sqrt("n")).alias("t"), (F.col("n") - 1).cast("double").alias("df"))


def equivalence(df: DataFrame, margin: float = 0.2) -> DataFrame:
    """(feature, t_low, t_high, df): the two one-sided statistics at `margin` pooled deviations."""
    m = group_moments(df)
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    se = pooled * F.sqrt(1 / F.col("n0") + 1 / F.col("n1"))
    diff = F.col("m1") - F.col("m0")
    return m.select("feature", F.try_divide(diff + margin * pooled, se).alias("t_low"), F.try_divide(diff - margin * pooled, se).alias("t_high"), (F.col("n0") + F.col("n1") - 2).cast("double").alias("df"))


def levene(df: DataFrame) -> DataFrame:
    """(feature, f, d1, d2): the test of equal spread on distances from group medians."""
    w = Window.partitionBy("feature", "grp")
    z = df.withColumn("value", F.abs(F.col("value") - F.median("value").over(w)))
    return anova(z).select("feature", "f", "d1", "d2")


def anova(df: DataFrame) -> DataFrame:
    """(feature, ssb, ssw, d1, d2, f, omega2): one-way analysis of variance over grp."""
    g = df.groupBy("feature", "grp").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    a = g.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("ssb"), F.sum(F.coalesce((F.col("n") - 1) * F.col("v"), F.lit(0.0))).alias("ssw"))
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    msw = F.try_divide(F.col("ssw"), d2)
    f = F.try_divide(F.try_divide(F.col("ssb"), d1), msw)
    return a.select("feature", "ssb", "ssw", d1.alias("d1"), d2.alias("d2"), f.alias("f"), F.try_divide(F.col("ssb") - d1 * msw, F.col("ssb") + F.col("ssw") + msw).alias("omega2"))


#: Ranges that the p-values of a group are cut into.
RANGES = 64


def _with(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df and the columns of other's row of the same keys, which may be null; other has one row if there are no keys."""
    if not keys:
        return df.crossJoin(F.broadcast(other))
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    for k, n in names.items():
        other = other.withColumnRenamed(k, n)
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return df.join(other, same, "left").drop(*names.values())


def positions(df: DataFrame, value: str, by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """(by..., value, _c, _range, _n, _le) of each distinct value: its rows, the range it lies in, all rows of its group, and the rows up to it. Nulls do
    not count.

    The distinct values are cut at quantiles into `ranges` ranges of each group of `by`, and a value's rows up to it are those in the range and the
    sizes of earlier ranges. What ranges tell each other is one array of `ranges` entries for each group, so no task sees all values of a
    group, and a value that many rows share is one row here.
    """
    by = by or []
    d = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    cuts = d.groupBy(*by).agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("_cuts"))
    d = _with(d, cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    sizes = d.groupBy(*by, "_range").agg(F.sum("_c").alias("_m")).groupBy(*by).agg(F.sum("_m").alias("_n"), F.collect_list(F.struct("_range", "_m")).alias("_sizes"))
    before = F.aggregate("_sizes", F.lit(0).cast("long"), lambda s, x: s + F.when(x["_range"] < F.col("_range"), x["_m"]).otherwise(0))
    d = _with(d, sizes, by).withColumn("_before", before).drop("_sizes")
    return d.withColumn("_le", F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy(value))).drop("_before")


def average_ranks(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Add `name`: the average rank of the value among all rows or in its group of `by`; null for a null. df is stored once."""
    df = checkpointed(df)
    rank = (F.col("_le") - (F.col("_c") - 1) / 2).alias(name)
    return _with(df, positions(df, value, by).select(*(by or []), value, rank), [*(by or []), value])


def step_up(df: DataFrame, p: str = "p", by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """(by..., p, adjusted) for each distinct p-value: the least of p' * n / rank(p') over all p' >= p, at most 1; rank counts the p-values that are
    as low, so ties share the last of their ranks. Null p-values do not count.

    The least ratio from a value on is the least in its range of positions() and in later ranges, which are told as an array.
    """
    by = by or []
    inside = Window.partitionBy(*by, "_range")
    # The ratios are read twice, as the least of ranges and one by one: they are stored in between.
    d = checkpointed(positions(df, p, by, ranges).select(*by, p, "_range", (F.col(p) * F.col("_n") / F.col("_le")).alias("_s")))
    least = d.groupBy(*by, "_range").agg(F.min("_s").alias("_l")).groupBy(*by).agg(F.collect_list(F.struct("_range", "_l")).alias("_least"))
    later = F.array_min(F.transform(F.filter("_least", lambda x: x["_range"] > F.col("_range")), lambda x: x["_l"]))
    here = F.min("_s").over(inside.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    return _with(d, least, by).withColumn("adjusted", F.least(here, later, F.lit(1.0))).select(*by, p, "adjusted")


def benjamini_hochberg(df: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Add `adjusted`: the step-up correction of p, in each group of `by` or over all rows; null for a null p. df is stored once, since the
    distinct p-values are made of it and joined to it."""
    df = checkpointed(df)
    return _with(df, step_up(df, p, by), [*(by or []), p])


def _whole(df: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """df and aggregates over all rows or over its group."""
    return _with(df, df.groupBy(*by).agg(*(v.alias(k) for k, v in values.items())), by)


def two_stage(df: DataFrame, p: str = "p", alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Add `adjusted`: two-stage step-up. The share of true nulls is what the first pass, at alpha / (1 + alpha),
    does not reject; the corrected values are multiplied by it. Nothing or everything rejected: as the first pass."""
    by = by or []
    df = _whole(benjamini_hochberg(df, p, by), by, _kept=F.avg((F.col("adjusted") > alpha / (1 + alpha)).cast("double")))
    factor = F.when((F.col("_kept") == 0) | (F.col("_kept") == 1), F.lit(1.0)).otherwise(F.col("_kept") * (1 + alpha))
    adjusted = F.greatest(F.least(F.col("adjusted") * factor, F.lit(1.0)), F.col(p))
    return df.withColumn("adjusted", F.when(F.col(p).isNotNull(), adjusted)).drop("_kept")


def correct_multiple_testing(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Add `adjusted` and `significant`: two-stage step-up; if it leaves more than 90 % of the rows below alpha,
    min(p * n, 1) and Bonferroni's own level, 0.05 / n, instead (as the reference does)."""
    df = _whole(two_stage(df, p), [], _n=F.count(F.lit(1)), _share=F.avg((F.col("adjusted") < alpha).cast("double")))
    many = F.col("_share") > 0.9
    df = df.withColumn("adjusted", F.when(many, F.least(F.col(p) * F.col("_n"), F.lit(1.0))).otherwise(F.col("adjusted")))
    return df.withColumn("significant", F.col("adjusted") < F.when(many, 0.05 / F.col("_n")).otherwise(alpha)).drop("_n", "_share")


def true_null_share(df: DataFrame, p: str = "p", alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """(by..., pi0): the share of p-values that the correction at alpha / (1 + alpha) does not reject."""
    return benjamini_hochberg(df, p, by).groupBy(*(by or [])).agg(F.avg(F.when(F.col("adjusted") > alpha / (1 + alpha), 1.0).otherwise(0.0)).alias("pi0"))


def grouped_two_stage(df: DataFrame, by: str, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Add `adjusted` and `significant`: corrections inside groups at levels alpha / max(pi0, 0.3)."""
    shares = true_null_share(df, p, alpha, [by])
    out = _with(benjamini_hochberg(df, p, [by]), shares, [by])
    return out.withColumn("level", F.lit(alpha) / F.greatest("pi0", F.lit(0.3))).withColumn("significant", F.col("adjusted") <= F.col("level"))


def differential(df: DataFrame, paired: bool = False) -> DataFrame:
    """(feature, mean, log2fc, t, df, p, adjusted, effect): group 1 against group 0 on transformed values."""
    if paired:
        d = df.groupBy("feature", "pair").agg(*(F.max(F.when(F.col("grp") == g, F.col("value"))).alias(f"x{g}") for g in (0, 1)), F.sum("value").alias("s"), F.count("value").alias("c"))
        diff = F.col("x1") - F.col("x0")
        m = d.groupBy("feature").agg(F.count(diff).alias("n"), F.avg(diff).alias("log2fc"), F.stddev_samp(diff).alias("sd"), (F.sum("s") / F.sum("c")).alias("mean"))
        out = m.select("feature", "mean", "log2fc", F.try_divide(F.col("log2fc"), F.col("sd") / F.sqrt("n")).alias("t"), (F.col("n") - 1).cast("double").alias("df"), F.try_divide("log2fc", "sd").alias("effect"))
    else:
        t, dof = _welch()
        out = group_moments(df).select("feature", "mean", (F.col("m1") - F.col("m0")).alias("log2fc"), t.alias("t"), dof.alias("df"), _pooled_effect().alias("effect"))
    out = correct_multiple_testing(out.withColumn("p", F.coalesce(F.nanvl(special.t_p(F.col("t"), F.col("df")), F.lit(1.0)), F.lit(1.0))))
    return out.select("feature", "mean", "log2fc", "t", "df", "p", "adjusted", "effect").orderBy("adjusted", "p", "feature")


def meta_analysis(df: DataFrame, model: str = "fixed") -> DataFrame:
    """(effect, variance, z, tau2) of studies (effect, variance): inverse-variance, or DerSimonian-Laird for `random`."""
    w = 1 / F.col("variance")
    a = df.agg(F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * F.col("effect")).alias("swe"), F.sum(w * F.col("effect") * F.col("effect")).alias("swee"), F.count("*").alias("k"))
    q = F.col("swee") - F.col("swe") * F.col("swe") / F.col("sw")
    tau = F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / (F.col("sw") - F.col("sw2") / F.col("sw"))) if model == "random" else F.lit(0.0)
    both = df.crossJoin(F.broadcast(a.select(tau.alias("tau2")))).withColumn("w", 1 / (F.col("variance") + F.col("tau2")))
    out = both.groupBy("tau2").agg((F.sum(F.col("w") * F.col("effect")) / F.sum("w")).alias("effect"), (1 / F.sum("w")).alias("variance"))
    return out.select("effect", "variance", (F.col("effect") / F.sqrt("variance")).alias("z"), "tau2")


def fisher_combined(df: DataFrame, key: Column) -> DataFrame:
    """(site, chi2, dof, effect): p-values of one key combined by Fisher's statistic, and their mean effect."""
    return df.groupBy(key.alias("site")).agg((-2 * F.sum(F.ln("p"))).alias("chi2"), (2 * F.count("*")).alias("dof"), F.avg("effect").alias("effect"))


def roc_auc(df: DataFrame) -> DataFrame:
    """(feature, auc): the chance that a value of group 1 exceeds one of group 0, ties half, from average ranks."""
    w = Window.partitionBy("feature").orderBy("value")
    same = Window.partitionBy("feature", "value")
    r = df.withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)
    a = r.groupBy("feature").agg(F.sum(F.when(F.col("grp") == 1, F.col("r"))).alias("s"), F.count_if(F.col("grp") == 1).alias("n1"), F.count_if(F.col("grp") == 0).alias("n0"))
    return a.select("feature", ((F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


def volcano(df: DataFrame, p_below: float = 0.05, fold_above: float = 0.0) -> DataFrame:
    """Add neg_log10 and category (up, down, none) to rows (feature, log2fc, adjusted)."""
    hit = F.col("adjusted") < p_below
    kind = F.when(hit & (F.col("log2fc") > fold_above), "up").when(hit & (F.col("log2fc") < -fold_above), "down").otherwise("none")
    return df.withColumn("neg_log10", -F.log10("adjusted")).withColumn("category", kind)


def p_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    return df.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def enrichment(counts: DataFrame, threshold: float = 1.645) -> DataFrame:
    """(motif, t, df, effect) of motif counts (feature, motif, n, target): features whose target exceeds the threshold
    against the rest. Both arms of the test get one more observation of 1; the effect's arms get 1 and 0 each."""
    base = counts.select("motif", F.col("n").cast("double").alias("value"), (F.col("target") > threshold).cast("int").alias("grp"))
    motifs = base.select("motif").distinct()
    extra = lambda rows: motifs.crossJoin(F.broadcast(counts.sparkSession.createDataFrame(rows, "value double, grp int"))).select("motif", "value", "grp")
    t = welch(base.unionByName(extra([(1.0, 0), (1.0, 1)])).withColumnRenamed("motif", "feature"))
    d = cohen_d(base.unionByName(extra([(1.0, 0), (0.0, 0), (1.0, 1), (0.0, 1)])).withColumnRenamed("motif", "feature"))
    return t.join(d, "feature").select(F.col("feature").alias("motif"), "t", "df", "effect")
