"""Cleaning and transforming abundance tables in long form: (feature, sample, grp, value).

Zero means "not detected". Every operator is a window or an aggregation keyed by feature or by sample, so one
shuffle on that key serves all of its expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_feature() -> WindowSpec:
    return Window.partitionBy("feature")


def by_sample() -> WindowSpec:
    return Window.partitionBy("sample")


def complete(df: DataFrame) -> DataFrame:
    """Every feature in every sample; missing or null values are 0, repeated cells are added. Cells are added up once; the list of samples, which
    are few, rides on each feature, whose cells are one map, so that no join is needed."""
    cells = df.groupBy("feature", "sample", "grp").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("value"))
    samples = cells.select("sample", "grp").distinct().agg(F.array_sort(F.collect_list(F.struct("sample", "grp"))).alias("all"))
    have = cells.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("sample", "grp"), "value"))).alias("have"))
    row = F.transform("all", lambda s: F.struct(s["sample"].alias("sample"), s["grp"].alias("grp"), F.coalesce(F.element_at("have", s), F.lit(0.0)).alias("value")))
    return have.crossJoin(F.broadcast(samples)).select("feature", F.explode(row).alias("c")).select("feature", "c.*")


def drop_empty(df: DataFrame) -> DataFrame:
    """Without features that are zero in every sample."""
    return df.withColumn("_m", F.max(F.abs("value")).over(by_feature())).where("_m > 0").drop("_m")


def prevalent(df: DataFrame, min_samples: float = 0.1) -> DataFrame:
    """Features that are non-zero in at least max(floor((samples + 1) * min_samples), 1) samples."""
    seen = F.count_if(F.col("value") != 0).over(by_feature())
    need = F.greatest(F.floor((F.count(F.lit(1)).over(by_feature()) + 1) * F.lit(min_samples)), F.lit(1))
    return df.withColumn("_k", seen >= need).where("_k").drop("_k")


def normalized(df: DataFrame) -> DataFrame:
    """Values as percentages of their sample."""
    return df.withColumn("value", F.col("value") / F.sum("value").over(by_sample()) * 100)


def floor_empty_groups(df: DataFrame, least: float = 1e-5) -> DataFrame:
    """A group in which a feature is zero everywhere gets `least`."""
    total = F.sum("value").over(Window.partitionBy("feature", "grp"))
    return df.withColumn("value", F.when(total == 0, F.lit(least)).otherwise(F.col("value")))


def impute_and_normalize(df: DataFrame, min_samples: float = 0.1) -> DataFrame:
    """The deterministic preparation: prevalence filter, floor of empty groups, percentages (remaining zeros stay)."""
    return normalized(floor_empty_groups(prevalent(df, min_samples)))


def impute_median(df: DataFrame, least: float = 1e-6) -> DataFrame:
    """Zeros take the median of the feature's non-zero values, and every value grows by `least`."""
    middle = F.median(F.when(F.col("value") != 0, F.col("value"))).over(by_feature())
    return df.withColumn("value", F.coalesce(F.when(F.col("value") != 0, F.col("value")), middle, F.lit(0.0)) + least)


def clr(df: DataFrame) -> DataFrame:
    """Centred log ratio: log2 of the value less the sample's mean log2 over non-zero values; null for zeros."""
    log = F.when(F.col("value") > 0, F.log2("value"))
    return df.withColumn("value", log - F.avg(log).over(by_sample()))


def alr(df: DataFrame, reference: str) -> DataFrame:
    """Additive log ratio against one feature, which leaves the table; null where either is zero."""
    log = F.when(F.col("value") > 0, F.log2("value"))
    base = F.max(F.when(F.col("feature") == reference, log)).over(by_sample())
    return df.withColumn("value", log - base).where(F.col("feature") != reference)


def clr_noise(df: DataFrame, group: int, gamma: float, seed: int) -> DataFrame:
    """clr with normal scale noise of deviation gamma on the cells of one group."""
    return clr(df).withColumn("value", F.col("value") + F.when(F.col("grp") == group, F.randn(seed) * gamma).otherwise(F.lit(0.0)))


def stabilized(df: DataFrame) -> DataFrame:
    """log1p, then z-scores in each sample; a sample without spread keeps its logs."""
    log = F.log1p("value")
    sd = F.stddev_samp(log).over(by_sample())
    return df.withColumn("value", F.when(sd > 0, (log - F.avg(log).over(by_sample())) / sd).otherwise(log))


def by_variance(df: DataFrame, least: float = 0.02) -> DataFrame:
    """(feature, variance, kept): kept if the variance over samples exceeds `least`."""
    return df.groupBy("feature").agg(F.var_samp("value").alias("variance")).withColumn("kept", F.col("variance") > least)


def iqr_capped(df: DataFrame) -> DataFrame:
    """Values beyond 1.5 interquartile ranges of their feature move to that bound; zeros are neither counted nor moved."""
    present = F.when(F.col("value") != 0, F.col("value"))
    low, high = F.percentile(present, F.lit(0.25)).over(by_feature()), F.percentile(present, F.lit(0.75)).over(by_feature())
    capped = F.greatest(F.least("value", high + 1.5 * (high - low)), low - 1.5 * (high - low))
    return df.withColumn("value", F.when(F.col("value") == 0, F.col("value")).otherwise(capped))


def winsorized(df: DataFrame, least: float = 0.05) -> DataFrame:
    """The k lowest and k highest values of a feature move to the next ones, k = floor(n * max(least, 1 / n)). A feature's two bounds are found
    once and joined to its cells."""
    o = df.where("value is not null").groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("o"))
    n = F.size("o")
    k = F.floor(n * F.greatest(F.lit(least), 1 / n) + 1e-9).cast("int")
    bounds = o.select("feature", F.when(2 * k < n, F.element_at("o", k + 1)).alias("_low"), F.when(2 * k < n, F.element_at("o", n - k)).alias("_high"))
    moved = F.greatest(F.least("value", "_high"), "_low")
    return df.join(bounds, "feature", "left").withColumn("value", F.when(F.col("value").isNotNull() & F.col("_low").isNotNull(), moved).otherwise(F.col("value"))).select(df.columns)


def mean_duplicates(df: DataFrame) -> DataFrame:
    return df.groupBy("feature", "sample", "grp").agg(F.avg("value").alias("value"))


def quantified(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Motif abundances: for each sample and motif the sum of value times the motif's count in the feature. counts: (feature, motif, n)."""
    return df.join(counts, "feature").groupBy("motif", "sample", "grp").agg(F.sum(F.col("value") * F.col("n")).alias("value"))


def coverage(df: DataFrame) -> DataFrame:
    """(feature, detected, mean): features by falling mean, with the number of samples that have them."""
    return df.groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("detected"), F.avg("value").alias("mean")).orderBy(F.desc("mean"), "feature")


def presence_matrix(df: DataFrame, label: str, item: str, items: list) -> DataFrame:
    """Counts of each item in each label, one column for each of `items`, zero filled."""
    return df.groupBy(label).pivot(item, items).count().fillna(0)
