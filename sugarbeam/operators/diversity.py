"""Diversity inside and between samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sugarbeam.operators import testing
from sugarbeam.operators.networks import numbered_names
from sugarbeam.sources.store import checkpointed


def alpha(df: DataFrame) -> DataFrame:
    """(sample, grp, richness, shannon, simpson) from counts (feature, sample, grp, value)."""
    p = F.col("value") / F.sum("value").over(Window.partitionBy("sample"))
    d = df.withColumn("p", p)
    return d.groupBy("sample", "grp").agg(F.count_if(F.col("value") != 0).alias("richness"), (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(F.lit(0.0)))).alias("shannon"), (1 - F.sum(F.col("p") * F.col("p"))).alias("simpson"))


def alpha_anova(df: DataFrame) -> DataFrame:
    """(metric, f, d1, d2): diversities by group."""
    long = alpha(df).select("sample", "grp", F.col("richness").cast("double").alias("richness"), "shannon", "simpson").unpivot(["sample", "grp"], ["richness", "shannon", "simpson"], "feature", "value")
    return testing.anova(long).select(F.col("feature").alias("metric"), "f", "d1", "d2")


def distances(df: DataFrame) -> DataFrame:
    """(a, b, ga, gb, d): Euclidean distance of each pair of samples a < b. Samples are few; features are joined on their key."""
    x, y = df.select("feature", F.col("sample").alias("a"), F.col("grp").alias("ga"), F.col("value").alias("x")), df.select("feature", F.col("sample").alias("b"), F.col("grp").alias("gb"), F.col("value").alias("y"))
    return x.join(y, "feature").where("a < b").groupBy("a", "b", "ga", "gb").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("d"))


def permanova_stat(pairs: DataFrame) -> DataFrame:
    """(f): the pseudo-F whose sums of squares are sums of distances over pairs, halved; each pair counts in both directions. Groups and samples
    follow from the pairs in the same aggregation: n samples make n (n - 1) / 2 pairs."""
    s = pairs.agg(F.sum("d").alias("total"), F.sum(F.when(F.col("ga") == F.col("gb"), F.col("d")).otherwise(F.lit(0.0))).alias("within"), F.size(F.array_union(F.collect_set("ga"), F.collect_set("gb"))).alias("k"), F.count("*").alias("m"))
    s = s.withColumn("n", F.round((1 + F.sqrt(1 + 8 * F.col("m"))) / 2))
    return s.select(F.try_divide((F.col("total") - F.col("within")) / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"))


def anosim_stat(pairs: DataFrame) -> DataFrame:
    """(r): difference of mean ranks between and within groups over half the number of pairs."""
    x = testing.average_ranks(pairs, "d", "r")
    a = x.agg(F.avg(F.when(F.col("ga") != F.col("gb"), F.col("r"))).alias("between"), F.avg(F.when(F.col("ga") == F.col("gb"), F.col("r"))).alias("within"), F.count("*").alias("m"))
    return a.select(((F.col("between") - F.col("within")) / (F.col("m") / 2)).alias("r"))


#: Samples of a block of the distance matrix.
BLOCK = 256


def _label_blocks(names: DataFrame, n: int, permutations: int, seed: int) -> DataFrame:
    """(block, labels): a block's group numbers under each permutation, the true ones first, as bytes of 4 for each sample."""
    codes = names.select("id", "grp").toPandas().sort_values("id")  # one number for each sample: as many as a row of the distance matrix has
    label = pd.factorize(codes["grp"])[0].astype(np.int32)
    here = names.sparkSession.sparkContext.broadcast(label)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf["id"].tolist():
                mine = here.value[np.random.default_rng([seed, int(r)]).permutation(n)] if r else here.value
                rows += [(i // BLOCK, int(r), mine[i : i + BLOCK].tobytes()) for i in range(0, n, BLOCK)]
            yield pd.DataFrame(rows, columns=["block", "r", "labels"])

    some = names.sparkSession.range(0, permutations + 1).mapInPandas(run, "block int, r int, labels binary")
    return some.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("r", "labels"))).alias("x")).select("block", F.expr("aggregate(transform(x, e -> e.labels), cast('' AS binary), (s, e) -> s || e)").alias("labels"))


def permuted(pairs: DataFrame, stat: str, permutations: int = 999, seed: int = 42) -> DataFrame:
    """(stat, p): the statistic and the share of label permutations that reach it (no correction by one), of pairs (a, b, ga, gb, d) of samples.

    Distances are cut into blocks of BLOCK by BLOCK samples. All permutations are columns of a label matrix, cut into the same blocks of samples; a block
    of distances meets the labels of its rows and of its columns, and a matrix product of each group's indicator gives what lies within groups for
    all permutations at once. Sums over blocks give the statistics, so neither the driver nor a task sees all pairs. One group number for
    each sample goes to every task.
    """
    pairs = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "ga", "gb", F.col("d").cast("double").alias("d"))
    pairs = testing.average_ranks(pairs, "d", "rank") if stat == "anosim" else pairs.withColumn("rank", F.col("d"))
    pairs = checkpointed(pairs.select("a", "b", "ga", "gb", F.col("rank").alias("x")))
    ends = pairs.select(F.col("a").alias("name"), F.col("ga").alias("grp")).union(pairs.select("b", "gb")).groupBy("name").agg(F.min("grp").alias("grp"))
    names = checkpointed(ends.join(numbered_names(ends, "name"), "name"))
    n, k = names.agg(F.count("*"), F.countDistinct("grp")).first()
    labels = checkpointed(_label_blocks(names, n, permutations, seed))
    at = pairs.join(names.select(F.col("name").alias("a"), F.col("id").alias("i")), "a").join(names.select(F.col("name").alias("b"), F.col("id").alias("j")), "b")
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    cells = at.select(F.floor(lo / BLOCK).cast("int").alias("bi"), F.floor(hi / BLOCK).cast("int").alias("bj"), F.struct((lo % BLOCK).alias("i"), (hi % BLOCK).alias("j"), "x").alias("c"))
    blocks = cells.groupBy("bi", "bj").agg(F.collect_list("c").alias("cells"))
    both = blocks.join(labels.select(F.col("block").alias("bi"), F.col("labels").alias("li")), "bi").join(labels.select(F.col("block").alias("bj"), F.col("labels").alias("lj")), "bj")

    def run(batches):
        for pdf in batches:
            for cells, li, lj in zip(pdf["cells"], pdf["li"], pdf["lj"], strict=True):
                u, v = (np.frombuffer(x, np.int32).reshape(permutations + 1, -1) for x in (li, lj))
                x, there = np.zeros((u.shape[1], v.shape[1])), np.zeros((u.shape[1], v.shape[1]))
                i, j = (np.array([c[f] for c in cells]) for f in ("i", "j"))
                x[i, j], there[i, j] = [c["x"] for c in cells], 1.0
                inside, pairs_ = np.zeros(len(u)), np.zeros(len(u))
                for g in np.intersect1d(np.unique(u), np.unique(v)):
                    a, b = (u == g).astype(float), v == g
                    inside += ((a @ x) * b).sum(1)
                    pairs_ += ((a @ there) * b).sum(1)
                yield pd.DataFrame({"r": np.arange(len(u)), "inside": inside, "pairs": pairs_})

    within = both.select("cells", "li", "lj").mapInPandas(run, "r int, inside double, pairs double").groupBy("r").agg(F.sum("inside").alias("inside"), F.sum("pairs").alias("pairs"))
    total = pairs.agg(F.sum("x").alias("total"), F.count("*").alias("m"))
    d = within.crossJoin(F.broadcast(total))  # one row
    if stat == "anosim":
        value = ((F.col("total") - F.col("inside")) / (F.col("m") - F.col("pairs")) - F.col("inside") / F.col("pairs")) / (F.col("m") / 2)
    else:
        value = ((F.col("total") - F.col("inside")) / (k - 1)) / (F.col("inside") / (n - k))
    # Sums over blocks come in any order: the last digits do not tell permutations apart.
    d = checkpointed(d.select("r", F.round(value, 12).alias("v")))
    real = d.where("r = 0").select(F.col("v").alias("stat"))
    return d.where("r > 0").crossJoin(F.broadcast(real)).groupBy("stat").agg(F.avg((F.col("v") >= F.col("stat")).cast("double")).alias("p"))
