"""Whole analyses in one call: from abundances of sequences to tested sequences or motifs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugarbeam.functions import strings
from sugarbeam.functions.motifs import motif_list
from sugarbeam.operators import abundance as ab
from sugarbeam.operators import annotation as an
from sugarbeam.operators import expression as ex
from sugarbeam.operators import matching as ma
from sugarbeam.sources.store import checkpointed
from sugarbeam.sources.tables import to_long

#: Added to abundances before their logs are taken.
SMALL = 1e-7
#: Log ratios are additive above this many features of N-linked sequences, unless they are asked for.
MANY = 50


def annotated(df: DataFrame, features: Sequence[str], motifs: Sequence[an.Motif] = (), column: str = "glycan") -> DataFrame:
    """(glycan, motif, n) as `annotation.annotate`, but named and custom motifs are found through the label index, so that a sequence meets only
    the motifs whose residues it has. Null texts have no rows, each distinct text is read once."""
    texts = df.select(F.col(column).alias("glycan")).where(F.col(column).isNotNull()).distinct()
    lists = {"known": motif_list, "custom": lambda: motifs}
    plain = [f for f in features if f not in lists]
    parts = [an.annotate(texts, plain)] if plain else []
    for f in features:
        if f in lists:
            table = df.sparkSession.createDataFrame([(n, m, list(t) or None) for n, m, t in lists[f]()], "name string, motif string, termini array<string>")
            parts.append(ma.motif_counts(texts, table).select("glycan", F.col("name").alias("motif"), "n"))
    out = reduce(DataFrame.unionByName, parts).groupBy("glycan", "motif").agg(F.max("n").cast("int").alias("n"))
    return out.withColumnRenamed("glycan", column)


def quantified(df: DataFrame, features: Sequence[str], motifs: Sequence[an.Motif] = (), remove_redundant: bool = True) -> DataFrame:
    """(feature, sample, grp, value): abundances of the motifs of df's features, which are sequences. Of motifs that are equal in all samples one stays."""
    values = ab.quantified(df, annotated(df, features, motifs, "feature"))
    values = an.deduplicated(checkpointed(values)) if remove_redundant else values
    return values.withColumnRenamed("motif", "feature")


def prepared(df: DataFrame, features: Sequence[str] = (), motifs: Sequence[an.Motif] = (), paired: bool = False, impute: bool = True, min_samples: float = 0.1, transform: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(logs, shares), both (feature, sample, grp, value), of abundances (feature, sample, grp, value[, pair]).

    Missing cells are 0, features without values go, outliers are winsorized, rare features go, zeros are imputed by forests (or stay), and
    samples add up to 100. With `features` (see annotation.annotate) the rows are motifs. transform: CLR, ALR, Nothing, or none of them: ALR for more than
    MANY features most of which are N-linked, else CLR. Paired samples keep their pair. An empty table gives empty tables.
    """
    if transform not in (None, "CLR", "ALR", "Nothing"):
        raise ValueError(f"no transformation: {transform}")
    d = ab.prevalent(ab.winsorized(ab.drop_empty(ab.complete(df))), min_samples)
    d = ab.floor_empty_groups(d)
    shares = checkpointed(ab.normalized(ex.impute_forest(d) if impute else d))
    if transform is None:
        n = shares.select("feature").distinct().agg(F.count("*").alias("all"), F.count_if(strings.has_class(F.col("feature"), "N")).alias("n")).first()
        transform = "ALR" if n["all"] > MANY and 2 * n["n"] > n["all"] else "CLR"
    if features:
        shares = checkpointed(quantified(shares, features, motifs))
    more = shares.withColumn("value", F.col("value") + SMALL)
    logs = more if transform == "Nothing" else ab.clr(more) if transform == "CLR" else ex.log_ratios(more)[0]
    shares = ab.normalized(shares)
    if paired:
        pairs = df.select("sample", "grp", "pair").distinct()
        logs, shares = (x.join(pairs, ["sample", "grp"]) for x in (logs, shares))
    return logs, shares


def differential_expression(df: DataFrame, group1: Sequence[str] = (), group2: Sequence[str] = (), features: Sequence[str] = (), motifs: Sequence[an.Motif] = (), paired: bool = False, impute: bool = True, min_samples: float = 0.1, transform: str | None = None, alpha: float | None = None) -> DataFrame:
    """The rows of `expression.differential` for sequences, or for their motifs if `features` names sets of them.

    df is long (feature, sample, grp, value[, pair]), or wide if groups are given: its first column holds the sequences, the columns group1 and
    group2 the samples, which are pairs in their order if `paired`.
    """
    if group1 or group2:
        long = to_long(df, {**dict.fromkeys(group1, 0), **dict.fromkeys(group2, 1)})
        if paired:
            if len(group1) != len(group2):
                raise ValueError("paired groups have one sample each for each pair")
            place = {s: i for g in (group1, group2) for i, s in enumerate(g)}
            long = long.withColumn("pair", F.create_map(*(F.lit(x) for kv in place.items() for x in kv))[F.col("sample")])
        df = long
    logs, shares = prepared(df, features, motifs, paired, impute, min_samples, transform)
    return ex.differential(logs, shares, paired, alpha)
