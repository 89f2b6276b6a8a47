"""Annotation of sequences in long form (glycan, motif, n), and what is made of it.

Motif lists, fragments and terminal structures are rows, so no table grows a column for each motif. Distinct
sequences are parsed once for all motifs in one Arrow-batched pass.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarbeam.functions import columns as c
from sugarbeam.functions import glycan as g
from sugarbeam.functions import structure
from sugarbeam.functions.motifs import motif_list
from sugarbeam.operators import networks as nw
from sugarbeam.sources.store import spread

Motif = tuple[str, str, list[str]]  # name, sequence, place of each residue


def motif_counts(df: DataFrame, motifs: list[Motif], column: str = "glycan") -> DataFrame:
    """(glycan, motif, n) of each distinct sequence and each motif that occurs in it. A motif that starts with `r` is a pattern
    of sugarbeam.functions.patterns. Texts that are no sequence, and nulls, have no rows."""
    from sugarbeam.functions import patterns

    def run(batches):
        compiled = {m: patterns.compile_pattern(m[1:]) for _, m, _ in motifs if m.startswith("r")}
        for pdf in batches:
            rows = []
            for x in pdf[column]:
                try:
                    have = x.count("(") + 1
                    for name, m, places in motifs:
                        if m in compiled:
                            n = len(patterns.matches(compiled[m], x))
                        else:
                            n = g.motif_count(x, m, places or None) if m.count("(") <= have else 0
                        if n:
                            rows.append((x, name, n))
                except g.NotASequence:
                    continue
            yield pd.DataFrame(rows, columns=[column, "motif", "n"])

    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    return texts.mapInPandas(run, f"`{column}` string, motif string, n int")


def monosaccharides(df: DataFrame, column: str = "glycan") -> DataFrame:
    """(glycan, motif, n) of residues, in plain expressions; `Sia` counts Neu5Ac and Neu5Gc where the table has both."""
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    n = texts.select(column, F.explode(c.tokens(F.regexp_replace(column, r"\([^()]*\)", "(")))).groupBy(column, F.col("col").alias("motif")).agg(F.count("*").cast("int").alias("n"))
    sia = n.where(F.col("motif").isin("Neu5Ac", "Neu5Gc"))
    both = sia.agg(F.countDistinct("motif").alias("k")).where("k = 2")
    extra = sia.groupBy(column).agg(F.sum("n").cast("int").alias("n")).crossJoin(F.broadcast(both)).select(column, F.lit("Sia").alias("motif"), "n")
    return n.unionByName(extra)


def fragment_counts(df: DataFrame, size: int, column: str = "glycan") -> DataFrame:
    """(glycan, motif, n) of the connected parts of `size` residues."""
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    return texts.select(column, F.explode(c.fragments(F.col(column), size)).alias("motif", "n"))


def terminal_counts(df: DataFrame, size: int = 1, column: str = "glycan") -> DataFrame:
    """(glycan, motif, n) of non-reducing ends, named Terminal_<structure>."""
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    d = texts.select(column, F.explode(c.terminal_structures(F.col(column), size)).alias("motif", "n"))
    return d.withColumn("motif", F.concat(F.lit("Terminal_"), "motif"))


def size_branching(df: DataFrame, bins: int = 3, column: str = "glycan") -> DataFrame:
    """(glycan, motif, n): the bin of size and of branching of each sequence, `bins` equal bins from the least to the greatest; with
    no bins the numbers themselves."""
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    d = texts.select(column, (c.occurrences(F.col(column), "(") + 1).alias("Size"), c.occurrences(F.col(column), "[").alias("Branch"))
    long = d.unpivot([column], ["Size", "Branch"], "kind", "x")
    if not bins:
        return long.select(column, F.when(F.col("kind") == "Branch", "Branching").otherwise(F.col("kind")).alias("motif"), F.col("x").cast("int").alias("n"))
    ends = long.groupBy("kind").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    width = (F.col("b") - F.col("a") + 1) / F.lit(bins)
    edge = lambda k: F.col("a") - 0.5 + width * k
    k = F.least(F.floor((F.col("x") - F.col("a") + 0.5) / width), F.lit(bins - 1))
    label = F.concat("kind", F.lit("_"), F.floor(edge(k) + 0.5).cast("int").cast("string"), F.lit("-"), F.floor(edge(k + 1) - 0.5).cast("int").cast("string"))
    flat = F.concat("kind", F.lit("_"), F.col("a").cast("string"))
    return long.join(F.broadcast(ends), "kind").select(column, F.when(F.col("a") == F.col("b"), flat).otherwise(label).alias("motif"), F.lit(1).alias("n"))


def annotate(df: DataFrame, features: list[str], motifs: list[Motif] = (), column: str = "glycan") -> DataFrame:
    """(glycan, motif, n): the rows of the feature sets known (the list of named motifs), custom (`motifs`), exhaustive (residues and disaccharides, with the
    fragments of open linkages), terminal, terminal1, terminal2, terminal3 and size_branch. Zero counts have no row, so a motif
    that occurs nowhere does not appear."""
    known = {
        "known": lambda: motif_counts(df, motif_list(), column), "custom": lambda: motif_counts(df, list(motifs), column),
        "exhaustive": lambda: monosaccharides(df, column).unionByName(with_open_linkages(fragment_counts(df, 2, column), column)),
        "terminal": lambda: terminal_counts(df, 1, column), "terminal1": lambda: terminal_counts(df, 1, column), "terminal2": lambda: terminal_counts(df, 2, column),
        "terminal3": lambda: terminal_counts(df, 3, column), "size_branch": lambda: size_branching(df, 3, column),
    }
    unknown = set(features) - set(known)
    if unknown:
        raise ValueError(f"no feature sets: {', '.join(sorted(unknown))}")
    return reduce(DataFrame.unionByName, (known[f]() for f in features)).groupBy(column, "motif").agg(F.max("n").cast("int").alias("n"))


#: Anomer, first and second position of a linkage.
BOND = r"\(([ab?])([0-9?/]+)-([0-9?/]+)\)"


def open_form(df: DataFrame, motif: str = "motif") -> DataFrame:
    """(motif, open): for each distinct fragment the one that stands for all fragments of its residues: each linkage with the anomer
    that all have (else ?) and every position that one has. Residue strings are the key, so the work is one aggregation
    on (residues, place of the linkage)."""
    d = df.select(motif).distinct().withColumn("bare", F.regexp_replace(motif, BOND, "(LINK)"))
    bonds = F.arrays_zip(*(F.regexp_extract_all(motif, F.lit(BOND), k).alias(n) for k, n in ((1, "a"), (2, "s"), (3, "e"))))
    each = d.select("bare", F.posexplode(bonds).alias("at", "b"))
    parts = lambda x: F.array_compact(F.transform(F.split(x, "/"), lambda v: F.when(v != "?", v.cast("int"))))
    per = each.groupBy("bare", "at").agg(
        F.collect_set(F.when(F.col("b.a") != "?", F.col("b.a"))).alias("a"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(parts(F.col("b.s")))))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(parts(F.col("b.e")))))).alias("e"),
    )
    shown = lambda x: F.when(F.size(x) > 0, F.array_join(x.cast("array<string>"), "/")).otherwise(F.lit("?"))
    bond = F.concat(F.lit("("), F.when(F.size("a") == 1, F.col("a")[0]).otherwise(F.lit("?")), shown(F.col("s")), F.lit("-"), shown(F.col("e")), F.lit(")"))
    per = per.select("bare", F.struct("at", bond.alias("bond")).alias("b")).groupBy("bare").agg(F.array_sort(F.collect_list("b")).alias("bonds"))
    fill = F.aggregate("bonds", F.col("bare"), lambda s, b: F.concat(F.substring_index(s, "(LINK)", 1), b["bond"], F.substring(s, F.length(F.substring_index(s, "(LINK)", 1)) + 7, F.length(s))))
    return d.join(per, "bare", "left").select(motif, F.coalesce(fill, F.col("bare")).alias("open"))


def with_open_linkages(counts: DataFrame, column: str = "glycan") -> DataFrame:
    """counts (glycan, motif, n) and, for each open fragment, the sum of the fragments that it stands for."""
    forms = open_form(counts)
    rolled = counts.join(forms, "motif").where(F.col("open") != F.col("motif")).groupBy(column, F.col("open").alias("motif")).agg(F.sum("n").cast("int").alias("n"))
    return counts.select(column, "motif", F.col("n").cast("int").alias("n")).unionByName(rolled).groupBy(column, "motif").agg(F.max("n").alias("n"))


def deduplicated(df: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """Motif abundances (motif, sample, grp, value) without motifs whose values equal another's in all samples: the longest label
    stays, then the first by name. Labels of `sequences` (motif, sequence) count as their sequence and 20 characters more."""
    size = F.length("motif")
    rows = df
    if sequences is not None:
        rows = df.join(sequences.select("motif", (F.length("sequence") + 20).alias("_l")), "motif", "left")
        size = F.coalesce("_l", F.length("motif"))
    per = rows.groupBy("motif").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("row"), F.max(size).alias("size"))
    best = per.groupBy("row").agg(F.min_by("motif", F.struct((-F.col("size")).alias("s"), F.col("motif").alias("m"))).alias("motif")).select("motif")
    return df.join(best, "motif", "left_semi")


def core_group(x: Column) -> Column:
    """core2, core1 or rest of an O-linked sequence."""
    has = lambda ms: c._mapped(lambda t: any(structure.matches(t, m) for m in ms), "boolean")(x)
    return F.when(has(["GlcNAc(b1-6)GalNAc", "GlcNAcOS(b1-6)GalNAc"]), "core2").when(has(["Gal(b1-3)GalNAc", "GalOS(b1-3)GalNAc"]), "core1").otherwise("rest")


def sia_fuc_group(x: Column) -> Column:
    sia, fuc = F.contains(x, F.lit("Neu")), F.contains(x, F.lit("Fuc"))
    return F.when(sia & fuc, "SiaFuc").when(sia, "Sia").when(fuc, "Fuc").otherwise("rest")


def n_group(x: Column) -> Column:
    """complex, hybrid, high_man or rest of an N-linked sequence."""
    has = lambda ms: c._mapped(lambda t: any(structure.matches(t, m) for m in ms), "boolean")(x)
    whole = has(["GlcNAc(b1-2)Man(a1-6)", "GlcNAc(b1-2)Man(a1-?)[GlcNAc(b1-2)Man(a1-?)]Man"])
    half = has(["GlcNAc(b1-2)Man(a1-3)[Man(a1-?)Man(a1-6)]Man"])
    return F.when(whole, "complex").when(half, "hybrid").when(c.occurrences(x, "Man") > 3, "high_man").otherwise("rest")


def similarity(counts: DataFrame, pairs: DataFrame, column: str = "glycan") -> DataFrame:
    """(a, b, similarity): the cosine of the motif counts of each pair (a, b) that is asked for."""
    norm = counts.groupBy(column).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    x = counts.select(F.col(column).alias("a"), "motif", F.col("n").alias("u"))
    y = counts.select(F.col(column).alias("b"), "motif", F.col("n").alias("v"))
    dot = pairs.select("a", "b").join(x, "a").join(y, ["b", "motif"]).groupBy("a", "b").agg(F.sum(F.col("u") * F.col("v")).alias("dot"))
    out = pairs.select("a", "b").join(dot, ["a", "b"], "left")
    out = out.join(norm.select(F.col(column).alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col(column).alias("b"), F.col("norm").alias("nb")), "b")
    return out.select("a", "b", (F.coalesce("dot", F.lit(0)) / (F.col("na") * F.col("nb"))).alias("similarity"))


def representatives(counts: DataFrame, enriched: DataFrame, most: int = 10, column: str = "glycan") -> DataFrame:
    """(glycan, score): up to `most` sequences that hold much of the enriched motifs (motif, p, adjusted) for their length, without those that
    hold another of them. Motifs below 0.05 after correction count by -log10 p over the greatest."""
    e = enriched.where("adjusted < 0.05").select("motif", (-F.log10("p")).alias("w"))
    top = e.agg(F.max("w").alias("top"))
    e = e.crossJoin(F.broadcast(top)).select("motif", (F.col("w") / F.col("top")).alias("w"))
    score = counts.where("n > 0").join(e, "motif").groupBy(column).agg((F.sum("w") / F.first(F.length(column))).alias("score"))
    best = score.orderBy(F.desc("score"), column).limit(most)
    all_ = best.agg(F.collect_list(column).alias("all"))  # `most` texts

    def alone(batches):
        for pdf in batches:
            keep = [sum(g.motif_count(o, x) > 0 for o in all_) <= 1 for x, all_ in zip(pdf[column], pdf["all"], strict=True)]
            yield pdf[keep][[column, "score"]]

    return best.crossJoin(F.broadcast(all_)).mapInPandas(alone, f"`{column}` string, score double")


def neighbours(df: DataFrame, residue: str, modified: bool = False, least: int = 10, column: str = "glycan") -> DataFrame:
    """(kind, name, n) of a residue: what it is bound to (`parent`), by which linkage (`bond`), and, with `modified`, its modified forms
    (`form`). Occurrences over all rows; names below `least` times go."""
    d = df.select(F.explode(c.disaccharides(F.col(column))).alias("pair", "k"))
    m = rf"^(.*)\({'([^()]*)'}\)(.*)$"
    d = d.select(F.regexp_extract("pair", m, 1).alias("child"), F.regexp_extract("pair", m, 2).alias("bond"), F.regexp_extract("pair", m, 3).alias("parent"), "k")
    d = d.where(F.contains("child", F.lit(residue)) if modified else F.col("child") == residue)
    kinds = ["bond", "parent"] + (["form"] if modified else [])
    long = d.select(F.col("child").alias("form"), "bond", "parent", "k").unpivot(["k"], kinds, "kind", "name")
    return long.groupBy("kind", "name").agg(F.sum("k").alias("n")).where(F.col("n") >= least)


def insight(asked: DataFrame, known: DataFrame, motifs: list[Motif], column: str = "glycan") -> DataFrame:
    """(glycan, species, phyla, motifs, ids) of each asked sequence that `known` (glycan, species, phylum, id) has, up to branch order: sorted
    species, the phyla if there are more than five species, the names of its motifs and its ids."""
    a = asked.select(column).distinct().withColumn("key", c.canonical(F.col(column)))
    k = known.withColumn("key", c.canonical(F.col(column))).groupBy("key").agg(F.array_sort(F.collect_set("species")).alias("species"), F.array_sort(F.collect_set("phylum")).alias("phyla"), F.array_sort(F.collect_set("id")).alias("ids"))
    m = motif_counts(asked, motifs, column).groupBy(column).agg(F.array_sort(F.collect_set("motif")).alias("motifs"))
    out = a.join(k, "key").join(m, column, "left")
    none = F.array().cast("array<string>")
    return out.select(column, "species", F.when(F.size("species") > 5, F.col("phyla")).otherwise(none).alias("phyla"), F.coalesce("motifs", none).alias("motifs"), "ids")


def present(asked: DataFrame, known: DataFrame, column: str = "glycan") -> DataFrame:
    """(glycan, present): whether `known` holds the sequence, up to branch order. Sequences with wildcards compare as texts of their own."""
    key = c.canonical(F.col(column)).alias("key")
    have = spread(known.select(column).distinct(), column).select(key).where("key is not null").distinct().withColumn("present", F.lit(True))
    return spread(asked.select(column), column).select(column, key).join(have, "key", "left").select(column, F.coalesce("present", F.lit(False)).alias("present"))


def uncertain_counts(df: DataFrame, feasible: DataFrame, motifs: list[Motif], column: str = "glycan") -> DataFrame:
    """(glycan, motif, n) of sequences with one floating part: counts in what is bound; a motif that is not there counts 1 if, on average
    over the feasible sequences (glycan) that the part could make, it occurs more than half a time. Feasible sequences meet those
    of the same residues only."""
    size = F.array_join(F.array_sort(c.tokens(F.regexp_replace(column, r"\([^()]*\)", "("))), ",")
    d = df.select(column).where(F.contains(column, F.lit("{"))).distinct().withColumn("size", size)
    f = feasible.select(F.col(column).alias("whole")).where(~F.contains("whole", F.lit("{"))).distinct()
    f = f.withColumn("size", F.array_join(F.array_sort(c.tokens(F.regexp_replace("whole", r"\([^()]*\)", "("))), ","))

    def run(batches):
        for pdf in batches:
            rows = []
            for x, whole in zip(pdf[column], pdf["whole"], strict=True):
                if structure.topology_matches(x, [whole], True):
                    rows += [(x, name, float(g.motif_count(whole, m, places or None))) for name, m, places in motifs]
            yield pd.DataFrame(rows, columns=[column, "motif", "k"])

    could = d.join(f, "size").select(column, "whole").mapInPandas(run, f"`{column}` string, motif string, k double").groupBy(column, "motif").agg(F.avg("k").alias("k"))
    plain = motif_counts(d, motifs, column)
    out = plain.join(could, [column, "motif"], "full_outer")
    n = F.coalesce(F.col("n"), F.when(F.col("k") > 0.5, 1))
    return out.select(column, "motif", n.alias("n")).where("n > 0")


def vocabulary(df: DataFrame, column: str = "glycan") -> DataFrame:
    """(token, id): residues and linkages numbered from 0 by name."""
    return nw.numbered_names(df.select(F.explode(c.tokens(F.col(column))).alias("token")), "token")


def expanded_vocabulary(known: DataFrame, df: DataFrame, column: str = "glycan") -> DataFrame:
    """known (token, id) and the new tokens of df, whose id is their number among all tokens of df plus the size of `known`."""
    size = known.agg(F.count("*").alias("size"))
    new = vocabulary(df, column).join(known.select("token"), "token", "left_anti").crossJoin(F.broadcast(size))
    return known.select("token", "id").unionByName(new.select("token", (F.col("id") + F.col("size")).cast("int").alias("id")))


def covered(df: DataFrame, known: DataFrame, column: str = "glycan") -> DataFrame:
    """(glycan, covered): whether `known` (token) has all residues and linkages of each distinct sequence."""
    t = df.select(column).distinct().select(column, F.explode(c.tokens(F.col(column))).alias("token"))
    d = t.join(known.select("token").distinct().withColumn("_k", F.lit(True)), "token", "left")
    return d.groupBy(column).agg(F.bool_and(F.col("_k").isNotNull()).alias("covered"))


def wildcard_rows(df: DataFrame, covers: list[str], wildcard: str, rate: float = 0.1, column: str = "glycan") -> DataFrame:
    """df and, for each residue of `covers` that a sequence holds, the sequence with the wildcard for it, at this rate. The choice depends on
    the sequence and the residue alone, so that a rerun of a task chooses the same."""
    each = df.withColumn("_r", F.explode(F.lit(covers))).where(F.contains(column, F.col("_r")))
    u = F.pmod(F.xxhash64(column, "_r"), F.lit(1 << 20)) / float(1 << 20)
    swapped = each.where(u < rate).withColumn(column, F.replace(F.col(column), F.col("_r"), F.lit(wildcard))).drop("_r")
    return df.unionByName(swapped)
