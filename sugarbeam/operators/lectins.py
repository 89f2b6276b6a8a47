"""Lectin arrays: which motifs the lectins of an array report on, and how strongly."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarbeam.functions import glycan as g
from sugarbeam.sources import tables


def load_library(spark: SparkSession, path: str) -> DataFrame:
    """(name, abbreviations, species, specificity, reference, notes) of a lectin library in typed cells, one JSON line for each lectin."""
    schema = {"name": "string", "abbreviations": "array<string>", "species": "string", "specificity": "map<string,array<string>>", "reference": "string", "notes": "string"}
    return tables.read_cells(spark, path, schema)


def match_names(array: DataFrame, library: DataFrame) -> DataFrame:
    """(lectin, name, species): the lectins of an array (lectin) with the first library row (name, abbreviations,
    species) that has the part of their name before `_` among its abbreviations, without regard to case."""
    known = library.select("name", "species", F.explode("abbreviations").alias("a")).groupBy(F.lower("a").alias("key")).agg(F.min(F.struct("name", "species")).alias("m"))
    return array.select("lectin").distinct().withColumn("key", F.lower(F.substring_index("lectin", "_", 1))).join(known, "key").select("lectin", "m.name", "m.species")


def binding_class(specificity: dict[str, list[str]], motif: str) -> int | None:
    """0 a primary motif, 1 a secondary one, 2 a part of a primary, 3 a part of a secondary; None for no binding or a negative motif."""
    if any(g.motif_count(motif, m) for m in specificity.get("negative") or []):
        return None
    for k, kind in enumerate(("primary", "secondary")):
        if any(g.motif_count(motif, m) for m in specificity.get(kind) or []):
            return k
    for k, kind in enumerate(("primary", "secondary")):
        if any(g.motif_count(m, motif) for m in specificity.get(kind) or []):
            return k + 2
    return None


def classes(library: DataFrame, motifs: list[str]) -> DataFrame:
    """(name, motif, class, specificity): every motif that a lectin (name, specificity map) binds, and how many motifs its entry has."""

    def run(batches):
        for pdf in batches:
            rows = []
            for name, spec in zip(pdf["name"], pdf["specificity"], strict=True):
                spec = {k: list(v) for k, v in (spec if isinstance(spec, dict) else dict(spec)).items() if v is not None}
                size = sum(len(v) for k, v in spec.items() if k != "negative")
                rows += [(name, m, k, size) for m in motifs if (k := binding_class(spec, m)) is not None]
            yield pd.DataFrame(rows, columns=["name", "motif", "class", "specificity"])

    return library.select("name", "specificity").mapInPandas(run, "name string, motif string, class int, specificity int")


# Weights of the binding classes, and the factor for each lectin of one library entry.
CLASS_WEIGHTS = {0: 1.0, 1: 0.5, 2: 0.5, 3: 0.25}
PENALTY = 0.8


def motif_scores(effects: DataFrame, bound: DataFrame) -> DataFrame:
    """(motif, lectins, change, score): the sum over a motif's lectins of effect x class weight x idf / breadth, where breadth is the number of
    motifs of the lectin's entry; n lectins of one entry (n > 1) count 0.8^n each. effects: (lectin, name, effect, idf), where idf is the
    lectin's variance over groups; bound: as classes gives it. score is the size of the sum in hundredths, change its direction."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_WEIGHTS.items() for x in kv]), F.col("class"))
    same = effects.groupBy("name").agg(F.count("*").alias("_n"))
    factor = F.when(F.col("_n") > 1, F.pow(F.lit(PENALTY), F.col("_n"))).otherwise(F.lit(1.0))
    d = effects.join(same, "name").join(bound, "name")
    part = F.col("effect") * weight * F.col("idf") / F.col("specificity") * factor
    order = F.transform(F.array_sort(F.collect_list(F.struct("class", "lectin"))), lambda x: x["lectin"])
    s = d.groupBy("motif").agg(F.sum(part).alias("s"), F.array_join(order, ", ").alias("lectins"))
    return s.select("motif", "lectins", F.when(F.col("s") < 0, "down").otherwise("up").alias("change"), F.round(F.abs("s"), 2).alias("score"))
