"""Readers and writers at the edges: delimited files, typed-cell JSON, catalogs, network tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or TSV file with a header, by suffix; a byte order mark goes and repeated headers lose their .1, .2 endings only if they stay distinct."""
    sep = "\t" if path.lower().endswith((".tsv", ".txt")) else ","
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=True, encoding="UTF-8")
    names = [c.lstrip("﻿") for c in df.columns]
    plain = [re.sub(r"\.\d+$", "", c) for c in names]
    return df.toDF(*(plain if len(set(plain)) == len(plain) else names))


def to_long(wide: DataFrame, groups: dict[str, int], feature: str | None = None) -> DataFrame:
    """(feature, sample, grp, value) from a table of one row for each feature; groups tells each sample column's group. Missing cells are 0."""
    feature = feature or wide.columns[0]
    long = wide.select(F.col(feature).alias("feature"), *(F.col(c).cast("double").alias(c) for c in groups)).unpivot("feature", list(groups), "sample", "value")
    g = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return long.select("feature", "sample", F.element_at(g, F.col("sample")).alias("grp"), F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).alias("value"))


def to_wide(df: DataFrame, samples: list[str]) -> DataFrame:
    return df.groupBy("feature").pivot("sample", samples).agg(F.first("value")).fillna(0.0)


CELL = "struct<type: string, value: string>"


def write_cells(df: DataFrame, path: str) -> None:
    """One JSON line for each row, each cell tagged list, dict, null or primitive, so that nested columns survive a text file."""

    def cell(name: str, kind: str):
        c = F.col(f"`{name}`")
        tag = "list" if kind.startswith("array") else "dict" if kind.startswith("map") else "primitive"
        value = F.to_json(c) if tag != "primitive" else c.cast("string")
        return F.struct(F.when(c.isNull(), "null").otherwise(F.lit(tag)).alias("type"), value.alias("value")).alias(name)

    df.select(F.to_json(F.struct(*(cell(n, k) for n, k in df.dtypes))).alias("value")).write.mode("overwrite").text(path)


def read_cells(spark: SparkSession, path: str, schema: dict[str, str]) -> DataFrame:
    """Rows of write_cells with the declared types: lists and maps are parsed, primitives cast, nulls stay null."""
    whole = "struct<" + ", ".join(f"`{n}`: {CELL}" for n in schema) + ">"
    row = spark.read.text(path).select(F.from_json("value", whole).alias("r"))

    def back(name: str, kind: str):
        v = F.col(f"r.`{name}`.value")
        nested = kind.startswith(("array", "map"))
        return F.when(F.col(f"r.`{name}`.type") != "null", F.from_json(v, kind) if nested else v.cast(kind)).alias(name)

    return row.select(*(back(n, k) for n, k in schema.items()))


def catalog(spark: SparkSession, folder: str, prefix: str = "") -> dict[str, str]:
    """Names to paths of the data files of a folder in any store that Spark reads; the prefix is cut off."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in at.getFileSystem(conf).listStatus(at)]
    return {re.sub(r"\.(csv|tsv|parquet|json)$", "", n).removeprefix(prefix): f"{folder}/{n}" for n in sorted(names) if n.startswith(prefix) and re.search(r"\.(csv|tsv|parquet|json)$", n)}


def export_network(edges: DataFrame, vertices: DataFrame, folder: str) -> None:
    """CSV files of edges (Source, Target, Label) and nodes (Id, Virtual)."""
    edges.select(F.col("src").alias("Source"), F.col("dst").alias("Target"), F.col("diffs").alias("Label")).write.mode("overwrite").csv(f"{folder}/edges", header=True)
    vertices.select(F.col("node").alias("Id"), F.col("virtual").alias("Virtual")).write.mode("overwrite").csv(f"{folder}/nodes", header=True)


def exploded(df: DataFrame, item: str, columns: list[str]) -> DataFrame:
    """One row for each place of parallel list columns, for rows whose first list is not empty."""
    z = df.where(F.size(columns[0]) > 0).select(item, F.explode(F.arrays_zip(*columns)).alias("z"))
    return z.select(item, *(F.col(f"z.{c}").alias(c) for c in columns))


def first_match(df: DataFrame, lookup: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """df with the value of the lookup's first row (by `order`) for its key."""
    first = lookup.groupBy(key).agg(F.min_by(value, order).alias(value))
    return df.join(first, key, "left")
