"""Gapless numbers inside groups of any size, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sugarbeam.llm.util import stored

#: Hash slices over which every group is spread; slices times groups bounds the table of offsets.
SLICES = 128


def numbered(df: DataFrame, group: str, order: list[str], name: str, slices: int = SLICES, salted: bool = False) -> DataFrame:
    """Add `name`: a gapless number from 0 inside each `group`, which has few distinct values.

    Rows are dealt by group and a hash of `order`, so that a group that holds any share of the rows spreads over
    many tasks. A row's number is its rank in its (slice, group) plus the size of the group's earlier slices;
    the table of those sizes has at most slices x groups rows and is broadcast. Rows equal in `order` are
    numbered in any order; `salted` deals them by where they stand in the input, too, so that one row that is repeated
    often does not make one slice: the slices are then written before they are counted, since they hold for one run.
    """
    salt = [F.spark_partition_id()] if salted else []
    df = df.withColumn("_slice", F.pmod(F.xxhash64(*order, *salt), F.lit(slices)).cast("int"))
    df = stored(df) if salted else df
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
    sizes = sizes.select(F.col(group).alias("_g"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank: Column = F.row_number().over(Window.partitionBy("_slice", group).orderBy(*order))
    ranked = df.repartition("_slice", group).withColumn("_rank", rank)
    out = ranked.join(F.broadcast(sizes), (ranked[group] == sizes["_g"]) & (ranked["_slice"] == sizes["_s"]))
    return out.withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_g", "_s", "_n", "_before", "_rank", "_slice")
