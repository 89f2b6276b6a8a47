"""Cutting lineage in iterative operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local session uses the machine's own
    temporary folder, and a cluster the warehouse, which it shares."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        where = f"{tempfile.gettempdir()}/sugarbeam-shared" if local else spark.conf.get("spark.sql.warehouse.dir")
    return where.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by the columns `by` to a fixed number of tasks: few short texts, which Spark would else put together into one task by their bytes,
    can be much work each. By a hash, since rows that are dealt by `by` already, as after distinct(), would else stay as they are."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), F.xxhash64(*by))


_written: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(_clean)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder and a scan of it, whose plan knows nothing of df's: what an optimizer infers from a plan would add up over
    many rounds of checkpoints. Tables are deleted when the driver's Python ends."""
    path = f"{shared_folder(df.sparkSession)}/sugarbeam/{uuid.uuid4().hex}"
    _written.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
