"""Shared storage, label folds and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarbeam.sources.store import shared_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share."""
    return shared_folder(spark)


_written: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(_clean)


def drop_stored(df: DataFrame) -> None:
    """Delete the table behind a scan that `stored` returned, once no later plan reads it."""
    path = getattr(df, "_stored_path", None)
    if path is None:
        return
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if (spark, path) in _written:
        _written.remove((spark, path))


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """While this lasts, a query's shuffle files are deleted as it ends. They would else stay until the driver happens to collect its garbage, which
    with a large heap is never, and those of all steps would add up on the executors' disks."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and return a scan of it: lineage ends there, so a lost
    executor costs a re-read, not a recomputation. Tables are deleted when the driver's Python ends, the shuffles behind them at once.
    `tasks`: write with so many tasks at most, for tables whose size is known to be small for each."""
    spark = df.sparkSession
    df = df.coalesce(tasks) if tasks else df
    path = f"{shared_dir(spark)}/sugarbeam/{uuid.uuid4().hex}"
    _written.append((spark, path))
    with shuffles_end(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 1 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's limit of bytes in an Arrow batch to BATCH_BYTES, so that a worker's memory
    does not grow with the length of the texts that happen to follow each other."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives memory that it no longer uses back to the system: Spark keeps workers for later
    stages, and what their allocators hold would add up from stage to stage."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim is not None:
            trim(0)

    return outer


def kept(columns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Names under which the columns (name, type) pass through an operator, so that none clashes with what it adds, and their types."""
    return [(f"_c{i}", t) for i, (_, t) in enumerate(columns)]


def guarded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns other than doc_id and text under names that no operator uses, and what gives rows of it their names back."""
    inner = [c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*inner), lambda out: out.select(*inner).toDF(*docs.columns)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


#: Bytes of text that a sample of labelled rows brings to the driver; a longer text than what is left is not in the sample.
FIT_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most: int = FIT_BYTES) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled documents and `most` bytes of text, both fixed bounds.

    The ids with the smallest hash are taken, up to half of `rows` from each class, so the choice does not depend on partitioning;
    null labels and null texts do not count, and of rows that repeat an id the one with the smallest text hash does. Only the chosen
    ids are broadcast, and they number at most `rows`.
    """
    got = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col(label) > 0).cast("int").alias("y"))
    got = got.withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    parts = [got.where(F.col("y") == y).orderBy("h", "doc_id").limit(rows // 2) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1]).groupBy("doc_id").agg(F.max("y").alias("y"), F.min("h").alias("h"))
    return one_text_each(docs, ids, ["y"], most)


def one_text_each(docs: DataFrame, ids: DataFrame, values: list[str], most: int = FIT_BYTES) -> DataFrame:
    """(doc_id, text, values) of the documents of `ids` (doc_id, h, values), a table of a bounded number of rows: one row an id, taken in order of h
    while the texts stay below `most` bytes; a text that does not fit is left out, and smaller ones after it are still taken."""
    mine = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    one = mine.groupBy("doc_id").agg(F.min_by(F.struct("text", "h", *values), F.struct(F.xxhash64("text"), "text")).alias("r")).select("doc_id", "r.*")
    # The texts are written where they were found; only ids and sizes, as many as `ids` has rows, meet in one place.
    one = stored(one.withColumn("_n", F.octet_length("text")))
    fits, left = [], most
    for r in sorted(one.select("h", "doc_id", "_n").collect()):
        if r["_n"] <= left:
            fits.append((r["doc_id"],))
            left -= r["_n"]
    taken = docs.sparkSession.createDataFrame(fits, one.select("doc_id").schema)
    return one.join(F.broadcast(taken), "doc_id", "left_semi").select("doc_id", "text", *values)
