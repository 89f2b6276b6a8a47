"""Counts in arrays of a fixed length: mappers count keys in NumPy, and slabs of their arrays are summed in a tree.

The array of one mapper travels as its slabs of SLAB counts, of each the places that are not zero. A task of the tree adds at most
FAN arrays of a slab, so neither a task nor the driver grows with the number of mappers, and what is broadcast has the array's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugarbeam.llm.util import drop_stored, in_batches, stored, trimmed

SLAB = 1 << 16
FAN = 64
#: Keys that a mapper holds before it sends their counts.
HELD = 1 << 21
SCHEMA = "slab int, mapper int, at binary, n binary"


def _planes(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """values[cuts[i]:cuts[i+1]] for each i with all lowest bytes first, then all second ones and so on, which compresses well."""
    raw = values.view(np.uint8).reshape(len(values), -1)
    return pa.array([np.ascontiguousarray(raw[a:b].T).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())


def _read(data: bytes, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def parts(keys: np.ndarray, counts: np.ndarray, mapper: int) -> pa.RecordBatch:
    """Counts of ascending, distinct keys as rows of SCHEMA."""
    slab = keys // SLAB
    cuts = np.append(np.flatnonzero(np.diff(slab, prepend=-1)), len(keys))
    m = len(cuts) - 1
    return pa.RecordBatch.from_arrays([pa.array(slab[cuts[:-1]].astype(np.int32)), pa.array(np.full(m, mapper, np.int32)), _planes((keys % SLAB).astype(np.uint16), cuts), _planes(counts.astype(np.int64), cuts)], ["slab", "mapper", "at", "n"])


class Tally:
    """Counts keys of one mapper, which holds HELD of them and the last ones added at most."""

    def __init__(self) -> None:
        self.mapper = TaskContext.get().partitionId()
        self._held: list[np.ndarray] = []
        self._n = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._held.append(keys.astype(np.int64))
        self._n += len(keys)
        if self._n >= HELD:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self._n:
            keys, counts = np.unique(np.concatenate(self._held), return_counts=True)
            self._held, self._n = [], 0
            yield parts(keys, counts, self.mapper)


def dense(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The array of one mapper that has counted with bincount."""
    keys = np.flatnonzero(counts)
    if len(keys):
        yield parts(keys, counts[keys], TaskContext.get().partitionId())


def _level(rows: DataFrame, tasks: int, finish: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(SLAB, np.int64)

        def close() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            if finish is None:
                at = np.flatnonzero(total)
                yield parts(at + now[0] * SLAB, total[at], now[1])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([finish(total).tobytes()], pa.binary())], ["slab", "data"])

        for batch in batches:
            for slab, mapper, at, n in zip(*(batch.column(c).to_pylist() for c in ("slab", "mapper", "at", "n")), strict=True):
                if (slab, mapper) != now:
                    yield from close()
                    now, total = (slab, mapper), np.zeros(SLAB, np.int64)
                total[_read(at, np.uint16)] += _read(n, np.int64)
        yield from close()

    # No more tasks than arrays come in: a row's slab and mapper stay together when partitions are put together.
    return rows.repartition("slab", "mapper").sortWithinPartitions("slab", "mapper").coalesce(tasks).transform(in_batches).mapInArrow(trimmed(run), SCHEMA if finish is None else "slab int, data binary")


def tree_sum(rows: DataFrame, size: int, dtype: type, finish: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of all mappers' arrays of `size` counts, slab by slab through `finish`, which gives an array of `dtype` for a slab; what no key
    counts in is zero. The result's size is fixed by `size`."""
    mappers = rows.rdd.getNumPartitions()
    while True:
        tasks, mappers = max(6, mappers), -(-mappers // FAN)
        rows = _level(rows.withColumn("mapper", F.floor(F.col("mapper") / FAN).cast("int")), tasks, None if mappers > 1 else finish)
        if mappers <= 1:
            break
    slabs = -(-size // SLAB)
    one = len(finish(np.zeros(SLAB, np.int64)))
    out = np.zeros(slabs * one, dtype)
    rows = stored(rows)  # with it the tree's shuffles end
    for slab, data in rows.toLocalIterator():
        out[slab * one : (slab + 1) * one] = np.frombuffer(data, dtype)
    drop_stored(rows)
    return out
