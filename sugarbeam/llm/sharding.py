"""Byte-balanced shards by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugarbeam.llm.numbering import numbered
from sugarbeam.llm.util import stored

#: Groups of at least 1/(shards * FINE) of all bytes are placed one by one, so there are at most shards * FINE.
FINE = 64
#: All smaller groups are placed in this many lumps, each a hash class of groups.
LUMPS = 4096


def differencing(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item, by the largest differencing method.

    Every item starts as a partial partition (size, 0, ..., 0). The two partial partitions with the largest
    spread are combined, the largest sum of one with the smallest of the other, until one is left.
    Ties go to the earlier item; no items give no shards.
    """
    if not sizes:
        return []
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(shards, np.int64)
        sums[0] = s
        heap.append((-int(s) if shards > 1 else 0, i, sums, [(i,)] + [()] * (shards - 1)))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = a + b[::-1]
        bins = [(p, q) if p and q else p or q for p, q in zip(x, reversed(y), strict=True)]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        n += 1
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), n, sums, [bins[k] for k in order]))
    out = [0] * len(sizes)
    for shard, tree in enumerate(heap[0][3]):
        stack = [tree] if tree else []
        while stack:
            t = stack.pop()
            if isinstance(t, int):
                out[t] = shard
            else:
                stack.extend(t)
    return out


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs (doc_id, text, ...).

    Law `bytes`: sizes (UTF-8 bytes plus 16; a null text has none) are balanced over shards while equal texts
    stay together; nulls are equal to each other, an empty text is a text. A group larger than an even share
    fills a shard alone and the rest is balanced over the others. Large groups (at most shards * FINE) and
    LUMPS hash classes of the smaller ones meet on the driver, a number that does not grow with the data.
    Repeated rows are kept, each with its own slot; slots count from 0 in each shard. An empty table gives no rows.
    """
    text = F.col("text").cast("binary")
    base = stored(docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("g")))
    groups = stored(base.groupBy("g").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    is_large = F.col("bytes") * (shards * FINE) >= total
    large = groups.where(is_large).orderBy("g").collect()
    lump = F.pmod(F.col("g"), F.lit(LUMPS)).cast("int")
    lumps = groups.where(~is_large).groupBy(lump.alias("lump")).agg(F.sum("bytes").alias("bytes")).orderBy("lump").collect()
    at = differencing([r["bytes"] for r in large] + [r["bytes"] for r in lumps], shards)
    of_lump = [0] * LUMPS
    for r, s in zip(lumps, at[len(large) :], strict=True):
        of_lump[r["lump"]] = s
    alone = docs.sparkSession.createDataFrame([(r["g"], s) for r, s in zip(large, at, strict=False)], "g bigint, alone int")
    placed = base.join(F.broadcast(alone), "g", "left")
    placed = placed.withColumn("shard", F.coalesce("alone", F.element_at(F.lit(of_lump), lump + 1)).cast("int"))
    out = numbered(placed, "shard", ["doc_id", "text_crc32", "size"], "slot", salted=True)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
