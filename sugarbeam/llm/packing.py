"""Packing token ids into sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sugarbeam.llm import kernels as K
from sugarbeam.llm import tokens
from sugarbeam.llm.numbering import numbered
from sugarbeam.llm.util import in_batches, stored, trimmed

#: Lengths are rounded up to classes of this many tokens for the linear program only.
WIDTH = 8
END_ID = 1


def pieces(docs: DataFrame, tokenizer: str, length: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full pieces of `length` ids and the rest of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        bpe = tokens.bpe(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            data, off = K.text_buffers(batch.column("text"))
            for i, j in K.blocks(off, tokens.BLOCK_BYTES):
                ids, first = bpe.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                raw = ids.astype("<u4").tobytes()
                n = np.diff(first) + 1
                cuts = -(-n // length)
                row = np.repeat(np.arange(j - i), cuts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * length
                size = np.minimum(length, n[row] - start)
                a, b = first[row] + start, first[row] + start + size
                stop = np.minimum(b, first[row + 1])
                crc = [zlib.crc32(end, zlib.crc32(raw[4 * x : 4 * y])) if z > y else zlib.crc32(raw[4 * x : 4 * y]) for x, y, z in zip(a.tolist(), stop.tolist(), b.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row + i)), *(pa.array(x, pa.int64()) for x in (start, size, crc, n[row]))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_batches).mapInArrow(trimmed(run), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def _best_pattern(y: np.ndarray, bins: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest price: an unbounded knapsack over classes of 1 .. bins units."""
    f, pick = np.zeros(bins + 1), np.zeros(bins + 1, int)
    for u in range(1, bins + 1):
        v = y[:u] + f[u - 1 :: -1]  # class c has c + 1 units
        c = int(np.argmax(v))
        if v[c] > f[u - 1]:
            f[u], pick[u] = v[c], c + 1
        else:
            f[u] = f[u - 1]
    a, u = np.zeros(len(y)), bins
    while u:
        if pick[u]:
            a[pick[u] - 1] += 1
            u -= pick[u]
        else:
            u -= 1
    return f[bins], a


def patterns(demand: np.ndarray, gap: float = 2e-4, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """[(pieces of each class in a sequence, sequences)] that hold `demand[c]` pieces of c + 1 units each.

    A sequence holds len(demand) units. The linear relaxation is solved by column generation with a revised
    simplex; it ends within `gap` of the bound that the duals prove. Its solution is rounded down, and what
    is left is filled largest class first.
    """
    bins = len(demand)
    used = np.flatnonzero(demand)
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    if len(used):
        n = demand[used].astype(float)
        basis = np.diag((bins // (used + 1)).astype(float))  # columns are patterns over the used classes
        inverse = np.diag(1 / np.diag(basis))
        x = inverse @ n
        y = np.zeros(bins)
        for _ in range(rounds):
            dual = inverse.sum(axis=0)
            y[:] = -1
            y[used] = dual
            value, a = _best_pattern(y, bins)
            if value <= 1 + 1e-9 or n @ dual / value >= (1 - gap) * x.sum():
                break
            col = inverse @ a[used]
            ratio = np.where(col > 1e-9, x / np.where(col > 1e-9, col, 1), np.inf)
            r = int(np.argmin(ratio))
            if not np.isfinite(ratio[r]):
                break
            basis[:, r] = a[used]
            row = inverse[r] / col[r]
            inverse -= np.outer(col, row)
            inverse[r] = row
            x = np.maximum(x - ratio[r] * col, 0)
            x[r] = max(ratio[r], 0)
        for k in np.argsort(-x, kind="stable"):
            a = np.zeros(bins, np.int64)
            a[used] = np.rint(basis[:, k])
            times = int(min(np.floor(x[k] + 1e-6), (left[a > 0] // a[a > 0]).min()))
            if times > 0:
                out.append((a, times))
                left -= times * a
    while left.any():
        a, room = np.zeros(bins, np.int64), bins
        for c in np.flatnonzero(left)[::-1]:
            a[c] = min(left[c], room // (c + 1))
            room -= a[c] * (c + 1)
        times = int((left[a > 0] // a[a > 0]).min())
        out.append((a, times))
        left -= times * a
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = 2048) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of docs (doc_id, text, ...).

    A document's ids are those of its text (null: empty) and a final id 1. A document beyond `length` ids is
    cut into full pieces and a rest; no other is cut. Pieces are counted by length class; column generation on
    that histogram (at most length / WIDTH numbers on the driver) gives patterns. Pieces ranked inside their
    class take the patterns' places in order. Every piece has one place; sequences are numbered from 0 and
    offsets are gapless. Repeated rows are packed each; an empty table gives no rows.
    """
    width = WIDTH if length % WIDTH == 0 else 1
    bins = length // width
    cut = stored(pieces(docs, tokenizer, length).withColumn("kind", (F.ceil(F.col("length") / width) - 1).cast("int")))
    demand = np.zeros(bins, np.int64)
    for r in cut.groupBy("kind").count().collect():
        demand[r["kind"]] = r["count"]
    plan: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
    taken, base = np.zeros(bins, np.int64), 0
    for a, times in patterns(demand):
        for c in np.flatnonzero(a):
            plan[c].append((int(taken[c]), int(a[c]), base))
        taken += a * times
        base += times
    rows = [(c, p) for c, p in enumerate(plan) if p]
    table = docs.sparkSession.createDataFrame(rows, "kind int, plan array<struct<low: bigint, per: bigint, base: bigint>>")
    ranked = numbered(cut, "kind", ["doc_id", "start"], "rank").join(F.broadcast(table), "kind")
    at = F.element_at(F.filter("plan", lambda e: e["low"] <= F.col("rank")), -1)
    placed = ranked.withColumn("at", at).withColumn("sequence_id", F.col("at.base") + F.floor((F.col("rank") - F.col("at.low")) / F.col("at.per")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "kind", "rank")
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("kind", "rank")
