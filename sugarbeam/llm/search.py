"""Exact top-k inner-product search with two cover trees.

Above the trees of blocks stands one level more: data are dealt to at most MOST_PARTS parts around centres, so that a query
goes to the block that promises most first and then only to parts whose centre and radius can still beat its kth score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sugarbeam.llm.util import in_batches, stored, trimmed

#: Vectors in a block (one task holds one block and its tree) and in a batch of queries, and points in a leaf.
BLOCK = 8192
QUERY_BATCH = 1024
LEAF = 48
#: Parts around centres, and vectors among which the centres are chosen; both are all that the driver sees of the vectors.
MOST_PARTS, SAMPLE = 256, 4096


class CoverTree:
    """A tree of nodes, each with a centre that is one of its points and the radius that covers its points.

    A node's children are balls of half its radius around points chosen one after the other; points whose
    balls are small are put together in leaves.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.norms = np.sqrt((x * x).sum(axis=1))
        self.points: list[np.ndarray] = []  # of leaves
        self.children: list[np.ndarray] = []
        self.center: list[int] = []
        self.radius: list[float] = []
        self.all: list[np.ndarray] = []
        self._build(np.arange(len(x)))
        self.centers = x[self.center]
        self.center_norms = self.norms[self.center]
        self.radii = np.array(self.radius)

    def _node(self, at: np.ndarray) -> tuple[int, np.ndarray]:
        d = self.x[at] - self.x[at[0]]
        d = np.sqrt((d * d).sum(axis=1))
        self.center.append(int(at[0]))
        self.radius.append(float(d.max()))
        self.children.append(np.zeros(0, int))
        self.points.append(at)
        return len(self.center) - 1, d

    def _build(self, root: np.ndarray) -> None:
        work = [(*self._node(root), root)]
        while work:
            k, d, at = work.pop()
            r = self.radius[k]
            if len(at) <= LEAF or r == 0:
                continue
            balls, small, left = [], [], at
            while len(left):
                near = d <= r / 2
                (balls if near.sum() > LEAF // 2 else small).append(left[near])
                left = left[~near]
                if len(left):
                    d = self.x[left] - self.x[left[0]]
                    d = np.sqrt((d * d).sum(axis=1))
                    if len(small) > 64:  # no structure at this scale: the rest goes into leaves
                        small.append(left)
                        break
            if small:
                rest = np.concatenate(small)
                balls += [rest[i : i + LEAF] for i in range(0, len(rest), LEAF)]
            made = [(*self._node(b), b) for b in balls]
            self.children[k] = np.array([m[0] for m in made])
            work += made


class Best:
    """The k best (score, smallest id) of each query."""

    def __init__(self, n: int, k: int, worst: np.ndarray | None = None) -> None:
        """`worst`: kth scores that are known already; lower ones need not be found."""
        self.k = k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (-score, id), sorted
        self.worst = np.full(n, -np.inf) if worst is None else worst.astype(float)

    def add(self, q: int, scores: list[int], ids: list[list[int]], own: int) -> None:
        got = self.rows[q] + [(-s, i) for s, many in zip(scores, ids, strict=True) for i in many if i != own]
        got.sort()
        self.rows[q] = got[: self.k]
        if len(self.rows[q]) == self.k:
            self.worst[q] = max(self.worst[q], -self.rows[q][-1][0])


def dual_search(queries: CoverTree, own: list[int], data: CoverTree, ids: list[list[int]], best: Best, exact: bool) -> None:
    """Visit node pairs, best bound first; a pair goes if no score in it can reach the worst kth score of its queries."""
    stack = [(0, 0, np.inf)]
    slack = 1 + 1e-9
    qx, dx = (queries.x, data.x) if exact else (queries.x.astype(np.int64), data.x.astype(np.int64))
    while stack:
        q, x, bound = stack.pop()
        at = queries.points[q]
        if bound < best.worst[at].min():
            continue
        if not len(queries.children[q]) and not len(data.children[x]):
            to = data.points[x]
            scores = qx[at] @ dx[to].T
            hit = scores >= best.worst[at][:, None]
            for r in np.flatnonzero(hit.any(axis=1)).tolist():
                on = np.flatnonzero(hit[r])
                best.add(int(at[r]), [int(s) for s in scores[r, on]], [ids[i] for i in to[on].tolist()], own[at[r]])
            continue
        if len(data.children[x]) and (not len(queries.children[q]) or data.radii[x] >= queries.radii[q]):
            kids, fixed, grow, still, swap = data.children[x], q, data, queries, False
        else:
            kids, fixed, grow, still, swap = queries.children[q], x, queries, data, True
        r, n = grow.radii[kids], grow.center_norms[kids]
        top = grow.centers[kids] @ still.centers[fixed] + slack * (r * still.center_norms[fixed] + n * still.radii[fixed] + r * still.radii[fixed]) + 1e-6
        for k in np.argsort(top, kind="stable").tolist():  # the last pushed is visited first
            stack.append((int(kids[k]), fixed, top[k]) if swap else (fixed, int(kids[k]), top[k]))


def _matrix(column: pa.Array) -> np.ndarray:
    flat, off = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(off) and (off == off[0]).all():
        return flat.reshape(len(off), -1)
    out = np.zeros((len(off), int(off.max()) if len(off) else 0))
    out[np.arange(out.shape[1]) < off[:, None]] = flat
    return out


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _distinct(x: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, list[list[int]]]:
    """Distinct vectors and the `keep` smallest ids of each: no other id of a vector can be in a result."""
    u, which = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, which.ravel()))
    cut = np.searchsorted(which.ravel()[order], np.arange(len(u) + 1))
    return u, [list(dict.fromkeys(ids[order[a:b]].tolist()))[:keep] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def centres(x: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of the vectors, each the farthest from those before it; fewer if all others are copies."""
    if not len(x):
        return x
    at = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(at) < most and far.max() > 0:
        at.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
    return x[at]


def _wide(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(x.shape[1], c.shape[1])
    return _fit(x, w), _fit(c, w)


def _placed(good: DataFrame, mid: np.ndarray) -> DataFrame:
    """(id, v, part, d): the nearest centre of each vector and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, c = _wide(_matrix(batch.column("v")), mid)
            d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)
            part = d.argmin(axis=1)
            gap = x - c[part]  # the distance itself, without the cancellation above
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(part.astype(np.int32)), pa.array(np.sqrt((gap * gap).sum(axis=1)))], ["id", "v", "part", "d"])

    return good.transform(in_batches).mapInArrow(trimmed(run), "id bigint, v array<double>, part int, d double")


@dataclass(frozen=True)
class Parts:
    """Centres and radii of the parts, and the blocks of each: `blocks[p]` of them from `first[p]` on."""

    mid: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    def block(self, part: Column, id_: Column) -> Column:
        of = lambda v: F.element_at(F.lit(v.tolist()), part + 1)
        return (of(self.first) + F.pmod(F.xxhash64(id_), of(self.blocks))).cast("int")

    def promises(self, q: np.ndarray) -> np.ndarray:
        """The greatest score that each query can have in each part."""
        x, c = _wide(q, self.mid)
        top = x @ c.T + np.sqrt((x * x).sum(axis=1))[:, None] * self.radius * (1 + 1e-9) + 1e-6
        return np.where(self.blocks > 0, top, -np.inf)


def _first_blocks(asked: DataFrame, parts: Parts) -> DataFrame:
    """(id, v, part): each query with the part whose centre scores best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, c = _wide(_matrix(batch.column("v")), parts.mid)
            score = np.where(parts.blocks > 0, x @ c.T, -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(score.argmax(axis=1).astype(np.int32))], ["id", "v", "part"])

    return asked.transform(in_batches).mapInArrow(trimmed(run), "id bigint, v array<double>, part int")


def _other_blocks(asked: DataFrame, parts: Parts) -> DataFrame:
    """(block, id, v, worst): each query of asked (id, v, block, worst) with every other block whose part can still beat its kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, worst = batch.column("block").to_numpy(), batch.column("worst").to_numpy()
            can = parts.promises(_matrix(batch.column("v"))) >= worst[:, None]
            for i in range(batch.num_rows):
                to = np.concatenate([np.arange(parts.first[p], parts.first[p] + parts.blocks[p]) for p in np.flatnonzero(can[i])] or [np.zeros(0, int)])
                to = to[to != seen[i]].astype(np.int32)
                if len(to):
                    at = pa.array(np.full(len(to), i))
                    yield pa.RecordBatch.from_arrays([pa.array(to), batch.column("id").take(at), batch.column("v").take(at), batch.column("worst").take(at)], ["block", "id", "v", "worst"])

    return asked.transform(in_batches).mapInArrow(trimmed(run), "block int, id bigint, v array<double>, worst double")


def _searched(data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query of asked (block, id, v, worst) in its block of data (block, id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, tree, names, limit = None, [], [], None, [], 0.0

        def search(q_ids: np.ndarray, q: np.ndarray, worst: np.ndarray) -> pa.RecordBatch:
            nonlocal tree, names, limit
            width = max([q.shape[1], *(h.shape[1] for h in held), 1])
            if held:
                x, names = _distinct(np.concatenate([_fit(h, width) for h in held]), np.concatenate(ids), k + 1)
                tree, limit = CoverTree(x), float(np.abs(x).max(initial=0))
                held.clear()
                ids.clear()
            out = []
            if tree is not None:
                w = max(tree.x.shape[1], width)
                data_ = tree if tree.x.shape[1] == w else CoverTree(_fit(tree.x, w))
                q = _fit(q, w)
                best = Best(len(q), k, worst)
                own = q_ids.tolist()
                dual_search(CoverTree(q), own, data_, names, best, limit * float(np.abs(q).max(initial=0)) * w < 2**52)
                out = [(o, i, -s) for o, rows_ in zip(own, best.rows, strict=True) for s, i in rows_]
            return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

        for batch in batches:
            b, side = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            at = np.flatnonzero(np.diff(b * 2 + side)) + 1
            for i, j in zip([0, *at.tolist()], [*at.tolist(), len(b)], strict=True):
                if i == j:
                    continue
                if b[i] != now:
                    now, tree = b[i], None
                    held.clear()
                    ids.clear()
                x, x_ids = _matrix(batch.column("v").slice(i, j - i)), batch.column("id").slice(i, j - i).to_numpy()
                if side[i] == 0:
                    held.append(x)
                    ids.append(x_ids)
                else:
                    floor = batch.column("worst").slice(i, j - i).to_numpy()
                    for a in range(0, j - i, QUERY_BATCH):
                        yield search(x_ids[a : a + QUERY_BATCH], x[a : a + QUERY_BATCH], floor[a : a + QUERY_BATCH])

    none = F.lit(float("-inf"))
    rows = data.select("block", F.lit(0).alias("side"), "id", "v", none.alias("worst")).unionByName(asked.select("block", F.lit(1).alias("side"), "id", "v", "worst"))
    return rows.repartition("block").sortWithinPartitions("block", "side", "id").transform(in_batches).mapInArrow(trimmed(run), "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose vec_id is divisible by `every`.

    A component x counts as floor(scale * x); scores are integer inner products (exact while they stay below
    2**63), ties go to smaller vec_id, a row with the query's vec_id is its own. Vectors that are null, hold
    a null or a non-finite component, or lack an id take no part; rows that repeat a vec_id and its vector
    count once; shorter vectors count as padded with 0; no vectors give no rows.

    Each vector belongs to the nearest of a bounded number of centres; parts of more than BLOCK vectors are cut into blocks by
    id hash, so that a hot vector or id range loads no task more than others. A query searches one block of the part whose
    centre scores best, which gives it a kth score, and then the blocks of those parts alone whose centre and radius can
    reach that score. A task holds the tree of one block. Copies of a vector inside a block are one point with its k + 1 smallest ids.
    """
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(F.col("vec_id").cast("long").alias("id"), ints.alias("v"))
    good = stored(good)
    n = good.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    some = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().combine_chunks()["v"]
    mid = centres(_matrix(some.chunk(0) if isinstance(some, pa.ChunkedArray) else some), min(MOST_PARTS, max(8, n // BLOCK)))
    placed = stored(_placed(good, mid))
    count, radius = np.zeros(len(mid), int), np.zeros(len(mid))
    for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect():
        count[r["part"]], radius[r["part"]] = r["n"], r["r"]
    blocks = -(-count // BLOCK)
    parts = Parts(mid, radius, np.cumsum(blocks) - blocks, blocks)
    # element_at asks for divisors other than 0, also of parts without vectors, which no row has.
    safe = Parts(mid, radius, parts.first, np.maximum(blocks, 1))
    data = placed.select(safe.block(F.col("part"), F.col("id")).alias("block"), "id", "v")
    asked = _first_blocks(good.where(F.col("id") % every == 0).distinct(), parts)
    asked = stored(asked.select(safe.block(F.col("part"), F.col("id")).alias("block"), "id", "v"))
    near = stored(_searched(data, asked.withColumn("worst", F.lit(float("-inf"))), k).distinct())
    worst = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("worst"))
    rest = asked.join(worst, "id", "left").select("id", "v", "block", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
    found = near.unionByName(_searched(data, _other_blocks(rest, parts), k)).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
