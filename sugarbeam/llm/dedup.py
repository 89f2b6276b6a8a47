"""Near-duplicate detection by min-max hashing.

Each permutation of the shingle hashes yields two signature values, the minimum and the maximum, so
48 hash evaluations give 96 values. Runs of `rows` values are banded. Documents that share a band
form families (connected sets of the banding graph); a family is cut into chunks of bounded size,
and full shingle sets are compared inside chunks. Links of exact Jaccard similarity at or above the
threshold make the components that are reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarbeam.llm import kernels as K
from sugarbeam.llm.util import guarded, in_batches, stored, trimmed


@dataclass(frozen=True)
class MinMax:
    """Parameters. `percent`: least similarity in hundredths. `chunk`: documents of a family in a group, of which about
    `pivots` are in each group of the family; `block`: documents of each side where groups meet. Groups of long
    documents have fewer: about `shingles` shingles in all, or one longer document.
    `slack`: a pair is compared on full sets if the share of equal signature values is within `slack` of the
    threshold (over five standard errors) or if it shares a band."""

    words: int = 4
    percent: int = 80
    permutations: int = 48
    rows: int = 4
    seed: int = 5
    chunk: int = 32
    pivots: int = 8
    block: int = 128
    shingles: int = 1 << 20
    slack: float = 0.2


def signatures(hashes: np.ndarray, first: np.ndarray, p: MinMax) -> np.ndarray:
    """Minimum and maximum under each permutation; one row for each text (zeros for an empty set)."""
    out = np.zeros((len(first) - 1, 2 * p.permutations), np.uint64)
    for k, c in enumerate(K.constants(p.permutations, p.seed)):
        x = hashes * c
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, 2 * k] = K.reduce_rows(np.minimum, x, first, 0)
        out[:, 2 * k + 1] = K.reduce_rows(np.maximum, x, first, 0)
    return out


def band_keys(sig: np.ndarray, p: MinMax) -> np.ndarray:
    """One 64-bit key for each band of `rows` signature values; a key tells its band, too."""
    n = sig.shape[1] // p.rows
    out = np.zeros((len(sig), n), np.uint64)
    for b in range(n):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(p.rows):
            h = K.mix(h * np.uint64(0x9FB21C651E98DF25) + sig[:, b * p.rows + r])
        out[:, b] = h
    return out


def profile(docs: DataFrame, p: MinMax) -> DataFrame:
    """(doc_id, t, n, f1, f2, bands) of each row: text hash, set size, 128-bit fingerprint of the set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            data, off = K.text_buffers(batch.column("text"))
            for i, j in K.blocks(off):
                h, first = K.shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], p.words)
                keys = band_keys(signatures(h, first, p), p)
                n = np.diff(first)
                f = [K.reduce_rows(np.add, K.mix(h ^ np.uint64(s)), first, 0).view(np.int64) for s in (0x1234567, 0x7654321)]
                width = np.where(n > 0, keys.shape[1], 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()), pa.array(keys[n > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("t").slice(i, j - i), pa.array(n), *map(pa.array, f), lists], ["doc_id", "t", "n", "f1", "f2", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").transform(in_batches).mapInArrow(trimmed(run), "doc_id bigint, t bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _parts(documents: Column, shingles: Column, size: int, p: MinMax) -> Column:
    """Parts that so many documents of so many shingles are cut into, `size` documents each or fewer long ones."""
    return F.ceil(F.greatest(documents / size, shingles / p.shingles))


def _tasks(rows: int) -> int:
    """Tasks for a table of so many narrow rows."""
    return max(6, -(-rows // 200_000))


def components(edges: DataFrame, rows: int) -> DataFrame:
    """(node, label): the smallest node that each node of `edges` (a, b), about `rows` of them, can reach.

    Labels spread along edges and jump to their label's label, so the rounds grow with the logarithm of
    the longest path; only labels that changed in the last round are sent on. Each round is written to the
    shared folder; no edge reaches the driver.
    """
    n = _tasks(rows)
    both = stored(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")), n)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("m", "node").alias("label"), F.col("node").alias("old")), n)
    while labels.where("label <> old").limit(1).count():
        moved = labels.where("label <> old").select(F.col("node").alias("b"), "label")
        seen = both.join(moved, "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old")).union(labels.select("node", "label", F.col("label").alias("old")))
        near = stored(seen.groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old")), n)
        up = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stored(near.join(up, "label").select("node", F.col("next").alias("label"), "old"), n)
    return labels.select("node", "label")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def chunk_links(sets: list[np.ndarray], comp: list, left: int, p: MinMax) -> list[tuple[int, int]]:
    """(i, j) pairs that connect what the links of one chunk connect, as stars around one document each.

    Documents of one `comp` count as linked. If left >= 0, only pairs of one document below `left` and one
    from it on are compared. Pairs are tried in order of falling signature agreement.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(sizes)])
    sig = signatures(np.concatenate(sets), first, p)
    keys = band_keys(sig, p)
    names: dict = {}
    up = [names.setdefault(c, i) if c is not None else i for i, c in enumerate(comp)]

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    rows = range(n) if left < 0 else range(left)
    found: list[tuple[float, int, int]] = []
    for i in rows:
        at = np.arange(i + 1, n) if left < 0 else np.arange(left, n)
        if not len(at):
            continue
        agree = (sig[at] == sig[i]).mean(axis=1)
        ok = (100 * np.minimum(sizes[at], sizes[i]) >= p.percent * np.maximum(sizes[at], sizes[i])) & ((agree >= p.percent / 100 - p.slack) | (keys[at] == keys[i]).any(axis=1))
        found += [(-a, i, j) for a, j in zip(agree[ok].tolist(), at[ok].tolist(), strict=True)]
    found.sort()
    out: list[int] = []
    for _, i, j in found:
        a, b = top(i), top(j)
        if a == b:
            continue
        both = _shared(sets[i], sets[j]) if sizes[i] < sizes[j] else _shared(sets[j], sets[i])
        if 100 * both >= p.percent * (sizes[i] + sizes[j] - both):
            up[max(a, b)] = min(a, b)
            out += [i, j]
    return sorted({(i, top(i)) for i in out if i != top(i)})


def _links(rows: DataFrame, p: MinMax) -> DataFrame:
    """Links (a, b) inside the groups of rows (group, side, node, comp, text). Groups are streamed one after
    the other from sorted partitions; side 0 of a group holds its probes, if it has any (else side is 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        now, held = None, []

        def close() -> list[tuple[int, int]]:
            probes = sum(1 for x in held if x[0] == 0)
            if len(held) < 2 or (probes and probes == len(held)):
                return []
            return [(held[i][1], held[j][1]) for i, j in chunk_links([x[3] for x in held], [x[2] for x in held], probes or -1, p)]

        for batch in batches:
            out: list[tuple[int, int]] = []
            data, off = K.text_buffers(batch.column("text"))
            cols = [batch.column(c).to_pylist() for c in ("group", "side", "node", "comp")]
            for i, j in K.blocks(off):
                h, first = K.shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], p.words)
                for r in range(i, j):
                    g, side, node, comp = (c[r] for c in cols)
                    if g != now:
                        out += close()
                        now, held = g, []
                    held.append((side, node, comp, h[first[r - i] : first[r - i + 1]].copy()))
            if out:
                yield _edges(out)
        out = close()
        if out:
            yield _edges(out)

    return rows.repartition("group").sortWithinPartitions("group", "side", "node").transform(in_batches).mapInArrow(trimmed(run), "a bigint, b bigint")


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["a", "b"])


def near_duplicates(docs: DataFrame, p: MinMax = MinMax()) -> DataFrame:
    """(doc_id, t, n_shingles, component_id) of each row of docs (doc_id, text, ...); t is the text's hash.

    A document's set holds its distinct shingles of `words` words (lower-cased A-Z; the whole sequence if
    it has fewer words). Rows are linked if 100 * |A & B| >= percent * |A | B|; component_id is the smallest
    doc_id that links reach. Null, empty or blank texts have an empty set and stay alone. Rows of equal sets
    are one node, so copies cost no comparisons. A null doc_id sorts below any other. Repeated rows repeat
    in the result. Bands miss a link with a chance of about 3e-6 at the threshold and less above it; links
    that are found are confirmed on full sets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = stored(profile(docs, p))
    total = base.count()
    some = _tasks(4 * total)
    # Numbers of nodes are fixed by the written table.
    nodes = base.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "t", "n", "bands")).alias("m"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "m.doc_id", "m.t", "m.n", "m.bands"), some)
    banded = nodes.select("node", F.explode("bands").alias("key"))
    heads = stored(banded.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("c")).where("c > 1").select("key", "head"), some)
    # A node and the heads of its bands, at most one for each band, hang on the smallest of them.
    tied = banded.join(heads, "key").where("node <> head").groupBy("node").agg(F.collect_set("head").alias("heads"))
    tied = tied.select(F.array_min("heads").alias("b"), F.explode(F.concat("heads", F.array("node"))).alias("a"))
    stars = stored(tied.where("a <> b").distinct().select("a", "b"), some)
    rows = stars.count()
    few = _tasks(rows)
    family = components(stars, rows)  # (node, label)
    member = stored(family.join(nodes.select("node", "doc_id", "t", "n"), "node"), few)
    counts = stored(member.groupBy("label").agg(_parts(F.count("*"), F.sum("n"), p.chunk, p).alias("c")), few)
    member = stored(member.join(counts, "label").withColumn("h", F.pmod(F.xxhash64("doc_id", "t"), F.lit(1 << 30))), few)
    small, large = member.where("c = 1"), member.where("c > 1")
    text = stored(_texts(docs, member))
    what = ["node"]
    # A family of several chunks: each chunk also gets the same few members, through which its parts find each other.
    # The share of the hash range below makes them about `pivots` for any family, fewer if its documents are long.
    pivot = large.where(F.col("h") * F.col("c") < F.lit((p.pivots << 30) // p.chunk))
    groups = small.select(*what, F.xxhash64("label", F.lit(-1)).alias("group")).union(large.select(*what, F.xxhash64("label", F.pmod("h", "c")).alias("group")))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    groups = groups.union(pivot.where(F.pmod("h", "c") >= 0).select(*what, "label", each("c").alias("k"), F.pmod("h", "c").alias("own")).where("k <> own").select(*what, F.xxhash64("label", "k").alias("group")))
    groups = stored(groups.select(*what, "group", F.lit(1).alias("side"), F.lit(None).cast("long").alias("comp")), few)
    links = stored(_links(text.join(groups.hint("merge"), "node"), p))
    comp = components(links, rows)
    if large.limit(1).count():
        more = stored(_stragglers(text, comp, large, few, p))
        if more.limit(1).count():
            comp = components(comp.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more), rows)
    least = stored(comp.join(nodes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("component_id")), few)
    known = nodes.select("f1", "f2", "node", "doc_id").join(comp.join(least, "label").select("node", "component_id"), "node", "left")
    known = stored(known.select("f1", "f2", F.coalesce("component_id", "doc_id").alias("component_id")), some)
    out = base.where("n > 0").select("doc_id", "t", F.col("n").alias("n_shingles"), "f1", "f2").join(known, ["f1", "f2"]).select("doc_id", "t", "n_shingles", "component_id")
    alone = base.where("n = 0").select("doc_id", "t", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def _texts(docs: DataFrame, member: DataFrame) -> DataFrame:
    """(node, text) of each member of a family. A row that repeats another gives the same node twice, which does no
    harm. The join is a sort-merge join at every size, so that a small table runs the plan of a large one."""
    text = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    same = text.doc_id.eqNullSafe(member.doc_id) & (text.t == member.t)
    return text.join(member.hint("merge"), same).select("node", "text")


def _stragglers(text: DataFrame, comp: DataFrame, large: DataFrame, few: int, p: MinMax) -> DataFrame:
    """Links across the chunks of large families. All members outside a family's largest component are
    compared with every chunk of the family, in blocks; members inside it are linked to each other already."""
    at = stored(large.join(comp.select("node", F.col("label").alias("root")), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), few)
    sizes = at.groupBy("label", "comp").agg(F.count("*").alias("s"), F.sum("n").alias("z"))
    top = F.max_by(F.struct("comp", "s", "z"), F.struct("s", "comp")).alias("top")
    most = stored(sizes.groupBy("label").agg(top, F.sum("s").alias("s"), F.sum("z").alias("z")), few)
    rest = _parts(F.col("s") - F.col("top.s"), F.col("z") - F.col("top.z"), p.block, p)
    most = most.select("label", "top.comp", rest.alias("sc"), _parts(F.col("s"), F.col("z"), p.block, p).alias("c")).where("sc > 0")
    both = stored(at.drop("c").join(most.withColumnRenamed("comp", "top"), "label"), few)
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    key = F.xxhash64("label", "i", "j").alias("group")
    what = ["node"]
    probe = both.where("comp <> top").select(*what, "label", "comp", F.pmod(F.xxhash64("node", F.lit(3)), "sc").alias("i"), each("c").alias("j")).select(*what, key, F.lit(0).alias("side"), "comp")
    whole = both.select(*what, "label", "comp", F.pmod("h", "c").alias("j"), each("sc").alias("i")).select(*what, key, F.lit(1).alias("side"), "comp")
    return _links(text.join(stored(probe.union(whole), few).hint("merge"), "node"), p)


def one_of_each(docs: DataFrame, p: MinMax = MinMax()) -> DataFrame:
    """docs without the rows of groups whose smallest doc_id another row has; of rows that repeat that doc_id and
    its text one stays. All columns are kept as they are."""
    docs, named = guarded(docs)
    found = near_duplicates(docs, p)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "t").agg(F.count("*").alias("times"))
    kept = stored(kept.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "times"))
    mine = docs.withColumn("_k", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_t"))
    out = mine.join(kept.where("times = 1").hint("merge"), same, "left_semi")
    if kept.where("times > 1").limit(1).count():
        out = out.unionByName(mine.join(kept.where("times > 1"), same, "left_semi").dropDuplicates(["doc_id", "_k"]))
    return named(out)
