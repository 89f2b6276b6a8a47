"""Biosynthetic networks as tables: vertices (node, virtual, abundance) and edges (src, dst, diffs)."""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sugarbeam.sources.store import checkpointed


def prune_directed(edges: DataFrame) -> DataFrame:
    """Edges from a shorter or equal string to a longer one."""
    return edges.where(F.length("src") <= F.length("dst"))


def drop_disregarded(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("diffs") != "disregard")


def alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, origin): nodes of two networks, `both`, `a` or `b`."""
    x, y = a.select("node").distinct().withColumn("_a", F.lit(1)), b.select("node").distinct().withColumn("_b", F.lit(1))
    origin = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "a").otherwise("b")
    return x.join(y, "node", "full_outer").select("node", origin.alias("origin"))


def inferred_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Virtual nodes of a that are observed in b."""
    return a.where("virtual = 1").select("node").join(b.where("virtual = 0").select("node"), "node", "left_semi")


def diamonds(edges: DataFrame) -> DataFrame:
    """(a, b, c, d) with edges a-b, a-c, b-d, c-d, b < c, and none between a and d or b and c."""
    e = edges.select("src", "dst").distinct()
    fork = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a").where("b < c")
    d = fork.join(e.select(F.col("src").alias("b"), F.col("dst").alias("d")), "b").join(e.select(F.col("src").alias("c"), F.col("dst").alias("d")), ["c", "d"]).where("a <> d")
    both = e.union(e.select("dst", "src")).distinct()
    d = d.join(both.select(F.col("src").alias("a"), F.col("dst").alias("d")), ["a", "d"], "left_anti")
    return d.join(both.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"], "left_anti").select("a", "b", "c", "d")


def edge_capacity(edges: DataFrame, vertices: DataFrame, root: str, root_default: float = 10.0, default: float = 0.1) -> DataFrame:
    """Add capacity: the mean abundance of both ends; nodes without one count as `default`, the root as `root_default`."""
    v = vertices.select("node", F.when(F.col("node") == root, F.lit(root_default)).otherwise(F.coalesce("abundance", F.lit(default))).alias("x"))
    out = edges.join(v.select(F.col("node").alias("src"), F.col("x").alias("_s")), "src", "left").join(v.select(F.col("node").alias("dst"), F.col("x").alias("_d")), "dst", "left")
    return out.withColumn("capacity", (F.coalesce("_s", F.lit(default)) + F.coalesce("_d", F.lit(default))) / 2).drop("_s", "_d")


def neighbor_estimates(vertices: DataFrame, edges: DataFrame, least: float = 0.001) -> DataFrame:
    """Nodes of abundance 0 take the mean of their neighbours' positive abundances, at least `least`."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    near = both.join(vertices.select(F.col("node").alias("dst"), F.col("abundance").alias("_x")), "dst").where("_x > 0").groupBy(F.col("src").alias("node")).agg(F.avg("_x").alias("_m"))
    x = F.when(F.col("abundance") > 0, F.col("abundance")).otherwise(F.greatest(F.coalesce("_m", F.lit(0.0)), F.lit(least)))
    return vertices.join(near, "node", "left").select("node", x.alias("abundance"))


#: Rounds after which an iteration counts as one that does not end.
MOST_ROUNDS = 500


def levels(edges: DataFrame, root: str, most: int = MOST_ROUNDS) -> DataFrame:
    """(node, level): steps of the shortest path from the root, a frontier at a time; each frontier is a join and an
    anti join, and checkpoints in the shared folder keep the plan short. More than `most` levels are an error."""
    spark = edges.sparkSession
    e = checkpointed(edges.select("src", "dst").distinct())
    seen = frontier = spark.createDataFrame([(root, 0)], "node string, level int")
    for k in range(1, most + 1):
        nxt = frontier.join(e, frontier.node == e.src).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = checkpointed(nxt.withColumn("level", F.lit(k)))
        if not frontier.limit(1).count():
            return seen
        seen = checkpointed(seen.union(frontier))
    raise RuntimeError(f"more than {most} levels")


def longest_levels(edges: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """(node, level): steps of the longest path from a node without a way in, which are level 0. A frontier holds what so many steps reach, so the
    last frontier that holds a node is its level; a cycle has no last one and is an error after `most` rounds."""
    e = checkpointed(edges.select("src", "dst").distinct())
    frontier = checkpointed(e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti"))
    parts = [frontier.withColumn("level", F.lit(0))]
    for k in range(1, most + 1):
        frontier = checkpointed(frontier.join(e, frontier.node == e.src).select(F.col("dst").alias("node")).distinct())
        if not frontier.limit(1).count():
            return reduce(DataFrame.union, parts).groupBy("node").agg(F.max("level").alias("level"))
        parts.append(frontier.withColumn("level", F.lit(k)))
    raise RuntimeError(f"more than {most} levels, or a cycle")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the first node, by order, that each node of `edges` (src, dst) is connected with. Labels move along edges and on to their
    label's label; each round is a checkpoint."""
    both = checkpointed(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = checkpointed(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("n"))
        step = labels.join(near, "node").select("node", F.least("label", "n").alias("label"), F.col("label").alias("old"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = checkpointed(step.join(up, "label").select("node", F.col("next").alias("label"), "old"))
        labels = step.select("node", "label")
        if not step.where("label <> old").limit(1).count():
            return labels
    raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")


def reaction_flow(flows: DataFrame, how: str = "sum") -> DataFrame:
    """(diffs, flow): flows (diffs, flow) by reaction, summed or averaged."""
    return flows.groupBy("diffs").agg((F.sum if how == "sum" else F.avg)("flow").alias("flow"))


def reaction_enzymes(edges: DataFrame, enzymes: DataFrame) -> DataFrame:
    """Add enzymes: names of the enzymes of the edge's linkage (monolink, glycoenzyme), sorted and joined by `_`; the label where there are none."""
    names = enzymes.groupBy(F.col("monolink").alias("diffs")).agg(F.array_join(F.array_sort(F.collect_set("glycoenzyme")), "_").alias("enzymes"))
    return edges.join(names, "diffs", "left").withColumn("enzymes", F.coalesce("enzymes", "diffs"))


def max_flow(edges: list[tuple[str, str, float]], source: str, sink: str) -> tuple[float, dict[tuple[str, str], float]]:
    """Greatest flow by shortest augmenting paths, and the flow on each edge."""
    left: dict[str, dict[str, float]] = {}
    for u, v, c in edges:
        left.setdefault(u, {})[v] = left.setdefault(u, {}).get(v, 0.0) + c
        left.setdefault(v, {}).setdefault(u, 0.0)
    total = 0.0
    while source in left:
        back, queue = {source: source}, deque([source])
        while queue and sink not in back:
            u = queue.popleft()
            for v, c in sorted(left[u].items()):
                if c > 1e-12 and v not in back:
                    back[v] = u
                    queue.append(v)
        if sink not in back:
            break
        path, v = [], sink
        while v != source:
            path.append((back[v], v))
            v = back[v]
        c = min(left[u][v] for u, v in path)
        for u, v in path:
            left[u][v] -= c
            left[v][u] += c
        total += c
    return total, {(u, v): max(0.0, c - left[u][v]) for u, v, c in edges}


def maximum_flows(edges: DataFrame, source: str, sinks: list[str]) -> DataFrame:
    """(network, sink, flow): greatest flow from the source to each sink in each network of edges (network, src, dst, capacity), by rounds over the
    edges of all networks."""
    from sugarbeam.operators import graphs

    return graphs.maximum_flow(edges, source, edges.select("network").distinct().withColumn("sink", F.explode(F.lit(sinks))))[0]


def jaccard_distances(members: DataFrame) -> DataFrame:
    """(a, b, distance): one minus the shared over all items of each pair of networks a < b of members (network, item)."""
    m = members.distinct()
    size = m.groupBy("network").agg(F.count("*").alias("n"))
    shared = m.select(F.col("network").alias("a"), "item").join(m.select(F.col("network").alias("b"), "item"), "item").where("a < b").groupBy("a", "b").agg(F.count("*").alias("s"))
    pairs = size.select(F.col("network").alias("a"), F.col("n").alias("na")).join(size.select(F.col("network").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    out = pairs.join(shared, ["a", "b"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    return out.select("a", "b", (1 - F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))).alias("distance"))


def embedding_distances(vectors: DataFrame) -> DataFrame:
    """(a, b, distance): cosine distance of the median vectors of each pair of labels a < b of (label, vec)."""
    m = vectors.select("label", F.posexplode("vec").alias("k", "x")).groupBy("label", "k").agg(F.median("x").alias("x"))
    a, b = m.select(F.col("label").alias("a"), "k", F.col("x").alias("u")), m.select(F.col("label").alias("b"), "k", F.col("x").alias("v"))
    d = a.join(b, "k").where("a < b").groupBy("a", "b").agg((1 - F.sum(F.col("u") * F.col("v")) / F.sqrt(F.sum(F.col("u") * F.col("u")) * F.sum(F.col("v") * F.col("v")))).alias("distance"))
    return d


def conservation(members: DataFrame, item: str) -> DataFrame:
    """(rank, share): the share of networks of each rank that have the item, for ranks of more than one network; members (rank, network, item)."""
    per = members.groupBy("rank", "network").agg(F.max((F.col("item") == item).cast("int")).alias("has"))
    return per.groupBy("rank").agg(F.avg("has").alias("share"), F.count("*").alias("n")).where("n > 1").select("rank", "share")


def hierarchy_filter(df: DataFrame, rank: str, item: str, min_seq: int) -> DataFrame:
    """(item, rank, code): distinct rows of classes of at least min_seq items, classes numbered from 0 by name."""
    d = df.select(item, rank).distinct().where(F.col(rank).isNotNull())
    d = d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(rank))).where(F.col("_n") >= min_seq).drop("_n")
    return d.join(numbered_names(d, rank).withColumnRenamed("id", "code"), rank)


def numbered_names(df: DataFrame, column: str) -> DataFrame:
    """(column, id): distinct values numbered from 0 in order. Values are numbered inside ranges that their first two characters make (numbers:
    as they are written to 12 digits) and the ranges' sizes are added up, so that no task sees all values."""
    number = dict(df.dtypes)[column] not in ("string", "binary")
    first = F.lpad((F.floor(F.col(column) / 1000) + 10**9).cast("string"), 12, "0") if number else F.substring(column, 1, 2)
    t = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_first", first)
    n = t.groupBy("_first").agg(F.count("*").alias("n"))
    starts = n.select("_first", F.coalesce(F.sum("n").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_first").orderBy(column)) - 1
    return t.join(starts, "_first").select(column, (F.col("_start") + rank).cast("int").alias("id"))


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2) -> DataFrame:
    """Add test: in each class the share `test` of rows with the smallest key hash."""
    w = Window.partitionBy(label)
    n, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(F.crc32(F.col(key).cast("string")), key))
    return df.withColumn("test", r <= F.floor(n * test + 0.5))


def multilabel(df: DataFrame, item: str, label: str) -> DataFrame:
    """(item, labels): for each item, 1 or 0 for each class in order of name."""
    classes = df.select(F.col(label).alias("_c")).distinct().agg(F.array_sort(F.collect_list("_c")).alias("classes"))
    own = df.groupBy(item).agg(F.collect_set(label).alias("own"))
    return own.crossJoin(F.broadcast(classes)).select(item, F.transform("classes", lambda c: F.array_contains("own", c).cast("int")).alias("labels"))
