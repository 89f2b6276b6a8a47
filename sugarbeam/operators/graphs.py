"""Graph algorithms as rounds of joins and aggregations over edge tables: communities, maximum flow, spanning forests.

Many networks are worked on in the same rounds, keyed by their name; a network of any size is spread over tasks by its nodes. Each round is a
table in the shared folder, so a lost executor costs a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sugarbeam.operators.networks import MOST_ROUNDS, connected
from sugarbeam.sources.store import written

def _kept(df: DataFrame) -> DataFrame:
    """df written in as many parts as its size asks for: those of unions and joins of small tables would add up from round to round."""
    return written(df.hint("rebalance"))


#: Half rounds of moves between two contractions.
MOVES = 12


def _weights(edges: DataFrame) -> DataFrame:
    """(network, a, b, w): each edge in both directions, repeats summed."""
    both = edges.select("network", F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("network", "dst", "src"))
    return both.groupBy("network", "a", "b").agg(F.count("*").cast("double").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(network, q): modularity of the communities (network, node, community) of undirected edges (network, src, dst)."""
    c = labels.select("network", F.col("node").alias("a"), F.col("community").alias("c"))
    return _quality(_weights(edges), c)


def _quality(w: DataFrame, c: DataFrame) -> DataFrame:
    d = w.join(c, ["network", "a"]).join(c.select("network", F.col("a").alias("b"), F.col("c").alias("c2")), ["network", "b"])
    per = d.groupBy("network", "c").agg(F.sum("w").alias("mass"), F.sum(F.when(F.col("c") == F.col("c2"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = F.sum("mass")
    return per.groupBy("network").agg((F.sum("inside") / total - F.sum(F.col("mass") * F.col("mass")) / (total * total)).alias("q"))


def _moved(w: DataFrame, at: DataFrame, turn: int) -> DataFrame:
    """Half a round of moves of at (network, a, c, k, m): half of the nodes, by a hash of the round, go to the neighbouring community that gains most;
    the next turn is the other half's. Two nodes that are alone do not change places: only the later one moves."""
    mass = at.groupBy("network", "c").agg(F.sum("k").alias("mass"), F.count("*").alias("members"))
    near = w.where("a <> b").join(at.select("network", F.col("a").alias("b"), "c"), ["network", "b"]).groupBy("network", "a", "c").agg(F.sum("w").alias("l"))
    own = at.select("network", "a", F.col("c").alias("own"), "k", "m")
    options = near.unionByName(at.select("network", "a", "c", F.lit(0.0).alias("l"))).groupBy("network", "a", "c").agg(F.max("l").alias("l"))
    d = options.join(own, ["network", "a"]).join(mass, ["network", "c"])
    mine = F.col("c") == F.col("own")
    gain = F.col("l") - F.col("k") * (F.col("mass") - F.when(mine, F.col("k")).otherwise(0.0)) / F.col("m")
    d = d.select("network", "a", "c", "own", "k", "m", "members", gain.alias("g"), mine.alias("mine"))
    best = d.groupBy("network", "a", "own", "k", "m").agg(F.min_by(F.struct("c", "g", "members"), F.struct(-F.col("g"), "c")).alias("best"), F.max(F.when(F.col("mine"), F.struct("g", "members"))).alias("now"))
    alone = (F.col("best.members") == 1) & (F.col("now.members") == 1) & (F.col("best.c") > F.col("own"))
    turns = F.pmod(F.xxhash64("network", "a", F.lit(turn // 2)), F.lit(2)) == turn % 2
    go = (F.col("best.g") > F.col("now.g") + 1e-9) & turns & ~alone
    return best.select("network", "a", F.when(go, F.col("best.c")).otherwise(F.col("own")).alias("c"), "k", "m", go.alias("moved"))


def communities(edges: DataFrame, most_levels: int = 10) -> DataFrame:
    """(network, node, community): communities of high modularity of each network of undirected edges (network, src, dst); a community has the name
    of its first node.

    Nodes move to the neighbouring community that raises modularity most, in rounds over the edge table, and communities become the nodes of
    the next level, until a level gains nothing. Moves of one round do not know of each other, so a level counts for a network only if
    its modularity has grown. Null ends are no nodes; an empty table gives no rows.
    """
    w = _kept(_weights(edges.where("src IS NOT NULL AND dst IS NOT NULL")))
    labels = w.select("network", F.col("a").alias("node"), F.col("a").alias("c")).distinct()
    quality = _kept(_quality(w, w.select("network", "a", F.col("a").alias("c")).distinct()))
    for level in range(most_levels):
        k = w.groupBy("network", "a").agg(F.sum("w").alias("k"))
        at = _kept(k.join(k.groupBy("network").agg(F.sum("k").alias("m")), "network").select("network", "a", F.col("a").alias("c"), "k", "m"))
        for turn in range(level * MOVES, (level + 1) * MOVES, 2):
            first = _kept(_moved(w, at, turn))
            second = _kept(_moved(w, first.drop("moved"), turn + 1))
            at = second.drop("moved")
            if not first.where("moved").union(second.where("moved")).limit(1).count():
                break
        found = _kept(_quality(w, at.select("network", "a", "c")))
        better = _kept(found.join(quality.withColumnRenamed("q", "before"), "network").where("q > before + 1e-9").select("network", "q"))
        if not better.limit(1).count():
            break
        at = _kept(at.join(better.select("network", F.lit(True).alias("up")), "network", "left").select("network", "a", F.when(F.col("up"), F.col("c")).otherwise(F.col("a")).alias("c")))
        quality = _kept(quality.join(better.withColumnRenamed("q", "now"), "network", "left").select("network", F.coalesce("now", "q").alias("q")))
        labels = _kept(labels.join(at.select("network", F.col("a").alias("c"), F.col("c").alias("c2")), ["network", "c"]).select("network", "node", F.col("c2").alias("c")))
        w = w.join(at, ["network", "a"]).withColumnRenamed("c", "ca").join(at.select("network", F.col("a").alias("b"), F.col("c").alias("cb")), ["network", "b"])
        w = _kept(w.groupBy("network", F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    first = labels.groupBy("network", "c").agg(F.min("node").alias("community"))
    return labels.join(first, ["network", "c"]).select("network", "node", "community")


_KEY = ["network", "sink"]
#: Rounds of pushes after which all heights are measured anew.
PUSHES = 12
#: Rounds after which it is seen whether excess is left; a round without any changes nothing.
LOOK = 4


def _heights(left: DataFrame, nodes: DataFrame, source: str) -> DataFrame:
    """nodes (network, sink, node, e, n) with h: the steps to the sink over residual edges, or n and the steps back to the source. Both ways are
    measured in the same rounds, a frontier at a time."""
    open_ = left.where("r > 0").select(*_KEY, "u", "v")
    ways = _kept(open_.where(F.col("u") != source).withColumn("way", F.lit(0)).union(open_.where(F.col("u") != F.col("sink")).withColumn("way", F.lit(1))))
    pairs = nodes.select(*_KEY).distinct()
    ends = pairs.select(*_KEY, F.col("sink").alias("node"), F.lit(0).alias("way")).union(pairs.select(*_KEY, F.lit(source), F.lit(1)))
    seen = frontier = _kept(ends.withColumn("far", F.lit(0).cast("long")))
    for k in range(1, MOST_ROUNDS + 1):
        back = ways.join(frontier.select(*_KEY, "way", F.col("node").alias("v")), [*_KEY, "way", "v"]).select(*_KEY, F.col("u").alias("node"), "way").distinct()
        frontier = _kept(back.join(seen.select(*_KEY, "node", "way"), [*_KEY, "node", "way"], "left_anti").withColumn("far", F.lit(k).cast("long")))
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    far = seen.groupBy(*_KEY, "node").agg(*(F.max(F.when(F.col("way") == w, F.col("far"))).alias(f"far{w}") for w in (0, 1)))
    h = F.when(F.col("node") == source, F.col("n")).otherwise(F.coalesce("far0", F.col("n") + F.col("far1"), 2 * F.col("n")))
    return nodes.join(far, [*_KEY, "node"], "left").select(*_KEY, "node", "e", "n", h.alias("h"))


def maximum_flow(edges: DataFrame, source: str, pairs: DataFrame, most: int = 20 * MOST_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((network, sink, flow), (network, sink, src, dst, flow)): the greatest flow from the source to the sink of each of pairs (network, sink) over
    edges (network, src, dst, capacity), and how much of it each edge carries.

    Push and relabel in rounds over a table of residual edges and one of heights: each node with excess pushes what it has along residual edges
    to nodes one step lower, in order of their names, and what cannot push is lifted. Every PUSHES rounds heights become the true steps to
    the sink, or for nodes that are cut off from it the steps back to the source, where their excess goes. Excess below 1e-12 of the greatest
    capacity counts as none. Edges that repeat add up, edges to themselves, null ends and capacities of 0 or less carry nothing.
    """
    e = edges.where((F.col("src") != F.col("dst")) & (F.col("capacity") > 0)).groupBy("network", F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.sum("capacity").cast("double").alias("c"))
    pairs = pairs.select(*_KEY).distinct().where(F.col("sink") != source)
    e = _kept(e.join(pairs, "network").where(F.col("v") != source))
    least = (e.agg(F.max("c")).first()[0] or 0.0) * 1e-12
    full = e.select(*_KEY, "u", "v", F.when(F.col("u") == source, 0.0).otherwise(F.col("c")).alias("r"))
    back = e.select(*_KEY, F.col("v").alias("u"), F.col("u").alias("v"), F.when(F.col("u") == source, F.col("c")).otherwise(0.0).alias("r"))
    left = _kept(full.union(back).groupBy(*_KEY, "u", "v").agg(F.sum("r").alias("r")))
    pushed = e.where(F.col("u") == source).select(*_KEY, F.col("v").alias("node"), F.col("c").alias("e"))
    nodes = pushed.union(left.select(*_KEY, F.col("u").alias("node"), F.lit(0.0))).union(pairs.select(*_KEY, F.col("sink"), F.lit(0.0))).union(pairs.select(*_KEY, F.lit(source), F.lit(0.0))).groupBy(*_KEY, "node").agg(F.sum("e").alias("e"))
    nodes = _kept(nodes.join(nodes.groupBy(*_KEY).agg(F.count("*").alias("n")), _KEY).select(*_KEY, "node", "e", "n"))
    inner = (F.col("node") != source) & (F.col("node") != F.col("sink"))
    for turn in range(most):
        active = nodes.where(inner & (F.col("e") > least))
        if turn % LOOK == 0 and not active.limit(1).count():
            break
        if turn % PUSHES == 0:
            nodes = _kept(_heights(left, nodes, source))
            active = nodes.where(inner & (F.col("e") > least))
        left, nodes = _pushed(left, nodes, active, inner, least)
    else:
        raise RuntimeError(f"no end after {most} rounds")
    value = nodes.where(F.col("node") == F.col("sink")).select(*_KEY, F.col("e").alias("flow"))
    rest = e.join(left, [*_KEY, "u", "v"], "left")
    return value, rest.select(*_KEY, F.col("u").alias("src"), F.col("v").alias("dst"), F.greatest(F.col("c") - F.coalesce("r", F.lit(0.0)), F.lit(0.0)).alias("flow"))


def _pushed(left: DataFrame, nodes: DataFrame, active: DataFrame, inner: Column, least: float) -> tuple[DataFrame, DataFrame]:
    """Residual edges and nodes after one round."""
    h = nodes.select(*_KEY, F.col("node").alias("v"), F.col("h").alias("hv"))
    way = left.where("r > 0").join(active.select(*_KEY, F.col("node").alias("u"), "e", F.col("h").alias("hu")), [*_KEY, "u"]).join(h, [*_KEY, "v"]).where("hu = hv + 1")
    before = F.coalesce(F.sum("r").over(Window.partitionBy(*_KEY, "u").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    push = _kept(way.withColumn("x", F.least(F.col("r"), F.col("e") - before)).where("x > 0").select(*_KEY, "u", "v", "x"))
    left = left.union(push.select(*_KEY, "u", "v", -F.col("x"))).union(push.select(*_KEY, F.col("v"), F.col("u"), "x")).groupBy(*_KEY, "u", "v").agg(F.sum("r").alias("r"))
    left = _kept(left.withColumn("r", F.when(F.col("r") > least, F.col("r")).otherwise(0.0)))
    moved = push.select(*_KEY, F.col("u").alias("node"), (-F.col("x")).alias("x")).union(push.select(*_KEY, "v", "x")).groupBy(*_KEY, "node").agg(F.sum("x").alias("x"))
    nodes = nodes.join(moved, [*_KEY, "node"], "left").withColumn("e", F.col("e") + F.coalesce("x", F.lit(0.0))).drop("x")
    # A node that still has excess and nowhere lower to send it is lifted over its lowest residual neighbour.
    low = left.where("r > 0").join(h, [*_KEY, "v"]).groupBy(*_KEY, F.col("u").alias("node")).agg(F.min("hv").alias("low"))
    up = inner & (F.col("e") > least) & (F.col("low") >= F.col("h"))
    nodes = nodes.join(low, [*_KEY, "node"], "left").withColumn("h", F.when(up, F.col("low") + 1).otherwise(F.col("h"))).select(*_KEY, "node", "e", "n", "h")
    return left, _kept(nodes)


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """(a, b, d): a minimum spanning forest of pairs (a, b, d), a < b. In each round every tree takes its least edge out, in the order of (d, a, b),
    and the trees it joins become one; rounds grow with the logarithm of the number of names. Null distances are no edges."""
    left = _kept(pairs.where("d IS NOT NULL AND a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d")))
    names = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    tree = _kept(names.withColumn("tree", F.col("node")))
    taken = None
    for _ in range(MOST_ROUNDS):
        out = left.join(tree.select(F.col("node").alias("a"), F.col("tree").alias("ta")), "a").join(tree.select(F.col("node").alias("b"), F.col("tree").alias("tb")), "b").where("ta <> tb")
        out = _kept(out.select("a", "b", "d", "ta", "tb"))
        if not out.limit(1).count():
            break
        ends = out.select(F.col("ta").alias("t"), F.struct("d", "a", "b", "ta", "tb").alias("e")).union(out.select("tb", F.struct("d", "a", "b", "ta", "tb")))
        best = _kept(ends.groupBy("t").agg(F.min("e").alias("e")).select("e.*").distinct())
        taken = best.select("a", "b", "d") if taken is None else taken.union(best.select("a", "b", "d"))
        joined = connected(best.select(F.col("ta").alias("src"), F.col("tb").alias("dst")))
        tree = _kept(tree.join(joined.select(F.col("node").alias("tree"), "label"), "tree", "left").select("node", F.coalesce("label", "tree").alias("tree")))
        left = out.select("a", "b", "d")  # edges inside a tree are never needed again
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    return taken if taken is not None else left.select("a", "b", "d")


def clusters(forest: DataFrame, names: DataFrame, height: float) -> DataFrame:
    """(node, cluster): single-linkage clusters of names (node) cut at a height: what edges of a spanning forest up to it join, by first name."""
    low = forest.where(F.col("d") <= height)
    if not low.limit(1).count():
        return names.select("node", F.col("node").alias("cluster"))
    got = connected(low.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return names.select("node").join(got, "node", "left").select("node", F.coalesce("label", "node").alias("cluster"))


def merges(forest: DataFrame) -> DataFrame:
    """(a, b, height): the merges of single linkage: the clusters, each named by its first member, that an edge of the forest joins at its distance.
    Edges of equal distance join in the order of their names.

    Two clusters meet at an edge as what lower edges have joined on its sides. Round by round, an edge that is the lowest at both of its
    clusters is contracted, as no later merge comes before it there: rounds are as many as the dendrogram is deep.
    """
    order = F.struct("d", "ea", "eb")
    left = _kept(forest.select("d", F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("a").alias("x"), F.col("b").alias("y")))
    done = []
    for _ in range(20 * MOST_ROUNDS):
        if not left.limit(1).count():
            break
        ends = left.select(F.col("x").alias("t"), order.alias("e")).union(left.select("y", order))
        low = ends.groupBy("t").agg(F.min("e").alias("e"))
        now = left.join(low.select(F.col("t").alias("x"), F.col("e").alias("ex")), "x").join(low.select(F.col("t").alias("y"), F.col("e").alias("ey")), "y")
        now = _kept(now.withColumn("own", order).where("own = ex AND own = ey").select("d", "ea", "eb", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
        done.append(now)
        new = now.select(F.col("y").alias("old"), F.col("x").alias("name"))
        rest = left.join(now.select("ea", "eb"), ["ea", "eb"], "left_anti")
        rest = rest.join(new.select(F.col("old").alias("x"), F.col("name").alias("nx")), "x", "left").withColumn("x", F.coalesce("nx", "x")).drop("nx")
        rest = rest.join(new.select(F.col("old").alias("y"), F.col("name").alias("ny")), "y", "left").withColumn("y", F.coalesce("ny", "y")).drop("ny")
        left = _kept(rest.select("d", "ea", "eb", "x", "y"))
    whole = done[0] if done else left
    for part in done[1:]:
        whole = whole.union(part)
    return whole.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("d").alias("height"))
