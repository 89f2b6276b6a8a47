"""Networks of synthesis: building them from sequences, filling and pruning them by other networks, flows and their comparison.

Vertices are (node, virtual, abundance), edges (src, dst, diffs) from the smaller to the larger sequence.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarbeam.functions import columns as c
from sugarbeam.functions import special, strings, structure
from sugarbeam.operators import networks as nw
from sugarbeam.operators import testing as te
from sugarbeam.sources.store import checkpointed

#: Rounds after which an iteration that should have ended counts as an error.
MOST_ROUNDS = 200


def permitted_roots(sequences: DataFrame, column: str = "glycan") -> DataFrame:
    """(root): the permitted roots of the table's class, by the reducing ends that occur; no rows if none is known."""
    kinds = sequences.select(strings.root_kind(F.col(column)).alias("k")).where("k is not null").agg(F.collect_set("k").alias("kinds"))
    return kinds.select(F.explode(strings.roots(F.col("kinds"))).alias("root"))


def without_disregarded(edges: DataFrame) -> DataFrame:
    return nw.drop_disregarded(edges)


def modified_edges(vertices: DataFrame) -> DataFrame:
    """(src, dst, diffs): edges from the sequence without its late modifications to each modified vertex, where the network has the former,
    or where the modification is the only difference of the letters: then the source is a new, virtual vertex."""
    bare = c._mapped(lambda x: [{"src": u[0], "diffs": u[1]} for u in [structure.unmodified(x)] if u], "array<struct<src: string, diffs: string>>")
    m = vertices.select(F.col("node").alias("dst"), F.explode(bare(F.col("node"))).alias("u")).select("u.src", "dst", "u.diffs")
    have = vertices.select(c.canonical(F.col("node")).alias("src"), F.col("node").alias("_known")).dropDuplicates(["src"])
    letters_of = lambda x: F.array_sort(F.split(x, ""))
    only = letters_of(F.col("dst")) == letters_of(F.concat("src", "diffs"))
    return m.join(have, "src", "left").where(F.col("_known").isNotNull() | only).select(F.coalesce("_known", "src").alias("src"), "dst", "diffs")


def labelled(edges: DataFrame) -> DataFrame:
    """edges whose missing diffs are found from the two sequences: the one part by which they differ, or `disregard`."""

    def run(batches):
        for pdf in batches:
            pdf["diffs"] = [d if d is not None else structure.difference(a, b) for a, b, d in zip(pdf["src"], pdf["dst"], pdf["diffs"], strict=True)]
            yield pdf

    return edges.select("src", "dst", "diffs").mapInPandas(run, "src string, dst string, diffs string")


def with_mannose_trimming(edges: DataFrame) -> DataFrame:
    """edges and, for targets of at least five Man, the reverse edges of their trimming."""
    back = edges.where(c.occurrences(F.col("dst"), "Man") >= 5).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "diffs")
    return edges.select("src", "dst", "diffs").unionByName(back)


def construct(sequences: DataFrame, roots: list[str] | None = None, column: str = "glycan") -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the precursors of observed sequences down to the size of the smallest root, a frontier at a time.

    A vertex is virtual (1) if it was not observed. Virtual vertices that no observed vertex or root leads to go, and edges with them;
    modified sequences hang on their unmodified form. Edges that carry a late modification are not steps of this kind and go.
    """
    spark = sequences.sparkSession
    seen = checkpointed(sequences.select(c.canonical(F.col(column)).alias("node")).where("node is not null").distinct())
    roots = [r["root"] for r in permitted_roots(sequences, column).collect()] if roots is None else roots
    ends = seen.where(strings.ends_with(F.col("node"), roots)) if roots else seen.limit(0)
    used = [r for r in roots if ends.where(F.col("node").endswith(r)).limit(1).count()]
    observed = checkpointed(seen.unionByName(spark.createDataFrame([(r,) for r in used], "node string")).distinct()) if used else seen
    least = min((r.count("(") + 1 for r in roots), default=1)
    all_, frontier, found = observed, observed, None
    for _ in range(MOST_ROUNDS):
        step = frontier.select(F.col("node").alias("dst"), F.explode(c._mapped(lambda x: [{"src": a, "diffs": b} for a, b in _precursors(x, least)], "array<struct<src: string, diffs: string>>")(F.col("node"))).alias("e"))
        step = checkpointed(step.select("e.src", "dst", "e.diffs"))
        found = step if found is None else found.unionByName(step)
        frontier = checkpointed(step.select(F.col("src").alias("node")).distinct().join(all_, "node", "left_anti"))
        if not frontier.limit(1).count():
            break
        all_ = checkpointed(all_.unionByName(frontier))
    else:
        raise RuntimeError(f"precursors did not end in {MOST_ROUNDS} rounds")
    edges = found.where(~F.exists(F.lit(list(structure.LATE)), lambda m: F.contains("diffs", m)))
    firm = observed.select("node", F.lit(0).alias("virtual"))
    keep = _reached(firm.select("node"), edges)
    vertices = keep.join(firm, "node", "left").select("node", F.coalesce("virtual", F.lit(1)).alias("virtual"))
    edges = edges.join(keep.select(F.col("node").alias("src")), "src", "left_semi").join(keep.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "diffs")
    return vertices, edges.unionByName(modified_edges(vertices))


def _precursors(text: str, least: int) -> list[tuple[str, str]]:
    from sugarbeam.functions import glycan as g

    return g.precursors(text, least)


def _reached(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): start and what its edges lead to, a frontier at a time."""
    e = checkpointed(edges.select("src", "dst").distinct())
    all_ = frontier = checkpointed(start.distinct())
    for _ in range(MOST_ROUNDS):
        frontier = checkpointed(e.join(frontier, e.src == frontier.node).select(F.col("dst").alias("node")).distinct().join(all_, "node", "left_anti"))
        if not frontier.limit(1).count():
            return all_
        all_ = checkpointed(all_.unionByName(frontier))
    raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")


def inferred(vertices: DataFrame, others: DataFrame) -> DataFrame:
    """vertices whose virtual is 2 where it was 1 and one of `others` (species, node, virtual) has the node observed."""
    seen = others.where("virtual = 0").select("node").distinct().withColumn("_seen", F.lit(True))
    out = vertices.join(seen, "node", "left")
    return out.withColumn("virtual", F.when((F.col("virtual") == 1) & F.col("_seen").isNotNull(), F.lit(2)).otherwise(F.col("virtual"))).drop("_seen")


def inferred_nodes(vertices: DataFrame) -> DataFrame:
    """(node) that `inferred` found in another species."""
    return vertices.where("virtual = 2").select("node")


def path_support(diamonds: DataFrame, others: DataFrame, mode: str = "presence", threshold: float = 0.0) -> DataFrame:
    """(a, d, middle, support) of both middles of each diamond (a, b, c, d), over `others` (species, node, virtual, abundance) that have a and d.

    presence: one less the mean of `virtual`, which is 1 where a species lacks the middle; abundance: the mean abundance, 0 where it lacks it.
    If neither middle has support both get 0.01 + threshold, since one of the ways has to be taken.
    """
    has = others.select("species", "node")
    both = diamonds.select("a", "b", "c", "d").join(has.select(F.col("node").alias("a"), "species"), "a").join(has.select(F.col("node").alias("d"), "species"), ["d", "species"])
    each = both.select("a", "b", "c", "d", "species", F.explode(F.array("b", "c")).alias("node"))
    value = F.coalesce("virtual", F.lit(1)) if mode == "presence" else F.coalesce("abundance", F.lit(0.0))
    mean = each.join(others, ["species", "node"], "left").groupBy("a", "b", "c", "d", "node").agg(F.avg(value).alias("m"))
    mean = mean.withColumn("m", 1 - F.col("m")) if mode == "presence" else mean
    pair = mean.groupBy("a", "b", "c", "d").agg(F.sum("m").alias("sum"))
    out = mean.join(pair, ["a", "b", "c", "d"]).withColumn("support", F.when(F.col("sum") == 0, F.col("m") + 0.01 + threshold).otherwise(F.col("m")))
    return out.select("a", "d", F.col("node").alias("middle"), "support")


def trace_diamonds(vertices: DataFrame, edges: DataFrame, others: DataFrame, mode: str = "presence", threshold: float = 0.0) -> DataFrame:
    """(node, probability): the mean support of each middle over all diamonds of the network that have a virtual middle (any diamond for
    abundance)."""
    d = nw.diamonds(edges)
    if mode == "presence":
        v = vertices.where("virtual = 1").select("node")
        d = d.join(v.withColumnRenamed("node", "b"), "b", "left_semi").unionByName(d.join(v.withColumnRenamed("node", "c"), "c", "left_semi")).select("a", "b", "c", "d").distinct()
    return path_support(d, others, mode, threshold).groupBy(F.col("middle").alias("node")).agg(F.avg("support").alias("probability"))


def prune(vertices: DataFrame, edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """vertices (node, virtual, abundance) in two passes: those of abundance at most the threshold go, unless one of their successors, a longer
    sequence, has no other way in; then virtual ones with a way in and at most one edge go."""
    e = edges.select("src", "dst").distinct()
    ways = e.groupBy("dst").agg(F.count("*").alias("ways"))
    needed = e.join(ways, "dst").where((F.col("ways") == 1) & (F.length("dst") > F.length("src"))).select(F.col("src").alias("node")).distinct()
    cut = vertices.where(F.col("abundance") <= threshold).select("node").join(needed, "node", "left_anti")
    left = vertices.join(cut, "node", "left_anti")
    e = e.join(cut.withColumnRenamed("node", "src"), "src", "left_anti").join(cut.withColumnRenamed("node", "dst"), "dst", "left_anti")
    degree = e.select(F.col("src").alias("node"), F.lit(0).alias("in")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("in")))
    degree = degree.groupBy("node").agg(F.count("*").alias("degree"), F.sum("in").alias("in"))
    stubs = degree.where((F.col("degree") <= 1) & (F.col("in") > 0)).select("node").join(left.where("virtual = 1"), "node", "left_semi")
    return left.join(stubs, "node", "left_anti")


def evoprune(vertices: DataFrame, edges: DataFrame, others: DataFrame, threshold: float = 0.01, mode: str = "presence") -> DataFrame:
    """prune by the probabilities of diamonds' middles, in hundredths; what is in no diamond counts 50."""
    p = trace_diamonds(vertices, edges, others, mode, threshold)
    v = vertices.drop("abundance").join(p, "node", "left").withColumn("abundance", F.coalesce(F.col("probability") * 100, F.lit(50.0))).drop("probability")
    return prune(v, edges, threshold * 100)


def highlighted(vertices: DataFrame, how: str, motif: str | None = None, others: DataFrame | None = None, species: str | None = None, values: DataFrame | None = None) -> DataFrame:
    """vertices with `highlight`: whether they hold the motif (`motif`; a pattern if it starts with r, a part of the text if it ends in a
    bracket) or are in the species' network (`species`), as 1 or 0; their value (node, value) in hundredths, 50 without one (`abundance`);
    or a hundred for each network that has them (`conservation`)."""
    if how == "motif":
        if motif.startswith("r"):
            hit = F.size(c.pattern_matches(F.col("node"), motif[1:])) > 0
        elif motif.endswith(")"):
            hit = F.contains("node", F.lit(motif))
        else:
            hit = c._mapped(lambda x: structure.matches(x, motif), "boolean")(F.col("node"))
        return vertices.withColumn("highlight", hit.cast("double"))
    if how == "species":
        mine = others.where(F.col("species") == species).select("node").distinct().withColumn("_h", F.lit(1.0))
        return vertices.join(mine, "node", "left").withColumn("highlight", F.coalesce("_h", F.lit(0.0))).drop("_h")
    if how == "abundance":
        return vertices.join(values.select("node", F.col("value").alias("_h")), "node", "left").withColumn("highlight", F.coalesce(F.col("_h") * 100, F.lit(50.0))).drop("_h")
    if how == "conservation":
        n = others.select("species", "node").distinct().groupBy("node").agg((F.count("*") * 100).cast("double").alias("_h"))
        return vertices.join(n, "node", "left").withColumn("highlight", F.coalesce("_h", F.lit(0.0))).drop("_h")
    raise ValueError(f"no way to highlight: {how}")


def capacities(edges: DataFrame, vertices: DataFrame, root: str, root_default: float = 10.0, least: float = 0.001) -> DataFrame:
    """edges with a capacity: the mean abundance of both ends, the root's at least `root_default` if it is below 0.1. The edges out of a node
    all of which have none get the mean of the other capacities at the node, or `least`. Vertices with a column `network` give the
    edges of each network."""
    by = ["network"] if "network" in vertices.columns else []
    x = F.when((F.col("node") == root) & (F.coalesce("abundance", F.lit(0.0)) < 0.1), F.lit(root_default)).otherwise(F.coalesce("abundance", F.lit(0.0)))
    v = vertices.select(*by, "node", x.alias("x"))
    e = edges.select("src", "dst", "diffs")
    if by:
        names = [r["network"] for r in vertices.select("network").distinct().orderBy("network").collect()]  # samples
        e = e.withColumn("network", F.explode(F.lit(names)))
    e = e.join(v.select(*by, F.col("node").alias("src"), F.col("x").alias("_s")), [*by, "src"], "left").join(v.select(*by, F.col("node").alias("dst"), F.col("x").alias("_d")), [*by, "dst"], "left")
    e = e.select(*by, "src", "dst", "diffs", ((F.coalesce("_s", F.lit(0.0)) + F.coalesce("_d", F.lit(0.0))) / 2).alias("capacity"))
    ends = e.select(*by, F.col("src").alias("node"), "capacity", F.lit(1).alias("out")).unionByName(e.select(*by, F.col("dst").alias("node"), "capacity", F.lit(0).alias("out")))
    per = ends.groupBy(*by, "node").agg(F.max(F.when(F.col("out") == 1, F.col("capacity"))).alias("most"), F.avg(F.when(F.col("capacity") != 0, F.col("capacity"))).alias("mean"))
    per = per.where("most = 0").select(*by, F.col("node").alias("src"), F.coalesce("mean", F.lit(least)).alias("_c"))
    return e.join(per, [*by, "src"], "left").select(*by, "src", "dst", "diffs", F.coalesce("_c", "capacity").alias("capacity"))


def flows(edges: DataFrame, source: str) -> DataFrame:
    """(network, sink, src, dst, diffs, flow, value): the flow on each edge of each network (network, src, dst, diffs, capacity) that carries the
    greatest flow from the source to each node without an edge out that it can reach; value is that flow times the steps of the
    shortest way. A network is one task's: its edges are the synthesis of one sample."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[["src", "dst", "capacity"]].itertuples(index=False, name=None))
        diffs = dict(zip(zip(pdf["src"], pdf["dst"], strict=True), pdf["diffs"], strict=True))
        out: dict[str, list[str]] = {}
        for u, v, _ in rows:
            out.setdefault(u, []).append(v)
        steps, queue = {source: 0}, [source]
        for u in queue:
            for v in out.get(u, []):
                if v not in steps:
                    steps[v] = steps[u] + 1
                    queue.append(v)
        got = []
        for sink in sorted(n for n in steps if n not in out and n != source):
            value, on = nw.max_flow(rows, source, sink)
            got += [(pdf["network"].iloc[0], sink, u, v, diffs[u, v], f, value * steps[sink]) for (u, v), f in on.items()]
        return pd.DataFrame(got, columns=["network", "sink", "src", "dst", "diffs", "flow", "value"])

    return edges.groupBy("network").applyInPandas(run, "network string, sink string, src string, dst string, diffs string, flow double, value double")


def flow_path(flow: DataFrame, vertices: DataFrame, source: str, sink: str) -> list[tuple[str, str]]:
    """The edges from the source to the sink that follow, at each node, the greatest flow times abundance (0.1 at least), of flows (src, dst, flow)
    to one sink. The edges of one sink's flow are those of one network."""
    rows = flow.join(vertices.select(F.col("node").alias("dst"), "abundance"), "dst", "left").select("src", "dst", (F.col("flow") * F.greatest(F.coalesce("abundance", F.lit(0.0)), F.lit(0.1))).alias("w"))
    best = {r["src"]: r["dst"] for r in rows.groupBy("src").agg(F.max_by("dst", F.struct("w", "dst")).alias("dst")).collect()}
    out, now = [], source
    while now != sink:
        if now not in best or len(out) > len(best):
            raise ValueError("no path")
        out.append((now, best[now]))
        now = best[now]
    return out


def reaction_lists(flow: DataFrame) -> DataFrame:
    """(diffs, flows): all flows of each reaction, sorted."""
    return flow.groupBy("diffs").agg(F.array_sort(F.collect_list("flow")).alias("flows"))


def sample_networks(edges: DataFrame, vertices: DataFrame, samples: DataFrame, root: str, least: float = 0.001) -> DataFrame:
    """(network, src, dst, diffs, capacity): the network with the abundances of each sample of (node, sample, value), percentages of the sample."""
    total = samples.groupBy("sample").agg(F.sum("value").alias("_t"))
    share = samples.join(F.broadcast(total), "sample").select(F.col("sample").alias("network"), "node", (F.col("value") / F.col("_t") * 100).alias("abundance"))
    return capacities(edges, share.join(vertices.select("node"), "node", "left_semi"), root, least=least)


def differential(flow: DataFrame, groups: DataFrame, by: str = "reaction", paired: bool = False, least_variance: float = 0.01) -> DataFrame:
    """(feature, mean, log2fc, p, adjusted, effect) of group 1 against group 0 of summed reaction flows, or of flows to sinks, of `flow` as
    flows() gives it; groups: (network, grp, ...). Reactions whose flow varies at most `least_variance` are left out."""
    if by == "reaction":
        d = flow.groupBy("network", F.col("diffs").alias("feature")).agg(F.sum("flow").alias("value"))
        vary = d.groupBy("feature").agg(F.var_samp("value").alias("v")).where(F.col("v") > least_variance).select("feature")
        d = d.join(vary, "feature", "left_semi")
    else:
        d = flow.groupBy("network", F.col("sink").alias("feature")).agg(F.max("value").alias("value"))
    d = d.join(groups, "network").withColumn("sample", F.col("network"))
    m = te.group_moments(d).select("feature", "mean", F.log2(F.col("m1") / F.col("m0")).alias("log2fc"))
    t = (te.paired_t(d) if paired else te.welch(d)).select("feature", F.coalesce(F.nanvl(special.t_p(F.col("t"), F.col("df")), F.lit(1.0)), F.lit(1.0)).alias("p"))
    e = (te.cohen_d_paired(d) if paired else te.cohen_d(d)).select("feature", "effect")
    return te.two_stage(m.join(t, "feature").join(e, "feature")).select("feature", "mean", "log2fc", "p", "adjusted", "effect").orderBy("p", "feature")


def leaves(edges: DataFrame) -> DataFrame:
    """(node) with a way in and none out."""
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def leaves_towards(nodes: DataFrame, target: dict[str, int]) -> DataFrame:
    """(node, lacking): the nodes (node) that lack the fewest parts of the target composition and have none beyond its kinds."""
    parts = c.composition(F.col("node"))
    want = F.create_map(*[F.lit(x) for kv in target.items() for x in kv])
    lacks = F.aggregate(F.map_entries(want), F.lit(0), lambda s, e: s + F.greatest(e["value"] - F.coalesce(F.element_at("_p", e["key"]), F.lit(0)), F.lit(0)))
    d = nodes.withColumn("_p", parts).where(F.forall(F.map_keys("_p"), lambda k: F.array_contains(F.lit(list(target)), k)))
    d = d.select("node", lacks.alias("lacking"))
    return d.join(F.broadcast(d.agg(F.min("lacking").alias("lacking"))), "lacking", "left_semi")


def extended(vertices: DataFrame, edges: DataFrame, steps: int = 1, target: dict[str, int] | None = None, allowed: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) grown by `steps` residues at the leaves, or at the leaves nearest to a target composition, with the network's own
    reactions, at places that make an allowed disaccharide (those of the network unless they are given). Open or modified reactions
    are not applied; new vertices are virtual."""
    open_ = ("?", "Hex", "O", "/")
    reactions = [r["diffs"] for r in edges.select("diffs").distinct().collect() if not any(x in r["diffs"] for x in open_) and r["diffs"].endswith(")")]
    if allowed is None:
        allowed = {r["k"] for r in vertices.select(F.explode(F.map_keys(c.disaccharides(F.col("node")))).alias("k")).distinct().collect()}
    ends = leaves(edges)
    for _ in range(steps):
        if target is not None:
            ends = leaves_towards(ends, target).select("node")
        new = ends.select(F.col("node").alias("src"), F.explode(c._mapped(lambda x: structure.extensions(x, reactions, allowed), "array<string>")(F.col("node"))).alias("dst"))
        new = checkpointed(labelled(new.select("src", "dst", F.lit(None).cast("string").alias("diffs"))))
        fresh = checkpointed(new.select(F.col("dst").alias("node")).distinct().join(vertices.select("node"), "node", "left_anti"))
        vertices = vertices.select("node", "virtual").unionByName(fresh.withColumn("virtual", F.lit(1)))
        edges = edges.select("src", "dst", "diffs").unionByName(new)
        ends = fresh
    return vertices, edges


def shared_neighbour(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with `shares`: whether a node has an edge with both, in any direction."""
    near = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    hit = pairs.join(near.select(F.col("src").alias("a"), F.col("dst").alias("n")), "a").join(near.select(F.col("src").alias("b"), F.col("dst").alias("n")), ["b", "n"])
    return pairs.join(hit.select("a", "b").distinct().withColumn("_h", F.lit(True)), ["a", "b"], "left").select("a", "b", F.coalesce("_h", F.lit(False)).alias("shares"))


def by_monosaccharide(diffs: Column) -> Column:
    """The residue of an edge label such as Fuc(a1-2)."""
    return F.substring_index(diffs, "(", 1)
