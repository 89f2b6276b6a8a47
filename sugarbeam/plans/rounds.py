"""Registered queries of matching through an index, and of graph algorithms and tests that work in rounds or blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarbeam.functions import columns as c
from sugarbeam.functions import structure
from sugarbeam.functions.motifs import motif_list
from sugarbeam.operators import graphs
from sugarbeam.operators import matching as ma
from sugarbeam.operators import series as se
from sugarbeam.plans import fixtures as fx
from sugarbeam.plans.registry import query, rounded
from sugarbeam.plans.sequences import sequences
from sugarbeam.plans.structures import TREE


@query(f"WITH {fx.OCCURRENCES} SELECT glycan, name, CAST(count(*) AS INTEGER) AS n FROM oc GROUP BY glycan, name")
def indexed_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the motif of each supplier is in the chain of each part, matched where the label index leaves a pair."""
    return ma.motif_counts(fx.chains(spark, sf_dir), fx.chain_motifs(spark, sf_dir))


@query()
def indexed_named_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of named motifs in all parts' chains, open ones too."""
    motifs = spark.createDataFrame([(n, m, list(t) or None) for n, m, t in motif_list()], "name string, motif string, termini array<string>")
    return ma.motif_counts(fx.chains(spark, sf_dir, True), motifs)


@query(f"""WITH {fx.OCCURRENCES}, m AS (SELECT *, CAST(row_number() OVER (PARTITION BY glycan, name ORDER BY i) - 1 AS INTEGER) AS match, unnest(range(0, size)) AS k FROM oc)
SELECT glycan, name, match, CAST(k AS INTEGER) AS motif_node, CAST(i + k - 1 AS INTEGER) AS node, rs[i + k] AS residue FROM m""")
def motif_node_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the motif of each supplier lies in the chain of each part: a row for each residue of each mapping."""
    return ma.node_maps(fx.chains(spark, sf_dir), fx.chain_motifs(spark, sf_dir))


_KIND = "CASE {0} WHEN 'Gal' THEN 'Hex' WHEN 'Man' THEN 'Hex' WHEN 'Glc' THEN 'Hex' WHEN 'GlcNAc' THEN 'HexNAc' WHEN 'Fuc' THEN 'dHex' WHEN 'Neu5Ac' THEN 'Sia' ELSE '' END"


@query(f"""WITH RECURSIVE {fx.chain_sql(True)}, u AS (SELECT DISTINCT glycan, rs, ls FROM ch),
e AS (SELECT a.glycan AS a, b.glycan AS b FROM u a JOIN u b ON len(a.rs) = len(b.rs) AND a.glycan <> b.glycan
  WHERE len(list_filter(range(1, len(a.rs) + 1), lambda i: NOT (a.rs[i] = b.rs[i] OR a.rs[i] = {_KIND.format("b.rs[i]")} OR b.rs[i] = {_KIND.format("a.rs[i]")}))) = 0
    AND len(list_filter(range(1, len(a.ls) + 1), lambda i: NOT (a.ls[i] = b.ls[i] OR a.ls[i] = '?1-?' OR b.ls[i] = '?1-?'))) = 0),
r(a, b) AS (SELECT glycan, glycan FROM u UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
w AS (SELECT a, b, length(b) - length(replace(b, '?', '')) AS w FROM r)
SELECT a AS glycan, a AS canonical, arg_min(b, lpad(CAST(w AS VARCHAR), 4, '0') || b) AS representative FROM w GROUP BY a""")
def sequences_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' open chains with the one that stands for all that equal each other up to wildcards."""
    return ma.deduplicated(fx.chains(spark, sf_dir, True))


@query()
def rhythm_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best waveform of each priority's monthly revenue with its exact chance."""
    return rounded(se.rhythm(fx.monthly(spark, sf_dir), [6, 12]), 9)


#: nd(a, b, d): distances of all pairs of customers' nations by what their market segments spend.
NATIONS = """nv AS (SELECT c_nationkey AS n, c_mktsegment AS s, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS x FROM customer GROUP BY ALL),
nd AS (SELECT a.n AS a, b.n AS b, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 4) AS d FROM nv a JOIN nv b ON a.s = b.s AND a.n < b.n GROUP BY ALL)"""


def nation_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, d): distances of all pairs of customers' nations by their balances in market segments, named by their keys."""
    v = fx.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s")).agg(fx.money("c_acctbal").alias("x"))
    d = v.select(F.col("n").alias("a"), "s", F.col("x").alias("u")).join(v.select(F.col("n").alias("b"), "s", F.col("x").alias("v")), "s").where("a < b")
    return d.groupBy("a", "b").agg(F.round(F.sqrt(F.sum((F.col("u") - F.col("v")) * (F.col("u") - F.col("v")))), 4).alias("d"))


def _minimax(steps: int = 5) -> str:
    """m<steps>(a, b, t): the least longest edge of ways of 2 ** steps edges at most, which pairs of nations have."""
    out = ["m0 AS (SELECT a, b, d AS t FROM nd UNION ALL SELECT b, a, d FROM nd UNION ALL SELECT DISTINCT n, n, 0.0 FROM nv)"]
    out += [f"m{k} AS (SELECT x.a, y.b, min(greatest(x.t, y.t)) AS t FROM m{k - 1} x JOIN m{k - 1} y ON x.b = y.a GROUP BY ALL)" for k in range(1, steps + 1)]
    return ", ".join(out)


@query(f"WITH {NATIONS}, {_minimax()} SELECT nd.a, nd.b, nd.d FROM nd JOIN m5 ON m5.a = nd.a AND m5.b = nd.b WHERE nd.d <= m5.t")
def spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum spanning tree of nations: an edge is in it if no way of shorter edges joins its ends."""
    return graphs.spanning_forest(nation_distances(spark, sf_dir))


@query()
def dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of single linkage of nations, named by their first members."""
    return rounded(graphs.merges(graphs.spanning_forest(nation_distances(spark, sf_dir))))


#: bl(glycan, i, parent, d, n): the residues at and below each one, and the nodes of its graph, which are residues and linkages.
BELOW = f"""{TREE.replace("WITH", "WITH RECURSIVE", 1)}, up(glycan, i, a) AS (SELECT glycan, i, i FROM res UNION ALL SELECT up.glycan, up.i, r.parent FROM up JOIN res r ON r.glycan = up.glycan AND r.i = up.a WHERE r.parent IS NOT NULL),
sz AS (SELECT glycan, 2 * count(*) - 1 AS n FROM res GROUP BY glycan), bl AS (SELECT r.glycan, r.i, r.parent, count(*) AS d, any_value(n) AS n FROM res r JOIN up ON up.glycan = r.glycan AND up.a = r.i JOIN sz ON sz.glycan = r.glycan GROUP BY r.glycan, r.i, r.parent),
kd AS (SELECT glycan, parent AS i, sum(4 * d * d) AS q, count(*) AS kids FROM bl WHERE parent IS NOT NULL GROUP BY ALL),
ld AS (SELECT bl.glycan, n, ((n - 1) * (n - 1) - coalesce(q, 0) - CASE WHEN bl.parent IS NULL THEN 0 ELSE (n - 2 * d + 1) * (n - 2 * d + 1) END) / ((n - 1) * (n - 2))::DOUBLE AS x FROM bl LEFT JOIN kd ON kd.glycan = bl.glycan AND kd.i = bl.i
  UNION ALL SELECT glycan, n, 2 * (2 * d - 1) * (n - 2 * d) / ((n - 1) * (n - 2))::DOUBLE FROM bl WHERE parent IS NOT NULL),
fl AS (SELECT glycan, unnest([2 * d * (n - 2 * d), (2 * d - 1) * (n - 2 * d + 1)]) / ((n - 1) * (n - 2))::DOUBLE AS x FROM bl WHERE parent IS NOT NULL)"""


@query(f"""{BELOW}, a AS (SELECT glycan, max(x) AS load_max, avg(x) AS load_mean, var_pop(x) AS load_var FROM ld GROUP BY glycan), b AS (SELECT glycan, max(x) AS flow_max, min(x) AS flow_min, avg(x) AS flow_mean FROM fl GROUP BY glycan),
e AS (SELECT bl.glycan, count(*) FILTER (WHERE kids IS NULL) AS ends FROM bl LEFT JOIN kd ON kd.glycan = bl.glycan AND kd.i = bl.i WHERE bl.parent IS NOT NULL GROUP BY bl.glycan)
SELECT glycan, round(load_max, 6) AS load_max, round(load_mean, 6) AS load_mean, round(load_var, 6) AS load_var, round(flow_max, 6) AS flow_max, round(flow_min, 6) AS flow_min, round(flow_mean, 6) AS flow_mean, CAST(ends AS DOUBLE) AS ends FROM a JOIN b USING (glycan) JOIN e USING (glycan)""")
def glycan_graph_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load of the nodes and current through the edges of each sequence's graph."""
    names = {"loadMax": "load_max", "loadAvg": "load_mean", "loadVar": "load_var", "flow_edgeMax": "flow_max", "flow_edgeMin": "flow_min", "flow_edgeAvg": "flow_mean", "max_deg_leaves": "ends"}
    s = c._mapped(structure.shape, "map<string,double>")(F.col("glycan"))
    return rounded(sequences(spark, sf_dir).select("glycan", s.alias("s")).select("glycan", *(F.element_at("s", k).alias(v) for k, v in names.items())))


@query()
def glycan_graph_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return times, Katz centrality, spectral gap and assortativity of each sequence's graph; tested against dense matrices."""
    names = {"secorderMax": "return_max", "secorderAvg": "return_mean", "eigenMax": "katz_max", "eigenAvg": "katz_mean", "egap": "gap", "entropyStation": "entropy", "deg_assort": "assortativity"}
    s = c._mapped(structure.shape, "map<string,double>")(F.col("glycan"))
    return rounded(sequences(spark, sf_dir).select("glycan", s.alias("s")).select("glycan", *(F.element_at("s", k).alias(v) for k, v in names.items())))
