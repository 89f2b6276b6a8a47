"""Registered queries of whole analyses, networks of synthesis and the functions around them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarbeam.operators import abundance as ab
from sugarbeam.operators import biosynthesis as bio
from sugarbeam.operators import diversity as dv
from sugarbeam.operators import expression as ex
from sugarbeam.operators import lectins
from sugarbeam.operators import multivariate as mv
from sugarbeam.operators import networks as nw
from sugarbeam.operators import series as se
from sugarbeam.operators import testing as te
from sugarbeam.plans import fixtures as fx
from sugarbeam.plans.registry import CLR, MOMENTS, PAIRS, _anova, _paired, query, rounded
from sugarbeam.sources import tables
from sugarbeam.sources.store import shared_folder

REF = "rv AS (SELECT feature, abs(coalesce(var_samp(log2(value)) FILTER (WHERE grp = 0), 0) - coalesce(var_samp(log2(value)) FILTER (WHERE grp = 1), 0)) AS variance FROM ab WHERE value > 0 GROUP BY feature)"


@query(f"WITH {fx.ABUNDANCE}, {REF} SELECT feature, 1.0::DOUBLE AS correlation, round(variance, 9) AS variance, round(1 / variance, 2) AS score FROM rv")
def alr_reference_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ex.reference_scores(fx.abundance(spark, sf_dir))
    return s.select("feature", "correlation", F.round("variance", 9).alias("variance"), F.round("score", 2).alias("score"))


@query(f"""WITH {fx.ABUNDANCE}, {REF}, best AS (SELECT feature AS f, variance AS v FROM rv ORDER BY 1 / variance DESC, feature LIMIT 1), r AS (SELECT sample, log2(value) AS b FROM ab, best WHERE feature = f)
SELECT feature, sample, grp, round(log2(value) - b, 6) AS value FROM ab JOIN r USING (sample), best WHERE v <= 0.1 AND feature <> f
UNION ALL SELECT feature, sample, grp, round(log2(value) - avg(log2(value)) OVER (PARTITION BY sample), 6) FROM ab WHERE (SELECT v FROM best) > 0.1""")
def log_ratio_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ex.log_ratios(fx.abundance(spark, sf_dir))[0])


@query()
def forest_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ex.impute_forest(fx.sparse(spark, sf_dir)))


@query(f"""{CLR}, {MOMENTS}, kp AS (SELECT feature, var_samp(value) > 0.02 AS kept, avg(value) AS mean FROM cl GROUP BY feature)
SELECT feature, {"round(mean, 6) AS mean"}, round(m1 - m0, 6) AS log2fc, round(CASE WHEN kept THEN (m1 - m0) / greatest(sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 1e-6) ELSE 0 END, 6) AS effect, kept AS tested FROM mm JOIN kp USING (feature)""")
def differential_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the whole differential analysis: means, changes, effects and which features were tested."""
    d = ab.clr(fx.abundance(spark, sf_dir))
    out = ex.differential(d).join(ab.by_variance(d).select("feature", F.col("kept").alias("tested")), "feature")
    return rounded(out.select("feature", "mean", "log2fc", "effect", "tested"))


@query()
def differential_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis of a sparse table: winsorized, filtered, imputed by forests, percentages, log ratios, filters, tests and corrections."""
    raw = ab.normalized(ex.impute_forest(ab.floor_empty_groups(ab.prevalent(ab.winsorized(fx.sparse(spark, sf_dir))))))
    return ex.differential(ex.log_ratios(raw)[0], raw)


@query()
def differential_paired_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.differential(_paired(spark, sf_dir), paired=True)


@query(f"""{CLR.replace("WITH", "WITH RECURSIVE", 1)}, pr AS (SELECT a.feature AS x, b.feature AS y FROM cl a JOIN cl b ON a.sample = b.sample AND a.feature <> b.feature GROUP BY ALL HAVING corr(a.value, b.value) > 0.6),
rc(x, y) AS (SELECT feature, feature FROM cl UNION SELECT rc.x, pr.y FROM rc JOIN pr ON rc.y = pr.x) SELECT x AS feature, min(y) AS "set" FROM rc GROUP BY x""")
def correlation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.sets_of(ab.clr(fx.abundance(spark, sf_dir)), 0.6)


@query(f"{CLR}, rk AS (SELECT feature, sample, value AS v FROM cl) SELECT a.feature AS x, b.feature AS y FROM rk a JOIN rk b ON a.sample = b.sample WHERE a.feature < b.feature GROUP BY ALL HAVING corr(a.v, b.v) > 0.6")
def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ab.clr(fx.abundance(spark, sf_dir))
    return se.correlation_groups(se.correlations(d, d, rank=False), 0.6)


@query(f"WITH {fx.P_VALUES} SELECT id, CASE WHEN abs(effect) > 1 AND p < 0.05 THEN CASE WHEN effect > 0 THEN 'up' ELSE 'down' END ELSE 'none' END AS category FROM pv")
def ma_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.p_values(spark, sf_dir).select("id", F.col("effect").alias("log2fc"), F.col("p").alias("adjusted"))
    return ex.ma_categories(d).select("id", "category")


CLC = f"WITH {fx.COUNTS}, cc AS (SELECT feature, sample, grp, log2(value) - avg(log2(value)) OVER (PARTITION BY sample) AS value FROM ct)"


@query(f"{CLC}, {_anova('cc')}, kp AS (SELECT feature, var_samp(value) > 0.001 AS kept FROM cc GROUP BY feature) SELECT feature, round(CASE WHEN kept THEN ssb / d1 / (ssw / d2) ELSE 0 END, 4) AS f, round((ssb - d1 * ssw / d2) / (ssb + ssw + ssw / d2), 4) AS omega2 FROM an JOIN kp USING (feature)")
def glycanova_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ex.glycanova(ab.clr(fx.counts(spark, sf_dir)), 0.001).select("feature", "f", "omega2"), 4)


@query()
def glycanova_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.glycanova(ab.clr(fx.counts(spark, sf_dir)), 0.001)


@query(f"""{CLC}, {_anova('cc')}, g AS (SELECT feature, grp, count(*) AS n, avg(value) AS m FROM cc GROUP BY ALL) SELECT x.feature, x.grp AS a, y.grp AS b, round(y.m - x.m, 6) AS difference,
round(abs(y.m - x.m) / sqrt(ssw / d2 / 2 * (1.0 / x.n + 1.0 / y.n)), 4) AS q FROM g x JOIN g y ON x.feature = y.feature AND x.grp < y.grp JOIN an ON an.feature = x.feature""")
def tukey_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ex.tukey(ab.clr(fx.counts(spark, sf_dir)))
    return t.select("feature", "a", "b", F.round("difference", 6).alias("difference"), F.round("q", 4).alias("q"))


@query(f"""{CLC}, au AS (SELECT g.grp, a.feature, avg(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0 END) AS u FROM (SELECT DISTINCT grp FROM cc) g JOIN cc a ON a.grp = g.grp JOIN cc b ON b.feature = a.feature AND b.grp <> g.grp GROUP BY ALL),
r AS (SELECT grp, feature, greatest(u, 1 - u) AS auc, row_number() OVER (PARTITION BY grp ORDER BY round(greatest(u, 1 - u), 12) DESC, feature) AS k FROM au) SELECT grp, feature, round(auc, 6) AS auc FROM r WHERE k = 1""")
def roc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ex.roc_by_group(ab.clr(fx.counts(spark, sf_dir))))


@query()
def biodiversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.abundance(spark, sf_dir)
    return ex.biodiversity(d, ab.clr(d), 199)


@query(f"""WITH {fx.COUNTS}, pr AS (SELECT *, value / sum(value) OVER (PARTITION BY sample) AS p FROM ct), dv AS (SELECT sample, grp, count(*)::DOUBLE AS richness, -sum(p * ln(p)) AS shannon, 1 - sum(p * p) AS simpson FROM pr GROUP BY ALL),
lg AS (SELECT sample, grp, 'shannon' AS feature, shannon AS value FROM dv UNION ALL SELECT sample, grp, 'simpson', simpson FROM dv), {_anova('lg')} SELECT feature AS metric, round(ssb / d1 / (ssw / d2), 4) AS f, d1, d2 FROM an""")
def alpha_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dv.alpha_anova(fx.counts(spark, sf_dir)).where("metric <> 'richness'"), 4)


@query()
def multi_feature_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, auc = ex.multi_feature_score(ab.clr(fx.abundance(spark, sf_dir)))
    return spark.createDataFrame([(features, auc)], "features array<string>, auc double")


@query()
def partial_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.partial_correlations(ab.clr(fx.abundance(spark, sf_dir)))


@query()
def site_model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = fx.table(spark, sf_dir, "lineitem")
    d = line.select(F.concat(F.lit("p"), F.col("l_suppkey") % 5).alias("site"), (F.col("l_returnflag") == "R").cast("double").alias("condition"), F.ln("l_extendedprice").alias("value"), F.col("l_quantity").alias("H"))
    return ex.model_table(mv.site_models(d, ["H"]))


@query(f"WITH {fx.ABUNDANCE} SELECT feature, sample, grp, round(log2(value) - avg(log2(value)) OVER (PARTITION BY sample), 6) AS value FROM ab")
def clr_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noisy form with a deviation of 0 is the plain one."""
    return rounded(ab.clr_noise(fx.abundance(spark, sf_dir), 1, 0.0, 7))


@query("SELECT p_brand AS feature, 's' || (p_size % 3) AS sample, CAST(p_size % 2 AS INTEGER) AS grp, round(avg(p_retailprice), 4) AS value FROM part GROUP BY ALL")
def mean_of_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature"), F.concat(F.lit("s"), F.col("p_size") % 3).alias("sample"), (F.col("p_size") % 2).cast("int").alias("grp"), F.col("p_retailprice").alias("value"))
    return rounded(ab.mean_duplicates(p), 4)


@query("SELECT 'S' || (c_custkey % 7) AS sample, CAST(c_custkey % 11 AS DOUBLE) AS time, CAST(c_nationkey AS VARCHAR) AS replicate, c_custkey AS k FROM customer")
def sample_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("S"), F.col("c_custkey") % 7, F.lit("_d"), F.col("c_custkey") % 11, F.lit("_"), "c_nationkey").alias("ID"))
    return se.parse_sample(d).select("sample", "time", "replicate", "k")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def cell_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed cells written as JSON lines and read again."""
    e = fx.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"), "event_type")
    path = f"{shared_folder(spark)}/sugarbeam/cells-{uuid.uuid4().hex}"
    tables.write_cells(e, path)
    back = tables.read_cells(spark, path, {"event_id": "bigint", "m": "map<string,bigint>", "event_type": "string"})
    return back.select("event_id", F.element_at("m", "k").alias("k"), "event_type")


@query(f"WITH {fx.EDGES}, {fx.VERTICES} SELECT 'edge' AS kind, src AS a, dst AS b, diffs AS c FROM ed UNION ALL SELECT 'node', node, CAST(virtual AS VARCHAR), NULL FROM ve")
def network_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV files of a network, read back."""
    path = f"{shared_folder(spark)}/sugarbeam/network-{uuid.uuid4().hex}"
    tables.export_network(fx.edges(spark, sf_dir), fx.vertices(spark, sf_dir), path)
    e, n = spark.read.csv(f"{path}/edges", header=True), spark.read.csv(f"{path}/nodes", header=True)
    return e.select(F.lit("edge").alias("kind"), F.col("Source").alias("a"), F.col("Target").alias("b"), F.col("Label").alias("c")).unionByName(n.select(F.lit("node").alias("kind"), F.col("Id").alias("a"), F.col("Virtual").alias("b"), F.lit(None).cast("string").alias("c")))


@query(f"WITH {fx.EDGES} SELECT src, dst, diffs FROM ed WHERE diffs <> 'r2'")
def network_disregarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.edges(spark, sf_dir).withColumn("label", F.col("diffs")).withColumn("diffs", F.when(F.col("diffs") == "r2", "disregard").otherwise(F.col("diffs")))
    return bio.without_disregarded(e).select("src", "dst", F.col("label").alias("diffs"))


@query(f"WITH {fx.EDGES} SELECT src, dst, diffs, CASE diffs WHEN 'r0' THEN 'A_B' WHEN 'r1' THEN 'C' ELSE diffs END AS enzymes FROM ed")
def network_enzymes(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = spark.createDataFrame([("r0", "B"), ("r0", "A"), ("r0", "A"), ("r1", "C")], "monolink string, glycoenzyme string")
    return nw.reaction_enzymes(fx.edges(spark, sf_dir), z).select("src", "dst", "diffs", "enzymes")


@query(f"""WITH RECURSIVE {fx.EDGES}, e AS (SELECT DISTINCT src, dst FROM ed), l(node, level) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT dst, level + 1 FROM l JOIN e ON node = src WHERE level < 100)
SELECT node, max(level) AS level FROM l GROUP BY node""")
def network_longest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.longest_levels(fx.edges(spark, sf_dir))


BI = "SELECT src, dst FROM ed WHERE diffs = 'r1' AND CAST(substr(src, 2) AS INTEGER) % 4 = 0"


@query(f"WITH RECURSIVE {fx.EDGES}, s AS ({BI}), u AS (SELECT src, dst FROM s UNION SELECT dst, src FROM s), r(a, b) AS (SELECT src, src FROM u UNION SELECT r.a, u.dst FROM r JOIN u ON r.b = u.src) SELECT a AS node, min(b) AS label FROM r GROUP BY a")
def network_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the edges of one reaction from every fourth node on."""
    e = fx.edges(spark, sf_dir).where("diffs = 'r1'").where(F.substring("src", 2, 9).cast("int") % 4 == 0)
    return nw.connected(e)


PRUNE = f"""WITH {fx.EDGES}, {fx.VERTICES}, e AS (SELECT DISTINCT src, dst FROM ed), w AS (SELECT dst, count(*) AS n FROM e GROUP BY dst), need AS (SELECT DISTINCT src FROM e JOIN w USING (dst) WHERE n = 1 AND length(dst) > length(src)),
cut AS (SELECT node FROM ve WHERE abundance <= 0 AND node NOT IN (SELECT src FROM need)), lf AS (SELECT * FROM ve WHERE node NOT IN (SELECT node FROM cut)), f AS (SELECT * FROM e WHERE src NOT IN (SELECT node FROM cut) AND dst NOT IN (SELECT node FROM cut)),
dg AS (SELECT node, count(*) AS n, sum(i) AS i FROM (SELECT src AS node, 0 AS i FROM f UNION ALL SELECT dst, 1 FROM f) GROUP BY node)"""


@query(f"{PRUNE} SELECT node, virtual, round(abundance, 2) AS abundance FROM lf WHERE NOT (virtual = 1 AND node IN (SELECT node FROM dg WHERE n <= 1 AND i > 0))")
def network_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bio.prune(fx.vertices(spark, sf_dir), fx.edges(spark, sf_dir)), 2)


def _others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species, node, virtual, abundance): the parts of each size class in classes of nodes."""
    p = fx.table(spark, sf_dir, "part").where("p_size % 7 <> p_partkey % 7")
    return p.groupBy(F.concat(F.lit("s"), F.col("p_size") % 4).alias("species"), F.concat(F.lit("n"), F.col("p_partkey") % 50).alias("node")).agg((F.count("*") % 2).cast("int").alias("virtual"), F.count("*").cast("double").alias("abundance"))


OTHERS = "ot AS (SELECT 's' || (p_size % 4) AS species, 'n' || (p_partkey % 50) AS node, CAST(count(*) % 2 AS INTEGER) AS virtual, CAST(count(*) AS DOUBLE) AS abundance FROM part WHERE p_size % 7 <> p_partkey % 7 GROUP BY ALL)"


@query(f"WITH {fx.VERTICES}, {OTHERS} SELECT node, CASE WHEN virtual = 1 AND node IN (SELECT node FROM ot WHERE virtual = 0) THEN 2 ELSE virtual END AS virtual FROM ve")
def network_inferred_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bio.inferred(fx.vertices(spark, sf_dir).select("node", "virtual"), _others(spark, sf_dir))


DIAMONDS = """e AS (SELECT DISTINCT src, dst FROM ed), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
dm AS (SELECT x.src AS a, x.dst AS b, y.dst AS c, z.dst AS d FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst JOIN e z ON z.src = x.dst JOIN e w ON w.src = y.dst AND w.dst = z.dst
WHERE x.src <> z.dst AND NOT EXISTS (SELECT 1 FROM u WHERE u.src = x.src AND u.dst = z.dst) AND NOT EXISTS (SELECT 1 FROM u WHERE u.src = x.dst AND u.dst = y.dst))"""


def _support(value: str, out: str) -> str:
    return f"""WITH {fx.EDGES}, {OTHERS}, {fx.VERTICES}, {DIAMONDS}, sp AS (SELECT dm.*, s.species FROM dm JOIN ot s ON s.node = dm.a JOIN ot t ON t.node = dm.d AND t.species = s.species),
md AS (SELECT a, b, c, d, species, unnest([b, c]) AS node FROM sp), mn AS (SELECT m.a, m.b, m.c, m.d, m.node, {out.format(f"avg({value})")} AS m FROM md m LEFT JOIN ot o ON o.species = m.species AND o.node = m.node GROUP BY ALL),
su AS (SELECT *, sum(m) OVER (PARTITION BY a, b, c, d) AS s FROM mn), pv AS (SELECT *, CASE WHEN s = 0 THEN m + 0.01 ELSE m END AS p FROM su)"""


@query(f"{_support('coalesce(o.virtual, 1)', '1 - {}')} SELECT node, round(avg(p), 6) AS probability FROM pv WHERE b IN (SELECT node FROM ve WHERE virtual = 1) OR c IN (SELECT node FROM ve WHERE virtual = 1) GROUP BY node")
def network_diamond_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bio.trace_diamonds(fx.vertices(spark, sf_dir), fx.edges(spark, sf_dir), _others(spark, sf_dir)))


@query(f"{_support('coalesce(o.abundance, 0)', '{}')} SELECT node, round(avg(p), 6) AS probability FROM pv GROUP BY node")
def network_abundance_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bio.trace_diamonds(fx.vertices(spark, sf_dir), fx.edges(spark, sf_dir), _others(spark, sf_dir), "abundance"))


@query()
def network_evopruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bio.evoprune(fx.vertices(spark, sf_dir), fx.edges(spark, sf_dir), _others(spark, sf_dir), 0.2))


@query(f"""WITH {fx.VERTICES}, {OTHERS}, c AS (SELECT node, count(DISTINCT species) * 100.0 AS h FROM ot GROUP BY node) SELECT node, 'conservation' AS how, coalesce(h, 0)::DOUBLE AS highlight FROM ve LEFT JOIN c USING (node)
UNION ALL SELECT node, 'species', CASE WHEN node IN (SELECT node FROM ot WHERE species = 's1') THEN 1.0 ELSE 0.0 END FROM ve UNION ALL SELECT node, 'abundance', CASE WHEN length(node) = 2 THEN 700.0 ELSE 50.0 END FROM ve""")
def network_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, o = fx.vertices(spark, sf_dir).select("node"), _others(spark, sf_dir)
    values = v.where(F.length("node") == 2).withColumn("value", F.lit(7.0))
    got = {"conservation": bio.highlighted(v, "conservation", others=o), "species": bio.highlighted(v, "species", others=o, species="s1"), "abundance": bio.highlighted(v, "abundance", values=values)}
    out = None
    for k, d in got.items():
        one = d.select("node", F.lit(k).alias("how"), "highlight")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {fx.EDGES}, {fx.VERTICES}, x AS (SELECT node, CASE WHEN node = 'n0' AND abundance < 0.1 THEN 10.0 ELSE abundance END AS x FROM ve),
c AS (SELECT src, dst, diffs, (coalesce(s.x, 0) + coalesce(d.x, 0)) / 2 AS c FROM ed LEFT JOIN x s ON s.node = src LEFT JOIN x d ON d.node = dst),
en AS (SELECT src AS node, c, 1 AS o FROM c UNION ALL SELECT dst, c, 0 FROM c), z AS (SELECT node, coalesce(avg(c) FILTER (WHERE c <> 0), 0.001) AS m FROM en GROUP BY node HAVING max(c) FILTER (WHERE o = 1) = 0)
SELECT src, dst, diffs, round(coalesce(m, c), 4) AS capacity FROM c LEFT JOIN z ON z.node = src""")
def network_filled_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bio.capacities(fx.edges(spark, sf_dir), fx.vertices(spark, sf_dir), "n0"), 4)


@query(f"WITH {fx.EDGES} SELECT diffs, array_to_string(list(length(src) ORDER BY length(src)), ',') AS flows FROM ed GROUP BY diffs")
def network_reaction_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bio.reaction_lists(fx.edges(spark, sf_dir).select("diffs", F.length("src").alias("flow")))
    return d.select("diffs", F.array_join(F.transform("flows", lambda x: x.cast("string")), ",").alias("flows"))


@query(f"WITH {fx.EDGES}, u AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), p AS (SELECT DISTINCT src AS a, dst AS b FROM ed) SELECT a, b, EXISTS (SELECT 1 FROM u x JOIN u y ON x.dst = y.dst WHERE x.src = a AND y.src = b) AS shares FROM p")
def network_shared_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.edges(spark, sf_dir)
    return bio.shared_neighbour(e, e.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())


@query(f"WITH {fx.EDGES} SELECT DISTINCT dst AS node FROM ed WHERE dst NOT IN (SELECT src FROM ed)")
def network_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bio.leaves(fx.edges(spark, sf_dir))


_L = "Gal(b1-4)Glc-ol"


@query(fx.answers("node, lacking", [(f"Gal(b1-3)GlcNAc(b1-3){_L}", 1)], each=False))
def network_leaves_towards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Towards Hex3HexNAc1dHex1 one leaf lacks one part, one lacks three, and one has a part too many."""
    nodes = fx.dealt(spark, sf_dir, [(f"Gal(b1-3)GlcNAc(b1-3){_L}",), (_L,), (f"Neu5Ac(a2-3){_L}",)], "node string").distinct()
    return bio.leaves_towards(nodes, {"Hex": 3, "HexNAc": 1, "dHex": 1})


def _milk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The milk network and amounts of its sequences in ten samples, from the abundances of five brands."""
    from sugarbeam.plans.structures import MILK

    v, e = bio.construct(spark.createDataFrame([(x,) for x in MILK], "glycan string"))
    brands = [f"Brand#1{i}" for i in range(1, 6)]
    node = F.element_at(F.create_map(*[F.lit(x) for kv in zip(brands, MILK, strict=True) for x in kv]), F.col("feature"))
    a = fx.abundance(spark, sf_dir).where(F.col("feature").isin(brands)).select(node.alias("node"), "sample", "grp", "value")
    return v, e, a


@query()
def differential_biosynthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reaction flows of two groups of samples: each sample's greatest flows through the network of milk sugars."""
    v, e, a = _milk(spark, sf_dir)
    flow = bio.flows(bio.sample_networks(e, v, a, _L), _L)
    return bio.differential(flow, a.select(F.col("sample").alias("network"), "grp").distinct())


@query(f"""WITH {fx.ABUNDANCE}, m(feature, node) AS (VALUES ('Brand#11', '{_L}'), ('Brand#12', 'Fuc(a1-2){_L}'), ('Brand#13', 'Neu5Ac(a2-3){_L}'), ('Brand#14', 'Gal(b1-3)GlcNAc(b1-3){_L}'), ('Brand#15', 'Fuc(a1-2)Gal(b1-3)GlcNAc(b1-3){_L}')),
s AS (SELECT sample, node, value / sum(value) OVER (PARTITION BY sample) * 100 AS x FROM ab JOIN m USING (feature)), w AS (SELECT sample, max(x) FILTER (WHERE node = '{_L}') AS l, max(x) FILTER (WHERE node = 'Fuc(a1-2){_L}') AS f, max(x) FILTER (WHERE node = 'Neu5Ac(a2-3){_L}') AS n,
 max(x) FILTER (WHERE node = 'Gal(b1-3)GlcNAc(b1-3){_L}') AS g, max(x) FILTER (WHERE node = 'Fuc(a1-2)Gal(b1-3)GlcNAc(b1-3){_L}') AS h FROM s GROUP BY sample)
SELECT sample AS network, 'Fuc(a1-2){_L}' AS sink, round((l + f) / 2, 4) AS value FROM w UNION ALL SELECT sample, 'Neu5Ac(a2-3){_L}', round((l + n) / 2, 4) FROM w
UNION ALL SELECT sample, 'Fuc(a1-2)Gal(b1-3)GlcNAc(b1-3){_L}', round(least(l / 2, g / 2, (g + h) / 2) * 3, 4) FROM w""")
def synthesis_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest flow to each sink of the milk network in each sample, times the steps: on a tree it is the least capacity on the way."""
    v, e, a = _milk(spark, sf_dir)
    flow = bio.flows(bio.sample_networks(e, v, a, _L), _L)
    return rounded(flow.groupBy("network", "sink").agg(F.max("value").alias("value")), 4)


#: By hand: effect x class weight x idf / breadth x 0.8^n for n > 1 lectins of an entry.
LECTINS = [("Man(a1-3)Man", "ConA_2, cona_1", "up", round((2.0 * 0.5 + 1.0 * 0.4) / 2 * 0.64, 2)), ("Neu5Ac(a2-6)Gal", "sna", "down", 3.0)]


@query(fx.answers("motif, lectins, change, score", LECTINS, each=False))
def lectin_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = spark.createDataFrame([("cona_1", "ConA", 2.0, 0.5), ("ConA_2", "ConA", 1.0, 0.4), ("sna", "SNA", -3.0, 2.0)], "lectin string, name string, effect double, idf double")
    bound = spark.createDataFrame([("ConA", "Man(a1-3)Man", 0, 2), ("SNA", "Neu5Ac(a2-6)Gal", 1, 1)], "name string, motif string, class int, specificity int")
    return lectins.motif_scores(effects, bound)


@query(f"{CLR}, {PAIRS} SELECT feature, pair, round(value, 6) AS value FROM pd")
def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.paired_differences(_paired(spark, sf_dir)).select("feature", F.col("pair").cast("int").alias("pair"), "value"))


@query("""WITH d AS (SELECT 'p' || (l_suppkey % 5) AS site, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS c, ln(l_extendedprice) AS y, l_quantity AS h FROM lineitem),
r AS (SELECT site, regr_intercept(y, h) FILTER (WHERE c = 0) AS a0, regr_slope(y, h) FILTER (WHERE c = 0) AS b0, regr_intercept(y, h) FILTER (WHERE c = 1) AS a1, regr_slope(y, h) FILTER (WHERE c = 1) AS b1 FROM d GROUP BY site)
SELECT site, 'intercept' AS term, round(a0, 5) AS coefficient FROM r UNION ALL SELECT site, 'condition', round(a1 - a0, 5) FROM r UNION ALL SELECT site, 'H', round(b0, 5) FROM r UNION ALL SELECT site, 'condition:H', round(b1 - b0, 5) FROM r""")
def site_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One count with its interaction is two lines, one for each condition."""
    line = fx.table(spark, sf_dir, "lineitem")
    d = line.select(F.concat(F.lit("p"), F.col("l_suppkey") % 5).alias("site"), (F.col("l_returnflag") == "R").cast("double").alias("condition"), F.ln("l_extendedprice").alias("value"), F.col("l_quantity").alias("H"))
    return rounded(mv.site_models(d, ["H"]).select("site", "term", "coefficient"), 5)


@query(f"""WITH {fx.MONTHLY}, a AS (SELECT feature, regr_slope(value, time) AS b, regr_intercept(value, time) AS a, regr_slope(time * time, time) AS d, regr_intercept(time * time, time) AS c FROM mo GROUP BY feature),
k AS (SELECT feature, regr_slope(value - a - b * time, time * time - c - d * time) AS q FROM mo JOIN a USING (feature) GROUP BY feature)
SELECT feature, round(max(q) / 100, 2) AS square, round(regr_slope(value - q * time * time, time) / 1000, 2) AS slope, round(regr_intercept(value - q * time * time, time) / 10000, 2) AS intercept FROM mo JOIN k USING (feature) GROUP BY feature""")
def time_series_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of the quadratic fits, in hundreds, thousands and ten thousands; the SQL takes the line out of values and squares first."""
    c = F.col("coefficients")
    p = se.polynomial(fx.monthly(spark, sf_dir), 2)
    return p.select("feature", F.round(c[0] / 100, 2).alias("square"), F.round(c[1] / 1000, 2).alias("slope"), F.round(c[2] / 10000, 2).alias("intercept"))
