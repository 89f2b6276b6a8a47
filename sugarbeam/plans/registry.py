"""The registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarbeam.operators import abundance as ab
from sugarbeam.operators import diversity as dv
from sugarbeam.operators import graphs
from sugarbeam.operators import multivariate as mv
from sugarbeam.operators import networks as nw
from sugarbeam.operators import series as se
from sugarbeam.operators import testing as te
from sugarbeam.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to fixed digits, so that orders of addition do not show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _r(c: str, d: int = 6) -> str:
    return f"round({c}, {d}) AS {c}"


CELL = "feature, sample, grp, round(value, 6) AS value"
CLR = f"WITH {fx.ABUNDANCE}, cl AS (SELECT feature, sample, grp, log2(value) - avg(log2(value)) OVER (PARTITION BY sample) AS value FROM ab)"
MOMENTS = """mm AS (SELECT feature, count(value) FILTER (WHERE grp = 0) AS n0, avg(value) FILTER (WHERE grp = 0) AS m0, var_samp(value) FILTER (WHERE grp = 0) AS v0,
  count(value) FILTER (WHERE grp = 1) AS n1, avg(value) FILTER (WHERE grp = 1) AS m1, var_samp(value) FILTER (WHERE grp = 1) AS v1 FROM cl GROUP BY feature)"""


@query(f"WITH {fx.ABUNDANCE} SELECT {CELL} FROM ab")
def abundance_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.abundance(spark, sf_dir))


@query(f"WITH {fx.SPARSE} SELECT {CELL} FROM sp")
def complete_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.sparse(spark, sf_dir))


@query(f"WITH {fx.SPARSE}, m AS (SELECT feature FROM sp GROUP BY feature HAVING count(*) FILTER (WHERE value <> 0) >= greatest(floor((count(*) + 1) * 0.3), 1)) SELECT {CELL} FROM sp WHERE feature IN (SELECT feature FROM m)")
def prevalence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ab.prevalent(fx.sparse(spark, sf_dir), 0.3))


@query(f"""WITH {fx.SPARSE}, k AS (SELECT *, count(*) FILTER (WHERE value <> 0) OVER (PARTITION BY feature) AS s, count(*) OVER (PARTITION BY feature) AS n FROM sp),
f AS (SELECT feature, sample, grp, CASE WHEN sum(value) OVER (PARTITION BY feature, grp) = 0 THEN 1e-5 ELSE value END AS value FROM k WHERE s >= greatest(floor((n + 1) * 0.1), 1))
SELECT feature, sample, grp, round(value / sum(value) OVER (PARTITION BY sample) * 100, 6) AS value FROM f""")
def impute_and_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ab.impute_and_normalize(fx.sparse(spark, sf_dir)))


@query(f"WITH {fx.SPARSE}, m AS (SELECT feature, median(value) FILTER (WHERE value <> 0) AS m FROM sp GROUP BY feature) SELECT feature, sample, grp, round(coalesce(nullif(value, 0), m, 0) + 1e-6, 6) AS value FROM sp JOIN m USING (feature)")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ab.impute_median(fx.sparse(spark, sf_dir)))


@query(f"{CLR} SELECT {CELL} FROM cl")
def clr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ab.clr(fx.abundance(spark, sf_dir)))


@query(f"WITH {fx.ABUNDANCE}, r AS (SELECT sample, log2(value) AS b FROM ab WHERE feature = 'Brand#11') SELECT feature, sample, grp, round(log2(value) - b, 6) AS value FROM ab JOIN r USING (sample) WHERE feature <> 'Brand#11'")
def alr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ab.alr(fx.abundance(spark, sf_dir), "Brand#11"))


@query(f"WITH {fx.ABUNDANCE} SELECT feature, sample, grp, round((ln(1 + value) - avg(ln(1 + value)) OVER (PARTITION BY sample)) / stddev_samp(ln(1 + value)) OVER (PARTITION BY sample), 6) AS value FROM ab")
def variance_stabilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ab.stabilized(fx.abundance(spark, sf_dir)))


@query(f"{CLR} SELECT feature, round(var_samp(value), 6) AS variance, var_samp(value) > 0.02 AS kept FROM cl GROUP BY feature")
def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ab.by_variance(ab.clr(fx.abundance(spark, sf_dir))))


@query(f"""WITH {fx.SPARSE}, q AS (SELECT feature, quantile_cont(value, 0.25) FILTER (WHERE value <> 0) AS a, quantile_cont(value, 0.75) FILTER (WHERE value <> 0) AS b FROM sp GROUP BY feature)
SELECT feature, sample, grp, round(CASE WHEN value = 0 THEN 0 ELSE greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)) END, 6) AS value FROM sp JOIN q USING (feature)""")
def iqr_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ab.iqr_capped(fx.sparse(spark, sf_dir)))


@query(f"""WITH {fx.ABUNDANCE}, o AS (SELECT feature, list(value ORDER BY value) AS o, CAST(floor(count(*) * greatest(0.05, 1.0 / count(*)) + 1e-9) AS INTEGER) AS k FROM ab GROUP BY feature)
SELECT feature, sample, grp, round(greatest(least(value, o[len(o) - k]), o[k + 1]), 6) AS value FROM ab JOIN o USING (feature)""")
def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ab.winsorized(fx.abundance(spark, sf_dir)))


@query(f"WITH {fx.SPARSE} SELECT feature, count(*) FILTER (WHERE value > 0) AS detected, round(avg(value), 6) AS mean FROM sp GROUP BY feature")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ab.coverage(fx.sparse(spark, sf_dir)))


@query(f"""WITH {fx.ABUNDANCE}, c AS (SELECT DISTINCT p_brand AS feature, p_type AS motif, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM part)
SELECT motif, sample, grp, round(sum(value * n), 4) AS value FROM ab JOIN c USING (feature) GROUP BY ALL""")
def quantify_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fx.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature"), F.col("p_type").alias("motif")).agg(F.count("*").alias("n"))
    return rounded(ab.quantified(fx.abundance(spark, sf_dir), counts), 4)


@query("SELECT event_type, count(*) FILTER (WHERE user_id % 3 = 0) AS g0, count(*) FILTER (WHERE user_id % 3 = 1) AS g1, count(*) FILTER (WHERE user_id % 3 = 2) AS g2 FROM events GROUP BY event_type")
def presence_to_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select("event_type", F.concat(F.lit("g"), F.col("user_id") % 3).alias("g"))
    return ab.presence_matrix(e, "event_type", "g", ["g0", "g1", "g2"])


@query(f"""{CLR}, {MOMENTS}, d AS (SELECT *, (m1 - m0) / greatest(sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 1e-6) AS effect FROM mm)
SELECT feature, {_r("effect")}, round((n0 + n1) / (n0 * n1)::DOUBLE + effect * effect / (2 * (n0 + n1)), 6) AS variance FROM d""")
def cohen_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.cohen_d(ab.clr(fx.abundance(spark, sf_dir))))


PAIRS = "pd AS (SELECT feature, CAST(substr(sample, 2) AS INTEGER) // 2 AS pair, max(value) FILTER (WHERE grp = 1) - max(value) FILTER (WHERE grp = 0) AS value FROM cl GROUP BY ALL)"


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ab.clr(fx.abundance(spark, sf_dir)).withColumn("pair", F.floor(F.substring("sample", 2, 9).cast("int") / 2))


@query(f"{CLR}, {PAIRS}, e AS (SELECT feature, count(*) AS n, avg(value) / stddev_samp(value) AS effect FROM pd GROUP BY feature) SELECT feature, {_r('effect')}, round(1.0 / n + effect * effect / (2 * n), 6) AS variance FROM e")
def cohen_d_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.cohen_d_paired(_paired(spark, sf_dir)))


@query(f"{CLR}, {PAIRS} SELECT feature, round(avg(value), 6) AS difference, round(avg(value) / (stddev_samp(value) / sqrt(count(*))), 6) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM pd GROUP BY feature")
def paired_t_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.paired_t(_paired(spark, sf_dir)))


@query(f"""{CLR}, {MOMENTS} SELECT feature, round(m1 - m0, 6) AS difference, round((m1 - m0) / sqrt(v0 / n0 + v1 / n1), 6) AS t,
round(pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)), 6) AS df FROM mm""")
def welch_t_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.welch(ab.clr(fx.abundance(spark, sf_dir))))


@query(f"""{CLR}, {MOMENTS}, s AS (SELECT *, sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS sp FROM mm)
SELECT feature, round((m1 - m0 + 0.2 * sp) / (sp * sqrt(1.0 / n0 + 1.0 / n1)), 6) AS t_low, round((m1 - m0 - 0.2 * sp) / (sp * sqrt(1.0 / n0 + 1.0 / n1)), 6) AS t_high, CAST(n0 + n1 - 2 AS DOUBLE) AS df FROM s""")
def equivalence_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.equivalence(ab.clr(fx.abundance(spark, sf_dir))))


def _anova(src: str) -> str:
    return f"""gm AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM {src} GROUP BY ALL),
tm AS (SELECT feature, avg(value) AS gm FROM {src} GROUP BY feature),
an AS (SELECT feature, sum(n * (m - gm) * (m - gm)) AS ssb, sum((n - 1) * v) AS ssw, CAST(count(*) - 1 AS DOUBLE) AS d1, CAST(sum(n) - count(*) AS DOUBLE) AS d2 FROM gm JOIN tm USING (feature) GROUP BY feature)"""


@query(f"{CLR}, md AS (SELECT feature, grp, abs(value - median(value) OVER (PARTITION BY feature, grp)) AS value FROM cl), {_anova('md')} SELECT feature, round(ssb / d1 / (ssw / d2), 4) AS f, d1, d2 FROM an")
def levene_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.levene(ab.clr(fx.abundance(spark, sf_dir))), 4)


@query(f"WITH {fx.COUNTS}, {_anova('ct')} SELECT feature, round(ssb, 4) AS ssb, round(ssw, 4) AS ssw, d1, d2, round(ssb / d1 / (ssw / d2), 4) AS f, round((ssb - d1 * ssw / d2) / (ssb + ssw + ssw / d2), 4) AS omega2 FROM an")
def glycanova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.anova(fx.counts(spark, sf_dir)), 4)


BH = """bh AS (SELECT *, least(min(p * n / r) OVER ({by} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS adjusted
FROM (SELECT *, row_number() OVER ({by} ORDER BY p) AS r, count(*) OVER ({by}) AS n FROM pv))"""


@query(f"WITH {fx.P_VALUES}, {BH.format(by='')} SELECT id, round(p, 9) AS p, round(adjusted, 9) AS adjusted FROM bh")
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.benjamini_hochberg(fx.p_values(spark, sf_dir)).select("id", "p", "adjusted"), 9)


@query(f"""WITH {fx.P_VALUES}, {BH.format(by="")}, k AS (SELECT avg(CASE WHEN adjusted > 0.05 / 1.05 THEN 1.0 ELSE 0.0 END) AS k FROM bh)
SELECT id, round(greatest(least(adjusted * CASE WHEN k IN (0, 1) THEN 1 ELSE k * 1.05 END, 1), p), 9) AS adjusted FROM bh, k""")
def two_stage_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.two_stage(fx.p_values(spark, sf_dir)).select("id", "adjusted"), 9)


@query(f"""WITH {fx.P_VALUES}, {BH.format(by="PARTITION BY grp")}, k AS (SELECT grp, avg(CASE WHEN adjusted > 0.05 / 1.05 THEN 1.0 ELSE 0.0 END) AS pi0 FROM bh GROUP BY grp)
SELECT id, grp, round(adjusted, 9) AS adjusted, round(pi0, 9) AS pi0, adjusted <= 0.05 / greatest(pi0, 0.3) AS significant FROM bh JOIN k USING (grp)""")
def grouped_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.grouped_two_stage(fx.p_values(spark, sf_dir), "grp").select("id", "grp", "adjusted", "pi0", "significant"), 9)


@query(f"WITH {fx.P_VALUES} SELECT 'g' || (id % 30) AS site, round(-2 * sum(ln(p)), 6) AS chi2, 2 * count(*) AS dof, round(avg(effect), 6) AS effect FROM pv GROUP BY id % 30")
def glycoform_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.fisher_combined(fx.p_values(spark, sf_dir), F.concat(F.lit("g"), F.col("id") % 30)))


@query(f"WITH {fx.P_VALUES} SELECT CAST(least(floor(p * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM pv GROUP BY 1")
def pval_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return te.p_histogram(fx.p_values(spark, sf_dir))


@query(f"""WITH {fx.P_VALUES} SELECT id, round(-log10(p), 6) AS neg_log10, CASE WHEN p < 0.05 AND effect > 1 THEN 'up' WHEN p < 0.05 AND effect < -1 THEN 'down' ELSE 'none' END AS category FROM pv""")
def volcano(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.p_values(spark, sf_dir).select("id", F.col("effect").alias("log2fc"), F.col("p").alias("adjusted"))
    return rounded(te.volcano(d, 0.05, 1.0).select("id", "neg_log10", "category"))


STUDIES = f"{fx.P_VALUES}, st AS (SELECT effect, p + 0.1 AS variance FROM pv), sm AS (SELECT sum(1 / variance) AS sw, sum(1 / variance / variance) AS sw2, sum(effect / variance) AS swe, sum(effect * effect / variance) AS swee, count(*) AS k FROM st)"


def _studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.p_values(spark, sf_dir).select("effect", (F.col("p") + 0.1).alias("variance"))


@query(f"WITH {STUDIES} SELECT round(swe / sw, 6) AS effect, round(1 / sw, 6) AS variance, round(swe / sw * sqrt(sw), 6) AS z, 0.0::DOUBLE AS tau2 FROM sm")
def meta_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.meta_analysis(_studies(spark, sf_dir)))


@query(f"""WITH {STUDIES}, t AS (SELECT greatest(0, (swee - swe * swe / sw - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM sm)
SELECT round(sum(effect / (variance + tau2)) / sum(1 / (variance + tau2)), 6) AS effect, round(1 / sum(1 / (variance + tau2)), 6) AS variance,
round(sum(effect / (variance + tau2)) / sqrt(sum(1 / (variance + tau2))), 6) AS z, round(max(tau2), 6) AS tau2 FROM st, t""")
def meta_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.meta_analysis(_studies(spark, sf_dir), "random"))


@query(f"{CLR} SELECT a.feature, round(avg(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0 END), 6) AS auc FROM cl a JOIN cl b ON a.feature = b.feature AND a.grp = 1 AND b.grp = 0 GROUP BY a.feature")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(te.roc_auc(ab.clr(fx.abundance(spark, sf_dir))))


@query()
def differential_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return te.differential(ab.clr(ab.impute_and_normalize(ab.winsorized(ab.complete(fx.abundance(spark, sf_dir))))))


@query()
def differential_expression_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return te.differential(_paired(spark, sf_dir), paired=True)


DIV = f"WITH {fx.COUNTS}, pr AS (SELECT *, value / sum(value) OVER (PARTITION BY sample) AS p FROM ct), dv AS (SELECT sample, grp, count(*) AS richness, -sum(p * ln(p)) AS shannon, 1 - sum(p * p) AS simpson FROM pr GROUP BY ALL)"


@query(f"{DIV} SELECT sample, grp, richness, {_r('shannon')}, {_r('simpson')} FROM dv")
def alpha_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dv.alpha(fx.counts(spark, sf_dir)))


@query(f"{CLR} SELECT a.sample AS a, b.sample AS b, a.grp AS ga, b.grp AS gb, round(sqrt(sum((a.value - b.value) * (a.value - b.value))), 6) AS d FROM cl a JOIN cl b ON a.feature = b.feature AND a.sample < b.sample GROUP BY ALL")
def beta_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dv.distances(ab.clr(fx.abundance(spark, sf_dir))))


DIST = f"{CLR}, ds AS (SELECT a.sample AS a, b.sample AS b, a.grp AS ga, b.grp AS gb, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS d FROM cl a JOIN cl b ON a.feature = b.feature AND a.sample < b.sample GROUP BY ALL)"


@query(f"{DIST}, n AS (SELECT count(DISTINCT grp) AS k, count(DISTINCT sample) AS n FROM cl) SELECT round((sum(d) FILTER (WHERE ga <> gb)) / (max(k) - 1) / ((sum(d) FILTER (WHERE ga = gb)) / (max(n) - max(k))), 6) AS f FROM ds, n")
def permanova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dv.permanova_stat(dv.distances(ab.clr(fx.abundance(spark, sf_dir)))))


@query(f"{DIST}, rk AS (SELECT *, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS r FROM ds) SELECT round((avg(r) FILTER (WHERE ga <> gb) - avg(r) FILTER (WHERE ga = gb)) / (count(*) / 2.0), 6) AS r FROM rk")
def anosim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dv.anosim_stat(dv.distances(ab.clr(fx.abundance(spark, sf_dir)))))


@query()
def permanova_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dv.permuted(dv.distances(ab.clr(fx.abundance(spark, sf_dir))), "permanova")


@query(f"WITH {fx.MONTHLY} SELECT feature, CAST(regr_count(value, time) AS BIGINT) AS n, round(regr_slope(value, time), 4) AS slope, round(regr_intercept(value, time), 4) AS intercept, round(regr_r2(value, time), 6) AS r2 FROM mo GROUP BY feature")
def time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = se.slopes(fx.monthly(spark, sf_dir))
    return s.select("feature", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query()
def change_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.change_over_time(fx.monthly(spark, sf_dir))


@query()
def time_series_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.polynomial(fx.monthly(spark, sf_dir), 2)


@query()
def rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.rhythm(fx.monthly(spark, sf_dir), [6, 12]).drop("p")


@query(f"""{CLR}, rk AS (SELECT feature, sample, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS v FROM cl)
SELECT a.feature AS x, b.feature AS y, round(corr(a.v, b.v), 6) AS r, count(*) AS n FROM rk a JOIN rk b ON a.sample = b.sample WHERE a.feature < b.feature GROUP BY ALL""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ab.clr(fx.abundance(spark, sf_dir))
    return rounded(se.correlations(d, d).where("x < y"))


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.principal_components(ab.clr(fx.abundance(spark, sf_dir)), 2)


@query(f"""{CLR}, b AS (SELECT p_type AS motif, p_brand AS feature, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY ALL), tg AS (SELECT feature, avg(value) FILTER (WHERE grp = 1) * 20 AS target FROM cl GROUP BY feature),
o AS (SELECT motif, n AS value, CASE WHEN target > 1.645 THEN 1 ELSE 0 END AS grp FROM b JOIN tg USING (feature)),
o1 AS (SELECT * FROM o UNION ALL SELECT motif, 1.0, g FROM (SELECT DISTINCT motif FROM o), (VALUES (0), (1)) v(g)),
o2 AS (SELECT * FROM o UNION ALL SELECT motif, x, g FROM (SELECT DISTINCT motif FROM o), (VALUES (0, 1.0), (0, 0.0), (1, 1.0), (1, 0.0)) v(g, x)),
a AS (SELECT motif, count(*) FILTER (WHERE grp = 0) AS n0, avg(value) FILTER (WHERE grp = 0) AS m0, var_samp(value) FILTER (WHERE grp = 0) AS v0, count(*) FILTER (WHERE grp = 1) AS n1, avg(value) FILTER (WHERE grp = 1) AS m1, var_samp(value) FILTER (WHERE grp = 1) AS v1 FROM o1 GROUP BY motif),
c AS (SELECT motif, count(*) FILTER (WHERE grp = 0) AS n0, avg(value) FILTER (WHERE grp = 0) AS m0, var_samp(value) FILTER (WHERE grp = 0) AS v0, count(*) FILTER (WHERE grp = 1) AS n1, avg(value) FILTER (WHERE grp = 1) AS m1, var_samp(value) FILTER (WHERE grp = 1) AS v1 FROM o2 GROUP BY motif)
SELECT a.motif, round((a.m1 - a.m0) / sqrt(a.v0 / a.n0 + a.v1 / a.n1), 4) AS t, round(pow(a.v0 / a.n0 + a.v1 / a.n1, 2) / (pow(a.v0 / a.n0, 2) / (a.n0 - 1) + pow(a.v1 / a.n1, 2) / (a.n1 - 1)), 4) AS df,
round((c.m1 - c.m0) / greatest(sqrt(((c.n0 - 1) * c.v0 + (c.n1 - 1) * c.v1) / (c.n0 + c.n1 - 2)), 1e-6), 4) AS effect FROM a JOIN c USING (motif)""")
def motif_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = ab.clr(fx.abundance(spark, sf_dir)).groupBy("feature").agg((F.avg(F.when(F.col("grp") == 1, F.col("value"))) * 20).alias("target"))
    counts = fx.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("motif"), F.col("p_brand").alias("feature")).agg(F.count("*").alias("n"))
    return rounded(te.enrichment(counts.join(target, "feature")), 4)


@query(f"WITH {fx.EDGES} SELECT src, dst, diffs FROM ed WHERE length(src) <= length(dst)")
def network_prune_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.prune_directed(fx.edges(spark, sf_dir))


@query(f"""WITH {fx.EDGES}, e AS (SELECT DISTINCT src, dst FROM ed), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)
SELECT x.src AS a, x.dst AS b, y.dst AS c, z.dst AS d FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst JOIN e z ON z.src = x.dst JOIN e w ON w.src = y.dst AND w.dst = z.dst
WHERE x.src <> z.dst AND NOT EXISTS (SELECT 1 FROM u WHERE u.src = x.src AND u.dst = z.dst) AND NOT EXISTS (SELECT 1 FROM u WHERE u.src = x.dst AND u.dst = y.dst)""")
def network_diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.diamonds(fx.edges(spark, sf_dir))


@query(f"WITH {fx.VERTICES}, a AS (SELECT node FROM ve WHERE virtual = 0), b AS (SELECT node FROM ve WHERE abundance > 0) SELECT coalesce(a.node, b.node) AS node, CASE WHEN a.node IS NULL THEN 'b' WHEN b.node IS NULL THEN 'a' ELSE 'both' END AS origin FROM a FULL OUTER JOIN b ON a.node = b.node")
def network_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.vertices(spark, sf_dir)
    return nw.alignment(v.where("virtual = 0"), v.where("abundance > 0"))


@query(f"WITH {fx.VERTICES} SELECT node FROM ve WHERE virtual = 1 AND CAST(substr(node, 2) AS INTEGER) % 2 = 0")
def network_inferred_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.vertices(spark, sf_dir)
    other = v.withColumn("virtual", F.substring("node", 2, 9).cast("int") % 2)
    return nw.inferred_nodes(v, other)


@query(f"WITH {fx.EDGES}, {fx.VERTICES}, x AS (SELECT node, CASE WHEN node = 'n0' THEN 10.0 ELSE abundance END AS x FROM ve) SELECT ed.src, ed.dst, diffs, round((coalesce(s.x, 0.1) + coalesce(d.x, 0.1)) / 2, 6) AS capacity FROM ed LEFT JOIN x s ON ed.src = s.node LEFT JOIN x d ON ed.dst = d.node")
def network_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nw.edge_capacity(fx.edges(spark, sf_dir), fx.vertices(spark, sf_dir), "n0").select("src", "dst", "diffs", "capacity"))


@query(f"""WITH {fx.EDGES}, {fx.VERTICES}, u AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), m AS (SELECT src AS node, avg(abundance) AS m FROM u JOIN ve ON dst = node WHERE abundance > 0 GROUP BY src)
SELECT node, round(CASE WHEN abundance > 0 THEN abundance ELSE greatest(coalesce(m, 0), 0.001) END, 6) AS abundance FROM ve LEFT JOIN m USING (node)""")
def network_estimate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nw.neighbor_estimates(fx.vertices(spark, sf_dir), fx.edges(spark, sf_dir)))


@query(f"""WITH RECURSIVE {fx.EDGES}, l(node, level) AS (SELECT 'n0', 0 UNION SELECT dst, level + 1 FROM l JOIN ed ON node = src WHERE level < 45) SELECT node, min(level) AS level FROM l GROUP BY node""")
def network_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.levels(fx.edges(spark, sf_dir), "n0")


@query(f"WITH {fx.EDGES} SELECT diffs, CAST(count(*) AS DOUBLE) * 0.5 AS flow FROM ed GROUP BY diffs")
def network_reaction_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.reaction_flow(fx.edges(spark, sf_dir).withColumn("flow", F.lit(0.5)))


@query()
def network_maximum_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nw.edge_capacity(fx.edges(spark, sf_dir), fx.classes(spark, sf_dir), "n0")
    return nw.maximum_flows(e.select(F.lit("all").alias("network"), "src", "dst", "capacity"), "n0", ["n20", "n35"])


@query("""WITH m AS (SELECT DISTINCT 'c' || (o_custkey % 12) AS network, 'i' || (o_orderkey % 9973) AS item FROM orders), s AS (SELECT network, count(*) AS n FROM m GROUP BY network),
x AS (SELECT a.network AS a, b.network AS b, count(*) AS s FROM m a JOIN m b ON a.item = b.item AND a.network < b.network GROUP BY ALL)
SELECT a.network AS a, b.network AS b, round(1 - coalesce(s, 0) / (a.n + b.n - coalesce(s, 0))::DOUBLE, 6) AS distance FROM s a JOIN s b ON a.network < b.network LEFT JOIN x ON x.a = a.network AND x.b = b.network""")
def jaccard_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders")
    return rounded(nw.jaccard_distances(o.select(F.concat(F.lit("c"), F.col("o_custkey") % 12).alias("network"), F.concat(F.lit("i"), F.col("o_orderkey") % 9973).alias("item"))))


@query("""WITH m AS (SELECT label, k, median(x) AS x FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY ALL)
SELECT a.label AS a, b.label AS b, round(1 - sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) AS distance FROM m a JOIN m b ON a.k = b.k AND a.label < b.label GROUP BY ALL""")
def embedding_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"))
    return rounded(nw.embedding_distances(e))


@query("""WITH h AS (SELECT n_regionkey AS rank, c_nationkey AS network, max(CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 4 = 0 THEN 1 ELSE 0 END) AS has FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT rank, round(avg(has), 6) AS share FROM h GROUP BY rank HAVING count(*) > 1""")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "customer").join(F.broadcast(fx.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    item = F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise(F.lit("other"))
    return rounded(nw.conservation(c.select(F.col("n_regionkey").alias("rank"), F.col("c_nationkey").alias("network"), item.alias("item")), "BUILDING"))


@query("""WITH d AS (SELECT DISTINCT c_custkey AS item, c_nationkey AS rank FROM customer), k AS (SELECT *, count(*) OVER (PARTITION BY rank) AS n FROM d)
SELECT item, rank, CAST(dense_rank() OVER (ORDER BY rank) - 1 AS INTEGER) AS code FROM k WHERE n >= 5""")
def hierarchy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").alias("rank"))
    return nw.hierarchy_filter(c, "rank", "item", 5)


@query()
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.stratified_split(fx.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


@query("""WITH c AS (SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS c FROM orders), o AS (SELECT o_custkey AS item, list(DISTINCT o_orderpriority) AS o FROM orders GROUP BY o_custkey)
SELECT item, array_to_string(list_transform(c, lambda x: CASE WHEN list_contains(o, x) THEN '1' ELSE '0' END), '') AS labels FROM o, c""")
def multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = nw.multilabel(fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), "o_orderpriority"), "item", "o_orderpriority")
    return m.select("item", F.array_join(F.col("labels").cast("array<string>"), "").alias("labels"))


@query()
def hotelling_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ab.clr(fx.abundance(spark, sf_dir))
    return mv.by_set(d.withColumn("set", F.substring("feature", 7, 1)))


@query()
def monte_carlo_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mv.monte_carlo(fx.sparse(spark, sf_dir))


@query()
def network_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.communities(fx.edges(spark, sf_dir).select(F.col("diffs").alias("network"), "src", "dst"))


@query()
def site_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = fx.table(spark, sf_dir, "lineitem")
    d = line.select(F.concat(F.lit("p"), F.col("l_suppkey") % 5).alias("site"), (F.col("l_returnflag") == "R").cast("double").alias("condition"), F.ln("l_extendedprice").alias("value"), F.col("l_quantity").alias("H"), F.col("l_linenumber").cast("double").alias("N"))
    return mv.site_models(d, ["H", "N"])
