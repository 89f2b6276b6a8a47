"""Registered queries over the trees of sequences and their text forms. The SQL reads the same sequences into residues, linkages and
parents by its own rules, so that it checks the parser, too; where only a table of answers can, these were worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarbeam.functions import columns as c
from sugarbeam.functions import formats, letters, notations, special, strings, structure
from sugarbeam.functions import glycan as g
from sugarbeam.operators import annotation as an
from sugarbeam.operators import biosynthesis as bio
from sugarbeam.operators import compositions as co
from sugarbeam.plans import fixtures as fx
from sugarbeam.plans.registry import QUERIES, SQL, query, rounded
from sugarbeam.plans.sequences import SEQUENCES, VALUES, WORDS, sequences

#: res(glycan, i, name, link, parent): residues by place, their bare names, linkages and the places of their parents. A residue's parent is the
#: first later residue whose bracket depth is as low as any on the way.
TREE = f"""WITH {VALUES},
t0 AS (SELECT glycan, regexp_extract_all(glycan, '\\([^()]*\\)|\\[|\\]|[^()\\[\\]]+') AS t FROM gl),
t1 AS (SELECT glycan, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS tok FROM t0),
t2 AS (SELECT *, sum(CASE tok WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER (PARTITION BY glycan ORDER BY i) AS d, lead(tok) OVER (PARTITION BY glycan ORDER BY i) AS nx FROM t1),
t3 AS (SELECT glycan, i, d, regexp_replace(tok, '(-ol|1Cer)$', '') AS name, CASE WHEN nx LIKE '(%' THEN substr(nx, 2, length(nx) - 2) END AS link FROM t2 WHERE NOT regexp_matches(tok, '^[(\\[\\]]')),
res AS (SELECT a.glycan, a.i, a.name, a.link, (SELECT min(b.i) FROM t3 b WHERE b.glycan = a.glycan AND b.i > a.i AND b.d = (SELECT min(x.d) FROM t2 x WHERE x.glycan = a.glycan AND x.i BETWEEN a.i AND b.i)) AS parent FROM t3 a)"""


def replace_sql(name: str, sql: str) -> None:
    """Give a query that is registered already its SQL."""
    assert name in QUERIES
    SQL[name] = sql


replace_sql("glycan_disaccharides", f"{TREE} SELECT c.glycan, c.name || '(' || c.link || ')' || p.name AS fragment, CAST(count(*) AS INTEGER) AS n FROM res c JOIN res p ON p.glycan = c.glycan AND p.i = c.parent GROUP BY ALL")
replace_sql("glycan_terminal_structures", f"{TREE} SELECT glycan, name || '(' || link || ')' AS terminal, CAST(count(*) AS INTEGER) AS n FROM res r WHERE link IS NOT NULL AND NOT EXISTS (SELECT 1 FROM res k WHERE k.glycan = r.glycan AND k.parent = r.i) GROUP BY ALL")
replace_sql("glycan_motifs", f"""{TREE}, e AS (SELECT c.glycan, c.i, c.name, c.link, c.parent, p.name AS pname FROM res c JOIN res p ON p.glycan = c.glycan AND p.i = c.parent),
tri AS (SELECT a.glycan, count(*) AS n FROM e a JOIN e b ON b.glycan = a.glycan AND b.parent = a.parent AND b.i <> a.i JOIN e m ON m.glycan = a.glycan AND m.i = a.parent JOIN e k ON k.glycan = a.glycan AND k.i = m.parent
  WHERE a.name = 'Man' AND a.link = 'a1-3' AND b.name = 'Man' AND b.link = 'a1-6' AND m.name = 'Man' AND m.link = 'b1-4' AND k.name = 'GlcNAc' AND k.link = 'b1-4' AND k.pname = 'GlcNAc' GROUP BY a.glycan)
SELECT g.glycan, CAST(count(*) FILTER (WHERE e.name = 'Gal' AND link = 'b1-4' AND pname = 'GlcNAc') AS INTEGER) AS LacNAc, CAST(count(*) FILTER (WHERE e.name = 'Gal' AND link = 'b1-3' AND pname = 'GalNAc') AS INTEGER) AS core1,
CAST(count(*) FILTER (WHERE e.name = 'Neu5Ac' AND link LIKE 'a2-%' AND pname = 'Gal') AS INTEGER) AS sialyl, CAST(coalesce(max(tri.n), 0) AS INTEGER) AS trimannosyl, CAST(count(*) FILTER (WHERE e.name = 'Fuc') AS INTEGER) AS fucosylated
FROM gl g LEFT JOIN e ON e.glycan = g.glycan LEFT JOIN tri ON tri.glycan = g.glycan GROUP BY g.glycan""")

replace_sql("glycan_k_saccharides", f"""{TREE}, x AS (SELECT *, CASE WHEN regexp_matches(link, '[0-9]$') THEN CAST(regexp_extract(link, '([0-9]+)$', 1) AS INTEGER) ELSE 99 END AS pos, name || '(' || link || ')' AS w FROM res),
f AS (SELECT c.glycan, c.w || p.w || q.name AS fragment FROM x c JOIN x p ON p.glycan = c.glycan AND p.i = c.parent JOIN x q ON q.glycan = p.glycan AND q.i = p.parent
UNION ALL SELECT a.glycan, a.w || '[' || b.w || ']' || p.name FROM x a JOIN x b ON b.glycan = a.glycan AND b.parent = a.parent AND a.i <> b.i AND (a.pos < b.pos OR (a.pos = b.pos AND (a.link < b.link OR (a.link = b.link AND (a.w < b.w OR (a.w = b.w AND a.i < b.i)))))) JOIN x p ON p.glycan = a.glycan AND p.i = a.parent)
SELECT glycan, fragment, CAST(count(*) AS INTEGER) AS n FROM f GROUP BY ALL""")
# By hand: the longest chain goes on outside of brackets, then the branch at the smaller position; one sequence is written otherwise.
_OTHERWISE = {"GalNAc(b1-4)[Neu5Ac(a2-3)]Gal(b1-4)Glc1Cer": "Neu5Ac(a2-3)[GalNAc(b1-4)]Gal(b1-4)Glc1Cer"}
replace_sql("glycan_canonical", fx.answers("glycan, canonical", [(s, _OTHERWISE.get(s, s)) for s in SEQUENCES]))
replace_sql("rhythm", f"""WITH {fx.MONTHLY}, ph AS (SELECT period, unnest(range(0, period)) AS phase FROM (VALUES (6), (12)) t(period)), w AS (SELECT feature, time, value, period, phase, cos(2 * pi() * (time - phase) / period) AS c FROM mo, ph),
p AS (SELECT a.feature, a.period, a.phase, sign(b.value - a.value) AS sy, sign(round(b.c - a.c, 9)) AS sw FROM w a JOIN w b ON a.feature = b.feature AND a.period = b.period AND a.phase = b.phase AND a.time < b.time),
t AS (SELECT feature, period, phase, CAST(sum(sy * sw) AS DOUBLE) AS s, CAST(sum(sy * sw) AS DOUBLE) / sum(abs(sw)) AS tau FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY tau DESC, period, phase) AS k FROM t)
SELECT feature, CAST(period AS INTEGER) AS period, CAST(phase AS DOUBLE) AS phase, tau, s FROM r WHERE k = 1""")


def table(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """The cases that the parts are dealt, each once: for what works on a set of sequences."""
    return fx.dealt(spark, sf_dir, rows, schema).distinct()


# Own cases of the class rules, with the classes that follow from the table of reducing ends.
CLASS_CASES = [
    ("[Gal(b1-4)]Glc(b1-3)Gal", "repeat"), ("Gal(b1-4)Glc-ol", "free"), ("Gal(b1-4)Glc1Cer", "lipid"), ("Man(a1-2)Ins", "lipid"), ("Ins(a1-2)Man", "O"), ("Man(b1-4)GlcNAc(b1-4)GlcNAc", "N"),
    ("Gal(b1-4)[Fuc(a1-6)]GlcNAc", "N"), ("Gal(b1-4)[Fuc(a1-3)]GlcNAc", "N"), ("Gal(b1-4)[Fuc(a1-2)]GlcNAc", "O"), ("Gal(b1-3)GalNAc4S", "O"), ("Gal(b1-3)GalNAcOS", "O"), ("Gal3S(b1-4)Glc", "lipid/free"),
    ("GalOS(b1-4)[Fuc(a1-3)]Glc", "lipid/free"), ("Gal(b1-4)Glc6S", "lipid/free"), ("Gal(b1-4)[Fuc(a1-2)]Glc", ""), ("Xyl", ""),
]


@query(fx.answers("glycan, class", CLASS_CASES))
def class_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.dealt(spark, sf_dir, [(a,) for a, _ in CLASS_CASES], "glycan string").select("glycan", c.sequence_class(F.col("glycan")).alias("class"))


SUITS = [("Gal(b1-3)GalNAc", True, False, False), ("Man(b1-4)GlcNAc(b1-4)GlcNAc", False, True, False), ("Gal(b1-4)Glc-ol", False, False, True), ("Gal(b1-4)Glc1Cer", False, False, True), ("Gal(b1-4)GlcNAc", True, True, True), ("Xyl(b1-4)Xyl", False, False, False)]


@query(fx.answers("glycan, o, n, free", SUITS))
def class_enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("glycan")
    return fx.dealt(spark, sf_dir, [(r[0],) for r in SUITS], "glycan string").select("glycan", *(strings.has_class(x, k).alias(k.lower()) for k in ("O", "N", "free")))


@query("SELECT p_partkey AS id, CASE WHEN len(string_split(p_name, 'e')) > 2 THEN CAST(length(p_name) - length(string_split(reverse(p_name), 'e')[1]) - 1 - length(string_split(reverse(p_name), 'e')[2]) - 1 AS INTEGER) ELSE -1 END AS place FROM part")
def find_from_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), strings.find_nth_reverse(F.col("p_name"), "e", 2).alias("place"))


BRACKETS = [("Gal(b1-3)[Fuc(a1-4)]GlcNAc", "Gal(b1-3)[Fuc(a1-4)]GlcNAc", 0, 1), ("[Fuc(a1-4)GlcNAc", "Fuc(a1-4)GlcNAc", 0, 0), ("Fuc(a1-4)]GlcNAc]", "Fuc(a1-4)GlcNAc", 0, 0), ("[a[b(c)]d]e", "[a[b(c)]d]e", 1, 2), ("]a[", "a", 0, 0)]


@query(fx.answers("text, matched, content, pairs", BRACKETS))
def bracket_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    d = fx.dealt(spark, sf_dir, [(r[0],) for r in BRACKETS], "text string")
    return d.select("text", c._mapped(strings.matched_brackets_only, "string")(x).alias("matched"), c._mapped(strings.nested_content, "int")(x).alias("content"), c._mapped(lambda t: len(strings.matching_brackets(t, "[", "]")), "int")(x).alias("pairs"))


REPEATS = [("Glc(b1-3)Gal(b1-4)Glc", "Glc(b1-3)Gal(b1-4)", True), ("Glc(b1-3)Gal(b1-4)Glc", "Gal(b1-4)Glc(b1-3)", True), ("Glc(b1-3)Gal(b1-4)Glc", "Gal(b1-3)Glc(b1-4)", False), ("Xyl(b1-4)", "Xyl(b1-4)", True)]


@query(fx.answers("a, b, same", REPEATS))
def repeat_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.dealt(spark, sf_dir, [r[:2] for r in REPEATS], "a string, b string").select("a", "b", strings.equal_repeats(F.col("a"), F.col("b")).alias("same"))


# Own cases of the shorthand forms, each read by hand.
FORMS = [
    ("disaccharide", "D2A6", "4uHexA2S(?1-?)GlcNAc6S"), ("disaccharide", "G0a10", "GlcA(?1-?)GalNAc4S6S"), ("disaccharide", "I2S9", "IdoA2S(?1-?)GlcNS3S6S"), ("disaccharide", "Z2S6", None),
    ("stub", "(Hex)1 (Deoxyhexose)1 + (Man)3(GlcNAc)2", "{Hex(?1-?)}{Fuc(?1-?)}Man(a1-3)[Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc"), ("root_first", "Y41Y41M(61M)31M", "Man(a1-3)[Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc"),
    ("repeat", "-4)Glc(b1-3)Gal(b1-", "Glc(b1-3)Gal(b1-4)Glc"), ("repeat", "Gal(b1-4)Glc", "Gal(b1-4)Glc"), ("possible", "Gal(b1-2)GlcNAc", "Gal(b1-?)GlcNAc"), ("possible", "Gal(b1-6)GlcNAc6S", "Gal(b1-?)GlcNAc6S"),
    ("possible", "Gal(b1-3)[Fuc(a1-3)]GlcNAc", "Gal(b1-?)[Fuc(a1-?)]GlcNAc"), ("possible", "Gal(b1-4)[Fuc(a1-3)]GlcNAc", "Gal(b1-4)[Fuc(a1-3)]GlcNAc"), ("specified", "Neu5Ac(a2-?)Gal(b1-?)GlcNAc", "Neu5Ac(a2-3/6)Gal(b1-3/4)GlcNAc"),
    ("specified", "Neu5Ac(a2-?)Neu5Ac(a2-3)Gal", "Neu5Ac(a2-8)Neu5Ac(a2-3)Gal"), ("specified", "dHex(a1-2)Gal", "Fuc(a1-2)Gal"), ("open", "Gal3S(b1-4)GlcNAc6S", "GalOS(b1-4)GlcNAcOS"), ("open", "Neu5Ac9Ac(a2-3)Gal", "Neu5AcOAc(a2-3)Gal"),
]


@query(fx.answers("form, text, condensed", FORMS))
def shorthand_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    how = {
        "disaccharide": strings.sulfated_disaccharide(x), "stub": c._mapped(lambda t: strings.core_stub(t) if "+" in t else None, "string")(x), "root_first": c._mapped(strings.root_first, "string")(x),
        "repeat": c._mapped(lambda t: strings.unrolled_repeat(t)[0], "string")(x), "possible": c._mapped(strings.possible_bonds, "string")(x), "specified": strings.specified(x), "open": c._mapped(structure.open_modifications, "string")(x),
    }
    out = None
    for k, v in how.items():
        out = F.when(F.col("form") == k, v) if out is None else out.when(F.col("form") == k, v)
    return fx.dealt(spark, sf_dir, [r[:2] for r in FORMS], "form string, text string").select("form", "text", out.alias("condensed"))


_KCF = "ENTRY G1 Glycan\nNODE 4\n1 GlcNAc 0 0\n2 Gal -8 1\n3 Fuc -8 -1\n4 Neu5Ac -16 1\nEDGE 3\n1 2:b1 1:4\n2 3:a1 1:3\n3 4:a2 2:3\n///"
_XML = '<sugar><residues><basetype id="1" anomer="b"><stemtype id="1" type="dglc"/></basetype><substituent id="2" name="n-acetyl"/><basetype id="3" anomer="b"><stemtype id="1" type="dgal"/></basetype><basetype id="4" anomer="a"><stemtype id="1" type="lgal"/></basetype></residues><linkages><connection id="1" parent="1" child="2"><linkage parentType="d" childType="n"><parent pos="2"/><child pos="1"/></linkage></connection><connection id="2" parent="1" child="3"><linkage parentType="o" childType="d"><parent pos="4"/><child pos="1"/></linkage></connection><connection id="3" parent="1" child="4"><linkage parentType="o" childType="d"><parent pos="3"/><child pos="1"/></linkage></connection></linkages></sugar>'
_GWB = "freeEnd--?b1D-Glc,p--4b1D-Gal,p(--2a1L-Fuc,p)--3a2D-NeuAc,p$MONO,Und,0,0,freeEnd"
GRAPHS = [("kcf", _KCF, "Neu5Ac(a2-3)Gal(b1-4)[Fuc(a1-3)]GlcNAc"), ("xml", _XML, "Fuc(a1-3)[Gal(b1-4)]GlcNAc"), ("workbench", _GWB, "Fuc(a1-2)[NeuAc(a2-3)]Gal(b1-4)Glc-ol"), ("kcf", "NODE 2\n1 Gal\n2 Glc\nEDGE 0", None), ("xml", "<sugar>", None)]


@query(fx.answers("form, condensed", [(a, r) for a, _, r in GRAPHS]))
def graph_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    read = {"kcf": formats.from_kcf, "xml": formats.from_glycoct_xml, "workbench": formats.from_workbench}
    d = fx.dealt(spark, sf_dir, [r[:2] for r in GRAPHS], "form string, text string")
    one = c._mapped(lambda t: read["xml" if t.startswith("<") else "workbench" if "--" in t else "kcf"](t), "string")
    return d.select("form", one(x).alias("condensed"))


GLYCOFORMS = [("P1_N20_H5N4F1A2", "P1_N20", 5, 4, 2, 1, 1, 0, 0), ("P1_N20_H9N2", "P1_N20", 9, 2, 0, 0, 0, 1, 1), ("P2_N7_H6N5F2A1", "P2_N7", 6, 5, 1, 2, 0, 0, 1), ("P2_N7_H3N2", "P2_N7", 3, 2, 0, 0, 0, 0, 0)]


@query(fx.answers("id, site, h, n, a, f, complex, high_man, hybrid", GLYCOFORMS))
def glycoform_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.dealt(spark, sf_dir, [(r[0],) for r in GLYCOFORMS], "id string")
    f = strings.glycoform_features(c.read_composition(F.substring_index("id", "_", -1)))
    d = d.select("id", strings.glycosite(F.col("id")).alias("site"), f.alias("f"))
    return d.select("id", "site", *(F.element_at("f", k).alias(k.lower()) for k in ("H", "N", "A", "F", "complex", "high_Man", "hybrid")))


GRAFTS = [
    ("{Neu5Ac(a2-3)}Gal(b1-4)[Fuc(a1-3)]GlcNAc", "Fuc(a1-3)[Neu5Ac(a2-3)Gal(b1-4)]GlcNAc|Neu5Ac(a2-3)Fuc(a1-3)[Gal(b1-4)]GlcNAc"), ("{Fuc(a1-4)}Gal(b1-4)GlcNAc", "Fuc(a1-4)Gal(b1-4)GlcNAc"), ("{OS}Gal(b1-4)GlcNAc", "Gal(b1-4)GlcNAcOS|GalOS(b1-4)GlcNAc"), ("{3S}Gal(b1-4)GlcNAc", "Gal3S(b1-4)GlcNAc"),
    ("Gal(b1-4)GlcNAc", None),
]


def _sorted_texts(rows: list[tuple[str, str | None]]) -> list[tuple[str, str | None]]:
    """The answers in canonical text, sorted: the order of branches is the writer's."""
    return [(a, "|".join(sorted(g.canonical(x) for x in b.split("|"))) if b else None) for a, b in rows]


@query(fx.answers("glycan, topologies", _sorted_texts(GRAFTS)))
def possible_topologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = c._mapped(structure.topologies, "array<string>")(F.col("glycan"))
    return fx.dealt(spark, sf_dir, [(r[0],) for r in GRAFTS], "glycan string").select("glycan", F.array_join(t, "|").alias("topologies"))


COMMON = [("Fuc(a1-2)Gal(b1-4)Glc", "Neu5Ac(a2-3)Gal(b1-4)Glc", "Gal(b1-4)Glc"), ("Gal(b1-3)[Fuc(a1-4)]GlcNAc(b1-3)Gal", "Gal(b1-3)GlcNAc(b1-3)Gal(b1-4)Glc", "Gal(b1-3)GlcNAc(b1-3)Gal"), ("Man(a1-3)[Man(a1-6)]Man", "Man(a1-6)Man", "Man(a1-6)Man"), ("Xyl", "Gal", "")]


@query(fx.answers("a, b, common", COMMON))
def largest_common_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.dealt(spark, sf_dir, [r[:2] for r in COMMON], "a string, b string").select("a", "b", c.largest_common(F.col("a"), F.col("b")).alias("common"))


DIFFS = [("Gal(b1-4)Glc-ol", "Fuc(a1-2)Gal(b1-4)Glc-ol", "Fuc(a1-2)"), ("Gal(b1-4)Glc-ol", "Neu5Ac(a2-8)Neu5Ac(a2-3)Gal(b1-4)Glc-ol", "Neu5Ac(a2-8)Neu5Ac(a2-3)"), ("Gal(b1-4)Glc-ol", "Gal(b1-3)GlcNAc", "disregard"), ("Gal(b1-4)GlcNAc", "Gal(b1-4)GlcNAc", ""), ("GlcNAc", "Gal6S(b1-4)GlcNAc", "disregard")]


@query(fx.answers("src, dst, diffs", DIFFS))
def network_edge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bio.labelled(fx.dealt(spark, sf_dir, [(*r[:2], None) for r in DIFFS], "src string, dst string, diffs string"))


@query(f"""{TREE}, k AS (SELECT parent AS i, glycan, count(*) AS kids FROM res WHERE parent IS NOT NULL GROUP BY ALL), n AS (SELECT r.glycan, r.i, r.link, coalesce(kids, 0) AS kids FROM res r LEFT JOIN k ON k.glycan = r.glycan AND k.i = r.i),
d AS (SELECT glycan, kids + CASE WHEN link IS NULL THEN 0 ELSE 1 END AS deg FROM n UNION ALL SELECT glycan, 2 FROM n WHERE link IS NOT NULL), nt AS (SELECT glycan, name FROM res UNION SELECT glycan, link FROM res WHERE link IS NOT NULL)
SELECT glycan, CAST(count(*) AS DOUBLE) AS nodes, CAST(count(*) FILTER (WHERE deg > 2) AS DOUBLE) AS branching, CAST(count(*) FILTER (WHERE deg = 1) AS DOUBLE) AS leaves, round(avg(deg), 6) AS mean_degree, CAST(max(deg) AS DOUBLE) AS most, CAST(count(*) - 1 AS DOUBLE) AS edges,
CAST((SELECT count(*) FROM nt WHERE nt.glycan = d.glycan) AS DOUBLE) AS types FROM d GROUP BY glycan""")
def glycan_graph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = c._mapped(lambda t: structure.shape(t.replace("-ol", "").replace("1Cer", "")), "map<string,double>")(F.col("glycan"))
    names = {"N": "nodes", "branching": "branching", "nbrLeaves": "leaves", "avgDeg": "mean_degree", "maxDeg": "most", "dens": "edges", "nbr_node_types": "types"}
    return rounded(sequences(spark, sf_dir).select("glycan", s.alias("s")).select("glycan", *(F.element_at("s", k).alias(v) for k, v in names.items())))


@query(f"""{TREE}, m AS (SELECT glycan, name AS motif, CAST(count(*) AS INTEGER) AS n FROM (SELECT glycan, regexp_replace(regexp_replace(tok, '-ol$', '-ol'), '1Cer$', '1Cer') AS name FROM t2 WHERE NOT regexp_matches(tok, '^[(\\[\\]]')) GROUP BY ALL) SELECT * FROM m""")
def annotation_monosaccharides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.monosaccharides(sequences(spark, sf_dir))


def _bins(bins: int) -> str:
    one = lambda kind, x: f"""SELECT glycan, '{kind}_' || CAST(floor(a - 0.5 + w * k + 0.5) AS INTEGER) || '-' || CAST(floor(a - 0.5 + w * (k + 1) - 0.5) AS INTEGER) AS motif, 1 AS n FROM (SELECT glycan, a, w, least(floor((x - a + 0.5) / w), {bins - 1}) AS k
      FROM (SELECT glycan, {x} AS x, min({x}) OVER () AS a, (max({x}) OVER () - min({x}) OVER () + 1) / {bins}.0 AS w FROM gl))"""  # noqa: E731
    return f"WITH {VALUES} {one('Size', "length(glycan) - length(replace(glycan, '(', '')) + 1")} UNION ALL {one('Branch', "length(glycan) - length(replace(glycan, '[', ''))")}"


@query(_bins(3))
def annotation_size_branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.size_branching(sequences(spark, sf_dir), 3)


OPEN = [
    ("Gal(b1-3)GlcNAc", "Gal(b1-3/4)GlcNAc"), ("Gal(b1-4)GlcNAc", "Gal(b1-3/4)GlcNAc"), ("Gal(?1-?)GlcNAc", "Gal(b1-3/4)GlcNAc"), ("Fuc(a1-2)Gal", "Fuc(a1-2)Gal"), ("Man(a1-3)Man(b1-4)GlcNAc", "Man(?1-2/3)Man(b1-4)GlcNAc"), ("Man(b1-2)Man(b1-4)GlcNAc", "Man(?1-2/3)Man(b1-4)GlcNAc"),
    ("Xyl(?1-?)Xyl", "Xyl(?1-?)Xyl"), ("GalNAc", "GalNAc"),
]


@query(fx.answers("motif, open", OPEN, each=False))
def fragment_open_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.open_form(table(spark, sf_dir, [(r[0],) for r in OPEN], "motif string"))


@query(f"""{TREE}, e AS (SELECT c.glycan, c.name || '(' || c.link || ')' || p.name AS m, c.name || '|' || p.name AS bare, c.link FROM res c JOIN res p ON p.glycan = c.glycan AND p.i = c.parent),
v AS (SELECT bare, CASE WHEN count(DISTINCT link[1]) = 1 THEN min(link[1]) ELSE '?' END AS a, string_agg(DISTINCT link[2], '/' ORDER BY link[2]) AS s, string_agg(DISTINCT link[4], '/' ORDER BY link[4]) AS o FROM e GROUP BY bare),
f AS (SELECT glycan, m AS motif, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT glycan, string_split(bare, '|')[1] || '(' || a || s || '-' || o || ')' || string_split(bare, '|')[2], count(*) FROM e JOIN v USING (bare) GROUP BY ALL)
SELECT glycan, motif, CAST(max(n) AS INTEGER) AS n FROM f GROUP BY ALL""")
def fragment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.with_open_linkages(an.fragment_counts(sequences(spark, sf_dir), 2))


GROUPED = [
    ("Gal(b1-3)[GlcNAc(b1-6)]GalNAc", "core2", "rest"), ("Gal(b1-3)GalNAc", "core1", "rest"), ("Neu5Ac(a2-3)Gal(b1-3)GalNAc", "core1", "Sia"), ("Gal3S(b1-3)[GlcNAc6S(b1-6)]GalNAc", "core2", "rest"), ("Fuc(a1-2)Gal(b1-3)GalNAc", "core1", "Fuc"), ("GlcNAc(b1-3)GalNAc", "rest", "rest"), ("Fuc(a1-2)[Neu5Ac(a2-3)]Gal(b1-3)GalNAc", "core1", "SiaFuc"),
]


@query(fx.answers("glycan, core, sia_fuc", GROUPED))
def o_linked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("glycan")
    return fx.dealt(spark, sf_dir, [(r[0],) for r in GROUPED], "glycan string").select("glycan", an.core_group(x).alias("core"), an.sia_fuc_group(x).alias("sia_fuc"))


_N = "Man(b1-4)GlcNAc(b1-4)GlcNAc"
N_TYPES = [(f"GlcNAc(b1-2)Man(a1-3)[GlcNAc(b1-2)Man(a1-6)]{_N}", "complex"), (f"GlcNAc(b1-2)Man(a1-3)[Man(a1-3)Man(a1-6)]{_N}", "hybrid"), (f"Man(a1-2)Man(a1-3)[Man(a1-3)[Man(a1-6)]Man(a1-6)]{_N}", "high_man"), (f"Man(a1-3)[Man(a1-6)]{_N}", "rest")]


@query(fx.answers("glycan, type", N_TYPES))
def n_linked_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.dealt(spark, sf_dir, [(r[0],) for r in N_TYPES], "glycan string").select("glycan", an.n_group(F.col("glycan")).alias("type"))


@query(f"""{TREE}, f AS (SELECT c.glycan, c.name || '(' || c.link || ')' || p.name AS m, count(*) AS n FROM res c JOIN res p ON p.glycan = c.glycan AND p.i = c.parent GROUP BY ALL), nn AS (SELECT glycan, sqrt(sum(n * n)) AS l FROM f GROUP BY glycan),
dt AS (SELECT x.glycan AS a, y.glycan AS b, sum(x.n * y.n) AS dot FROM f x JOIN f y USING (m) GROUP BY ALL)
SELECT a.glycan AS a, b.glycan AS b, round(coalesce(dot, 0) / (a.l * b.l), 6) AS similarity FROM nn a JOIN nn b ON a.glycan <> b.glycan LEFT JOIN dt ON dt.a = a.glycan AND dt.b = b.glycan
WHERE b.glycan IN ({", ".join(f"'{s}'" for s in SEQUENCES)})""")
def glycan_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence beside each of the well-known ones, a list of fixed length."""
    d = sequences(spark, sf_dir)
    pairs = d.select(F.col("glycan").alias("a"), F.explode(F.array(*map(F.lit, SEQUENCES))).alias("b")).where("a <> b")
    return rounded(an.similarity(an.fragment_counts(d, 2), pairs))


@query(f"""{TREE}, e AS (SELECT c.name, c.link, p.name AS parent FROM res c JOIN res p ON p.glycan = c.glycan AND p.i = c.parent WHERE c.name = 'Gal'), u AS (SELECT 'bond' AS kind, link AS name FROM e UNION ALL SELECT 'parent', parent FROM e)
SELECT kind, name, count(*) AS n FROM u GROUP BY ALL HAVING count(*) >= 2""")
def monosaccharide_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.neighbours(sequences(spark, sf_dir), "Gal", least=2)


@query(f"WITH {VALUES}, {WORDS}, old AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT unnest(tokens) AS token FROM tk WHERE suffix(glycan, '-ol'))), al AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS k FROM (SELECT DISTINCT unnest(tokens) AS token FROM tk)) SELECT al.token, CAST(coalesce(old.id, k + (SELECT count(*) FROM old)) AS INTEGER) AS id FROM al LEFT JOIN old USING (token)")
def vocabulary_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequences(spark, sf_dir)
    return an.expanded_vocabulary(an.vocabulary(d.where(F.col("glycan").endswith("-ol"))), d)


@query(f"WITH {VALUES}, {WORDS}, old AS (SELECT list(DISTINCT token) AS o FROM (SELECT unnest(tokens) AS token FROM tk WHERE suffix(glycan, '-ol'))) SELECT glycan, len(list_filter(tokens, lambda x: NOT list_contains(o, x))) = 0 AS covered FROM tk, old")
def vocabulary_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequences(spark, sf_dir)
    return an.covered(d, an.vocabulary(d.where(F.col("glycan").endswith("-ol"))))


@query(f"WITH {VALUES}, k AS (SELECT glycan FROM gl WHERE NOT suffix(glycan, 'GalNAc')) SELECT glycan, glycan IN (SELECT glycan FROM k) AS present FROM gl")
def presence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequences(spark, sf_dir)
    return an.present(d, d.where(~F.col("glycan").endswith("GalNAc")))


ROOT_TABLES = [("Gal(b1-4)Glc-ol", "free"), ("Gal(b1-3)GalNAc", "o"), ("Man(b1-4)GlcNAc(b1-4)GlcNAc", "n"), ("Gal(b1-4)Glc1Cer", "lipid")]


@query("SELECT * FROM (VALUES ('free', 'Gal(b1-4)Glc-ol'), ('free', 'Gal(b1-4)GlcNAc-ol'), ('o', 'GalNAc'), ('o', 'Fuc'), ('o', 'Man'), ('n', 'Man(b1-4)GlcNAc(b1-4)GlcNAc'), ('lipid', 'Glc1Cer'), ('lipid', 'Gal1Cer'), ('lipid', 'Ins')) t(kind, root)")
def network_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for x, kind in ROOT_TABLES:
        one = bio.permitted_roots(table(spark, sf_dir, [(x,)], "glycan string")).select(F.lit(kind).alias("kind"), "root")
        out = one if out is None else out.unionByName(one)
    return out


_L = "Gal(b1-4)Glc-ol"
BUILT = [(_L, f"Fuc(a1-2){_L}", "Fuc(a1-2)"), (_L, f"Neu5Ac(a2-3){_L}", "Neu5Ac(a2-3)"), (_L, f"GlcNAc(b1-3){_L}", "GlcNAc(b1-3)"), (f"GlcNAc(b1-3){_L}", f"Gal(b1-3)GlcNAc(b1-3){_L}", "Gal(b1-3)"), (f"Gal(b1-3)GlcNAc(b1-3){_L}", f"Fuc(a1-2)Gal(b1-3)GlcNAc(b1-3){_L}", "Fuc(a1-2)")]
MILK = [_L, f"Fuc(a1-2){_L}", f"Neu5Ac(a2-3){_L}", f"Gal(b1-3)GlcNAc(b1-3){_L}", f"Fuc(a1-2)Gal(b1-3)GlcNAc(b1-3){_L}"]


@query(fx.answers("src, dst, diffs, virtual", [(*r, int(r[0] not in MILK)) for r in BUILT], each=False))
def network_construction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milk sugars: one vertex, with GlcNAc, is virtual; each edge tells whether its source is."""
    v, e = bio.construct(table(spark, sf_dir, [(x,) for x in MILK], "glycan string"))
    return e.join(v.select(F.col("node").alias("src"), "virtual"), "src").select("src", "dst", "diffs", "virtual")


@query(fx.answers("src, dst, diffs", [("Gal(b1-4)GlcNAc-ol", "Gal3S(b1-4)GlcNAc-ol", "3S"), ("Gal(b1-4)GlcNAc-ol", "Gal(b1-4)GlcNAc6S-ol", "6S")], each=False))
def network_modified_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bio.modified_edges(table(spark, sf_dir, [("Gal(b1-4)GlcNAc-ol",), ("Gal3S(b1-4)GlcNAc-ol",), ("Gal(b1-4)GlcNAc6S-ol",)], "node string"))


EXTENDED = [(f"Fuc(a1-2){_L}", f"Fuc(a1-2)[Neu5Ac(a2-3)]{_L}", "Neu5Ac(a2-3)"), (f"Neu5Ac(a2-3){_L}", f"Fuc(a1-2)[Neu5Ac(a2-3)]{_L}", "Fuc(a1-2)")]


@query(fx.answers("src, dst, diffs", [(a, g.canonical(b), d) for a, b, d in EXTENDED], each=False))
def network_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step from two leaves by the network's own two reactions, at the one place that each disaccharide allows."""
    e = table(spark, sf_dir, [(_L, f"Fuc(a1-2){_L}", "Fuc(a1-2)"), (_L, f"Neu5Ac(a2-3){_L}", "Neu5Ac(a2-3)")], "src string, dst string, diffs string")
    v = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("virtual", F.lit(0))
    _, new = bio.extended(v, e)
    return new.join(e.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "diffs")


MAN5, MAN6 = f"Man(a1-3)[Man(a1-3)[Man(a1-6)]Man(a1-6)]{_N}", f"Man(a1-2)Man(a1-3)[Man(a1-3)[Man(a1-6)]Man(a1-6)]{_N}"
TRIM = [(_N, f"Man(a1-6){_N}", "Man(a1-6)"), (MAN5, MAN6, "Man(a1-2)")]


@query(fx.answers("src, dst, diffs", [*TRIM, (MAN6, MAN5, "Man(a1-2)")], each=False))
def network_mannose_trimming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bio.with_mannose_trimming(table(spark, sf_dir, TRIM, "src string, dst string, diffs string"))


@query(f"""WITH {VALUES}, {WORDS}, pt(name, part) AS (VALUES ('Gal', 'Hex'), ('Glc', 'Hex'), ('Man', 'Hex'), ('GlcNAc', 'HexNAc'), ('GalNAc', 'HexNAc'), ('GlcNAc6S', 'HexNAc'), ('Fuc', 'dHex'), ('Xyl', 'Pen'), ('Neu5Ac', 'Neu5Ac')),
ms(part, m) AS (VALUES ('Hex', 204.0997736889::DOUBLE), ('HexNAc', 245.1263227895), ('dHex', 174.0892089810), ('Pen', 160.0735589169), ('Neu5Ac', 361.1736668567)), rs AS (SELECT glycan, regexp_replace(unnest(tokens), '(-ol|1Cer)$', '') AS name FROM tk),
w AS (SELECT glycan, sum(m) + 46.0418648118 + sum(CASE name WHEN 'GlcNAc6S' THEN 79.95681485868 - 14.01565006 ELSE 0 END) AS mass FROM rs JOIN pt USING (name) JOIN ms USING (part) GROUP BY glycan) SELECT glycan, round(mass, 3) AS mass FROM w""")
def permethylated_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequences(spark, sf_dir).select("glycan", co.derivatized_mass(c.composition(F.col("glycan")), "permethylated").alias("mass")), 3)


@query(f"""WITH {VALUES}, {WORDS}, pt(name, part) AS (VALUES ('Gal', 'Hex'), ('Glc', 'Hex'), ('Man', 'Hex'), ('GlcNAc', 'HexNAc'), ('GalNAc', 'HexNAc'), ('GlcNAc6S', 'HexNAc'), ('Fuc', 'dHex'), ('Xyl', 'Pen'), ('Neu5Ac', 'Neu5Ac')),
rs AS (SELECT glycan, regexp_replace(unnest(tokens), '(-ol|1Cer)$', '') AS name FROM tk), cp AS (SELECT glycan, part, count(*) AS n FROM rs JOIN pt USING (name) GROUP BY ALL UNION ALL SELECT glycan, 'S', count(*) FROM rs WHERE name = 'GlcNAc6S' GROUP BY glycan),
ms(part, m) AS (VALUES ('Hex', 162.0528234315::DOUBLE), ('HexNAc', 203.0793725321), ('dHex', 146.0579088094), ('Pen', 132.0422587453), ('Neu5Ac', 291.0954165277), ('S', 79.95681485868)),
k AS (SELECT DISTINCT key, mass FROM (SELECT glycan, string_agg(part || n, '' ORDER BY part) AS key, round(sum(n * m) + 18.0105646837, 9) AS mass FROM cp JOIN ms USING (part) GROUP BY glycan)),
mz AS (SELECT p_partkey AS id, 300 + (p_partkey * 37 % 2200)::DOUBLE AS mz FROM part), a AS (SELECT id, 0 AS how, mz AS x FROM mz UNION ALL SELECT id, 2, (mz + 0.5) * 2 FROM mz),
h AS (SELECT id, key, how, row_number() OVER (PARTITION BY id ORDER BY how, abs(mass - x), key) AS r FROM a JOIN k ON abs(mass - x) < 0.5) SELECT id, key AS composition, CASE how WHEN 0 THEN 'plain' ELSE 'doubly_charged' END AS how FROM h WHERE r = 1""")
def mz_to_compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mz = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (300 + F.col("p_partkey") * 37 % 2200).cast("double").alias("mz"))
    return co.mz_to_compositions(mz, sequences(spark, sf_dir).select(c.composition(F.col("glycan")).alias("composition")))


MATCHED = [(1, "Gal(b1-3)GlcNAc(b1-3)Gal(b1-4)Glc-ol"), (2, "Neu5Ac(a2-3)Gal(b1-3)GalNAc")]


@query(fx.answers("id, glycan", MATCHED, each=False))
def compositions_to_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex3HexNAc1 has one sequence; of two equal up to a wildcard the better defined one stays; Hex9 has none."""
    known = sequences(spark, sf_dir).where(F.col("glycan").isin([x for _, x in MATCHED])).union(table(spark, sf_dir, [("Neu5Ac(a2-?)Gal(b1-3)GalNAc",)], "glycan string"))
    asked = fx.dealt(spark, sf_dir, [(1, {"Hex": 3, "HexNAc": 1}), (2, {"Neu5Ac": 1, "Hex": 1, "HexNAc": 1}), (3, {"Hex": 9})], "id int, composition map<string,int>").dropDuplicates(["id"])
    return co.compositions_to_structures(asked, known).select("id", "glycan")


@query(fx.answers("topology", [("Hex(?1-?)Hex-ol",), ("Hex(?1-?)Hex",)], each=False))
def unique_topologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.unique_topologies(sequences(spark, sf_dir).union(table(spark, sf_dir, [("Gal(b1-3)Gal-ol",)], "glycan string")), {"Hex": 2})


PRIORS = [(20, "JAB", 0.05), (20, "min", 0.1), (20, "robust", 0.223607), (20, "balanced", 0.396333), (1000, "min", 0.002), (1000, "balanced", 0.05605)]


@query(fx.answers("n, method, prior", PRIORS))
def bayes_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.dealt(spark, sf_dir, [(n, m, special.jab_prior(n, m)) for n, m, _ in PRIORS], "n int, method string, prior double"))


#: exp(x^2 / 2) / n^(1/4) for the two-sided normal quantiles 1.959963985 and 2.575829304.
FACTORS = [(0.05, 3.227786), (0.01, 13.046439)]


@query(fx.answers("p, factor", FACTORS))
def bayes_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.dealt(spark, sf_dir, [(p,) for p, _ in FACTORS], "p double")
    return rounded(d.select("p", special.bayes_factors(F.col("p"), 20, z=True).alias("factor")))


LINES = [("\n a\nb\n\nc \n", "a|b||c"), ("x", "x")]


@query(fx.answers("text, lines", LINES))
def pasted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.dealt(spark, sf_dir, [(a,) for a, _ in LINES], "text string").select("text", F.array_join(strings.lines(F.col("text")), "|").alias("lines"))


@query("SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_brand, ''), lambda x: coalesce(CAST(nullif(strpos('Brand#123', x) - 1, -1) AS VARCHAR), '-')), ',') AS labels FROM part")
def character_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = strings.labels(F.col("p_brand"), {ch: i for i, ch in enumerate("Brand#123")})
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(x, lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",").alias("labels"))


STEMS = [("GlcNAc6S(b1-3)Gal", "GlcNAc(b1-3)Gal"), ("Gal3S(b1-4)Glc", "Gal3S(b1-4)Glc"), ("Gal3S(b1-3)Gal", "Gal3S(b1-3)Gal"), ("Neu5Ac9Ac(a2-3)Gal", "Neu5Ac(a2-3)Gal")]


@query(fx.answers("glycan, stem", STEMS, each=False))
def stemified_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modified residues that occur once become their cores; Gal3S occurs twice and stays."""
    d = table(spark, sf_dir, [(a, a) for a, _ in STEMS], "glycan string, stem string")
    return letters.stemified(d, "stem", 1)


@query(f"WITH {VALUES}, w AS (SELECT glycan FROM gl UNION ALL SELECT replace(glycan, r, 'Hex') FROM gl, (VALUES ('Gal'), ('Man')) v(r) WHERE contains(glycan, r)) SELECT glycan, count(*) AS n FROM w GROUP BY glycan")
def wildcard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.wildcard_rows(sequences(spark, sf_dir), ["Gal", "Man"], "Hex", 1.0).groupBy("glycan").agg(F.count("*").alias("n"))


IDENTIFIED = [("Gal(b1-4)Glc-ol", "G1"), ("Xyl", "Xyl")]


@query(fx.answers("glycan, id", IDENTIFIED))
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, [("Gal(b1-4)Glc-ol", "G1"), ("Gal(b1-3)GalNAc", "G2")], "glycan string, id string")
    return co.ids_of(fx.dealt(spark, sf_dir, [(a,) for a, _ in IDENTIFIED], "glycan string"), known, "glycan", "id")


@query(fx.answers("glycan, motif, n", [("{Fuc(a1-2)}Gal(b1-4)GlcNAc", "lacnac", 1), ("{Fuc(a1-2)}Gal(b1-4)GlcNAc", "h", 1)], each=False))
def uncertain_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A floating fucose: what is bound counts; the H motif counts since the one feasible sequence of these residues has it."""
    d = table(spark, sf_dir, [("{Fuc(a1-2)}Gal(b1-4)GlcNAc",)], "glycan string")
    f = table(spark, sf_dir, [("Fuc(a1-2)Gal(b1-4)GlcNAc",), ("Gal(b1-4)[Fuc(a1-3)]GlcNAc",), ("Gal(b1-4)Glc",)], "glycan string")
    motifs = [("lacnac", "Gal(b1-4)GlcNAc", []), ("h", "Fuc(a1-2)Gal", []), ("x", "Fuc(a1-3)GlcNAc", [])]
    return an.uncertain_counts(d, f, motifs)


# Spellings of one composition.
SPELLED = [("Hex5HexNAc4Fuc1Neu5Ac2", 5, 4, 1, 2), ("H5N4F1A2", 5, 4, 1, 2), ("5_4_2_1", 5, 4, 1, 2), ("5421", 5, 4, 1, 2), ("5 4 2 0 1", 5, 4, 1, 2), ("9200", 9, 2, 0, 0)]


@query(fx.answers("text, hex, hexnac, dhex, sia", SPELLED))
def composition_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.dealt(spark, sf_dir, [(r[0],) for r in SPELLED], "text string").select("text", c.read_composition(F.col("text")).alias("m"))
    return d.select("text", *(F.coalesce(F.element_at("m", k), F.lit(0)).alias(v) for k, v in {"Hex": "hex", "HexNAc": "hexnac", "dHex": "dhex", "Neu5Ac": "sia"}.items()))


ROUND_TRIPS = [s for s in SEQUENCES if "[" not in s]


@query(fx.answers("glycan, canonical", [(s, s) for s in ROUND_TRIPS]))
def linear_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbranched sequences are their own canonical text, whichever reader takes them."""
    read = c._mapped(notations.canonicalize, "string")
    return fx.dealt(spark, sf_dir, [(s,) for s in ROUND_TRIPS], "glycan string").select("glycan", read(F.col("glycan")).alias("canonical"))


# The named motifs that some sequences hold, read off the list by hand.
KNOWN = [
    ("Gal(b1-4)[Fuc(a1-3)]GlcNAc(b1-3)Gal", "Terminal_LewisX", 1), ("Fuc(a1-2)Gal(b1-4)[Fuc(a1-3)]GlcNAc(b1-3)Gal", "LewisY", 1), ("Neu5Ac(a2-3)Gal(b1-4)[Fuc(a1-3)]GlcNAc(b1-3)Gal", "SialylLewisX", 1), ("Neu5Ac(a2-3)Gal(b1-4)[Fuc(a1-3)]GlcNAc(b1-3)Gal", "Internal_LewisX", 1),
    ("Gal(b1-3)GalNAc", "Oglycan_core1", 1),
]


@query(fx.answers("glycan, motif, n", KNOWN, each=False))
def known_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Lewis motifs and the first core among all named motifs; a fucose on the galactose or a branch to position 6 forbids the inner Lewis X and core 1."""
    d = table(spark, sf_dir, [(x,) for x in dict.fromkeys([r[0] for r in KNOWN] + ["Gal(b1-3)[GlcNAc(b1-6)]GalNAc"])], "glycan string")
    return an.annotate(d, ["known"]).where(F.col("motif").isin("Terminal_LewisX", "Internal_LewisX", "LewisY", "SialylLewisX", "Oglycan_core1")).select("glycan", "motif", "n")


@query("SELECT 'Gal(b1-3)GalNAc' AS glycan, 2 AS n")
def random_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two draws of one sequence from a class of one give it each time."""
    known = table(spark, sf_dir, [("Gal(b1-3)GalNAc",), ("Gal(b1-4)Glc-ol",), ("Gal(b1-4)Glc1Cer",)], "glycan string")
    draws = co.random_sequences(known, 1, 1, "O").unionByName(co.random_sequences(known, 1, 2, "O"))
    return draws.groupBy("glycan").agg(F.count("*").cast("int").alias("n"))


@query(fx.answers("token, specific", [("b1-?", True), ("Hex", True), ("Gal", False), ("a2-3/6", True)]))
def specified_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open letters become specified ones that they stand for; specified ones stay."""
    known = ["b1-3", "b1-4", "a2-3", "a2-6", "?1-?"]

    def stands(t: str) -> bool:
        x = letters.specific(t, known)
        return x != t and (g.same_linkage(x, t) if "-" in t else x in g.CLASSES[t])

    d = fx.dealt(spark, sf_dir, [("b1-?",), ("Hex",), ("Gal",), ("a2-3/6",)], "token string")
    return d.select("token", c._mapped(stands, "boolean")(F.col("token")).alias("specific"))
