"""Registered queries over sugar sequences, which no test table holds: they are made from the rows of `part`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarbeam.functions import columns as c
from sugarbeam.functions import glycan as g
from sugarbeam.plans import fixtures as fx
from sugarbeam.plans.registry import query, rounded
from sugarbeam.sources import tables
from sugarbeam.streaming import events

# Well-known sequences.
SEQUENCES = [
    "Gal(b1-4)Glc-ol", "Fuc(a1-2)Gal(b1-4)Glc-ol", "Neu5Ac(a2-3)Gal(b1-4)Glc-ol", "Gal(b1-3)GlcNAc(b1-3)Gal(b1-4)Glc-ol",
    "Fuc(a1-2)Gal(b1-3)GlcNAc(b1-3)Gal(b1-4)Glc-ol", "Gal(b1-3)[Fuc(a1-4)]GlcNAc(b1-3)Gal(b1-4)Glc-ol", "Neu5Ac(a2-3)Gal(b1-4)Glc1Cer", "GalNAc(b1-4)[Neu5Ac(a2-3)]Gal(b1-4)Glc1Cer",
    "Man(a1-3)[Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc", "Man(a1-2)Man(a1-3)[Man(a1-3)[Man(a1-6)]Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc",
    "Neu5Ac(a2-6)Gal(b1-4)GlcNAc(b1-2)Man(a1-3)[Neu5Ac(a2-6)Gal(b1-4)GlcNAc(b1-2)Man(a1-6)]Man(b1-4)GlcNAc(b1-4)[Fuc(a1-6)]GlcNAc",
    "Gal(b1-3)GalNAc", "Neu5Ac(a2-3)Gal(b1-3)GalNAc", "Neu5Ac(a2-3)Gal(b1-3)[Neu5Ac(a2-6)]GalNAc", "Gal(b1-4)GlcNAc6S(b1-6)[Gal(b1-3)]GalNAc", "Gal(b1-4)Glc", "Xyl(b1-2)[Man(a1-3)][Man(a1-6)]Man(b1-4)GlcNAc(b1-4)[Fuc(a1-3)]GlcNAc",
]
VALUES = fx.branched_sql(SEQUENCES)
WORDS = "tk AS (SELECT glycan, list_filter(string_split_regex(glycan, '[()\\[\\]{}]+'), lambda x: x <> '') AS tokens FROM gl)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.branched(spark, sf_dir, SEQUENCES)


@query(f"WITH {VALUES}, {WORDS} SELECT glycan, array_to_string(tokens, '|') AS tokens FROM tk")
def glycan_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("glycan", F.array_join(c.tokens(F.col("glycan")), "|").alias("tokens"))


@query(f"WITH {VALUES}, {WORDS}, t AS (SELECT DISTINCT unnest(tokens) AS token FROM tk) SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS id FROM t")
def glycan_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sugarbeam.operators import annotation

    return annotation.vocabulary(sequences(spark, sf_dir))


@query(f"WITH {VALUES} SELECT glycan, CAST(length(glycan) - length(replace(glycan, '(', '')) + 1 AS INTEGER) AS size, CAST(length(glycan) - length(replace(glycan, '[', '')) AS INTEGER) AS branches FROM gl")
def glycan_size_branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("glycan")
    return sequences(spark, sf_dir).select("glycan", (c.occurrences(x, "(") + 1).alias("size"), c.occurrences(x, "[").alias("branches"))


@query(f"""WITH {VALUES} SELECT glycan, CASE WHEN suffix(glycan, '-ol') THEN 'free' WHEN suffix(glycan, '1Cer') THEN 'lipid' WHEN regexp_matches(glycan, 'GlcNAc\\(b1-4\\)(\\[Fuc\\(a1-[36]\\)\\])?GlcNAc$') THEN 'N'
WHEN regexp_matches(glycan, 'Gal\\(b1-4\\)Glc$') THEN 'lipid/free' WHEN suffix(glycan, 'GalNAc') THEN 'O' ELSE '' END AS class FROM gl""")
def glycan_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("glycan", c.sequence_class(F.col("glycan")).alias("class"))


_PARTS = """pt(name, part) AS (VALUES ('Gal', 'Hex'), ('Glc', 'Hex'), ('Man', 'Hex'), ('GlcNAc', 'HexNAc'), ('GalNAc', 'HexNAc'), ('GlcNAc6S', 'HexNAc'), ('Fuc', 'dHex'), ('Xyl', 'Pen'), ('Neu5Ac', 'Neu5Ac')),
rs AS (SELECT glycan, regexp_replace(unnest(tokens), '(-ol|1Cer)$', '') AS name FROM tk),
cp AS (SELECT glycan, part, count(*) AS n FROM rs JOIN pt USING (name) GROUP BY ALL UNION ALL SELECT glycan, 'S', count(*) FROM rs WHERE name = 'GlcNAc6S' GROUP BY glycan)"""


@query(f"WITH {VALUES}, {WORDS}, {_PARTS} SELECT glycan, string_agg(part || n, '' ORDER BY part) AS composition FROM cp GROUP BY glycan")
def glycan_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("glycan", c.stringify_map(c.composition(F.col("glycan"))).alias("composition"))


@query(f"""WITH {VALUES}, {WORDS}, {_PARTS}, ms(part, m) AS (VALUES ('Hex', 162.0528234315::DOUBLE), ('HexNAc', 203.0793725321), ('dHex', 146.0579088094), ('Pen', 132.0422587453), ('Neu5Ac', 291.0954165277), ('S', 79.95681485868))
SELECT glycan, round(sum(n * m) + 18.0105646837, 4) AS mass FROM cp JOIN ms USING (part) GROUP BY glycan""")
def glycan_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequences(spark, sf_dir).select("glycan", c.mass(c.composition(F.col("glycan"))).alias("mass")), 4)


@query(f"""WITH {VALUES}, {WORDS}, {_PARTS}, ms(part, m) AS (VALUES ('Hex', 162.0528234315::DOUBLE), ('HexNAc', 203.0793725321), ('dHex', 146.0579088094), ('Pen', 132.0422587453), ('Neu5Ac', 291.0954165277), ('S', 79.95681485868)),
w AS (SELECT glycan, sum(n * m) + 18.0105646837 AS mass FROM cp JOIN ms USING (part) GROUP BY glycan), mz AS (SELECT p_partkey AS id, 300 + (p_partkey * 37 % 2200) AS mz FROM part)
SELECT id, glycan FROM mz JOIN w ON abs(mz - mass) < 0.5""")
def mz_to_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masses within a tolerance: both sides are dealt into bins of that width, each mass into its bin and its neighbours."""
    known = sequences(spark, sf_dir).select("glycan", c.mass(c.composition(F.col("glycan"))).alias("mass"))
    known = known.select("glycan", "mass", F.explode(F.array(*(F.floor(F.col("mass") / 0.5) + k for k in (-1, 0, 1)))).alias("bin"))
    mz = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (300 + F.col("p_partkey") * 37 % 2200).cast("double").alias("mz")).withColumn("bin", F.floor(F.col("mz") / 0.5))
    return mz.join(known, "bin").where(F.abs(F.col("mz") - F.col("mass")) < 0.5).select("id", "glycan")


@query()
def glycan_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.dealt(spark, sf_dir, [(s,) for s in SEQUENCES], "glycan string").select("glycan", c.canonical(F.col("glycan")).alias("canonical"))


# One sequence in the notations that are read.
NOTATIONS = [("dialect", "Manα1-3(Manα1-6)Manβ1-4GlcNAcβ1-4GlcNAc"), ("linear", "Ma3(Ma6)Mb4GNb4GN;"), ("bare", "Mana3(Mana6)Manb4GlcNAcb4GlcNAc"), ("condensed", "Man(a1-6)[Man(a1-3)]Man(b1-4)GlcNAc(b1-4)GlcNAc"), ("junk", "no sequence")]


_READ = "Man(a1-3)[Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc"


@query(fx.answers("notation, canonical", [(k, None if k == "junk" else _READ) for k, _ in NOTATIONS]))
def glycan_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.dealt(spark, sf_dir, NOTATIONS, "notation string, text string").select("notation", c.canonicalize(F.col("text")).alias("canonical"))


@query("SELECT * FROM (VALUES ('Man(a1-3)[Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc', 'Man(b1-4)GlcNAc(b1-4)GlcNAc')) t(glycan, parts)")
def glycan_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequences(spark, sf_dir).where(F.col("glycan").startswith("Man(a1-3)[Man(a1-6)]"))
    return d.select("glycan", F.array_join(c.pattern_matches(F.col("glycan"), "Hex-[HexNAc]{2}"), "|").alias("parts"))


@query()
def glycan_disaccharides(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequences(spark, sf_dir).select("glycan", F.explode(c.disaccharides(F.col("glycan"))).alias("fragment", "n"))
    return d


@query()
def glycan_k_saccharides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("glycan", F.explode(c.fragments(F.col("glycan"), 3)).alias("fragment", "n"))


@query()
def glycan_terminal_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("glycan", F.explode(c.terminal_structures(F.col("glycan"))).alias("terminal", "n"))


MOTIFS = {"LacNAc": "Gal(b1-4)GlcNAc", "core1": "Gal(b1-3)GalNAc", "sialyl": "Sia(a2-?)Gal", "trimannosyl": "Man(a1-3)[Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc", "fucosylated": "Fuc(?1-?)Monosaccharide"}


@query()
def glycan_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequences(spark, sf_dir).select("glycan", c.motif_counts(F.col("glycan"), MOTIFS).alias("n"))
    return d.select("glycan", *(F.element_at("n", k).alias(k) for k in MOTIFS))


@query()
def glycan_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each sequence's precursors, a frontier at a time, down to single residues."""
    from sugarbeam.sources.store import checkpointed, spread

    frontier = checkpointed(spread(sequences(spark, sf_dir), "glycan").select(c.canonical(F.col("glycan")).alias("dst")))
    seen, found = frontier, None
    for _ in range(20):
        step = checkpointed(spread(frontier, "dst").select("dst", F.explode(c.precursors(F.col("dst"))).alias("e")).select("e.src", "dst", "e.diffs"))
        found = step if found is None else found.union(step)
        frontier = checkpointed(step.select(F.col("src").alias("dst")).distinct().join(seen, "dst", "left_anti"))
        if not frontier.limit(1).count():
            break
        seen = checkpointed(seen.union(frontier))
    return found


@query("SELECT p_partkey AS id, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS INTEGER) AS n, CASE WHEN len(string_split(p_name, 'e')) > 2 THEN CAST(length(string_split(p_name, 'e')[1]) + 1 + length(string_split(p_name, 'e')[2]) AS INTEGER) ELSE -1 END AS second, replace(replace(p_name, 'old', 'OLD'), 'wid', 'W') AS replaced FROM part")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.table(spark, sf_dir, "part")
    x = F.col("p_name")
    return p.select(F.col("p_partkey").alias("id"), c.occurrences(x, "e").alias("n"), c.find_nth(x, "e", 2).alias("second"), c.multireplace(x, {"old": "OLD", "wid": "W"}).alias("replaced"))


@query(f"WITH {VALUES} SELECT glycan, regexp_replace(regexp_replace(regexp_replace(glycan, '\\[[^\\[\\]]*\\]', '', 'g'), '\\[[^\\[\\]]*\\]', '', 'g'), '\\[[^\\[\\]]*\\]', '', 'g') AS trunk FROM gl")
def bracket_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("glycan", c.fragments_in_brackets_removed(F.col("glycan")).alias("trunk"))


@query("SELECT o_custkey AS item, o_orderpriority AS a, o_orderstatus AS b FROM orders")
def explode_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.collect_list(F.struct("o_orderpriority", "o_orderstatus")).alias("s"))
    return tables.exploded(o.select("item", F.col("s.o_orderpriority").alias("a"), F.col("s.o_orderstatus").alias("b")), "item", ["a", "b"])


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("k"))
    r = fx.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name")
    return tables.first_match(n, r, "k", "r_name", "r_name").select("n_name", "r_name")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.windowed_counts(fx.table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("""WITH c AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS k FROM events GROUP BY ALL), s AS (SELECT *, sum(k) OVER (PARTITION BY start) AS n FROM c)
SELECT start, CAST(max(n) AS BIGINT) AS n, round(-sum(k / n * ln(k / n)), 9) AS shannon FROM s GROUP BY start""")
def windowed_shannon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all event types that the table has."""
    e = fx.table(spark, sf_dir, "events")
    types = [r["event_type"] for r in e.select("event_type").where("event_type is not null").distinct().orderBy("event_type").collect()]
    d = events.windowed_shannon(e, types).where("n > 0")
    return d.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n", F.round("shannon", 9).alias("shannon"))


@query(f"""WITH {VALUES}, {WORDS}, t AS (SELECT glycan, unnest(tokens) AS token FROM tk), n AS (SELECT token, count(*) AS n FROM t GROUP BY token)
SELECT token, n FROM n WHERE NOT regexp_matches(token, '^[ab?][12?]-') AND 100 * n <= (SELECT sum(n) FROM n)""")
def rare_monosaccharides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues that are at most a hundredth of all tokens."""
    t = sequences(spark, sf_dir).select(F.explode(c.tokens(F.col("glycan"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    t = t.join(F.broadcast(t.agg(F.sum("n").alias("all"))), F.expr("100 * n <= all"))  # one row
    return t.where(~F.col("token").rlike("^[ab?][12?]-")).select("token", "n")


@query()
def glycan_topologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sugarbeam.functions import letters

    return sequences(spark, sf_dir).select("glycan", c._mapped(letters.topology, "string")(F.col("glycan")).alias("topology"))
