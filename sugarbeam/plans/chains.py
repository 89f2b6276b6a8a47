"""Registered queries of whole analyses, from sequences to tested motifs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarbeam.operators import annotation as an
from sugarbeam.operators import variance as va
from sugarbeam.operators import workflow as wf
from sugarbeam.plans import fixtures as fx
from sugarbeam.plans import structures  # noqa: F401  gives queries their SQL
from sugarbeam.plans.registry import SQL, query, rounded
from sugarbeam.plans.sequences import SEQUENCES, sequences

_SETS = " UNION ALL ".join(f"SELECT glycan, {name} AS motif, n FROM ({SQL[q]})" for q, name in (("annotation_monosaccharides", "motif"), ("fragment_rollup", "motif"), ("glycan_terminal_structures", "'Terminal_' || terminal"), ("annotation_size_branching", "motif")))
#: Own motifs of the custom set.
OWN = [("lacnac", "Gal(b1-4)GlcNAc", []), ("core1", "Gal(b1-3)GalNAc", []), ("fucose_a2", "Fuc(a1-2)Gal", [])]
_OWN = " UNION ALL ".join(f"SELECT glycan, '{name}', n FROM ({SQL['glycan_disaccharides']}) WHERE fragment = '{m}'" for name, m, _ in OWN)


@query(f"SELECT glycan, motif, CAST(max(n) AS INTEGER) AS n FROM ({_SETS} UNION ALL {_OWN}) GROUP BY ALL")
def annotated_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feature sets but the named motifs of the parts' sequences in one table."""
    return wf.annotated(sequences(spark, sf_dir), ["exhaustive", "terminal", "size_branch", "custom"], OWN)


@query()
def annotated_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named motifs of the parts' sequences, through the label index; tested against all pairs."""
    return wf.annotated(sequences(spark, sf_dir), ["known"])


@query(f"""WITH {fx.sequence_abundance_sql(SEQUENCES)}, an AS (SELECT glycan, 'Terminal_' || terminal AS motif, n FROM ({SQL["glycan_terminal_structures"]})),
q AS (SELECT motif, sample, grp, sum(value * n) AS value FROM sa JOIN an ON feature = glycan GROUP BY ALL) SELECT motif AS feature, sample, grp, round(value, 4) AS value FROM q""")
def quantified_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by the terminal residues of the parts' sequences."""
    return rounded(wf.quantified(fx.sequence_abundance(spark, sf_dir, SEQUENCES), ["terminal"], remove_redundant=False), 4)


@query()
def differential_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of samples compared by all residues, disaccharides and terminal residues of the parts' sequences: one call from abundances to tests."""
    out = wf.differential_expression(fx.sequence_abundance(spark, sf_dir, SEQUENCES), features=["exhaustive", "terminal"], impute=False)
    return rounded(out, 9)


@query()
def differential_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the sequences themselves, from a wide table, a column for each sample."""
    d = fx.sequence_abundance(spark, sf_dir, SEQUENCES)
    wide = d.groupBy("feature").pivot("sample", [f"s{k}" for k in range(10)]).agg(F.first("value"))
    return rounded(wf.differential_expression(wide, [f"s{k}" for k in range(0, 10, 2)], [f"s{k}" for k in range(1, 10, 2)], impute=False), 9)


@query()
def variance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances of log revenue over the parts' sequences, samples and the rest, with fixed means of sequences with and without sialic acid and fucose; sequences
    that a sample lacks are missing cells. Tested against dense matrices."""
    d = fx.sequence_abundance(spark, sf_dir, SEQUENCES).select("feature", "sample", an.sia_fuc_group(F.col("feature")).alias("group"), F.log2("value").alias("x"))
    return rounded(spark.createDataFrame([va.components(d)], "features double, samples double, rest double"), 5)
