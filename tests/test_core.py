import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sugarbeam.functions import columns as c
from sugarbeam.functions import glycan as g
from sugarbeam.functions import special
from sugarbeam.operators import abundance as ab
from sugarbeam.operators import networks as nw
from sugarbeam.operators import testing as te
from sugarbeam.sources import tables
from sugarbeam.streaming import events


def test_distribution_functions():
    assert special.t_two_sided(2.0, 1.0) == pytest.approx(1 - 2 / math.pi * math.atan(2.0), abs=1e-12)
    assert special.t_two_sided(1.5, 2.0) == pytest.approx(1 - 1.5 / math.sqrt(2 + 2.25), abs=1e-12)
    assert special.f_upper(4.0, 2.0, 6.0) == pytest.approx((1 + 2 * 4 / 6) ** -3, abs=1e-12)
    assert special.chi2_upper(3.0, 2.0) == pytest.approx(math.exp(-1.5), abs=1e-12)
    assert special.chi2_upper(1.0, 1.0) == pytest.approx(math.erfc(math.sqrt(0.5)), abs=1e-12)
    assert special.normal_two_sided(0.0) == 1.0
    assert special.t_two_sided(0.0, 5.0) == pytest.approx(1.0)
    assert 0 < special.alpha_n(1000) < special.alpha_n(20) < 1


@pytest.mark.parametrize("text,kind", [("Glc-ol", "free"), ("Glc1Cer", "lipid"), ("Gal(b1-4)Glc", "lipid/free"), ("UnknownGlycan", ""), ("Man(b1-4)GlcNAc(b1-4)GlcNAc", "N"), ("Gal(b1-3)GalNAc", "O"), ("[Gal(b1-4)]Glc(b1-3)Gal", "repeat"), ("Gal(b1-4)", "")])
def test_classes(spark, text, kind):
    assert g.sequence_class(text) == kind
    assert spark.createDataFrame([(text,)], "x string").select(c.sequence_class(F.col("x"))).first()[0] == kind


@pytest.mark.parametrize("text,parts", [("H5N4F1A2", {"Hex": 5, "HexNAc": 4, "dHex": 1, "Neu5Ac": 2}), ("Hex5HexNAc4Fuc1Neu5Ac2", {"Hex": 5, "HexNAc": 4, "dHex": 1, "Neu5Ac": 2}), ("H8N2H1", {"Hex": 9, "HexNAc": 2}), ("9_2_0_0", {"Hex": 9, "HexNAc": 2}), ("9200", {"Hex": 9, "HexNAc": 2}), ("9 2 0 1 0", {"Hex": 9, "HexNAc": 2, "Neu5Gc": 1}), ("??", {})])
def test_composition_spellings(text, parts):
    assert g.read_composition(text) == parts


def test_composition_and_mass():
    assert g.composition("Neu5Ac(a2-3)Gal6S(b1-4)GlcNAc") == {"Neu5Ac": 1, "Hex": 1, "S": 1, "HexNAc": 1}
    assert g.composition("Foo(a1-3)Gal") == {}
    assert g.mass({"Hex": 1}) == pytest.approx(180.0634, abs=1e-4)
    assert g.mass({"Hex": 5, "HexNAc": 2}) == pytest.approx(1234.4333, abs=1e-3)


def test_motifs():
    core = "Man(a1-3)[Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc"
    assert g.motif_count(core, "Man(a1-3)[Man(a1-6)]Man") == 1
    assert g.motif_count(core, "Man(a1-?)Man") == 2
    assert g.motif_count(core, "Man(a1-?)[Man(a1-?)]Man") == 2  # interchangeable branches count twice
    assert g.motif_count(core, "Hex") == 3 and g.motif_count(core, "GlcNAc") == 2
    assert g.motif_count(core, "Gal") == 0 and g.motif_count("GalNAc", "Gal") == 0
    # A residue without the forbidden child, whether or not it has others: two of three Man, all of them, and the GlcNAc that has Gal instead.
    assert g.motif_count(core, "!Man(a1-3)Man") == 2 and g.motif_count(core, "!Gal(a1-3)Man") == 3 and g.motif_count("Gal(b1-4)GlcNAc", "!Man(a1-3)GlcNAc") == 1
    arms = "Neu5Ac(a2-3)Gal(b1-3)GlcNAc(b1-2)Man(a1-3)[Gal(b1-4)GlcNAc(b1-2)Man(a1-6)]Man"
    assert g.motif_count(arms, "!Neu5Ac(a2-?)Gal(?1-?)GlcNAc") == 1 and g.motif_count(arms, "Neu5Ac(a2-?)!Gal(b1-4)GlcNAc") == 1 and g.motif_count(arms, "Neu5Ac(a2-?)!Gal(b1-3)GlcNAc") == 0
    assert g.motif_count(core, "Man", ["terminal"]) == 2 and g.motif_count(core, "Man", ["internal"]) == 1
    assert g.motif_count("Gal(b1-3/4)GlcNAc", "Gal(b1-4)GlcNAc") == 1
    assert g.motif_count(core, "Man(a1-3)") == 1
    assert g.motif_count("{Fuc(a1-3)}Gal(b1-4)GlcNAc", "Fuc") == 1


def test_canonical_and_equality():
    a = "Gal(b1-3)[Fuc(a1-4)]GlcNAc(b1-3)Gal"
    b = "Fuc(a1-4)[Gal(b1-3)]GlcNAc(b1-3)Gal"
    assert g.canonical(a) == g.canonical(b) and g.same_sequence(a, b)
    assert g.same_sequence("Gal(b1-?)Glc", "Gal(b1-4)Glc") and not g.same_sequence("Gal(a1-4)Glc", "Gal(b1-4)Glc")
    for bad in ("", "Gal(b1-4)[Fuc", "Gal]", "(b1-4)", "A[B(a1-3)]"):
        with pytest.raises(g.NotASequence):
            g.canonical(bad)


NAMES = st.sampled_from(["Gal", "Glc", "GlcNAc", "Fuc", "Man", "Neu5Ac"])
LINKS = st.sampled_from(["a1-3", "b1-4", "a2-6", "a1-2"])
TREES = st.recursive(st.builds(g.Residue, NAMES, LINKS), lambda kids: st.builds(g.Residue, NAMES, LINKS, st.lists(kids, max_size=3)), max_leaves=8)


@settings(max_examples=80, deadline=None)
@given(TREES)
def test_round_trip(tree):
    root = g.Residue(tree.name, "", tree.children)
    text = g.write(root)
    assert g.canonical(text) == text and len(g.residues(g.parse(text)[-1])) == len(g.residues(root))
    assert g.motif_count(text, text) >= 1
    assert sum(g.fragments(text, 1).values()) == len(g.residues(root))
    assert g.fragments(text, 2) == g.fragments(g.canonical(text), 2) and sum(g.fragments(text, 2).values()) == len(g.residues(root)) - 1


def test_fragments_and_ends():
    t = "Neu5Ac(a2-3)Gal(b1-4)[Fuc(a1-3)]GlcNAc"
    assert g.disaccharides(t) == {"Neu5Ac(a2-3)Gal": 1, "Gal(b1-4)GlcNAc": 1, "Fuc(a1-3)GlcNAc": 1}
    assert g.fragments(t, 3) == {"Neu5Ac(a2-3)Gal(b1-4)GlcNAc": 1, "Fuc(a1-3)[Gal(b1-4)]GlcNAc": 1}
    assert g.terminal_structures(t) == {"Neu5Ac(a2-3)": 1, "Fuc(a1-3)": 1}
    assert g.terminal_structures(t, 2) == {"Neu5Ac(a2-3)Gal(b1-4)": 1, "Fuc(a1-3)GlcNAc": 1}
    assert g.precursors("Fuc(a1-2)Gal(b1-4)Glc-ol") == [("Gal(b1-4)Glc-ol", "Fuc(a1-2)")]


def test_column_functions(spark):
    d = spark.createDataFrame([("a-b-c-d",), ("",), (None,)], "x string")
    x = F.col("x")
    rows = d.select(c.replace_every_second(x, "-", "+"), c.find_nth(x, "-", 2), c.occurrences(x, "-"), c.strip_suffix(F.concat(x, F.lit(".12")))).collect()
    assert tuple(rows[0]) == ("a-b+c-d", 3, 3, "a-b-c-d") and tuple(rows[1]) == ("", -1, 0, "") and rows[2][0] is None
    n = spark.createDataFrame([("A[B[C]D[E]]F[G]",)], "x string").select(c.nested_brackets(F.col("x")), c.fragments_in_brackets_removed(F.col("x"))).first()
    assert tuple(n) == (2, "AF")
    out = spark.createDataFrame([("Gal(b1-4)Glc",), ("junk[",), (None,)], "x string").select(c.canonical(F.col("x")).alias("y")).collect()
    assert [r.y for r in out] == ["Gal(b1-4)Glc", None, None]


def test_transformations(spark):
    d = spark.createDataFrame([("f1", "s1", 0, 1.0), ("f1", "s2", 1, 3.0), ("f2", "s1", 0, 4.0), ("f3", "s2", 1, 0.0)], "feature string, sample string, grp int, value double")
    full = ab.complete(d)
    assert full.count() == 6 and full.where("value = 0").count() == 3
    assert {r.feature for r in ab.drop_empty(full).collect()} == {"f1", "f2"}
    n = {(r.feature, r["sample"]): r.value for r in ab.impute_and_normalize(ab.drop_empty(full)).collect()}
    assert n["f1", "s1"] == pytest.approx(20.0) and sum(v for (_, s), v in n.items() if s == "s2") == pytest.approx(100)
    z = ab.clr(d.where("value > 0")).groupBy("sample").agg(F.sum("value").alias("v")).collect()
    assert all(abs(r.v) < 1e-12 for r in z)


def test_corrections(spark):
    p = [0.01, 0.02, 0.03, 0.5]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "id int, p double")
    got = [r.adjusted for r in te.benjamini_hochberg(d).orderBy("id").collect()]
    assert got == pytest.approx([0.04, 0.04, 0.04, 0.5])
    two = [r.adjusted for r in te.two_stage(d).orderBy("id").collect()]
    assert all(a >= b for a, b in zip(two, p)) and two[0] == pytest.approx(0.04 * 0.25 * 1.05)


def test_correction_turns_to_bonferroni_if_nearly_all_are_significant(spark):
    ps = [0.001 * (i + 1) for i in range(20)]
    got = te.correct_multiple_testing(spark.createDataFrame(list(enumerate(ps)), "id int, p double")).orderBy("id").collect()
    assert [round(r.adjusted, 9) for r in got] == [round(20 * p, 9) for p in ps] and not any(r.significant for r in got)
    some = spark.createDataFrame(list(enumerate(ps[:18] + [0.5, 0.9])), "id int, p double")
    few, two = (f(some).orderBy("id").collect() for f in (te.correct_multiple_testing, te.two_stage))
    assert [r.adjusted for r in few] == [r.adjusted for r in two] and sum(r.significant for r in few) == 18
    rows = [(f"f{k}", f"s{i}", i % 2, 5.0 * (i % 2) + 0.01 * k * i) for k in range(1, 6) for i in range(8)]
    out = te.differential(spark.createDataFrame(rows, "feature string, sample string, grp int, value double")).collect()
    assert len(out) == 5 and all(abs(r.adjusted - min(5 * r.p, 1)) < 1e-12 for r in out)


def test_differential_finds_the_changed_feature(spark):
    rng = np.random.default_rng(0)
    rows = [(f"f{i}", f"s{j}", j % 2, float(rng.normal() + (8 if i == 3 and j % 2 else 0))) for i in range(6) for j in range(12)]
    out = te.differential(spark.createDataFrame(rows, "feature string, sample string, grp int, value double")).collect()
    assert out[0].feature == "f3" and out[0].adjusted < 1e-4 and out[0].log2fc == pytest.approx(8, abs=1.5)
    assert all(r.p <= r.adjusted + 1e-12 for r in out)


def test_flow_and_levels(spark):
    e = [("s", "a", 3.0), ("s", "b", 2.0), ("a", "b", 5.0), ("a", "t", 2.0), ("b", "t", 3.0)]
    total, flow = nw.max_flow(e, "s", "t")
    assert total == 5.0 and sum(v for (u, _), v in flow.items() if u == "s") == 5.0
    d = spark.createDataFrame(e, "src string, dst string, capacity double")
    assert {r.node: r.level for r in nw.levels(d, "s").collect()} == {"s": 0, "a": 1, "b": 1, "t": 2}
    assert nw.max_flow(e, "x", "t")[0] == 0


def test_tables_round_trip(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_bytes("﻿glycan,C1,T1\nGal,1,2\nGlc,,4\n".encode())
    w = tables.read_wide(spark, str(p))
    assert w.columns == ["glycan", "C1", "T1"]
    long = tables.to_long(w, {"C1": 0, "T1": 1})
    assert sorted((r.feature, r["sample"], r.grp, r.value) for r in long.collect()) == [("Gal", "C1", 0, 1.0), ("Gal", "T1", 1, 2.0), ("Glc", "C1", 0, 0.0), ("Glc", "T1", 1, 4.0)]
    assert tables.to_wide(long, ["C1", "T1"]).count() == 2
    schema = {"a": "array<string>", "m": "map<string,int>", "n": "int"}
    d = spark.createDataFrame([(["x", "y"], {"k": 1}, 3), ([], None, None)], "a array<string>, m map<string,int>, n int")
    tables.write_cells(d, str(tmp_path / "cells"))
    assert sorted(map(str, tables.read_cells(spark, str(tmp_path / "cells"), schema).collect())) == sorted(map(str, d.collect()))
    assert list(tables.catalog(spark, str(tmp_path))) == ["w"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id*5,0,0) AS ts, concat('t', id % 3) AS event_type FROM range(20)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = events.windowed_shannon(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["t0", "t1", "t2"])
    q = s.writeStream.format("memory").queryName("shannon").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {r.start: round(r.shannon, 9) for r in spark.table("shannon").collect()}
    assert got == {r.start: round(r.shannon, 9) for r in events.windowed_shannon(rows, ["t0", "t1", "t2"]).collect()} and len(got) > 1


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "feature"
