import pytest
from pyspark.sql import functions as F

from sugarbeam.functions import letters as le
from sugarbeam.functions.patterns import matches
from sugarbeam.operators import lectins


def test_names():
    assert le.core("Gal6S") == "Gal" and le.core("GlcNAc6S") == "GlcNAc" and le.core("b1-4") == "b1-4" and le.core("Odd") == "Odd"
    assert le.modification("Gal6S") == "6S" and le.modification("Gal") == ""
    assert le.stem("Gal6S(b1-4)GlcNAc6S-ol") == "Gal(b1-4)GlcNAc-ol"
    assert le.base("Gal") == "Hex" and le.base("GlcNAc6S", True) == "HexNAcOS" and le.base("a2-3") == "?2-?" and le.base("Fuc") == "dHex" and le.base("Neu5Ac") == "Neu5Ac"
    assert le.topology("Fuc(a1-3)[Gal(b1-4)]GlcNAc") == "Hex(?1-?)[dHex(?1-?)]HexNAc"
    assert le.possible_linkages("a1-?", ["a1-2", "a1-3", "b1-3", "a1-?"]) == ["a1-2", "a1-3"]
    assert "Man" in le.possible_monosaccharides("Hex") and le.possible_monosaccharides("Man") == ["Man"]
    assert le.rare_letters(["Gal(b1-4)Glc", "Gal(b1-4)Glc", "Fuc(a1-2)Gal"], 1, 1) == ({"Fuc"}, {"a1-2"})
    assert le.adduct_mass("-H2O") == pytest.approx(-18.010565, abs=1e-5)
    with pytest.raises(ValueError):
        le.adduct_mass("+Xx")
    t = "Fuc(a1-2)Gal(b1-4)Glc"
    assert matches(le.sequence_to_pattern(t), t) == [t]


def test_masking_and_codes(spark):
    d = spark.createDataFrame([("Gal(b1-4)Glc",), ("Gal(b1-4)Glc",), ("Fuc(a1-2)Gal",), (None,)], "x string")
    assert [r.x for r in le.mask_rare(d, "x", 1, 1).collect()] == ["Gal(b1-4)Glc", "Gal(b1-4)Glc", "Monosaccharide(?1-?)Gal", None]
    got = spark.createDataFrame([("acB",), ("",)], "x string").select(le.protein_codes(F.col("x"), 5)).collect()
    assert got[0][0] == [0, 1, 22, 23, 23] and got[1][0] == [23] * 5


def test_lectins(spark):
    lib = spark.createDataFrame([("ConA", ["ConA"], "plant", {"primary": ["Man(a1-?)Man"], "secondary": ["Glc"], "negative": []}), ("SNA", ["SNA", "SNA-I"], "plant", {"primary": ["Neu5Ac(a2-6)Gal"], "secondary": [], "negative": ["Neu5Ac(a2-3)Gal"]})], "name string, abbreviations array<string>, species string, specificity map<string,array<string>>")
    array = spark.createDataFrame([("cona_1", 2.0, 0.5), ("ConA_2", 1.0, 0.5), ("sna", -1.0, 0.5), ("what", 5.0, 0.5)], "lectin string, effect double, idf double")
    names = lectins.match_names(array, lib)
    assert {(r.lectin, r["name"]) for r in names.collect()} == {("cona_1", "ConA"), ("ConA_2", "ConA"), ("sna", "SNA")}
    bound = lectins.classes(lib, ["Man(a1-3)Man(b1-4)GlcNAc", "Neu5Ac(a2-6)Gal(b1-4)GlcNAc", "Neu5Ac(a2-3)Gal"])
    assert {(r["name"], r["class"]) for r in bound.collect()} == {("ConA", 0), ("SNA", 0)}
    scores = {r.motif: (r.change, r.score) for r in lectins.motif_scores(array.join(names, "lectin"), bound).collect()}
    # (2 + 1) * 0.5 / 2 motifs, twice 0.8 for two lectins of one entry; -1 * 0.5 / 1
    assert scores == {"Man(a1-3)Man(b1-4)GlcNAc": ("up", 0.48), "Neu5Ac(a2-6)Gal(b1-4)GlcNAc": ("down", 0.5)}
