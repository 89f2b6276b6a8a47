"""Matching through the label index, node maps and equality with wildcards against all pairs."""

import itertools
import re

import pytest

from sugarbeam.functions import glycan as g
from sugarbeam.functions import structure
from sugarbeam.functions.motifs import motif_list
from sugarbeam.operators import matching as ma
from sugarbeam.plans import rounds  # noqa: F401
from sugarbeam.plans.registry import QUERIES
from sugarbeam.plans.sequences import SEQUENCES
from sugarbeam.sources.store import written

OPEN = ["Hex(b1-4)Glc", "Monosaccharide(b1-4)Glc", "Gal(?1-?)GlcNAc", "Neu5Ac(a2-3/6)Gal(b1-3)GalNAc", "Sia(a2-3)Gal(b1-3)GalNAc", "{Fuc(a1-2)}Gal(b1-4)Glc", "[no sequence"]


def test_index_leaves_every_match(spark):
    texts = [*SEQUENCES, *OPEN, None]
    named = motif_list()
    own = [("free", "Monosaccharide(?1-?)Monosaccharide", []), ("class", "Hex(b1-4)HexNAc", []), ("end", "Fuc(a1-2)", []), ("pattern", "rGal-Glc", [])]
    rows = [(n, m, t or None) for n, m, t in [*named, *own]]
    df, motifs = spark.createDataFrame([(t,) for t in texts], "glycan string"), spark.createDataFrame(rows, "name string, motif string, termini array<string>")
    got = {(r.glycan, r.name): r.n for r in ma.motif_counts(df, motifs).collect()}
    want = {}
    for t in texts:
        for n, m, places in rows:
            if t and not m.startswith("r"):
                try:
                    k = g.motif_count(t, m, places)
                except g.NotASequence:
                    continue
                if k:
                    want[t, n] = k
    assert {k: v for k, v in got.items() if k[1] != "pattern"} == want
    share = ma.share_matched(df, motifs).first()
    assert share.matched == len(got) and share.matched <= share.candidates < share.pairs / 2
    assert ma.motif_counts(df.limit(0), motifs).count() == ma.motif_counts(df, motifs.limit(0)).count() == 0


def test_a_motif_of_many_names_is_matched_once(spark):
    rows = [(f"n{i}", m, None) for i in range(50) for m in ("Gal(b1-4)Glc", "Man(a1-3)Man")]
    df, motifs = spark.createDataFrame([(t,) for t in SEQUENCES], "glycan string"), spark.createDataFrame(rows, "name string, motif string, termini array<string>")
    want = {(t, n, g.motif_count(t, m)) for t in SEQUENCES for n, m, _ in rows if g.motif_count(t, m)}
    got = ma.motif_counts(df, motifs).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    each = ma._each(motifs)
    assert each.count() == 2
    # A certain linkage that the sequence does not have rules a pair out.
    assert "b:a1-3" in ma.motif_labels("Man(a1-3)Man") and {r.motif for r in ma._pairs(df.where("glycan = 'Man(a1-2)Man'"), each, "glycan").collect()} == set()
    assert ma._pairs(df, each, "glycan").rdd.getNumPartitions() >= 4  # not in one task for few bytes


def test_node_maps_of_a_motif_of_many_names(spark):
    rows = [(f"n{i}", "Gal(b1-4)Glc", None) for i in range(9)]
    df, motifs = spark.createDataFrame([(t,) for t in SEQUENCES], "glycan string"), spark.createDataFrame(rows, "name string, motif string, termini array<string>")
    got = ma.node_maps(df, motifs).collect()
    want = {(t, n, k, a, b) for t in SEQUENCES for n, m, p in rows for k, way in enumerate(structure.embeddings(t, m, p)) for a, b in way}
    assert {(r.glycan, r.name, r["match"], r.motif_node, r.node) for r in got} == want and len(got) == len(want)


def test_labels_are_read_once_and_after_the_dealing(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(ma, "written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), written(df))[1])
    df, motifs = spark.createDataFrame([(t,) for t in SEQUENCES], "glycan string"), spark.createDataFrame([("n", "Gal(b1-4)Glc", None)], "name string, motif string, termini array<string>")
    ma.node_maps(df, motifs)
    ma.equal_links(df)
    called = [x for x in plans if "ArrowEvalPython" in x]
    assert called and all(x.count("ArrowEvalPython") == 1 for x in called)  # a filter would call it below the dealing, too


def test_sequences_are_not_sent_to_all_where_the_size_of_motifs_is_not_known(spark):
    rows = [(n, m, list(t) or None) for n, m, t in motif_list()[:9]]
    texts = [f"{a}({x}){b}({y}){t}" for a, b in itertools.permutations(("Gal", "Man", "GlcNAc", "Fuc", "Hex"), 2) for x, y in itertools.permutations(("b1-4", "b1-3", "a1-2", "?1-?"), 2) for t in SEQUENCES]
    df, motifs = spark.createDataFrame([(t,) for t in texts], "glycan string"), spark.createDataFrame(rows, "name string, motif string, termini array<string>")
    plan = ma.motif_counts(df, motifs)._jdf.queryExecution().executedPlan().toString()
    sent = [x for x in re.split(r"\n(?=[ :+-]*BroadcastExchange)", plan)[1:] if "_have" in x.split("FileScan")[1].split("\n")[0]]
    assert "BroadcastNestedLoopJoin" in plan and not sent


def _sent(plan) -> int:
    """Bytes that the broadcasts of a plan that has run sent to the driver and on to all."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _sent(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _sent(plan.plan())
    if kind == "BroadcastExchangeExec":
        return plan.metrics().apply("dataSize").value()
    return sum(_sent(plan.children().apply(i)) for i in range(plan.children().size()))


def test_what_named_motifs_send_to_all_does_not_grow_with_the_parts(spark, tmp_path):
    sent = []
    for n in (500, 2_000):
        spark.range(n).selectExpr("id AS p_partkey", "int(id * 7919 % 50 + 1) AS p_size").write.parquet(f"{tmp_path}/{n}/part.parquet")
        out = QUERIES["indexed_named_motifs"](spark, f"{tmp_path}/{n}")
        assert out.collect()
        sent.append(_sent(out._jdf.queryExecution().executedPlan()))
    assert sent[0] and sent[0] == sent[1]


def brute(text: str, motif: str) -> int:
    """Injective maps of the motif's residues that keep names, parents and linkages, over all choices of residues."""

    def flat(s: str) -> list[tuple]:
        out = []
        for tree in g.parse(s):
            order = g._in_text_order(tree)
            place = {id(r): len(out) + i for i, r in enumerate(order)}
            up = {id(c): place[id(r)] for r in order for c in r.children}
            out += [(r.name, r.linkage, up.get(id(r))) for r in order]
        return out

    a, b = flat(text), flat(motif)
    fits = lambda way: all(
        g.same_residue(a[way[k]][0], n) and (p is None or (a[way[k]][2] == way[p] and g.same_linkage(a[way[k]][1], link))) for k, (n, link, p) in enumerate(b)
    )
    return {way for way in itertools.permutations(range(len(a)), len(b)) if fits(way)}


@pytest.mark.parametrize("text", SEQUENCES[:10])
def test_node_maps_are_all_maps(text):
    for motif in ("Gal(b1-4)Glc", "Man(a1-3)[Man(a1-6)]Man", "Hex(?1-?)Hex", "Monosaccharide(?1-?)Gal"):
        got = {tuple(b for _, b in way) for way in structure.embeddings(text, motif)}
        assert got == brute(text, motif) and len(structure.embeddings(text, motif)) == g.motif_count(text, motif)


def test_table_function_gives_a_row_for_each_node(spark):
    df = spark.createDataFrame([(t,) for t in SEQUENCES], "glycan string")
    rows = [(n, m, t or None) for n, m, t in motif_list()[:60]]
    got = ma.node_maps(df, spark.createDataFrame(rows, "name string, motif string, termini array<string>")).collect()
    want = {(t, n, k, a, b) for t in SEQUENCES for n, m, p in rows for k, way in enumerate(structure.embeddings(t, m, p)) for a, b in way}
    assert {(r.glycan, r.name, r["match"], r.motif_node, r.node) for r in got} == want and len(got) == len(want)


def test_equality_with_wildcards_loses_no_link(spark):
    texts = [*SEQUENCES, *OPEN, "Glc(b1-4)Glc", "Gal(b1-4)GlcNAc", "Man(b1-4)GlcNAc", "Gal(b1-?)GlcNAc", "Neu5Ac(a2-6)Gal(b1-3)GalNAc", "Gal(b1-3)[Neu5Ac(a2-6)]GalNAc", "Neu5Ac(a2-6)[Gal(b1-3)]GalNAc", "Monosaccharide(?1-?)Monosaccharide"]
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "glycan string")
    ok = [t for t in dict.fromkeys(texts) if t != "[no sequence"]
    canon = sorted({g.canonical(t) for t in ok})
    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(canon, 2) if g.same_sequence(a, b) or g.same_sequence(b, a)}
    assert {tuple(sorted(r)) for r in ma.equal_links(df).collect()} == want
    up = {c: c for c in canon}
    for a, b in want:
        x, y = up[a], up[b]
        up = {c: x if v == y else v for c, v in up.items()}
    first = {}
    for c in canon:
        key = (c.count("?") + c.count("/"), c)
        first[up[c]] = min(first.get(up[c], key), key)
    got = {r.glycan: r.representative for r in ma.deduplicated(df).collect()}
    assert got == {**{t: first[up[g.canonical(t)]][1] for t in ok}, "[no sequence": "[no sequence"}
    assert ma.kept(df).count() == len(set(got.values()))


def test_chains_meet_by_key_alone(spark, monkeypatch):
    names, links = ["Gal", "Man", "Hex", "GlcNAc", "HexNAc"], ["b1-4", "a1-2", "?1-?"]
    texts = [f"{a}({x}){b}({y})Gal{end}" for a in names for x in links for b in names for y in links for end in ("", "-ol")][::3] + ["Gal(b1-?)Man(a1-2)Gal", "Sia(a2-3)Gal(b1-4)Gal", "Neu5Ac(a2-3)Hex(b1-4)Gal"]
    df = spark.createDataFrame([(t,) for t in texts], "glycan string")
    want = {tuple(sorted(p)) for p in itertools.combinations(texts, 2) if g.same_sequence(*p) or g.same_sequence(*p[::-1])}
    got = [tuple(sorted(r)) for r in ma.equal_links(df).collect()]
    assert set(got) == want and len(got) == len(want)
    d = ma._blocks(ma._texts(df, "glycan"))
    assert all("b1-?" in r.a + r.b for r in ma._other_links(d).collect())  # other pairs are compared by key, none in Python
    up = {t: t for t in texts}
    for a, b in want:
        x, y = up[a], up[b]
        up = {t: x if v == y else v for t, v in up.items()}
    stars = {t: t for t in texts}
    for a, b in ma._stars(d).collect():
        assert up[a] == up[b]
        x, y = stars[a], stars[b]
        stars = {t: x if v == y else v for t, v in stars.items()}
    assert len(set(stars.values())) == len(set(up.values()))


def test_canonical_text_writes_each_branch_once(monkeypatch):
    called, position = [], g._position
    monkeypatch.setattr(g, "_position", lambda link: called.append(link) or position(link))
    text = "Gal(b1-4)" * 14 + "Glc"
    assert g.canonical(text) == text and len(called) == 14


def test_sequences_are_dealt_before_python(spark):
    from sugarbeam.operators import annotation as an

    df = spark.createDataFrame([(t,) for t in SEQUENCES], "glycan string").distinct()
    out = an.present(df, df.where("glycan LIKE 'Gal%'"))
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()
    assert {r.glycan: r.present for r in out.collect()} == {t: t.startswith("Gal") for t in SEQUENCES}
