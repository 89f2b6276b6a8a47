"""Motifs matched through an inverted index of labels, their node maps as a table function, and equality with wildcards in blocks."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sugarbeam.functions import columns as c
from sugarbeam.functions import glycan as g
from sugarbeam.functions import patterns, structure
from sugarbeam.operators.networks import connected
from sugarbeam.sources.store import spread, written

#: A residue that may be any, and what a motif without a certain residue is listed under.
ANY = "*"
#: What linkages that are not certain are counted under.
OPEN = "b:?"
_CERTAIN = re.compile(r"[ab][12]-\d")


def _bare(name: str) -> str:
    return re.sub("-ol$|1Cer$", "", name)


@functools.lru_cache(1 << 16)
def _residue_labels(name: str) -> tuple[str, ...]:
    name = _bare(name)
    if "Monosaccharide" in name or name.startswith("!"):
        return (ANY,)
    classes = {f"c:{k}" for k, names in g.CLASSES.items() if name in names}
    return tuple({f"r:{name}", f"c:{name}"} | {f"r:{x}" for x in g.CLASSES.get(name, ())} | classes)


def sequence_labels(text: str) -> dict[str, int]:
    """How often each label occurs: `r:` and a residue that a residue of the sequence may be, `c:` and a class that it may belong to; ANY for
    residues that may be any; `b:` and a certain linkage, OPEN for other linkages. ANY and OPEN are always there, with 0 if none is."""
    out: Counter[str] = Counter({ANY: 0, OPEN: 0})
    for tree in g.parse(text):
        for r in g.residues(tree):
            if r.linkage:
                out[f"b:{r.linkage}" if _CERTAIN.fullmatch(r.linkage) else OPEN] += 1
            for label in _residue_labels(r.name):
                out[label] += 1
    return dict(out)


def motif_labels(motif: str) -> dict[str, int]:
    """Labels that a sequence must have so often if it holds the motif; none for a pattern, which starts with `r`."""
    if motif.startswith("r"):
        return {}
    out: Counter[str] = Counter()
    for r in g.residues(g.parse(motif)[-1]):
        name = _bare(r.name)
        if "Monosaccharide" not in name and not name.startswith("!"):
            out[f"c:{name}" if name in g.CLASSES else f"r:{name}"] += 1
        if not name.startswith("!") and _CERTAIN.fullmatch(r.linkage):  # of !X the linkage may be another
            out[f"b:{r.linkage}"] += 1
    return dict(out)


def _each(motifs: DataFrame) -> DataFrame:
    """(_m, motif, termini, _want): each motif once, however many names it has, with a number that the written table fixes."""
    once = motifs.select("motif", "termini").distinct().withColumn("_want", c._mapped(motif_labels, "map<string,int>")(F.col("motif")))
    return written(once.select(F.monotonically_increasing_id().alias("_m"), "motif", "termini", "_want")).where("_want IS NOT NULL")


def _pairs(df: DataFrame, want: DataFrame, column: str) -> DataFrame:
    """(glycan, _m, motif, termini): the pairs of a distinct sequence and a motif of `want`, as `_each` gives them, whose labels the sequence holds."""
    texts = spread(df.select(column).where(F.col(column).isNotNull()).distinct(), column)
    # Filtered as a table: Spark would call Python for a filter before the dealing too, on every row and in as few tasks as the input has files.
    texts = written(texts.withColumn("_have", c._mapped(sequence_labels, "map<string,int>")(F.col(column)))).where("_have IS NOT NULL")
    labels = want.select("_m", F.explode_outer(F.map_keys(F.map_filter("_want", lambda k, _: ~k.startswith("b:")))).alias("label"))
    certain = labels.select("label").distinct()
    often = texts.select(F.explode(F.map_keys("_have")).alias("label")).join(F.broadcast(certain), "label").groupBy("label").agg(F.count("*").alias("_df"))  # as many as there are residues
    rarest = labels.join(often, "label", "left").groupBy("_m").agg(F.min_by("label", F.struct(F.coalesce("_df", F.lit(0)), "label")).alias("label"))
    listed = written(want.join(rarest.select("_m", F.coalesce("label", F.lit(ANY)).alias("label")), "_m"))
    # A sequence with residues that may be any meets every motif.
    free = F.col("_have")[ANY]
    own = texts.where(free == 0).select(column, "_have", F.explode(F.map_keys("_have")).alias("label"))
    some = own.join(listed, "label")
    every = texts.where(free > 0).withColumn("label", F.lit(ANY)).join(want.withColumn("label", F.lit(ANY)), "label").select(some.columns)
    spare = lambda k: F.when(k.startswith("b:"), F.col("_have")[OPEN]).otherwise(free)
    fits = F.forall(F.map_entries("_want"), lambda e: F.coalesce(F.element_at("_have", e["key"]), F.lit(0)) + spare(e["key"]) >= e["value"])
    return spread(some.unionByName(every).where(fits).select(column, "_m", "motif", "termini"), column, "_m")


def _named(found: DataFrame, motifs: DataFrame, want: DataFrame, column: str) -> DataFrame:
    """found (glycan, _m, ...) with the names of its motifs. A motif with many names or in many sequences is dealt into SALTS parts."""
    m = motifs.select("name", F.col("motif").alias("_t"), F.col("termini").alias("_p"))
    names = m.join(want, (F.col("_t") == F.col("motif")) & F.col("_p").eqNullSafe(F.col("termini"))).select("name", "_m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return found.withColumn("_salt", F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")).join(names, ["_m", "_salt"])


def candidates(df: DataFrame, motifs: DataFrame, column: str = "glycan") -> DataFrame:
    """(glycan, name, motif, termini): the pairs of a distinct sequence and a motif (name, motif, termini) whose labels the sequence holds.

    Motifs of several names are looked up once. Each motif is listed under the rarest of its residues' labels among the sequences only, and sequences
    are listed under the labels that motifs are listed under, so a pair comes up once, and motifs with a rare residue meet the few sequences that have
    it. The other labels are compared as maps in plain expressions. Motifs that are no sequence and texts that are none have no rows.
    """
    want = _each(motifs)
    return _named(_pairs(df, want, column), motifs, want, column).select(column, "name", "motif", "termini")


def motif_counts(df: DataFrame, motifs: DataFrame, column: str = "glycan") -> DataFrame:
    """(glycan, name, n) of each distinct sequence and each motif (name, motif, termini) that occurs in it; only pairs that the index leaves are
    matched, once for all names of a motif. termini: for each residue of the motif terminal, internal or flexible, or null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled: dict = {}
        for pdf in batches:
            rows = []
            for x, k, m, places in zip(pdf[column], pdf["_m"], pdf["motif"], pdf["termini"], strict=True):
                if m.startswith("r"):
                    compiled[m] = compiled.get(m) or patterns.compile_pattern(m[1:])
                    n = len(patterns.matches(compiled[m], x))
                else:
                    n = g.motif_count(x, m, list(places) if places is not None else None)
                if n:
                    rows.append((x, k, n))
            yield pd.DataFrame(rows, columns=[column, "_m", "n"])

    want = _each(motifs)
    found = _pairs(df, want, column).mapInPandas(run, f"`{column}` string, _m bigint, n int")
    return _named(found, motifs, want, column).select(column, "name", "n")


class MotifNodes:
    """One row for each residue of each mapping of a motif into a sequence."""

    def eval(self, glycan: str, motif: str, termini: list[str] | None):
        if glycan is None or motif is None:
            return
        try:
            found = structure.embeddings(glycan, motif, termini)
        except g.NotASequence:
            return
        names = [r.name for t in g.parse(glycan) for r in g._in_text_order(t)]
        for k, way in enumerate(found):
            for a, b in way:
                yield k, a, b, names[b]


def register(spark: SparkSession) -> None:
    """Make motif_nodes(glycan, motif, termini) a table function of SQL, for use behind LATERAL: (match, motif_node, node, residue)."""
    spark.udtf.register("motif_nodes", F.udtf(MotifNodes, returnType="match int, motif_node int, node int, residue string"))


def node_maps(df: DataFrame, motifs: DataFrame, column: str = "glycan") -> DataFrame:
    """(glycan, name, match, motif_node, node, residue): where each motif lies in each distinct sequence, a row for each of its residues; places
    count from 0 in the order of the texts. What the table function does runs in batches on the pairs that the index leaves, once for all names of a motif."""
    register(df.sparkSession)
    names = [column, "_m", "match", "motif_node", "node", "residue"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = MotifNodes()
        for pdf in batches:
            rows = [(x, k, *row) for x, k, m, places in zip(pdf[column], pdf["_m"], pdf["motif"], pdf["termini"], strict=True) for row in one.eval(x, m, list(places) if places is not None else None)]
            yield pd.DataFrame(rows, columns=names)

    motifs = motifs.where(~F.col("motif").startswith("r"))
    want = _each(motifs)
    found = _pairs(df, want, column).mapInPandas(run, f"`{column}` string, _m bigint, match int, motif_node int, node int, residue string")
    return _named(found, motifs, want, column).select(column, "name", "match", "motif_node", "node", "residue")


#: Parts that a block of sequences and the names of a motif are dealt into.
SALTS = 8


#: The linkage that any other equals.
FREE = "?1-?"


def _block(text: str) -> list[list[str]] | None:
    """[[shape, parts, wildcards and marked ends, mask], names, classes]: what equal sequences share is the shape (size, leaves and branching) and the classes of their residues unless one may be
    any. None for floating parts, which equal as texts only. Of a chain without branches whose residues and linkages are each certain, a class or
    wholly open, names are its residues and linkages from the root on, classes the same with every residue's class and FREE for linkages, and
    the mask has 1 where the chain is open; mask and lists are empty for other sequences."""
    trees = g.parse(text)
    if len(trees) != 1:
        return None
    all_ = g.residues(trees[0])
    kind = {name: k for k, names in g.CLASSES.items() for name in names}
    names = [_bare(r.name) for r in all_]
    free = any("Monosaccharide" in n or n.startswith("!") for n in names)
    open_ = sum(n in g.CLASSES for n in names) + text.count("?") + text.count("/") + free + sum(r.name != _bare(r.name) for r in all_)
    parts = ANY if free else "|".join(sorted(kind.get(n, n) for n in names))
    links = [r.linkage for r in all_[1:]]
    plain = not free and all(len(r.children) < 2 for r in all_) and not trees[0].linkage and all(x == FREE or _CERTAIN.fullmatch(x) for x in links)
    head = [f"{len(all_)},{sum(not r.children for r in all_)},{sum(len(r.children) > 1 for r in all_)}", parts, str(open_)]
    if not plain:
        return [[*head, ""], [], []]
    fine = [x for pair in zip(names, ["", *links], strict=True) for x in pair]
    mask = "".join("1" if x in g.CLASSES or x == FREE else "0" for x in fine)
    return [[*head, mask], fine, [x for n in names for x in (kind.get(n, n), FREE)]]


def _blocks(texts: DataFrame) -> DataFrame:
    """(text, shape, parts, open, mask, names, classes) of canonical texts, written once."""
    d = written(spread(texts, "text").withColumn("k", c._mapped(_block, "array<array<string>>")(F.col("text")))).where("k IS NOT NULL")
    return written(d.selectExpr("text", "k[0][0] AS shape", "k[0][1] AS parts", "int(k[0][2]) AS open", "k[0][3] AS mask", "k[1] AS names", "k[2] AS classes"))


def _chain_groups(d: DataFrame) -> DataFrame:
    """(text, side, low, high, key) of chains, d as `_blocks` gives it: two chains, one of mask `low` (side 0) and one of mask `high` (side 1, or 0 too if the masks are
    one), are equal if and only if they share a key: the names where neither is open and the classes where one is. A chain has one row for each mask
    that its block holds, so rows are never more than the pairs of the block, and on few masks grow with the chains."""
    own = d.where("mask <> ''")
    masks = own.select("parts", F.col("mask").alias("other")).distinct()  # parts tell the length
    both = own.select("text", "parts", "mask", "names", "classes").join(masks, "parts")
    opened = lambda i: (F.substring("mask", i + 1, F.lit(1)) == "1") | (F.substring("other", i + 1, F.lit(1)) == "1")
    key = F.array_join(F.transform("names", lambda x, i: F.when(opened(i), F.element_at("classes", i + 1)).otherwise(x)), "|")
    return both.select("text", (F.col("mask") > F.col("other")).cast("int").alias("side"), F.least("mask", "other").alias("low"), F.greatest("mask", "other").alias("high"), key.alias("key"))


_GROUP = ["low", "high", "key"]


def _other_links(d: DataFrame) -> DataFrame:
    """(a, b): equal pairs of which one at least is no chain as `_block` reads it.

    They meet inside blocks of one shape and one multiset of residue classes. Two sequences without wildcards are equal only as texts
    (a reducing end that is marked counts as one, since it equals the plain residue), so one side of each pair has wildcards; the other side of a block is dealt into SALTS parts, each of which meets all of the first.
    Sequences with a residue that may be any meet their whole shape.
    """
    d = d.withColumn("plain", F.col("mask") != "")
    many = d.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
    wild = d.where("open > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def met(wild: DataFrame, many: DataFrame) -> DataFrame:
        x, y = wild.select(F.col("text").alias("a"), "shape", "salt", F.col("parts").alias("pa")), many.select(F.col("text").alias("b"), "shape", "salt", F.col("parts").alias("pb"), F.col("open").alias("ob"))
        certain = x.where(F.col("pa") != ANY).join(y.where(F.col("pb") != ANY).withColumn("pa", F.col("pb")), ["shape", "salt", "pa"])
        any_ = x.where(F.col("pa") == ANY).join(y, ["shape", "salt"]).select(certain.columns)
        other = x.where(F.col("pa") != ANY).join(y.where(F.col("pb") == ANY), ["shape", "salt"]).select(certain.columns)
        return certain.unionByName(any_).unionByName(other)

    # Of two that both have wildcards the pair comes up in both orders.
    pairs = met(wild.where("NOT plain"), many).unionByName(met(wild.where("plain"), many.where("NOT plain")))
    pairs = spread(pairs.where("a <> b AND (ob = 0 OR a < b)").select("a", "b").distinct(), "a", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [g.same_sequence(a, b) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]

    return pairs.mapInPandas(run, "a string, b string")


def _texts(df: DataFrame, column: str) -> DataFrame:
    texts = df.select(column).where(F.col(column).isNotNull()).distinct().transform(spread, column).select(c.canonical(F.col(column)).alias("text"))
    return written(texts).where("text IS NOT NULL").distinct()


def equal_links(df: DataFrame, column: str = "glycan") -> DataFrame:
    """(a, b): pairs of distinct canonical texts that are equal up to wildcards. Chains meet by their groups' keys, other sequences in blocks."""
    d = _blocks(_texts(df, column))
    rows = _chain_groups(d)
    x, y = rows.where("side = 0").withColumnRenamed("text", "a").drop("side"), rows.where("side = 1 OR low = high").withColumnRenamed("text", "b").drop("side")
    pairs = x.join(y, _GROUP).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.unionByName(_other_links(d))


def _stars(d: DataFrame) -> DataFrame:
    """(a, b): links that connect what those of equal_links connect: all chains of a group hang on its first, if both of its masks have one."""
    whole = Window.partitionBy(*_GROUP)
    rows = _chain_groups(d).select("text", F.min("text").over(whole).alias("b"), (F.expr("low = high") | (F.min("side").over(whole) < F.max("side").over(whole))).alias("ok"))
    return rows.where("ok AND text <> b").select(F.col("text").alias("a"), "b").distinct().unionByName(_other_links(d))


def deduplicated(df: DataFrame, column: str = "glycan") -> DataFrame:
    """(glycan, canonical, representative) of each distinct sequence: sequences that links of equality connect have one representative, the one of
    fewest wildcards (? and /), then the first by text. Texts that are no sequence stand for themselves, with a null canonical text."""
    d = written(spread(df.select(column).where(F.col(column).isNotNull()).distinct(), column).withColumn("canonical", c.canonical(F.col(column))))
    links = _stars(_blocks(d.select(F.col("canonical").alias("text")).where("text IS NOT NULL").distinct()))
    label = connected(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    wild = F.length(F.regexp_replace("canonical", "[^?/]", ""))
    first = d.join(label.withColumnRenamed("node", "canonical"), "canonical").groupBy("label").agg(F.min_by("canonical", F.struct(wild, "canonical")).alias("_first"))
    near = label.join(first, "label").select(F.col("node").alias("canonical"), "_first")
    return d.join(near, "canonical", "left").select(column, "canonical", F.coalesce("_first", "canonical", column).alias("representative"))


def kept(df: DataFrame, column: str = "glycan") -> DataFrame:
    """The representatives of df's sequences, one row each."""
    return deduplicated(df, column).select(F.col("representative").alias(column)).distinct()


def share_matched(df: DataFrame, motifs: DataFrame, column: str = "glycan") -> DataFrame:
    """(pairs, candidates, matched): all pairs of a sequence and a motif, those that the index leaves, and those that match."""
    all_ = df.select(column).where(F.col(column).isNotNull()).distinct().agg(F.count("*").alias("s")).join(motifs.agg(F.count("*").alias("m")), F.lit(True))
    left = candidates(df, motifs, column).agg(F.count("*").alias("candidates"))
    hit = motif_counts(df, motifs, column).agg(F.count("*").alias("matched"))
    return all_.select((F.col("s") * F.col("m")).alias("pairs")).join(left, F.lit(True)).join(hit, F.lit(True))
