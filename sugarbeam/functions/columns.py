"""The sequence functions as Arrow-batched columns, and small string functions as plain expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sugarbeam.functions import glycan as g


def _mapped(fn, returns: str):
    """fn on each distinct text of a batch once; a null or a text that is no sequence gives null."""

    def safe(x):
        try:
            return fn(x) if x is not None else None
        except g.NotASequence:
            return None

    def run(s: pd.Series) -> pd.Series:
        known = {x: safe(x) for x in s.unique()}
        return pd.Series([known[x] for x in s], dtype=object)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returns)


def largest_common(a: Column, b: Column) -> Column:
    """The largest connected part of two sequences; null if one of them is none."""
    from sugarbeam.functions.structure import largest_common as one

    def safe(x, y):
        try:
            return one(x, y) if x is not None and y is not None else None
        except g.NotASequence:
            return None

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([safe(u, v) for u, v in zip(x, y, strict=True)], dtype=object)

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(a, b)


def tokens(c: Column) -> Column:
    """Residues and linkages in order, without Python."""
    return F.filter(F.split(c, r"[()\[\]{}]+"), lambda x: x != "")


def canonical(c: Column) -> Column:
    return _mapped(g.canonical, "string")(c)


def canonicalize(c: Column) -> Column:
    """Canonical condensed text from any notation that is understood, null otherwise."""
    from sugarbeam.functions.notations import canonicalize as read

    return _mapped(read, "string")(c)


def pattern_matches(c: Column, pattern: str) -> Column:
    """Parts of the sequence that the pattern of sugarbeam.functions.patterns matches; the pattern is read once."""
    from sugarbeam.functions import patterns

    known = patterns.compile_pattern(pattern)
    return _mapped(lambda x: patterns.matches(known, x), "array<string>")(c)


def composition(c: Column) -> Column:
    return _mapped(g.composition, "map<string,int>")(c)


def read_composition(c: Column) -> Column:
    return _mapped(g.read_composition, "map<string,int>")(c)


def disaccharides(c: Column) -> Column:
    return _mapped(lambda x: dict(g.disaccharides(x)), "map<string,int>")(c)


def fragments(c: Column, size: int) -> Column:
    return _mapped(lambda x: dict(g.fragments(x, size)), "map<string,int>")(c)


def terminal_structures(c: Column, size: int = 1) -> Column:
    return _mapped(lambda x: dict(g.terminal_structures(x, size)), "map<string,int>")(c)


def precursors(c: Column) -> Column:
    return _mapped(lambda x: [{"src": a, "diffs": b} for a, b in g.precursors(x)], "array<struct<src: string, diffs: string>>")(c)


def motif_count(c: Column, motif: str, termini: list[str] | None = None) -> Column:
    """Behind a cheap necessary condition in plain expressions: as many residues as the motif has."""
    need = motif.count("(") + (0 if motif.endswith(")") else 1)
    have = F.length(c) - F.length(F.replace(c, F.lit("("), F.lit(""))) + 1
    return F.when(have >= need, _mapped(lambda x: g.motif_count(x, motif, termini), "int")(c)).otherwise(F.lit(0))


def motif_counts(c: Column, motifs: dict[str, str]) -> Column:
    """map of the count of each motif; one pass over the distinct sequences for all of them. Motifs with more residues than a sequence are 0."""
    sizes = {k: m.count("(") + (0 if m.endswith(")") else 1) for k, m in motifs.items()}

    def one(x: str) -> dict[str, int]:
        have = x.count("(") + 1
        return {k: g.motif_count(x, m) if sizes[k] <= have else 0 for k, m in motifs.items()}

    return _mapped(one, "map<string,int>")(c)


def mass(parts: Column) -> Column:
    """Mass of a composition map, without Python; null for a null or empty map or an unknown part."""
    masses = F.create_map(*[F.lit(v) for kv in g.MASSES.items() for v in kv])
    total = F.aggregate(F.map_entries(parts), F.lit(g.formula_mass(g.WATER)), lambda s, e: s + F.element_at(masses, e["key"]) * e["value"])
    return F.when(F.size(parts) > 0, total)


def sequence_class(c: Column) -> Column:
    from sugarbeam.functions import strings

    return strings.sequence_class(c)


def occurrences(c: Column, needle: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def find_nth(c: Column, needle: str, n: int) -> Column:
    """Place from 0 of the n-th needle, without overlaps; -1 if there are fewer."""
    before = F.substring_index(c, needle, n)
    return F.when(occurrences(c, needle) >= n, F.length(before)).otherwise(F.lit(-1))


def multireplace(c: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), pairs.items(), c)


def stringify_map(c: Column) -> Column:
    """Keys and values side by side, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], e["value"].cast("string"))), "")


def strip_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"\.\d+$", "")


def _state(c: Column, zero: Column, step, end) -> Column:
    return F.aggregate(F.split(c, ""), zero, step, end)


def replace_every_second(c: Column, old: str, new: str) -> Column:
    """Every second `old` character becomes `new`."""
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(s: Column, ch: Column) -> Column:
        hit = ch == old
        n = s["n"] + hit.cast("int")
        return F.struct(n.alias("n"), F.concat(s["out"], F.when(hit & (n % 2 == 0), F.lit(new)).otherwise(ch)).alias("out"))

    return _state(c, zero, step, lambda s: s["out"])


def nested_brackets(c: Column) -> Column:
    """Opening square brackets inside another bracket."""
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("n"))

    def step(s: Column, ch: Column) -> Column:
        n = s["n"] + ((ch == "[") & (s["d"] > 0)).cast("int")
        d = s["d"] + F.when(ch == "[", 1).when(ch == "]", -1).otherwise(0)
        return F.struct(d.alias("d"), n.alias("n"))

    return _state(c, zero, step, lambda s: s["n"])


def fragments_in_brackets_removed(c: Column, depth: int = 4) -> Column:
    """Without square brackets and what they hold, innermost first."""
    return reduce(lambda x, _: F.regexp_replace(x, r"\[[^\[\]]*\]", ""), range(depth), c)
