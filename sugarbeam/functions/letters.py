"""Residue and linkage names: cores, modifications, base classes, wildcards, masking; protein codes; adduct masses."""

from __future__ import annotations

import re
from collections import Counter
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarbeam.functions import columns as c
from sugarbeam.functions import glycan as g

#: Cores, the longest first, so that GlcNAc is found before Glc.
CORES = sorted({n for names in g.CLASSES.values() for n in names} | {"Mur", "Kdo", "Api", "Fru", "Bac", "Neu", "Hep"}, key=lambda n: (-len(n), n))
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWXYZ"
LINKAGE = re.compile(r"^[ab?][12?]-[\d?]+(/\d+)*$")


def is_linkage(token: str) -> bool:
    return bool(LINKAGE.match(token))


def core(token: str) -> str:
    """The monosaccharide without modifications; a linkage and an unknown name stay."""
    return token if is_linkage(token) else next((k for k in CORES if k in token), token)


def modification(token: str) -> str:
    return token.replace(core(token), "", 1) if core(token) != token else ""


def stem(text: str) -> str:
    """A sequence of cores."""
    return re.sub(r"[^()\[\]{}]+", lambda m: m[0] if is_linkage(m[0]) else core(m[0]) + ("-ol" if m[0].endswith("-ol") else ""), text)


def base(token: str, keep_sulfate: bool = False) -> str:
    """The class of a residue (Hex, HexNAc, dHex, ...), `?1-?` for a linkage; itself if it has none."""
    if is_linkage(token):
        return "?1-?" if token[1:2] != "2" else "?2-?"
    k = core(token)
    kind = next((name for name, members in g.CLASSES.items() if k in members and name != "Sia"), k)
    m = re.search(r"(?:\d|O)([SP])$", token)
    return kind + (f"O{m[1]}" if keep_sulfate and m else "")


def topology(text: str) -> str:
    """The sequence in classes and open linkages, in canonical form."""
    return g.canonical(re.sub(r"[^()\[\]{}]+", lambda m: base(m[0]) + ("-ol" if m[0].endswith("-ol") else ""), text))


def possible_linkages(wildcard: str, known: list[str]) -> list[str]:
    return sorted(k for k in known if "?" not in k and "/" not in k and g.same_linkage(k, wildcard))


def possible_monosaccharides(wildcard: str) -> list[str]:
    return list(g.CLASSES.get(wildcard, [wildcard]))


def rare_letters(texts: list[str], monosaccharides: int | None = None, linkages: int | None = None) -> tuple[set[str], set[str]]:
    """(monosaccharides, linkages) that occur at most ceil(0.001 n) and ceil(0.03 n) times, or at most the given times."""
    n = Counter(t for x in texts for t in g.tokens(x))
    most = (ceil(0.001 * len(texts)) if monosaccharides is None else monosaccharides, ceil(0.03 * len(texts)) if linkages is None else linkages)
    return {t for t, k in n.items() if not is_linkage(t) and k <= most[0]}, {t for t, k in n.items() if is_linkage(t) and k <= most[1]}


def swapped(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """df with each residue or linkage of the column that `names` (token, new) has replaced. Tokens of distinct texts are joined with the names and
    put together again, so that a vocabulary of any size stays in the cluster. Texts without such a token, and nulls, stay."""
    parts = F.posexplode(F.regexp_extract_all("_t", F.lit(r"([^()\[\]{}]+|[()\[\]{}])"), 1)).alias("_at", "token")
    texts = df.select(F.col(column).alias("_t")).where("_t is not null").distinct()
    each = texts.select("_t", parts).join(names.select("token", "new"), "token", "left")
    new = each.groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("new", "token").alias("x")))).alias("_p"))
    new = new.select("_t", F.array_join(F.transform("_p", lambda p: p["x"]), "").alias("_new"))
    out = df.join(new, df[column] == new["_t"], "left").withColumn(column, F.coalesce("_new", column))
    return out.drop("_t", "_new")


def _counts(df: DataFrame, column: str) -> DataFrame:
    """(token, count, link) over all rows."""
    n = df.select(F.explode(c.tokens(F.col(column))).alias("token")).groupBy("token").count()
    return n.withColumn("link", F.col("token").rlike(LINKAGE.pattern))


def mask_rare(df: DataFrame, column: str, monosaccharides: int, linkages: int) -> DataFrame:
    """Residues and linkages of at most so many occurrences over all rows become `Monosaccharide`, and `?1-?` or `?2-?`."""
    n = _counts(df, column)
    rare = n.where((~F.col("link") & (F.col("count") <= monosaccharides)) | (F.col("link") & (F.col("count") <= linkages)))
    open_ = F.when(F.substring("token", 2, 1) == "2", "?2-?").otherwise("?1-?")
    return swapped(df, column, rare.select("token", F.when(F.col("link"), open_).otherwise("Monosaccharide").alias("new")))


def stemified(df: DataFrame, column: str, rarity: int = 1) -> DataFrame:
    """Residues that occur at most `rarity` times over all rows become their cores."""
    rare = _counts(df, column).where(~F.col("link") & (F.col("count") <= rarity))
    return swapped(df, column, rare.select("token", c._mapped(stem, "string")(F.col("token")).alias("new")))


def specific(token: str, known: list[str], seed: int = 0) -> str:
    """One specified form of an open residue or linkage, the same for the same seed; itself if it is specified already."""
    could = possible_linkages(token, known) if "?" in token or "/" in token else g.CLASSES.get(token, [])
    return could[int.from_bytes(f"{token}{seed}".encode(), "big") % len(could)] if could else token


def protein_codes(x: Column, length: int = 1000) -> Column:
    """Codes of amino acids from 0 (unknown ones get the last code, the padding the one after), cut and padded to `length`."""
    known = F.create_map(*[F.lit(v) for i, a in enumerate(AMINO_ACIDS) for v in (a, i)])
    letters = F.filter(F.split(F.upper(F.substring(x, 1, length)), ""), lambda a: a != "")
    got = F.transform(letters, lambda a: F.coalesce(F.element_at(known, a), F.lit(len(AMINO_ACIDS))))
    return F.concat(got, F.array_repeat(F.lit(len(AMINO_ACIDS) + 1), F.lit(length) - F.size(got)))


def adduct_mass(formula: str) -> float:
    """Monoisotopic mass of a formula such as C2H4O2, +H2O or -H2O."""
    sign = -1.0 if formula.startswith("-") else 1.0
    body = formula.lstrip("+-")
    if not re.fullmatch(r"(?:(?:" + "|".join(g.ELEMENTS) + r")\d*)+", body):
        raise ValueError(f"no formula of {', '.join(g.ELEMENTS)}: {formula}")
    return sign * g.formula_mass(body)


def sequence_to_pattern(text: str) -> str:
    """A linear sequence as a pattern of sugarbeam.functions.patterns."""
    return "-".join(f"{r}{(link or '').replace('1-', '').replace('2-', '')}" for r, link in re.findall(r"([^()\[\]{}]+)(?:\(([^)]*)\))?", text))
