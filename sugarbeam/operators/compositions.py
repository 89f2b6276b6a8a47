"""From masses to compositions and from compositions to sequences, as joins on mass bins and on composition keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarbeam.functions import columns as c
from sugarbeam.functions import glycan as g
from sugarbeam.functions import letters

# Masses of a hydrogen atom and of a sodium ion, the acetate, and what methylation and acetylation add at each free site of
# each part of a composition.
HYDROGEN = 1.0078
SODIUM = 22.989218
ACETATE = "C2H3O2"
DERIVATIVES = {
    "permethylated": ("C1H2", {"Hex": 3, "HexNAc": 3, "HexN": 4, "HexA": 3, "dHex": 2, "Pen": 2, "Neu5Ac": 5, "Neu5Gc": 6, "Kdn": 5, "S": -1, "P": 0, "Me": -1, "Ac": -1}),
    "peracetylated": ("C2H2O1", {"Hex": 3, "HexNAc": 2, "HexN": 3, "HexA": 2, "dHex": 2, "Pen": 2, "Neu5Ac": 3, "Neu5Gc": 4, "Kdn": 4, "S": -1, "P": 0, "Me": -1, "Ac": -1}),
}
#: Parts that a match has only if nothing else fits.
LAST = ("Me", "HexA", "PCho")


def derivatized_mass(parts: Column, prep: str = "underivatized") -> Column:
    """Mass of a composition map; permethylated and peracetylated sugars gain CH2 or C2H2O at each free hydroxyl and at both ends."""
    plain = c.mass(parts)
    if prep == "underivatized":
        return plain
    formula, table = DERIVATIVES[prep]
    sites = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return plain + g.formula_mass(formula) * F.aggregate(F.map_entries(parts), F.lit(2), lambda s, e: s + F.element_at(sites, e["key"]) * e["value"])


def key(parts: Column) -> Column:
    """A composition as text, equal for equal ones."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(parts)), lambda e: F.concat(e["key"], e["value"].cast("string"))), "")


def mz_to_compositions(
    mz: DataFrame, pool: DataFrame, tolerance: float = 0.5, mode: str = "negative", reduced: bool = False, prep: str = "underivatized",
    extras: tuple[str, ...] = ("doubly_charged",), adduct: str | None = None, without: tuple[str, ...] = (), last: tuple[str, ...] = LAST,
) -> DataFrame:
    """(id, composition, how) of each mass of mz (id, mz): the best composition of `pool` (composition map) within the tolerance.

    Compositions with a part of `last` come after all others; among equals plain matches come before matches with the mode's adduct and
    those before doubly charged ones, then the nearest mass, then the first by text. Compositions with a part of `without` do not
    count. Masses meet in bins of the tolerance's width, so that no mass meets the whole pool.
    """
    x = F.col("mz") - (letters.adduct_mass(adduct) if adduct else 0.0) - (HYDROGEN if reduced else 0.0)
    sign = 1 if mode == "negative" else -1
    of_mode = SODIUM if mode == "positive" else g.formula_mass(ACETATE)
    # A doubly charged ion's mass; the hydrogen of a reduced end counts once.
    double = (x + 0.5 * sign) * 2 + (HYDROGEN if reduced else 0.0)
    looks = [F.struct(F.lit(0).alias("how"), x.alias("x"))]
    looks += [F.struct(F.lit(1).alias("how"), (x - of_mode).alias("x"))] if "adduct" in extras else []
    looks += [F.struct(F.lit(2).alias("how"), double.alias("x"))] if "doubly_charged" in extras else []
    asked = mz.select("id", F.explode(F.array(*looks)).alias("l")).select("id", "l.how", "l.x").withColumn("bin", F.floor(F.col("x") / tolerance))
    k = pool.select("composition", key(F.col("composition")).alias("key")).dropDuplicates(["key"])
    k = k.withColumn("mass", derivatized_mass(F.col("composition"), prep)).where("mass is not null")
    if without:
        k = k.where(~F.arrays_overlap(F.map_keys("composition"), F.lit(list(without))))
    k = k.withColumn("late", F.arrays_overlap(F.map_keys("composition"), F.lit(list(last))) if last else F.lit(False))
    k = k.withColumn("bin", F.explode(F.array(*(F.floor(F.col("mass") / tolerance) + d for d in (-1, 0, 1)))))
    hit = asked.join(k, "bin").where(F.abs(F.col("mass") - F.col("x")) < tolerance)
    best = hit.groupBy("id").agg(F.min_by(F.struct("key", "how"), F.struct("late", "how", F.abs(F.col("mass") - F.col("x")).alias("d"), "key")).alias("b"))
    return best.select("id", F.col("b.key").alias("composition"), F.element_at(F.lit(["plain", "adduct", "doubly_charged"]), F.col("b.how") + 1).alias("how"))


def match_relaxed(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (id, composition map, ...) with each glycan of `known` (glycan) of that composition: a join on the composition's text."""
    k = known.select("glycan").distinct().withColumn("key", key(c.composition(F.col("glycan")))).where("key <> ''")
    return asked.withColumn("key", key(F.col("composition"))).join(k, "key").drop("key")


def condensed(matched: DataFrame) -> DataFrame:
    """matched (id, glycan, ...) without sequences that a better defined one of the same id stands for: sequences that are equal up to
    wildcards form chains, of which those with the fewest `?` stay. Only sequences of one id and one topology meet."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(pdf["glycan"].unique())
        group = list(range(len(texts)))
        for i, a in enumerate(texts):
            for j in range(i):
                if group[i] != group[j] and g.same_sequence(a, texts[j]):
                    old, new = max(group[i], group[j]), min(group[i], group[j])
                    group = [new if x == old else x for x in group]
        least: dict[int, int] = {}
        for t, k in zip(texts, group, strict=True):
            least[k] = min(least.get(k, t.count("?")), t.count("?"))
        keep = {t for t, k in zip(texts, group, strict=True) if t.count("?") == least[k]}
        return pdf[pdf["glycan"].isin(keep)]

    schema = ", ".join(f"`{n}` {t}" for n, t in matched.dtypes)
    return matched.groupBy("id", F.length(F.regexp_replace("glycan", r"[^(]", ""))).applyInPandas(run, schema)


def compositions_to_structures(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (id, composition map, values...) with the condensed sequences of each composition."""
    return condensed(match_relaxed(asked, known)).drop("composition")


def unique_topologies(known: DataFrame, composition: dict[str, int]) -> DataFrame:
    """(topology) of the sequences of a composition, in classes and open linkages; sequences with floating parts do not count."""
    want = "".join(f"{k}{v}" for k, v in sorted(composition.items()))
    d = known.select("glycan").distinct().where(~F.contains("glycan", F.lit("{"))).where(key(c.composition(F.col("glycan"))) == want)
    return d.select(c._mapped(letters.topology, "string")(F.col("glycan")).alias("topology")).distinct()


def random_sequences(known: DataFrame, n: int, seed: int = 0, kind: str | None = None) -> DataFrame:
    """n sequences (or all, if fewer) of a class, those with the smallest seeded hash: the same for any partitioning."""
    d = known.select("glycan").distinct()
    d = d.where(c.sequence_class(F.col("glycan")) == kind) if kind else d
    return d.orderBy(F.xxhash64("glycan", F.lit(seed)), "glycan").limit(n)


def ids_of(asked: DataFrame, table: DataFrame, of: str, to: str) -> DataFrame:
    """asked (of) with its first partner in `table` (of, to); one that the table lacks keeps its own text."""
    first = table.groupBy(of).agg(F.min(to).alias(to))
    return asked.join(first, of, "left").withColumn(to, F.coalesce(to, of))
