"""Text functions: places, brackets, repeats, classes by reducing end, glycoform counts and shorthand notations.

What plain expressions can say is a Column function; the rest works on one text and is mapped by `columns`.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reducing ends of the classes, in the order in which they are asked for.
ENDS = {
    "free": ["-ol"],
    "lipid": ["1Cer", "Ins"],
    "N": ["GlcNAc(b1-4)GlcNAc", "[Fuc(a1-6)]GlcNAc", "[Fuc(a1-3)]GlcNAc"],
    "O": ["GalNAc", "GalNAcOS", "GalNAc4S", "GalNAc6S", "Man", "Fuc", "Gal", "GlcNAc", "GlcNAcOS", "GlcNAc6S"],
    "lipid/free": [f"Gal{s}(b1-4){b}Glc" for s in ("", "3S", "6S", "OS") for b in ("", "[Fuc(a1-3)]")] + [f"Gal(b1-4)Glc{s}" for s in ("3S", "6S", "OS")],
}
# Last residues of each class, and the N cores that O, free and lipid exclude.
LAST = {
    "O": ["GalNAc", "GalNAcOS", "GalNAc4S", "GalNAc6S", "Man", "Fuc", "Gal", "GlcNAc", "GlcNAcOS", "GlcNAc6S"],
    "N": ["GlcNAc"],
    "free": ["Glc", "GlcOS", "Glc3S", "GlcNAc", "GlcNAcOS", "Gal", "GalOS", "Gal3S", "Ins"],
    "lipid": ["Glc", "GlcOS", "Glc3S", "GlcNAc", "GlcNAcOS", "Gal", "GalOS", "Gal3S", "Ins"],
}
N_CORES = ["GlcNAc(b1-4)GlcNAc", "[Fuc(a1-6)]GlcNAc"]
# Roots of the networks of each class.
ROOTS = {
    "free": ["Gal(b1-4)Glc-ol", "Gal(b1-4)GlcNAc-ol"],
    "O": ["GalNAc", "Fuc", "Man"],
    "N": ["Man(b1-4)GlcNAc(b1-4)GlcNAc"],
    "lipid": ["Glc1Cer", "Gal1Cer", "Ins"],
    "milk": ["Gal(b1-4)Glc", "Gal(b1-4)GlcNAc"],
}
ROOT_ENDS = {"free": ["-ol"], "O": ["GalNAc"], "N": ["GlcNAc"], "lipid": ["1Cer", "Ins"], "milk": ["Glc"]}
# The codes of sulfated disaccharides.
URONIC = {"U": "HexA", "D": "4uHexA", "G": "GlcA", "I": "IdoA", "g": "Gal"}
URONIC_SULFATE = {"0": "", "2": "2S"}
HEXOSAMINE = {"A": "GlcNAc", "a": "GalNAc", "S": "GlcNS", "H": "GlcN"}
HEXOSAMINE_SULFATE = {"0": "", "3": "3S", "4": "4S", "6": "6S", "9": "3S6S", "10": "4S6S"}
# Letters of a linear code that is written from the root on, with their anomers.
ROOT_FIRST = {"G": ("Glc", "a"), "A": ("Gal", "b"), "Y": ("GlcNAc", "b"), "M": ("Man", "a"), "X": ("Xyl", "b"), "F": ("Fuc", "a"), "L": ("GlcA", "b")}


def ends_with(c: Column, ends: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.endswith(e) for e in ends))


def sequence_class(c: Column) -> Column:
    """repeat, free, lipid, N, O, lipid/free or nothing; null for null."""
    out = F.when(c.startswith("["), F.lit("repeat"))
    for kind, ends in ENDS.items():
        out = out.when(ends_with(c, ends), F.lit(kind))
    return out.when(c.isNotNull(), F.lit(""))


def has_class(c: Column, kind: str, confidence: float | None = None, least: float = 0.3) -> Column:
    """Whether the last residue suits the class; where it does not, a confidence above `least` decides, if there is one."""
    if kind not in LAST:
        return F.lit(False)
    bare = F.regexp_replace(c, "(-ol|1Cer)$", "")
    fits = ends_with(bare, LAST[kind])
    if kind != "N":
        fits = fits & ~ends_with(bare, N_CORES)
    return fits if confidence is None else fits | F.lit(confidence > least)


def find_nth_reverse(c: Column, needle: str, n: int) -> Column:
    """Place from 0 of the n-th needle from the end, without overlaps; -1 if there are fewer."""
    from sugarbeam.functions.columns import find_nth

    at = find_nth(F.reverse(c), needle[::-1], n)
    return F.when(at >= 0, F.length(c) - at - len(needle)).otherwise(F.lit(-1))


def nth_from_end(text: str, needle: str, n: int, with_branch: bool = False) -> int:
    """As find_nth_reverse; `with_branch` steps back over the branch that stands right before the match."""
    at = len(text)
    for _ in range(n):
        at = text.rfind(needle, 0, at)
        if at < 0:
            return -1
    if with_branch and at > 1 and text[at - 1] == "]" and text[at - 2] != "[":
        depth, k = 0, at
        while k > 0:
            k -= 1
            depth += {"]": 1, "[": -1}.get(text[k], 0)
            if not depth:
                return k
    return at


def matching_brackets(text: str, opening: str = "(", closing: str = ")") -> list[tuple[int, int, int]]:
    """(first place inside, place of the closing one, depth) of each pair in order of closing; escaped ones do not count."""
    out, stack = [], []
    for i, ch in enumerate(text):
        if i and text[i - 1] == "\\":
            continue
        if ch == opening:
            stack.append(i + 1)
        elif ch == closing and stack:
            out.append((stack.pop(), i, len(stack)))
    return out


def matched_brackets_only(text: str) -> str:
    """The text without square brackets that have no partner."""
    paired = {p for a, b, _ in matching_brackets(text.replace("\\", " "), "[", "]") for p in (a - 1, b)}
    return "".join(ch for i, ch in enumerate(text) if ch not in "[]" or i in paired)


def nested_content(text: str) -> int:
    """Linkages at a bracket depth of two or more."""
    depth = n = 0
    for ch in text:
        depth += {"[": 1, "]": -1}.get(ch, 0)
        n += ch == "(" and depth > 1
    return n


def lines(c: Column) -> Column:
    """The lines of a pasted block, without white space around the block."""
    return F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), "\n")


def equal_repeats(a: Column, b: Column) -> Column:
    """Whether b is a rotation of the repeat a, whose last part after the last linkage does not count."""
    unit = F.regexp_extract(a, r"^(.*\))", 1)
    return (a == b) | F.contains(F.concat(unit, unit), b)


def labels(c: Column, library: dict[str, int]) -> Column:
    """The number of each character; null for one that the library lacks."""
    known = F.create_map(*[F.lit(x) for kv in library.items() for x in kv])
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.element_at(known, x))


def roots(kinds: Column) -> Column:
    """The permitted roots of a table whose distinct reducing-end classes are `kinds` (array): the first of free, O, N, lipid, milk."""
    out = F.when(F.array_contains(kinds, "free"), F.lit(ROOTS["free"]))
    for k in ("O", "N", "lipid", "milk"):
        out = out.when(F.array_contains(kinds, k), F.lit(ROOTS[k]))
    return out.otherwise(F.array().cast("array<string>"))


def root_kind(c: Column) -> Column:
    out = F.when(ends_with(c, ROOT_ENDS["free"]), F.lit("free"))
    for k in ("O", "N", "lipid", "milk"):
        out = out.when(ends_with(c, ROOT_ENDS[k]), F.lit(k))
    return out


def glycoform_features(parts: Column, letters: tuple[str, ...] = ("H", "N", "A", "F", "G")) -> Column:
    """map of the counts of H, N, A, F, G in a composition map (by long or short names; 0 where one is missing) and of complex, high_Man, hybrid, antennary_Fuc (0 or 1)."""
    # The long names of the letters.
    long = {"H": "Hex", "N": "HexNAc", "F": "dHex", "A": "Neu5Ac", "G": "Neu5Gc"}
    have = {k: F.coalesce(F.element_at(parts, k), F.element_at(parts, long[k]), F.lit(0)) for k in long}
    sia = have["A"] + have["G"]
    flags = {"complex": sia > 1, "high_Man": (have["H"] > 5) & (have["N"] == 2), "hybrid": (sia < 2) & (have["H"] > 4), "antennary_Fuc": have["F"] > 1}
    pairs = [(k, have[k].cast("int")) for k in letters] + [(k, v.cast("int")) for k, v in flags.items()]
    return F.when(parts.isNotNull(), F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]))


def glycosite(c: Column) -> Column:
    """protein_site of protein_site_composition."""
    return F.substring_index(c, "_", 2)


def bracketed_glycoform(c: Column) -> Column:
    """HxNxFxAx of a composition written as four numbers in square brackets (Hex, HexNAc, Neu5Ac, dHex)."""
    n = F.regexp_extract_all(F.regexp_extract(c, r"\[(.*)", 1), F.lit(r"(\d+)"), 1)
    return F.when(F.size(n) >= 4, F.concat(F.lit("H"), n[0], F.lit("N"), n[1], F.lit("F"), n[3], F.lit("A"), n[2]))


def sulfated_disaccharide(c: Column) -> Column:
    """Condensed form of a four- or five-letter disaccharide code such as D2A6; null if a letter is unknown."""
    get = lambda table, x: F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x)
    return F.concat(
        get(URONIC, F.substring(c, 1, 1)), get(URONIC_SULFATE, F.substring(c, 2, 1)), F.lit("(?1-?)"),
        get(HEXOSAMINE, F.substring(c, 3, 1)), get(HEXOSAMINE_SULFATE, F.substring(c, 4, 9)),
    )


def specified(c: Column, kingdom: str = "Animalia", clade: str = "Mammalia") -> Column:
    """The sequence with what the species' enzymes leave open filled in."""
    # Inferences of the clades, in order.
    steps = [("dHex", "Fuc"), ("Gal(b1-?)GlcNAc", "Gal(b1-3/4)GlcNAc")] if kingdom == "Animalia" else []
    steps += [("GlcNAc(b1-4)[Fuc(a1-?)]GlcNAc", "GlcNAc(b1-4)[Fuc(a1-6)]GlcNAc" if clade == "Mammalia" else "GlcNAc(b1-4)[Fuc(a1-3/6)]GlcNAc")]
    for s in ("Neu5Ac", "Neu5Gc"):
        steps += [(f"{s}(a2-?){s}", f"{s}(a2-8){s}"), (f"{s}(a2-?)", f"{s}(a2-3/6)")]
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), steps, c)


def core_stub(text: str) -> str:
    """A composition over the trimannosyl core, as '(Hex)2 (HexNAc)1 + (Man)3(GlcNAc)2': the parts float before the core."""
    extra, core = (x.strip() for x in text.replace("Deoxyhexose", "Fuc").split("+"))
    core = core.replace("(Man)3(GlcNAc)2", "Man(a1-3)[Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc")
    return "".join(f"{{{name}(?1-?)}}" * int(n) for name, n in re.findall(r"\(([^)]+)\)(\d+)", extra)) + core


def root_first(text: str) -> str:
    """A linear code written from the root on, as Y41Y41M: between two letters stand the parent's and the child's position.
    It is read from its end, so that a letter comes right before the positions of its own bond."""
    out = []
    for letter, own, to, mark in re.findall(r"([GAYMXFL])(?:(\d)(\d))?|([()])", text[::-1]):
        if mark:
            out.append("[" if mark == ")" else "]")
            continue
        name, anomer = ROOT_FIRST[letter]
        out.append(f"{name}({anomer}{own}-{to})" if own else name)
    return "".join(out).replace("Man(a1-4)GlcNAc", "Man(b1-4)GlcNAc")


def unrolled_repeat(text: str) -> tuple[str, bool]:
    """'-4)Glc(b1-3)Gal(b1-' as one unit that ends in the residue it begins with, and whether it was such a repeat."""
    m = re.match(r"(-P)?(-\d+\))(\[[^\]]*\])?([A-Za-z0-9-]+)", text)
    if not text.startswith("-") or not m:
        return text, False
    phosphate, bond, branch, first = (x or "" for x in m.groups())
    unit = branch + first + text[m.end() :].rstrip("-") + phosphate + bond + first
    unit = re.sub(r"(\w+)\(([\w?])(\d+)-P-(\d+)\)", r"\1\3P(\2\3-\4)", unit)
    return re.sub(r"-ol(\d+)P", r"\1P-ol", unit), True


def possible_bonds(text: str) -> str:
    """The sequence with bonds that chemistry forbids left open: to position 2 of an N-acetylated residue, to a position
    that is modified, and two bonds of neighbours to one position."""
    residue, bond = r"[A-Za-z]+", r"[ab?][12]"
    text = re.sub(rf"\(({bond})-2\)({residue}NAc)", r"(\1-?)\2", text)
    text = re.sub(rf"\(({bond})-(\d)\)({residue}\2[A-Z])", r"(\1-?)\3", text)
    twice = re.compile(rf"({residue})\(({bond})-(\d)\)\[((?:{residue}\({bond}-\d\))*)({residue})\(({bond})-\3\)\]")
    return twice.sub(r"\1(\2-?)[\4\5(\6-?)]", text)
