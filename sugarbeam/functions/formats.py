"""Readers of graph-like formats: node and edge lists (KCF), XML residues (GlycoCT) and the workbench's line format."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from sugarbeam.functions import glycan as g
from sugarbeam.functions.glycan import NotASequence, Residue

# Stem types and substituents of the XML form.
STEMS = {"dglc": "Glc", "dgal": "Gal", "dman": "Man", "lgal": "Fuc", "dgro": "Neu", "lido": "Ido", "dxyl": "Xyl", "dara": "D-Ara", "lara": "Ara", "HEX": "Hex", "lman": "Rha", "lxyl": "Col", "dgul": "Gul"}
SUBSTITUENTS = {"n-acetyl": "NAc", "sulfate": "OS", "phosphate": "OP", "n-glycolyl": "5Gc", "acetyl": "OAc", "methyl": "OMe", "amino": "N"}


def _tree(names: dict[int, str], bonds: list[tuple[int, int, str]]) -> str:
    """Canonical text of residues and bonds (parent, child, linkage); the root is the residue that is no child."""
    nodes = {k: Residue(v) for k, v in names.items()}
    kids = set()
    for parent, child, link in bonds:
        if parent not in nodes or child not in nodes or child in kids or parent == child:
            raise NotASequence("a bond of a residue that is unknown or bound already")
        kids.add(child)
        nodes[child].linkage = link
        nodes[parent].children.append(nodes[child])
    roots = [k for k in nodes if k not in kids]
    if len(roots) != 1 or len(g.residues(nodes[roots[0]])) != len(nodes):
        raise NotASequence("not one tree")
    return g.write(nodes[roots[0]])


def from_kcf(text: str) -> str:
    """NODE and EDGE sections: `1 GlcNAc 0 0` and `1 2:b1 1:4` (donor with anomer and position, acceptor with position)."""
    section, names, bonds = "", {}, []
    for line in (x.strip() for x in text.split("\n")):
        word = line.split()
        if not word or line.startswith("///"):
            continue
        if word[0] in ("ENTRY", "NODE", "EDGE"):
            section = word[0]
        elif section == "NODE":
            names[int(word[0])] = word[1].capitalize() if word[1].islower() or word[1].isupper() else word[1]
        elif section == "EDGE":
            (donor, _, own), (acceptor, _, to) = (w.partition(":") for w in word[1:3])
            bonds.append((int(acceptor), int(donor), f"{own[:1] or '?'}{own[1:] or '?'}-{to or '?'}"))
    return _tree(names, bonds)


def from_glycoct_xml(text: str) -> str:
    """basetype and substituent residues and the connections between them."""
    try:
        top = ET.fromstring(text.strip())
    except ET.ParseError as e:
        raise NotASequence(str(e)) from e
    base, names, subs = {}, {}, {}
    for b in top.iter("basetype"):
        stem = b.find("stemtype") if b.find("stemtype") is not None else next(b.iter("stemtype"), None)
        base[int(b.get("id"))] = (b.get("anomer") or "?").replace("x", "?").replace("o", "?")
        names[int(b.get("id"))] = STEMS.get(stem.get("type"), stem.get("type")) if stem is not None else "Monosaccharide"
    for s in top.iter("substituent"):
        subs[int(s.get("id"))] = SUBSTITUENTS.get(s.get("name").lower(), s.get("name"))
    bonds = []
    for c in top.iter("connection"):
        parent, child = int(c.get("parent")), int(c.get("child"))
        link = next(c.iter("linkage"), c)
        place = lambda tag: next((x.get("pos") for x in link.iter(tag) if x.get("pos")), "?").replace("-1", "?")
        if child in subs:
            names[parent] += subs[child] if subs[child] in ("NAc", "5Gc", "N") else place("parent").replace("?", "O") + subs[child].lstrip("O")
        else:
            bonds.append((parent, child, f"{base[child]}{place('child')}-{place('parent')}"))
    names = {k: v.replace("Neu5Gc", "Neu5Gc").replace("NeuNAc", "Neu5Ac") for k, v in names.items()}
    return _tree(names, bonds)


_UNIT = re.compile(r"--(?P<to>[\d?])(?P<an>[ab?])(?P<own>[\d?])(?P<ring>[DL]-|[?]-)?(?P<name>[A-Za-z0-9]+)(?:,(?P<size>[pf?]))?")


def from_workbench(text: str) -> str:
    """`freeEnd--?b1D-Glc,p--4b1D-Gal,p$MONO,...`: units from the root on, branches in round brackets; sulfates and phosphates are
    units of their own; `}` ends the bound part, before which floating units follow in brackets."""
    body = text.split("$MONO")[0]
    main, _, rest = body.partition("}")

    def read(s: str) -> list[Residue]:
        top: list[Residue] = []
        now: Residue | None = None
        stack: list[Residue | None] = []
        i = 0
        while i < len(s):
            if s[i] == "(":
                stack.append(now)
                i += 1
                continue
            if s[i] == ")":
                if not stack:
                    raise NotASequence(s)
                now = stack.pop()
                i += 1
                continue
            m = _UNIT.match(s, i)
            if not m:
                raise NotASequence(s)
            i = m.end()
            name = m["name"] + ("f" if m["size"] == "f" else "")
            if name in ("S", "P"):
                if now is None:
                    raise NotASequence(s)
                now.name += ("O" if m["to"] == "?" else m["to"]) + name
                continue
            r = Residue(name, f"{m['an']}{m['own']}-{m['to']}")
            (top if now is None else now.children).append(r)
            now = r
        return top

    head, sep, chain = main.partition("--")
    trees = read(sep + chain)
    if len(trees) != 1:
        raise NotASequence(text)
    root = trees[0]
    out = g.write(Residue(root.name + ("-ol" if head == "freeEnd" else ""), "", root.children))
    floating = sorted(g.write(r) for part in re.findall(r"\(*(--[^()]*)\)*", rest) for r in read(part))
    return "".join(f"{{{f}}}" for f in floating) + out
