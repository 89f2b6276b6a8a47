import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sugarbeam.llm import chat, kernels, licenses, mixing, packing, quality, search, sharding, tiff, tokens, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
TEXTS = ["", " ", "a", "A b", "one two three", "One two THREE four", "x " * 9, "ä ö\tü\nß  é", "one two three four five one two three four", None]


def shingles(text, k):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [1, 2, 4, 5])
def test_shingle_sets_match_brute_force(k):
    np.seterr(over="ignore")
    data, off = kernels.text_buffers(pa.array(TEXTS * 2))
    h, first = kernels.shingle_sets(data, off, k)
    sets = [frozenset(h[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    want = [shingles(t, k) for t in TEXTS * 2]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for i in range(len(sets)):
        for j in range(len(sets)):
            assert len(sets[i] & sets[j]) == len(want[i] & want[j])


def test_text_buffers_of_slices_and_blocks():
    a = pa.array(["ab", None, "", "cde", "f"])
    data, off = kernels.text_buffers(a.slice(1, 3))
    assert data.tobytes() == b"cde" and off.tolist() == [0, 0, 0, 3]
    assert list(kernels.blocks(np.array([0, 5, 5, 9, 30]), 8)) == [(0, 2), (2, 3), (3, 4)]
    assert kernels.text_buffers(pa.array([], pa.string()))[1].tolist() == [0]


def test_token_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    np.seterr(over="ignore")
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, mine = Tokenizer.from_file(path), tokens.bpe(path)
    rng = random.Random(1)
    parts = ["'", "s", "re", "ll", "d", " ", "  ", "\n", "\t", " \n", "1", "2½", "é", "漢", "!", "..", " ", " ", "😀", "n't", "'S", "a", "Z", "_", "٣", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)] + [""]
    for at in range(0, len(texts), 7):
        some = texts[at : at + 7]
        ids, first = mine.encode(*kernels.text_buffers(pa.array(some)))
        for i, t in enumerate(some):
            assert ids[first[i] : first[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_differencing_balances_and_isolates_a_giant():
    rng = random.Random(3)
    sizes = [rng.randint(16, 5000) for _ in range(900)]
    at = sharding.differencing(sizes, 7)
    sums = [sum(s for s, k in zip(sizes, at) if k == b) for b in range(7)]
    assert max(sums) - min(sums) <= 20
    at = sharding.differencing([10**6, *sizes[:50]], 4)
    assert sum(k == at[0] for k in at) == 1
    assert sharding.differencing([], 4) == [] and sharding.differencing([5], 3) in ([0], [1], [2])
    assert sorted(sharding.differencing([4, 4, 4], 3)) == [0, 1, 2] and sharding.differencing([1, 2], 1) == [0, 0]


def test_patterns_hold_all_pieces_close_to_the_bound():
    rng = np.random.default_rng(0)
    demand = rng.integers(0, 3000, 64)
    got = packing.patterns(demand)
    assert (sum(a * t for a, t in got) == demand).all()
    units = np.arange(1, 65)
    assert all(units @ a <= 64 for a, _ in got)
    least = (demand @ units) / 64
    assert sum(t for _, t in got) <= least * 1.03 + 64
    assert packing.patterns(np.zeros(8, int)) == []
    one = packing.patterns(np.array([0, 0, 5]))
    assert sum(t for _, t in one) == 5


def test_tiff_round_trips():
    rng = np.random.default_rng(1)
    text = np.frombuffer((b"the quick brown fox " * 900)[:17920], np.uint8).reshape(-1, 64)
    pages = [text, rng.integers(0, 256, (37, 21), np.uint8), np.zeros((5, 200), np.uint8), rng.integers(0, 4, (33, 18, 3), np.uint8)]
    for kind in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for predictor in (1, 2):
            for tile in (0, 16):
                for order in "<>":
                    raw = tiff.encode(pages, kind, predictor, tile, 7, order)
                    rows = tiff.pages_of(raw)
                    assert [r[7] for r in rows] == [p.tobytes() for p in pages] and [r[0] for r in rows] == [0, 1, 2, 3]


def test_bad_tiff_files_give_an_error_row():
    raw = tiff.encode([np.arange(256, dtype=np.uint8).reshape(4, 64)])
    for bad in (None, b"", b"II*\0", b"junk", raw[:20], raw[:-9], raw[:4] + b"\xff\xff\xff\x7f" + raw[8:]):
        rows = tiff.pages_of(bad)
        assert len(rows) >= 1 and all(r[9] for r in rows)
    for i in range(8, len(raw)):
        tiff.pages_of(raw[:i] + b"\xff" + raw[i + 1 :])
    loop = bytearray(raw)
    loop[-4:] = loop[4:8]
    assert len(tiff.pages_of(bytes(loop))) == 1


def test_dual_search_equals_brute_force():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 12)) * 200
    x = np.floor(np.concatenate([centers[rng.integers(0, 6, 700)] + rng.normal(size=(700, 12)) * 9, np.zeros((90, 12)), rng.normal(size=(60, 12)) * 100]))
    ids = rng.permutation(len(x))
    own = [int(i) for i in ids[::40]]
    q = x[::40]
    best = search.Best(len(q), 5)
    u, names = search._distinct(x, ids, 6)
    search.dual_search(search.CoverTree(q), own, search.CoverTree(u), names, best, True)
    for k, o in enumerate(own):
        want = sorted((-int(v @ q[k]), int(i)) for v, i in zip(x, ids) if i != o)[:5]
        assert best.rows[k] == want


def test_cover_tree_covers():
    x = np.random.default_rng(2).normal(size=(500, 3))
    t = search.CoverTree(x)
    for k in range(len(t.center)):
        d = np.sqrt(((x[t.points[k]] - x[t.center[k]]) ** 2).sum(axis=1))
        assert d.max() <= t.radius[k] + 1e-9
        if len(t.children[k]):
            assert sorted(np.concatenate([t.points[c] for c in t.children[k]]).tolist()) == sorted(t.points[k].tolist())


def test_rules_and_lasso_find_a_conjunction():
    rng = np.random.default_rng(4)
    x = rng.random((2000, len(quality.STATS)))
    y = ((x[:, 3] > 0.5) & (x[:, 5] <= 0.7)).astype(float)
    rules = quality.tree_rules(x, y)
    r = np.stack([quality._holds(x, q) for q in rules], axis=1).astype(float)
    b, w = quality.lasso_logistic(r, y, quality.L1)
    model = quality.RuleModel(b, tuple((q, float(v)) for q, v in zip(rules, w) if abs(v) > 1e-6))
    assert ((model.scores(x) >= 0.5) == (y == 1)).mean() > 0.97
    assert len(model.rules) < len(rules)


def test_toxicity_learns_words():
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "mild", "calm", "river", "stone"]
    texts, y = [], []
    for i in range(400):
        t = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            t[rng.randrange(40)] = rng.choice(["idiot", "scum"])
        texts.append(" ".join(t))
        y.append(float(i % 4 == 0))
    data, off = kernels.text_buffers(pa.array(texts))
    m = toxicity.fit_texts(data[: off[300]], off[:301], np.array(y[:300]))
    p = m.scores(data[off[300] :], off[300:] - off[300], m.slots())
    assert ((p >= 0.5) == (np.array(y[300:]) == 1)).all()
    assert m.scores(np.zeros(0, np.uint8), np.array([0, 0]), m.slots()).shape == (1,)


def test_posteriors_and_rates_reach_targets():
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.3, 0.3, 0.3], 3000)
    t = rng.integers(1, 400, 3000).astype(float)
    want = np.array([0.5, 0.3, 0.2]) * 1.5 * t.sum()
    norm = np.linalg.eigvalsh((p * t[:, None]).T @ p).max()
    steps = []
    for _ in range(200):
        steps.append((p.T @ (mixing.replay(p, steps)[1] * t) - want) / norm)
    x = mixing.replay(p, steps)[1]
    assert (x >= 0).all() and np.abs(p.T @ (x * t) / want - 1).max() < 1e-3


def test_license_anchors_are_in_all_matches():
    sets = {k: licenses.bigrams(licenses.normal_words(v)) for k, v in licenses.TEMPLATES.items()}
    marks = set(licenses.anchors(sets, licenses.PERCENT))
    for b in sets.values():
        free = {g for g in b if not marks & set(g.split())}
        assert len(free) < licenses.size_bounds(len(b), licenses.PERCENT)[0]
    for n in range(1, 60):
        low, high = licenses.size_bounds(n, 80)
        fits = [a for a in range(1, 200) if 200 * min(a, n) >= 80 * (a + n)]
        assert (min(fits), max(fits)) == (low, high)


def test_template_escapes_are_prefix_free():
    t = chat.Template()
    codes = [c for _, c in t.escapes]
    assert len(set(codes)) == len(codes) and all(c[0] == "\\" and len(c) == 2 for c in codes)
