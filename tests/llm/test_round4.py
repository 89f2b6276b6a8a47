"""The n-gram join, phrase mining and ranked search against brute force, with edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sugarbeam.llm import lexical, ngram_join, phrases, quality
from sugarbeam.llm.lexical import Ranking, Shard, block_bounds

DOCS = "doc_id bigint, text string, lang string, _c0 string, group string"


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None, k: int = 5) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, min(len(words), 1))))


def components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, size, component) by comparing all pairs of sets."""
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[top(i)] = top(j)
    least: dict = {}
    for i, r in enumerate(rows):
        least.setdefault(top(i), []).append(r[0])
    small = {t: min(ids, key=lambda x: (x is not None, x or 0)) for t, ids in least.items()}
    return [(r[0], len(s), small[top(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(seed: int, n: int, words: int, edits: int) -> list[str]:
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        text = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits)):
            text[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("p", [ngram_join.Join(bits=16), ngram_join.Join(bits=10, hot=2, block=4, wide=8, chunk=4, marks=64)])
def test_join_equals_all_pairs(spark, p):
    texts = near_copies(1, 60, 60, 6) + near_copies(2, 30, 200, 14) + near_copies(3, 20, 12, 2)
    common = " ".join(f"c{i}" for i in range(70))
    texts += [f"{common} own{i} text{i} of{i} document{i} {i} {i + 1} {i + 2}" for i in range(25)] + [f"u{i} " * 8 + common for i in range(10)]
    texts += ["one two", "ONE\ttwo", "two one", "a b c d e", "A b\nc d  e", "", "  \n", None, None, "x" * 5000, "long " * 3000, "Ünï cödé wörds hére nöw", "  is a word"]
    rows = [(i % 150 if i != 3 else None, t) for i, t in enumerate(texts)]
    rows += rows[:40] + [(None, "one two")]
    df = spark.createDataFrame([(*r, None, "z", "g") for r in rows], DOCS)
    got = [tuple(r) for r in ngram_join.similar(df, p).collect()]
    assert Counter(got) == Counter(components(rows))


def test_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.similar(df).count() == 0
    one = spark.createDataFrame([(5, None), (5, " ")], "doc_id bigint, text string")
    assert sorted(map(tuple, ngram_join.similar(one).collect())) == [(5, 0, 5), (5, 0, 5)]


def test_marks_bound_the_common_part_from_above():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, 90).astype(np.uint64)) for _ in range(12)]
    for bits in (64, 2048):
        m = ngram_join.marks(sets, bits)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                assert len(a) - int(np.bitwise_count(m[i] & ~m[j]).sum()) >= len(np.intersect1d(a, b))


def best_phrases(rows: list[tuple], least: int, top: int) -> list[tuple]:
    f: dict = {}
    n: Counter = Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        rows_ = []
        for w, a in often.items():
            if any(len(v) > len(w) and b >= a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for v, b in often.items()):
                continue
            cuts = [(1000 * a * n[lang] // (counts[w[:k]] * counts[w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows_.append((-score, -a, " ".join(w).encode(), a, counts[w[:k]], counts[w[k:]], score))
        rows_.sort()
        out += [(lang, i + 1, r[2].decode(), r[3], r[4], r[5], n[lang], r[6]) for i, r in enumerate(rows_[:top])]
    return sorted(out)


@pytest.mark.parametrize("p", [phrases.Mining(least=4, top=30), phrases.Mining(least=4, top=30, bits=10, slots=16, block=64, load=10**9)])
def test_phrases_equal_brute_force(spark, p):
    rng = np.random.default_rng(7)
    names = ["red", "Blue", "grün", "TALL", "small", "old"]
    rows = [(i, " ".join(names[k] for k in rng.integers(0, 6, 40)) + ("; new york city hall. new york" if i % 2 else "\nnew\tyork, city"), ["en", "de", None, "und"][i % 4]) for i in range(24)]
    rows += [(1, None, "en"), (2, "", "xx"), (3, ".;.", "yy"), (4, "lone", "zz"), (5, "red red red red red red red", "rr")] + rows[:3]
    df = spark.createDataFrame([(a, b, c, "z", "g") for a, b, c in rows], DOCS)
    got = sorted(map(tuple, phrases.phrases(df, p).collect()))
    assert got == best_phrases(rows, 4, 30)


def test_phrases_of_nothing_and_the_perfect_hash(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert phrases.phrases(df).count() == 0
    assert phrases.phrases(spark.createDataFrame([(1, None, None), (2, "a b", None)], "doc_id bigint, text string, lang string")).count() == 0
    np.seterr(over="ignore")
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    h = phrases.PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    words = keys[: len(keys) // 2 * 2].reshape(-1, 2)
    slots = phrases.Slots(words)
    find = lambda rows: slots.find(phrases.phrase_keys(rows), lambda i, j: rows[i, j])
    at = find(words)
    assert (slots.phrases[at] == words).all() and (find(words[:, ::-1].copy()) == -1).all()


def ranking(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    words = lambda t: [low(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    counts = [(i, len(w), Counter(w)) for i, w in held]
    df = Counter(x for _, _, c in counts for x in c)
    weight = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * v + 1))) for x, v in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, size, c in counts:
            m = 100 - 25 + (25 * size * n) // total
            scored.append((sum(weight[x] * ((10**9 * c[x]) // (1000 * c[x] + 12 * m)) for x in words(text) if x in c), i))
        scored = sorted(((s, i) for s, i in scored if s > 0), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("p", [Ranking(k=5), Ranking(k=5, documents=16, range=2, longest=4, items=3, postings=50)])
def test_ranked_search_equals_brute_force(spark, p):
    rng = np.random.default_rng(11)
    names = [f"t{int(k)}" for k in np.minimum(rng.zipf(1.4, 4000), 60)]
    docs = [(i, " ".join(names[a : a + int(rng.integers(1, 60))]).replace("t7", "Ünï-T7")) for i, a in enumerate(rng.integers(0, 3900, 120))]
    docs += docs[:5] + [(500, None), (501, ""), (502, "--- !!"), (None, "t1 t2 t3"), (503, "t2 " * 5000)]
    items = [(i, " ".join(names[a : a + 6])) for i, a in enumerate(rng.integers(0, 3900, 9))] + [(20, None), (21, "nowhere"), (22, "t7 ÜNÏ t7"), (22, "t7 ÜNÏ t7"), (None, "T1")]
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id bigint, text string, score string, terms string")
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, rank int")
    got = [tuple(r) for r in lexical.ranked(d, q, p).collect()]
    assert Counter(got) == Counter(ranking(docs, items, 5))


def test_ranked_search_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.ranked(d.limit(0), q).count() == lexical.ranked(d, q.limit(0)).count() == 0


def test_blocks_minimise_the_bound_error():
    rng = np.random.default_rng(2)
    most = rng.integers(0, 50, (4, 9)) * rng.integers(0, 2, (4, 9))
    count = np.where(most > 0, rng.integers(1, 5, (4, 9)), 0)
    total = np.where(most > 0, most + (count - 1) * (most // 2), 0)
    got = block_bounds(most, count, total, 4, 2.0)
    assert (got >= most).all()

    def cost(t: int, cuts: list[int]) -> float:
        each = 2.0 * total[t].sum() / max(count[t].sum(), 1)
        return sum(each + count[t, a:b].sum() * most[t, a:b].max() - total[t, a:b].sum() for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    for t in range(4):
        ways = [[0, *(i + 1 for i in range(8) if bits >> i & 1), 9] for bits in range(256)]
        least = min(cost(t, w) for w in ways if max(np.diff(w)) <= 4)
        # The chosen bounds are those of some way of least cost.
        fits = [w for w in ways if max(np.diff(w)) <= 4 and cost(t, w) == pytest.approx(least) and all((got[t, a:b] == most[t, a:b].max() * (count[t, a:b] > 0)).all() for a, b in zip(w[:-1], w[1:], strict=True))]
        assert fits


def test_search_skips_ranges_that_cannot_matter():
    n = np.arange(1, 2001)
    ids = np.arange(2000)
    first = np.arange(2001)
    here = Shard(ids, n, first, np.where(ids < 40, 0, 1), np.ones(2000, np.int64), np.array([5000, 10]), 2000, int(n.sum()), Ranking(k=5))
    doc, score = here.search(np.array([0, 1]), np.array([1, 1]))
    assert len(doc) == 5 and (np.diff(score) <= 0).all() and here.read < here.ranges / 2


def test_queries_have_their_contracts_columns(spark):
    from sugarbeam.llm import queries as q

    sf = "/root/testdata/sf0.001"
    want = {
        "op11_phrase_slots": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
        "op12_grouped_prefix_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op13_variable_block_wand": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    }
    for name, columns in want.items():
        assert dict(q.QUERIES[name](spark, sf).dtypes) == columns


def test_tallies_of_several_mappers_add_up(spark):
    from sugarbeam.llm import slabs

    def run(batches):
        tally = slabs.Tally()
        for batch in batches:
            yield from tally.add(batch.column("k").to_numpy())
        yield from tally.rest()

    keys = np.random.default_rng(3).integers(0, 200_000, 5000)
    df = spark.createDataFrame(pa.table({"k": keys})).repartition(150)
    got = slabs.tree_sum(df.mapInArrow(run, slabs.SCHEMA), 200_000, np.int64, lambda x: x)
    assert (got[:200_000] == np.bincount(keys, minlength=200_000)).all()


def test_keys_sent_before_are_not_sorted_again(monkeypatch):
    sorted_, unique = [], np.unique
    monkeypatch.setattr(phrases.np, "unique", lambda x, **more: (sorted_.append(len(x)), unique(x, **more))[1])
    some, sent, seen = np.random.default_rng(5), phrases.Sent(1 << 16), set()
    for key in [np.array([0, 7, 0, 1 << 16, 7 + (1 << 16), 7], np.uint64), *(some.integers(0, 2**64, 900, np.uint64)[some.integers(0, 900, 5000)] for _ in range(2))] * 3:
        at = sent.new(key)
        got = key[at].tolist()
        assert got == sorted(set(key.tolist()) - seen) and all(key.tolist().index(k) == i for k, i in zip(got, at.tolist(), strict=True))
        seen |= set(got)
    assert max(sorted_[3:]) < 500 and len(sent.keys) == len(seen)


def test_quality_is_fitted_on_ids_of_any_type(spark):
    docs = spark.createDataFrame([(i, "A plain line of words, and one more. " * (1 + i % 7) if i % 2 else "$$ ## 123 " * (1 + i % 5)) for i in range(120)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) AS quality")
    want = quality.fit(docs, labels)
    for kind in ("int", "decimal(38,0)", "double"):
        as_ = lambda df, kind=kind: df.withColumn("doc_id", F.col("doc_id").cast(kind))
        assert want.rules and quality.fit(as_(docs), as_(labels)) == want
