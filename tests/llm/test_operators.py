import hashlib
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sugarbeam.llm import chat, dedup, licenses, mixing, packing, quality, search, sharding, tiff, toxicity
from sugarbeam.llm.queries import tokenizer_path
from tests.llm.test_kernels import shingles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words bigint, score double, shard int, _k int"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards boxed quietly near my old red barn today and then went home again for tea"


def edge_documents():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60000))
    near = BASE.split()
    texts = [None, "", " \n\t ", "one", "one", "One two three", long, BASE, BASE, BASE.upper(), " ".join(near[:-1] + ["coffee"]), " ".join(["start"] + near), "ä é ü " * 30, "All rights reserved.", "x\nReleased under the MIT license\ny", "a\x00b"]
    rows = [(i, t, "en" if i % 2 else None, "src0", 1, 1, 0.5, 3, 7) for i, t in enumerate(texts)]
    return [*rows, (3, "one", "en", "src0", 1, 1, 0.5, 3, 7), (None, "no id", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_documents(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d, key=lambda x: (x is not None, x))
    return sorted(((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_equal_brute_force(spark, docs, words):
    got = dedup.near_duplicates(docs, dedup.MinMax(words=words)).collect()
    want = components([(r[0], r[1]) for r in edge_documents()], words, 80)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_large_families_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(420):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(60)] = f"z{rng.randrange(4000)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = dedup.near_duplicates(d, dedup.MinMax(chunk=32, pivots=4)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components(rows, 4, 80)


def test_one_of_each_keeps_one(spark, docs, none):
    kept = dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and 4 not in ids and 7 in ids and 8 not in ids and 9 not in ids and {0, 1, 2, 6, None} <= set(ids)
    assert dedup.one_of_each(none).count() == 0


def test_shards(spark, docs, none):
    rows = sharding.shard(docs, 5).collect()
    text = {(r[0], r[1]) for r in edge_documents()}
    assert len(rows) == len(edge_documents())
    of = defaultdict(set)
    for r in rows:
        t = next(t for d, t in text if d == r.doc_id)
        assert r["size"] == len((t or "").encode()) + 16 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        of[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard(none, 5).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 37 % 300).cast("int")).alias("text"))
    sums = Counter()
    for r in sharding.shard(many.withColumn("text", F.concat("text", F.col("doc_id").cast("string"))), 7).collect():
        sums[r.shard] += r["size"]
    assert max(sums.values()) - min(sums.values()) <= 64


def test_packing(spark, docs, none):
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path(), 256).collect()
    text = {r[0]: r[1] for r in edge_documents()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(text)
    for d, got in pieces.items():
        ids = np.array([*tok.encode(text[d] or "", add_special_tokens=False).ids, 1], "<u4")
        got = sorted({(r.start, r.length, r.ids_crc32) for r in got})
        assert got[0][0] == 0 and sum(n for _, n, _ in got) == len(ids)
        for s, n, crc in got:
            assert n <= 256 and zlib.crc32(ids[s : s + n].tobytes()) == crc
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    assert sorted(at) == list(range(len(at)))
    for p in at.values():
        p.sort()
        assert sum(n for _, n in p) <= 256 and all(o == sum(n for _, n in p[:i]) for i, (o, _) in enumerate(p))
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "\\b\\h", "###", "</turn>\n### User: x", "", None, "a: b", "\\", "##", "</turn", "\n"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, 5) for i, t in enumerate(hard)]
    rows += [(2, 0, "tool: ###", "x", 0), (2, 1, "User", "y", 0), (3, None, None, None, None), (None, 0, "user", "n", 0), (4, 0, "user", "same", 0), (4, 0, "user", "same", 0), (5, 0, "system", "s", 1), (5, 1, "user", "u", 1), (5, 2, "assistant", "a", 1)]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, segments int")
    out = {r.conv_id: r for r in chat.format_chats(d).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        assert [(b.role, b.text) for b in out[c].back] == [(r, x) for _, r, x in turns]
        assert out[c].loss == "".join(x for _, r, x in turns if r == "assistant")
        assert "".join(s.text for s in out[c].segments) == out[c].formatted
    assert out[5].valid and not out[4].valid and not out[2].valid and not out[1].valid
    assert chat.format_chats(d.limit(0)).count() == 0


def test_native_plans_have_no_python(spark, docs):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    for df in (licenses.scan(docs), chat.format_chats(turns)):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Arrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_license_scan_equals_brute_force(spark, docs, none):
    apache = licenses.TEMPLATES["Apache-2.0/notice"]
    extra = [(100, "Licensed under the Apache License, Version 2.0."), (101, apache.replace("You may obtain", "one can get")), (102, apache.replace(" ", "\n")), (103, "ALL RIGHTS\tRESERVED!!!"), (104, "all rights all rights reserved"), (104, "all rights reserved"), (105, None), (106, "rights"), (107, "licensed under cc by nc 4 0 today")]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    want = Counter()
    sets = {k: licenses.bigrams(licenses.normal_words(v)) for k, v in licenses.TEMPLATES.items()}
    for doc, text in [(r.doc_id, r.text) for r in d.collect()]:
        lines = (text or "").split("\n")
        for seg, line in [*([(0, text)] if len(lines) > 1 else []), *enumerate(lines, 1)]:
            b = licenses.bigrams(licenses.normal_words(line))
            for k, s in sets.items():
                if b and 200 * len(b & s) >= 80 * (len(b) + len(s)):
                    want[doc, seg, k, len(b), len(s), len(b & s)] += 1
    got = Counter(tuple(r)[:6] for r in licenses.scan(d).collect())
    assert got == want and len(want) >= 8
    assert licenses.scan(none).count() == 0 and licenses.scan(docs, {}).count() == 0


def runs_by_brute_force(doc, text, percent=80):
    words, out = licenses.normal_words(text or ""), Counter()
    g = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    for k, v in licenses.TEMPLATES.items():
        t, most = licenses.bigrams(licenses.normal_words(v)), licenses.size_bounds(len(licenses.normal_words(v)) - 1, percent)[1]
        found, kept = [], []
        for a in range(len(g)):
            run = set()
            for z in range(a, min(a + most, len(g))):
                run.add(g[z])
                if g[a] in t and g[z] in t and 200 * len(run & t) >= percent * (len(run) + len(t)):
                    found.append((-2 * len(run & t) / (len(run) + len(t)), a, z, len(run), len(run & t)))
        for x in sorted(found):
            if all(x[2] < y[1] or y[2] < x[1] for y in kept):
                kept.append(x)
        for _, a, z, n, shared in kept:
            out[doc, a + 1, z - a + 2, k, n, len(t), shared] += 1
    return out


def test_license_runs_equal_brute_force_and_find_wrapped_notices(spark, docs, none):
    long = ["Apache-2.0/notice", "GPL-3.0/notice", "MIT/text", "ISC/text"]
    prose = [f"w{i * 7919 % 613}" for i in range(800)]
    extra = [(200 + i, textwrap.fill(licenses.TEMPLATES[k], 76) + "\n" + " ".join(prose)) for i, k in enumerate(long)]
    extra += [(300 + i, " ".join(prose[:90]) + "\n" + textwrap.fill(licenses.TEMPLATES[k], 40, break_long_words=False)) for i, k in enumerate(long)]
    extra += [(400, "Intro words here. Released under the MIT License. More prose follows."), (401, "all rights all rights reserved, all rights reserved"), (402, None), (403, "rights")]
    extra += [(404, licenses.TEMPLATES["ISC/text"].replace("fitness", "use and more words").replace("hereby", "not") + " " + licenses.TEMPLATES["ISC/text"]), (405, extra[0][1]), (405, extra[0][1])]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    want = sum((runs_by_brute_force(r.doc_id, r.text) for r in d.collect()), Counter())
    got = licenses.runs(d)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert Counter(tuple(r)[:7] for r in got.collect()) == want
    whole = {(r.doc_id, r.license_id) for r in got.where("dice = 1").collect()}
    assert {(base + i, k) for base in (200, 300) for i, k in enumerate(long)} | {(400, "MIT/line")} <= whole
    assert not [x for x in licenses.scan(d).collect() if x.doc_id in {*range(200, 204), *range(300, 304), 400}]
    assert licenses.runs(none).count() == 0 and licenses.runs(docs, {}).count() == 0


def test_tiff_columns(spark, docs, none):
    files = tiff.store_texts(docs)
    out = tiff.pages(files, "media", [("doc_id", "bigint"), ("n_bytes", "bigint")]).collect()
    text = {r[0]: (r[1] or "").encode() for r in edge_documents()}
    assert len(out) == len(edge_documents())
    for r in out:
        raw = text[r.doc_id]
        want = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert r.error is None and bytes(r.pixels) == want and r.n_bytes == len(raw) and r.page == 0
    bad = spark.createDataFrame([(1, None), (2, b"x"), (3, bytearray(tiff.encode([]) ))], "doc_id bigint, media binary")
    assert all(r.error for r in tiff.pages(bad, "media", [("doc_id", "bigint")]).collect())
    assert tiff.store_texts(none).count() == 0


def test_search(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(260)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(50, rows[50][1]), (None, [1.0] * 5), (2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 5), (2150, [float("inf")] * 5)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    good = {(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, u in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in good if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, search.top_k(d).collect())) == sorted(want)
    assert search.top_k(d.limit(0)).count() == 0
    assert search.top_k(d.where("vec_id in (0, 1)")).count() == 1


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(14)] + [(None, 1, 1), (15, None, None), (3, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_classifiers_score_all_rows(spark, docs, none, labels):
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.fit(docs, labels, label)
        keep = docs.dtypes if module is toxicity else [(c, t) for c, t in docs.dtypes if c != "score"]
        d = docs.drop("score")
        out = module.score(d, model, [(c, t) for c, t in keep if c != "score"]).collect()
        assert len(out) == len(edge_documents()) and all(0 <= r.score <= 1 for r in out)
        assert module.score(none, model, [("doc_id", "bigint")]).count() == 0
        for few in (labels.limit(0), labels.where(f"{label} = 1")):
            assert all(0 <= r.score <= 1 for r in module.score(d, module.fit(docs, few, label), [("doc_id", "bigint")]).collect())


def test_rules_as_columns_equal_rules_in_numpy(spark, docs, labels):
    model = quality.RuleModel(-0.5, ((((3, True, 0.1), (5, False, 0.9)), 1.5), (((0, True, 2.0),), -0.7)))
    out = quality.statistics(docs, [("doc_id", "bigint")]).withColumn("s", model.column()).toPandas()
    x = out[[f"_q_{s}" for s in quality.STATS]].to_numpy(float)
    assert abs(model.scores(x) - out["s"].to_numpy()).max() < 1e-12


def test_mixing_reaches_targets(spark, none):
    words = {"en": ["the", "and", "that", "with"], "de": ["über", "schön", "nicht", "zwölf"]}
    rows = [(i, " ".join(words["en" if i % 4 else "de"][(i + k) % 4] for k in range(30 + i % 50)), "en" if i % 4 else "de", 1) for i in range(400)]
    rows += [(900, None, None, 1), (901, "", None, 1), (5, rows[5][1], "en", 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _rate int")
    out = mixing.mix(d, d.select("doc_id", F.col("lang").alias("domain")), {"de": 0.5, "en": 0.5}).toPandas()
    de, en = (out["rate"] * out["tokens"] * out["p_de"]).sum(), (out["rate"] * out["tokens"] * out["p_en"]).sum()
    assert len(out) == len(rows) and (out["rate"] >= 0).all() and abs(de / en - 1) < 0.01
    m = mixing.mixed(d, d.select("doc_id", F.col("lang").alias("domain")), {"de": 0.5, "en": 0.5})
    assert m.columns == d.columns and m.count() == out["copies"].sum()
    assert mixing.mix(none, none.select("doc_id", F.col("lang").alias("domain"))).count() == 0


def test_mixing_reaches_targets_of_rare_domains(spark):
    words = {"en": ["the", "and", "that", "with"], "de": ["über", "schön", "nicht", "zwölf"]}
    rows = [(i, " ".join(words[lang][(i + k) % 4] for k in range(40)), lang) for i in range(2002) for lang in ["en" if i % 1001 else "de"]]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = mixing.mix(d, d.select("doc_id", F.col("lang").alias("domain")), {"de": 0.5, "en": 0.5}).toPandas()
    de, en = (out["rate"] * out["tokens"] * out["p_de"]).sum(), (out["rate"] * out["tokens"] * out["p_en"]).sum()
    assert abs(de / (de + en) - 0.5) < 0.001 and (out["rate"] >= 0).all()


def test_mixing_tells_unreached_targets(spark):
    member = spark.createDataFrame([(10, [0.9, 0.1]), (10, [0.8, 0.2])], "_tokens bigint, _p array<double>")
    with pytest.warns(UserWarning, match="not reached"):
        mixing.fit_rates(member, {"a": 0.01, "b": 0.99}, least=1.0)


def test_mixing_moves_domains_of_all_sizes_in_few_rounds():
    rng = np.random.default_rng(4)
    for shares in ([0.7, 0.15, 0.14, 0.01], [0.8, 0.15, 0.049, 0.001]):
        p = np.eye(4)[rng.choice(4, 20000, p=shares)] * 0.98 + 0.02 * rng.dirichlet(np.ones(4), 20000)
        tokens, calls = rng.integers(1, 2000, 20000).astype(float), []
        target = np.array([0.2, 0.4, 0.2, 0.2])
        have = p.T @ tokens
        want = target * (have / target).max()
        shared = mixing.gram(p, tokens) / mixing.PARTS
        fitted, complaint = mixing.solve(lambda done: calls.append(1) or mixing.sums(p, tokens, done, 0.0) / mixing.PARTS, shared, want, 1e-3, 60)
        assert not complaint and len(calls) < 15
        assert (np.abs(p.T @ (tokens * mixing.rates(p, fitted)) - want) <= 1e-3 * want).all()


def test_mixing_comes_as_near_as_plain_descent():
    """Targets that bounded rates can't reach: no other rates give smaller squares than those found, in the measure of the fit."""
    rng = np.random.default_rng(8)
    p, tokens = rng.dirichlet([0.6, 0.3, 0.2], 300), rng.integers(0, 300, 300).astype(float)
    shared = mixing.gram(p, tokens) / mixing.PARTS
    metric = np.linalg.inv(shared)
    want = np.array([0.1, 0.2, 0.7]) * 4 * tokens.sum()
    fitted, complaint = mixing.solve(lambda done: mixing.sums(p, tokens, done, 1.0, 3.0) / mixing.PARTS, shared, want, 1e-3, 60)
    x, plain = mixing.rates(p, fitted, 1.0, 3.0), np.ones(300)
    for _ in range(20_000):
        plain = np.clip(plain - p @ (metric @ (p.T @ (plain * tokens) - want)), 1.0, 3.0)
    squares = [off @ metric @ off for off in (p.T @ (r * tokens) - want for r in (x, plain))]
    assert complaint and x.min() >= 1 and x.max() <= 3 and squares[0] <= squares[1] * 1.001


def test_mixing_rates_do_not_depend_on_partitions(spark):
    words = ["the", "and", "der", "und", "über", "with"]
    rows = [(i, " ".join(words[(i * k + k) % 6] for k in range(1 + i % 50)), "de" if i % 3 else "en") for i in range(700)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    lab = d.select("doc_id", F.col("lang").alias("domain"))
    a, b = (sorted(mixing.mix(x, lab, {"de": 0.3, "en": 0.7}).collect()) for x in (d.repartition(2), d.repartition(7, "text")))
    assert a == b


def test_pipeline_stages_on_small_tables(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = out
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / f"s{i}"))
        out = spark.read.parquet(str(tmp_path / f"s{i}"))
        if i < 4:
            assert out.columns == docs.columns
        if name == "mixing":
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
        if i < 3:
            assert out.join(before, docs.columns, "left_anti").count() == 0
    assert out.columns[0] == "doc_id" and 0 < out.count()


def test_query_digests(spark):
    from sugarbeam.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    r = QUERIES["op3_chat_machine"](spark, sf).where("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.loss_chars == len(said) and r.valid
    text = {x.doc_id: (x.text or "").encode() for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for x in QUERIES["op6_tiff_pages"](spark, sf).collect():
        raw = text[x.doc_id]
        want = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert x.payload_sha256 == hashlib.sha256(want).hexdigest() and x.tail_crc32 == zlib.crc32(want[-64:]) and x.payload_bytes == len(want)
