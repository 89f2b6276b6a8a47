"""Bounds, clashing names and edge cases of the operators, features recomputed by brute force, and the registered queries' contracts."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sugarbeam.llm import chat, kernels, mixing, quality, queries, search, sharding, tokens, toxicity
from sugarbeam.llm.util import labelled_sample

SF = "/root/testdata/sf0.001"
TEXTS = ["", "Ärger über Öl", "one two three two\nONE two, 3!", "x" * 300, "naïve café — déjà vu?", "a\tb\n\nc  d"]


def test_samples_are_bounded_by_rows_and_bytes(spark):
    docs = spark.createDataFrame([(1, "same text")] * 500 + [(2, "b" * 900), (3, None), (4, "d")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (None, 1)], "doc_id bigint, toxic int")
    got = labelled_sample(docs, labels, "toxic", 4).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 4]
    assert sum(len(r.text) for r in labelled_sample(docs, labels, "toxic", 4, 100).collect()) <= 100
    # A text that is longer than the bound loses itself only.
    assert sorted(r.doc_id for r in labelled_sample(docs, labels, "toxic", 4, 100).collect()) == [1, 4]
    assert labelled_sample(docs, labels.limit(0), "toxic", 4).count() == 0


def test_classifiers_keep_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(i, t, i * 1.5, "x", "y") for i, t in enumerate([*TEXTS, None])], "doc_id bigint, text string, score double, _score string, _c0 string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id bigint, toxic int, quality int")
    for m in (toxicity, quality):
        out = m.score(docs, m.fit(docs, labels), docs.dtypes)
        assert out.columns == [*docs.columns, "score"]
        rows = sorted(map(tuple, out.collect()))
        assert [r[:5] for r in rows] == sorted(tuple(r) for r in docs.collect()) and all(0 <= r[5] <= 1 for r in rows)
        for d, lab in ((docs, labels.limit(0)), (docs.limit(0), labels), (docs, labels.where("toxic = 1"))):
            assert m.score(docs, m.fit(d, lab), [("doc_id", "bigint")]).count() == len(TEXTS) + 1
        assert m.score(docs.limit(0), m.fit(docs, labels), docs.dtypes).count() == 0


def test_toxicity_features_are_the_character_ngrams():
    np.seterr(over="ignore")
    data, off = kernels.text_buffers(pa.array(TEXTS))
    f, first = toxicity.block_features(data, off, None)

    def one(gram: str) -> int:
        g = 0
        for ch in gram:
            g = (g * 0x9E3779B97F4A7C15 + ord(ch)) % 2**64
        return ((g ^ len(gram)) * 0xD6E8FEB86659FD93 % 2**64) >> (64 - toxicity.BITS)

    for i, t in enumerate(TEXTS):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
        assert set(f[first[i] : first[i + 1]].tolist()) == {one(low[a : a + k]) for k in toxicity.SIZES for a in range(len(low) - k + 1)}


def test_toxicity_weights_are_scaled_by_log_count_ratios():
    texts = ["bad word here"] * 30 + ["kind word here"] * 30
    data, off = kernels.text_buffers(pa.array(texts))
    m = toxicity.fit_texts(data, off, np.array([1.0] * 30 + [0.0] * 30))
    w = dict(zip(m.hashes.tolist(), m.weights.tolist(), strict=True))
    bad, first = toxicity.block_features(*kernels.text_buffers(pa.array(["bad word"])), None)
    kind, _ = toxicity.block_features(*kernels.text_buffers(pa.array(["kind word"])), None)
    only_bad, only_kind = set(bad.tolist()) - set(kind.tolist()), set(kind.tolist()) - set(bad.tolist())
    assert all(w[h] > 0 for h in only_bad if h in w) and all(w[h] < 0 for h in only_kind if h in w) and only_bad & set(w) and only_kind & set(w)


def test_quality_statistics_by_brute_force():
    data, off = kernels.text_buffers(pa.array(TEXTS))
    got = quality.block_statistics(data, off)
    for i, t in enumerate(TEXTS):
        raw = t.encode()
        words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
        lines = raw.split(b"\n")
        lines = lines[:-1] if lines[-1] == b"" else lines
        n = max(len(raw), 1)
        share = lambda chars: sum(raw.count(bytes([c])) for c in chars) / n  # noqa: B023, E731
        want = {
            "log_bytes": np.log1p(len(raw)), "words": np.log1p(len(words)), "word_bytes": sum(map(len, words)) / max(len(words), 1), "upper": share(range(65, 91)), "digits": share(b"0123456789"), "wide": share(range(128, 256)),
            "distinct_words": len(set(words)) / len(words) if words else 1.0, "commas": share(b",;:"), "bangs": share(b"!"), "stops": share(b".?"), "line_words": np.log1p(len(words) / max(len(lines), 1)),
        }
        for name, v in want.items():
            assert got[i, quality.STATS.index(name)] == pytest.approx(0.0 if not raw else v), (t, name)


def test_mixing_by_brute_force(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(["the", "and", "of"] if i % 3 else ["der", "und", "von"], 12))) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, "de" if i % 3 == 0 else "en") for i in range(60)], "doc_id bigint, domain string")
    model = mixing.fit(d, lab, ["de", "en"])
    count = {k: np.ones(1 << 16) for k in ("de", "en")}
    for i, t in docs:
        raw = t.lower().encode()
        for a, b in zip(raw, raw[1:], strict=False):
            count["de" if i % 3 == 0 else "en"][a << 8 | b] += 1
    w = np.log(np.stack([count[k] / count[k].sum() for k in ("de", "en")]))
    w -= w.mean(axis=0)
    got = {r.doc_id: r for r in mixing.mix(d, lab, {"de": 0.5, "en": 0.5}).collect()}
    total = np.zeros(2)
    for i, t in docs:
        raw = t.lower().encode()
        z = np.log(np.array([21, 41]) / 62) + sum(w[:, a << 8 | b] for a, b in zip(raw, raw[1:], strict=False)) / np.sqrt(len(raw) - 1)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert [got[i].p_de, got[i].p_en] == pytest.approx(p.tolist(), abs=1e-9) and got[i].tokens == 12 and got[i].rate >= 0
        total += 12 * got[i].rate * p
    assert total[0] == pytest.approx(total[1], rel=5e-3)


def test_mixed_sends_texts_through_python_once(spark):
    rows = [(None if i == 9 else i, t, "de" if i % 3 else "en", "x") for i, t in enumerate([*TEXTS, None, "der die das und " * 40_000, "the cat and the dog", "the the of"])]
    d = spark.createDataFrame([*rows, rows[1]], "doc_id bigint, text string, lang string, _rate string")
    lab = d.select("doc_id", F.col("lang").alias("domain"))
    targets = {"de": 0.3, "en": 0.7}
    out = mixing.mixed(d, lab, targets, least=1.0)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    model = mixing.fit(d, lab, list(targets))
    keep = [("doc_id", "bigint"), ("text", "string")]
    member = mixing.memberships(d, model, keep)
    pull = mixing.fit_rates(member, targets, least=1.0)
    two, one = mixing.rated(member, pull, 2, keep, 1.0), mixing.rated_texts(d, model, pull, keep, 1.0)
    key = lambda r: (str(r.doc_id), str(r.text), r._rate)
    assert sorted(map(key, two.collect())) == sorted(map(key, one.collect()))
    times = two.withColumn("times", mixing.copies()).groupBy("doc_id", "text").agg(F.sum("times").alias("n"))
    assert sorted((str(r.doc_id), str(r.text), r["count"]) for r in out.groupBy("doc_id", "text").count().collect()) == sorted((str(r.doc_id), str(r.text), r.n) for r in times.collect())


def test_mixing_bounds_and_strictness(spark):
    d = spark.createDataFrame([(i, "the and of") for i in range(40)] + [(99, "der und von")], "doc_id bigint, text string")
    lab = d.select("doc_id", F.when(F.col("doc_id") == 99, "de").otherwise("en").alias("domain"))
    with pytest.warns(UserWarning, match="not reached"):
        out = mixing.mixed(d, lab, {"de": 0.5, "en": 0.5}, least=1.0, most=3.0)
        assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3 and out.select("doc_id").distinct().count() == 41
    with pytest.raises(ValueError, match="not reached"):
        mixing.mixed(d, lab, {"de": 0.5, "en": 0.5}, least=1.0, most=3.0, strict=True)


@pytest.mark.parametrize("marks", [("### ", ": ", "</turn>\n"), ("<<", " = ", "|end|"), ("[[", "->", "(.*)\n"), ("@@ ", "::", "$^")])
def test_other_templates_round_trip(spark, marks):
    t = chat.Template(head=marks[0], colon=marks[1], end=marks[2])
    texts = ["plain", "".join(marks), "\\h\\t\\b\\c", marks[0].strip() * 3 + "\\" + marks[2].strip(), "", None]
    rows = [(1, i, ["user", "assistant", "odd" + marks[1] + "role"][i % 3], x) for i, x in enumerate(texts)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), t)
    back = out.select(chat.read_back(F.col("formatted"), t).alias("b")).first().b
    assert [(r.role, r.text) for r in back] == [(r[2], r[3] or "") for r in rows]


def test_templates_of_bad_marks_are_refused():
    for bad in (dict(head=" "), dict(end="\\n"), dict(head="h "), dict(head="## ", end="##")):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_a_very_long_conversation(spark):
    d = spark.range(3000).select(F.lit(1).alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("x "), 200).alias("text")).withColumnRenamed("id", "turn")
    out = chat.format_chats(d).select("n_turns", "valid", F.size(chat.read_back(F.col("formatted"))).alias("back")).first()
    assert tuple(out) == (3000, True, 3000)


def test_one_row_repeated_often_is_dealt_over_slices(spark):
    d = spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text")).repartition(16)
    out = sharding.shard(d, 4)
    assert out.select("shard").distinct().count() == 1  # equal texts stay together
    assert sorted(r.slot for r in out.select("slot").collect()) == list(range(4000))


def test_search_routes_by_bounds(spark):
    rng = np.random.default_rng(3)
    mid = rng.normal(size=(10, 8)) * 4
    x = mid[rng.integers(0, 10, 1500)] + rng.normal(size=(1500, 8)) * 0.1
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    e = np.floor(256 * x)
    s = e @ e.T
    want = []
    for q in range(0, 1500, 50):
        best = sorted((-s[q, j], j) for j in range(1500) if j != q)[:5]
        want += [(q, k + 1, j, int(-v)) for k, (v, j) in enumerate(best)]
    assert sorted(map(tuple, search.top_k(d).collect())) == want
    # parts whose centre and radius cannot reach a query's kth score are left out
    c = search.centres(e, 10)
    part = ((e[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
    radius = np.array([np.sqrt(((e[part == p] - c[p]) ** 2).sum(axis=1)).max(initial=0) for p in range(len(c))])
    parts = search.Parts(c, radius, np.arange(len(c)), np.ones(len(c), int))
    worst = np.array([-w[3] for w in want if w[1] == 5]) * -1.0
    can = parts.promises(e[::50]) >= worst[:, None]
    assert can.mean() < 0.5
    assert all((s[q][part == p].max() < worst[i]) for i, q in enumerate(range(0, 1500, 50)) for p in range(len(c)) if not can[i, p] and (part == p).any())


def test_vectors_of_one_value_make_one_part(spark):
    d = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in search.top_k(d).collect()}
    assert len(got) == 30 and [got[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5]


def _fold(i: int, n: int) -> int:
    return zlib.crc32(str(i).encode()) % n


def test_query_contracts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    ids = sorted(docs["doc_id"].tolist())
    for name, n, held in (("op5_nb_ngram_toxicity", 5, 0), ("op7_rule_quality", 3, 1)):
        out = queries.QUERIES[name](spark, SF).toPandas()
        assert sorted(out["doc_id"].tolist()) == ids and out["score"].between(0, 1).all() and ((out["score"] >= 0.5).astype(int) == out["predicted"]).all()
        assert all(h == (_fold(i, n) == held) for i, h in zip(out["doc_id"], out["held_out"], strict=True))
    out = queries.QUERIES["op1_kk_shards"](spark, SF).toPandas().merge(docs, on="doc_id")
    assert len(out) == len(ids) and set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all() and out["shard"].between(0, 39).all()
    assert all(s == 16 + len((t or "").encode()) for s, t in zip(out["size"], out["text"], strict=True)) and all(c == zlib.crc32(t.encode()) for c, t in zip(out["text_crc32"], out["text"], strict=True) if t is not None)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    out = queries.QUERIES["op2_cutting_stock"](spark, SF).toPandas()
    assert set(out["doc_id"]) == set(ids)
    for _, g in out.groupby("doc_id"):
        g = g.sort_values("start")
        assert g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() == g["doc_tokens"].iloc[0]
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    out = queries.QUERIES["op8_minmax_dedup"](spark, SF).toPandas()
    assert sorted(out["doc_id"].tolist()) == ids and (out["kept"] == (out["doc_id"] == out["component_id"])).all() and (out["component_id"] <= out["doc_id"]).all()
    out = queries.QUERIES["op4_soft_mixing"](spark, SF).toPandas()
    assert sorted(out["doc_id"].tolist()) == ids and np.allclose(out[[c for c in out.columns if c.startswith("p_")]].sum(axis=1), 1) and (out["rate"] >= 0).all()


def test_labels_of_held_out_rows_are_not_read(spark, tmp_path):
    """Turned labels of the held-out rows change no score."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    labels.withColumn("toxic", F.when(crc % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(crc % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op5_nb_ngram_toxicity", "op7_rule_quality"):
        a, b = (queries.QUERIES[name](spark, str(x)).select("doc_id", F.round("score", 9)).collect() for x in (SF, tmp_path))
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_toxicity_finds_held_out_rows():
    """Of the held-out labelled documents of the larger table nine in ten toxic ones are found, and what is found is toxic."""
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.1"
    docs = dict(zip(*(pq.read_table(f"{sf}/documents.parquet", columns=[c])[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    labels = pq.read_table(f"{sf}/labels.parquet", columns=["doc_id", "toxic"]).to_pylist()
    rows = sorted((r["doc_id"], docs[r["doc_id"]], r["toxic"] > 0) for r in labels if r["toxic"] is not None and docs.get(r["doc_id"]) is not None)
    parts = {held: [r for r in rows if (_fold(r[0], 5) == 0) == held] for held in (False, True)}
    model = toxicity.fit_texts(*kernels.text_buffers(pa.array([r[1] for r in parts[False]])), np.array([float(r[2]) for r in parts[False]]))
    data, off = kernels.text_buffers(pa.array([r[1] for r in parts[True]]))
    got = np.concatenate([model.scores(data[off[i] : off[j]], off[i : j + 1] - off[i], model.slots()) for i, j in kernels.blocks(off)]) >= 0.5
    truth = np.array([r[2] for r in parts[True]])
    assert (got & truth).sum() >= 0.9 * truth.sum() and (got & truth).sum() >= 0.97 * got.sum()


CUT = [b"", b"caf\xc3", b"\xa9 goes on", b"\xff\xfe two \xe2\x82 bad bytes", b"\xed\xa0\x80 a lone surrogate", "Ärger über Öl".encode(), b"<|endoftext|> \xc3", b"caf\xc3\xa9"]


def _block(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return kernels.text_buffers(pa.array(raw, pa.binary()))


def test_malformed_bytes_count_as_replacement_characters():
    np.seterr(over="ignore")
    mended = [r.decode(errors="replace").encode() for r in CUT]
    for k in range(len(CUT)):
        for raw, want in ((CUT[:k], mended[:k]), (CUT[k:], mended[k:]), (CUT[k : k + 2], mended[k : k + 2])):
            data, off = kernels.utf8(*_block(raw))
            assert [data[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)] == want
            for f in (lambda d, o: toxicity.block_features(d, o, None), tokens.bpe(queries.tokenizer_path()).encode):
                assert all((x == y).all() and len(x) == len(y) for x, y in zip(f(*_block(raw)), f(*_block(want)), strict=True))
    data, off = _block(mended)
    assert kernels.utf8(data, off)[0] is data


def test_pipeline_takes_texts_cut_inside_a_character(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "documents":  # labelled texts, too
            df = df.withColumn("text", F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("20E282"))).otherwise(F.unhex(F.lit("")))).cast("string"))
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = out
        stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        cut = out.where("doc_id % 3 = 0")
        assert cut.count()
        if "text" in out.columns:  # as they came
            assert cut.where(F.hex(F.col("text").cast("binary")).endswith("20E282")).count() == cut.count()
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_features_of_long_texts_are_read_in_windows(monkeypatch):
    np.seterr(over="ignore")
    text = "".join(chr(65 + x) for x in np.random.default_rng(2).integers(0, 300, 5000))
    data, off = _block([text.encode()])
    slot = np.where(np.arange(1 << toxicity.BITS) % 3 == 0, np.arange(1 << toxicity.BITS) // 3, -1).astype(np.int32)
    sizes = []
    whole, inner = [toxicity.block_features(data, off, s) for s in (None, slot)], toxicity._grams
    monkeypatch.setattr(toxicity, "_grams", lambda cp, o, s: sizes.append(len(cp)) or inner(cp, o, s))
    for w in (1, 7, 1000, 4999, 5000):
        monkeypatch.setattr(toxicity, "WINDOW", w)
        for s, want in zip((None, slot), whole, strict=True):
            sizes.clear()
            got = toxicity.block_features(data, off, s)
            assert all((x == y).all() and len(x) == len(y) for x, y in zip(got, want, strict=True)) and max(sizes) <= w + 5
