"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarbeam.llm import chat, dedup, lexical, licenses, mixing, ngram_join, packing, phrases, quality, search, sharding, tiff, toxicity
from sugarbeam.llm.util import fold, read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_kk_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes. Null texts are one group, repeated rows have a slot each."""
    return sharding.shard(read(spark, sf_dir, "documents"))


def op2_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens. A null or empty text is one piece of its final id; repeated rows are packed each."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def _predictions(scored: DataFrame, n: int, held: int) -> DataFrame:
    return scored.select("doc_id", (fold(F.col("doc_id"), n) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_chat_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, read back from their formatted text. Nulls count as empty; repeated turns are turns."""
    told = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = [spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), said.alias("text")) for i, r in enumerate(("user", "assistant"))]
    out = chat.format_chats(told.unionByName(extra[0]).unionByName(extra[1]))
    back, loss = F.col("back"), F.col("loss")
    out = out.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    turns = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size(back).cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rates and copies of all documents; the classifier learns the languages of labelled documents. Texts without words have 0 tokens."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return mixing.mix(docs, docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain")))


def op5_nb_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labels outside fold 0 of 5. Null and empty texts have the score of the bias."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return _predictions(toxicity.score(docs, model, [("doc_id", "bigint")]), 5, 0)


def op6_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as TIFF pages and read back. A null text is 64 zero bytes, as an empty one is."""
    files = tiff.store_texts(read(spark, sf_dir, "documents"))
    keep = [("doc_id", "bigint"), ("n_bytes", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string")]
    files = files.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    out = tiff.pages(files, "media", keep)
    size = F.octet_length("pixels")
    return out.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring(F.col("pixels"), F.lit(-64), F.lit(64))).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def op7_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from labels outside fold 1 of 3. Null texts count as empty, which have a score like any other."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    return _predictions(quality.score(docs, model, [("doc_id", "bigint")]), 3, 1)


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents. Null, empty and blank texts stay alone; repeated rows repeat."""
    got = dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for each fiftieth vector. Vectors that are null or hold null or non-finite components take no part."""
    return search.top_k(read(spark, sf_dir, "embeddings"))


def op10_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and whole texts of all documents that match a licence template. Null texts match nothing; repeated rows match each."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_license_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of all documents that match a licence template, over lines and inside prose."""
    return licenses.runs(read(spark, sf_dir, "documents"))


def op11_phrase_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language of all documents. Null texts are empty, a null lang is `und`; repeated rows count each."""
    return phrases.phrases(read(spark, sf_dir, "documents"))


def op12_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard similarity of 0.8. Null, empty and blank texts stay alone; repeated rows repeat."""
    return ngram_join.similar(read(spark, sf_dir, "documents"))


def op13_variable_block_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item. Null texts have no terms; repeated rows are ranked each."""
    return lexical.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_kk_shards, op2_cutting_stock, op3_chat_machine, op4_soft_mixing, op5_nb_ngram_toxicity, op6_tiff_pages, op7_rule_quality, op8_minmax_dedup, op9_cover_tree_search, op10_license_dice, op10_license_runs, op11_phrase_slots, op12_grouped_prefix_join, op13_variable_block_wand)}

_OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP3 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t') AS etext,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
      ELSE '~' || replace(replace(replace(replace(role, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t'), ': ', '\\c') END AS label,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prior,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS later
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(label) + 2 + length(etext) + 8) AS BIGINT) AS formatted_chars,
  bool_and(coalesce(prior, 'start') || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')
    AND (later IS NOT NULL OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
"""


def _op10() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
    words = "list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH n(license_id, text) AS (VALUES {rows}),
t AS (SELECT license_id, {grams} AS b FROM (SELECT license_id, {words.format("text")} AS w FROM n)),
c AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT doc_id, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS segment, unnest(ls) AS line FROM c
  UNION ALL SELECT doc_id, 0, text FROM c WHERE len(ls) > 1),
g AS (SELECT doc_id, segment, {grams} AS b FROM (SELECT doc_id, segment, {words.format("line")} AS w FROM s)),
m AS (
  SELECT doc_id, segment, license_id, CAST(len(g.b) AS BIGINT) AS bigrams, CAST(len(t.b) AS BIGINT) AS template_bigrams, CAST(len(list_intersect(g.b, t.b)) AS BIGINT) AS shared
  FROM g JOIN t ON 200 * least(len(g.b), len(t.b)) >= {licenses.PERCENT} * (len(g.b) + len(t.b)))
SELECT *, 2.0::DOUBLE * shared / (bigrams + template_bigrams) AS dice FROM m WHERE 200 * shared >= {licenses.PERCENT} * (bigrams + template_bigrams)
"""


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, {_LOW.format("text")} AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
k AS (SELECT unnest(range(1, 6)) AS k),
g AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, k) GROUP BY ALL HAVING count(*) >= 100),
c AS (
  SELECT lang, k, phrase, a, j, array_to_string(ws[1 : j], ' ') AS head, array_to_string(ws[j + 1 : k], ' ') AS tail
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM g WHERE k > 1)),
s AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.j, x.a AS l, y.a AS r, n.n, CAST((1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM c JOIN g AS x ON x.lang = c.lang AND x.phrase = c.head JOIN g AS y ON y.lang = c.lang AND y.phrase = c.tail JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.lang = b.lang AND g.k > b.k AND g.a >= b.a AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM o QUALIFY rank <= 2000
"""

_TERMS = "list_filter(string_split_regex(" + _LOW + ", '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS.format("text")} AS ws FROM documents WHERE text IS NOT NULL),
v AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS total FROM d WHERE len(ws) > 0),
t AS (SELECT d, doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
f AS (SELECT d, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
q AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, v WHERE term IN (SELECT term FROM q) GROUP BY term),
i AS (SELECT d, doc_id, f.term, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS s FROM f JOIN w ON w.term = f.term, v),
r AS (SELECT q, item_id, d, doc_id, CAST(sum(times * s) AS BIGINT) AS score FROM q JOIN i ON i.term = q.term GROUP BY ALL HAVING sum(times * s) > 0),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM r)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""


_OP12 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS d, doc_id, list_filter(string_split_regex({_LOW.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT d, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS g FROM d),
u AS (SELECT min(d) AS u, list_sort(g) AS g, min(doc_id) AS doc_id FROM s WHERE len(g) > 0 GROUP BY list_sort(g)),
t AS (SELECT u, len(g) AS n, unnest(g) AS token FROM u),
e AS (
  SELECT a.u AS a, b.u AS b FROM t AS a JOIN t AS b ON a.token = b.token AND a.u <> b.u AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.u, b.u, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT u, u FROM u UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT r.a AS u, min(u.doc_id) AS component_id FROM r JOIN u ON u.u = r.b GROUP BY r.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN u ON u.g = list_sort(s.g) LEFT JOIN c ON c.u = u.u
"""

SQL: dict[str, str] = {"op11_phrase_slots": _OP11, "op12_grouped_prefix_join": _OP12, "op13_variable_block_wand": _OP13, "op3_chat_machine": _OP3, "op9_cover_tree_search": _OP9, "op10_license_dice": _op10()}
