"""Stand-in inputs of the registered queries, from the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str):
    """Sums of money in decimals, which add up the same in any order."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, sample, grp, value): revenue by brand and supplier class; two groups of five samples."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    d = line.select("l_partkey", (F.col("l_suppkey") % 10).alias("k"), "l_extendedprice").join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    d = d.groupBy(F.col("p_brand").alias("feature"), "k").agg(money("l_extendedprice").alias("value"))
    return d.select("feature", F.concat(F.lit("s"), "k").alias("sample"), (F.col("k") % 2).cast("int").alias("grp"), "value")


ABUNDANCE = """ab AS (
  SELECT p_brand AS feature, 's' || (l_suppkey % 10) AS sample, CAST((l_suppkey % 10) % 2 AS INTEGER) AS grp,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As abundance, over few line items, so that cells are missing; completed with zeros."""
    from sugarbeam.operators.abundance import complete

    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    line = line.where((F.col("l_quantity") >= 49) & (F.col("l_discount") >= 0.085)).select("l_partkey", (F.col("l_suppkey") % 10).alias("k"), "l_quantity")
    d = line.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("feature"), "k").agg(F.sum("l_quantity").alias("value"))
    return complete(d.select("feature", F.concat(F.lit("s"), "k").alias("sample"), (F.col("k") % 2).cast("int").alias("grp"), "value"))


SPARSE = """sp0 AS (
  SELECT p_brand AS feature, 's' || (l_suppkey % 10) AS sample, CAST((l_suppkey % 10) % 2 AS INTEGER) AS grp, sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49 AND l_discount >= 0.085 GROUP BY ALL),
sp AS (
  SELECT f.feature, s.sample, s.grp, coalesce(sp0.value, 0.0) AS value
  FROM (SELECT DISTINCT feature FROM sp0) f CROSS JOIN (SELECT DISTINCT sample, grp FROM sp0) s LEFT JOIN sp0 ON sp0.feature = f.feature AND sp0.sample = s.sample)"""


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, p, effect): p-values made from customers' balances."""
    c = table(spark, sf_dir, "customer")
    p = ((F.col("c_custkey") * 7919 % 10007) + 1) / 10008.0
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("grp"), (p * p * p).alias("p"), (F.col("c_acctbal") / 1000).alias("effect"))


P_VALUES = """pv AS (
  SELECT c_custkey AS id, c_mktsegment AS grp, q * q * q AS p, c_acctbal / 1000 AS effect
  FROM (SELECT *, ((c_custkey * 7919 % 10007) + 1) / 10008.0::DOUBLE AS q FROM customer))"""


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, sample, grp, value): events by type in communities of users."""
    e = table(spark, sf_dir, "events")
    d = e.groupBy((F.col("user_id") % 20).alias("k"), F.col("event_type").alias("feature")).agg(F.count("*").cast("double").alias("value"))
    return d.select("feature", F.concat(F.lit("u"), "k").alias("sample"), (F.col("k") % 3).cast("int").alias("grp"), "value")


COUNTS = """ct AS (
  SELECT event_type AS feature, 'u' || (user_id % 20) AS sample, CAST((user_id % 20) % 3 AS INTEGER) AS grp, CAST(count(*) AS DOUBLE) AS value
  FROM events GROUP BY ALL)"""


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, time, sample, value): revenue by order priority and month."""
    o = table(spark, sf_dir, "orders")
    t = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")
    d = o.groupBy(F.col("o_orderpriority").alias("feature"), t.cast("double").alias("time")).agg(money("o_totalprice").alias("value"))
    return d.withColumn("sample", F.col("time").cast("string"))


MONTHLY = """mo AS (
  SELECT o_orderpriority AS feature, CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS DOUBLE) AS time,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY ALL)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, diffs): parts that precede others, by supplier and line number classes."""
    line = table(spark, sf_dir, "lineitem")
    src, step = F.col("l_partkey") % 40, F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(10)
    d = line.select(F.concat(F.lit("n"), src).alias("src"), F.concat(F.lit("n"), src + step).alias("dst"), F.concat(F.lit("r"), F.col("l_suppkey") % 3).alias("diffs"))
    return d.distinct()


EDGES = """ed AS (
  SELECT DISTINCT 'n' || (l_partkey % 40) AS src, 'n' || (l_partkey % 40 + CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 10 END) AS dst, 'r' || (l_suppkey % 3) AS diffs FROM lineitem)"""


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, virtual, abundance): all parts in 50 classes, as many as `edges` has nodes. virtual: an odd number of odd sizes; abundance: the price
    of all, 0 where the number of large sizes is divisible by 3."""
    part = table(spark, sf_dir, "part")
    d = part.groupBy(F.concat(F.lit("n"), F.col("p_partkey") % 50).alias("node")).agg(F.count_if(F.col("p_size") % 2 == 1).alias("odd"), F.count_if(F.col("p_size") > 25).alias("large"), money("p_retailprice").alias("x"))
    return d.select("node", (F.col("odd") % 2).cast("int").alias("virtual"), F.when(F.col("large") % 3 == 0, F.lit(0.0)).otherwise(F.col("x")).alias("abundance"))


VERTICES = """ve AS (
  SELECT 'n' || (p_partkey % 50) AS node, CAST(count(*) FILTER (WHERE p_size % 2 = 1) % 2 AS INTEGER) AS virtual,
    CASE WHEN count(*) FILTER (WHERE p_size > 25) % 3 = 0 THEN 0.0 ELSE CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) END AS abundance
  FROM part GROUP BY ALL)"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, abundance): all parts in 50 classes, as many as `edges` has nodes; the money of those that vertices() counts."""
    part = table(spark, sf_dir, "part").withColumn("x", F.when(F.col("p_size") % 3 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice")))
    return part.groupBy(F.concat(F.lit("n"), F.col("p_partkey") % 50).alias("node")).agg(money("x").alias("abundance"))


#: Residues and linkages that chains are made of.
CHAIN = ["Gal", "GlcNAc", "Man", "Fuc", "Neu5Ac", "Glc"]
BONDS = ["b1-4", "b1-3", "a1-2", "a2-3", "a1-6"]
#: Classes of the residues, for chains that leave some open.
KINDS = ["Hex", "HexNAc", "Hex", "dHex", "Sia", "Hex"]


def _pick(values: list[str], k) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def chains(spark: SparkSession, sf_dir: str, open_: bool = False) -> DataFrame:
    """(id, glycan): a chain of 3 to 6 residues for each part, from its key and size; open_: every eleventh residue is a class and every seventh bond
    unknown."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("long").alias("s"))

    def piece(j: int):
        k = F.floor(F.col("id") / (j + 1)) + F.col("s") * j
        name, bond = _pick(CHAIN, k), _pick(BONDS, F.col("id") + F.col("s") * j + j)
        if open_:
            name = F.when((F.col("id") + j) % 11 == 0, _pick(KINDS, k)).otherwise(name)
            bond = F.when((F.col("id") + j) % 7 == 0, F.lit("?1-?")).otherwise(bond)
        last = F.lit(j) == F.col("s") % 4 + 2
        return F.when(F.lit(j) > F.col("s") % 4 + 2, F.lit("")).when(last, name).otherwise(F.concat(name, F.lit("("), bond, F.lit(")")))

    return part.select("id", F.concat(*map(piece, range(6))).alias("glycan"))


def chain_sql(open_: bool = False) -> str:
    """ch(id, glycan, rs, ls): the chains with their residues and bonds as lists."""
    names = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
    pick = lambda v, k: f"{names(v)}[({k}) % {len(v)} + 1]"
    k = "p_partkey // (j + 1) + p_size * j"
    name, bond = pick(CHAIN, k), pick(BONDS, "p_partkey + p_size * j + j")
    if open_:
        name, bond = f"CASE WHEN (p_partkey + j) % 11 = 0 THEN {pick(KINDS, k)} ELSE {name} END", f"CASE WHEN (p_partkey + j) % 7 = 0 THEN '?1-?' ELSE {bond} END"
    return f"""ch0 AS (SELECT p_partkey AS id, list_transform(range(0, p_size % 4 + 3), lambda j: {name}) AS rs, list_transform(range(0, p_size % 4 + 2), lambda j: {bond}) AS ls FROM part),
ch AS (SELECT id, rs, ls, array_to_string(list_transform(range(1, len(rs)), lambda i: rs[i] || '(' || ls[i] || ')'), '') || rs[len(rs)] AS glycan FROM ch0)"""


def chain_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, motif, termini): two residues for each supplier, three for odd keys."""
    k = F.col("s_suppkey").cast("long")
    a, b, c = (_pick(CHAIN, F.floor(k / d)) for d in (1, 6, 4))
    x, y = (_pick(BONDS, F.floor(k / d)) for d in (3, 2))
    text = F.concat(a, F.lit("("), x, F.lit(")"), b, F.when(k % 2 == 1, F.concat(F.lit("("), y, F.lit(")"), c)).otherwise(F.lit("")))
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("name"), text.alias("motif"), F.lit(None).cast("array<string>").alias("termini"))


def _at(values: list[str], k: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + f"][({k}) % {len(values)} + 1]"


CHAIN_MOTIFS = f"""mt AS (SELECT CAST(s_suppkey AS VARCHAR) AS name, {_at(CHAIN, "s_suppkey")} AS a, {_at(CHAIN, "s_suppkey // 6")} AS b, CASE WHEN s_suppkey % 2 = 1 THEN {_at(CHAIN, "s_suppkey // 4")} END AS c,
  {_at(BONDS, "s_suppkey // 3")} AS x, {_at(BONDS, "s_suppkey // 2")} AS y FROM supplier)"""
#: oc(glycan, name, i): where each motif begins in each distinct chain.
OCCURRENCES = f"""{CHAIN_MOTIFS}, {chain_sql()},
pl AS (SELECT glycan, rs, ls, unnest(range(1, len(rs))) AS i FROM (SELECT DISTINCT glycan, rs, ls FROM ch)),
oc AS (SELECT glycan, name, i, CASE WHEN c IS NULL THEN 2 ELSE 3 END AS size, rs FROM pl JOIN mt ON rs[i] = a AND ls[i] = x AND rs[i + 1] = b AND (c IS NULL OR (i + 2 <= len(rs) AND ls[i + 1] = y AND rs[i + 2] = c)))"""


def _sequence(known: list[str]) -> F.Column:
    """For a row of `part` one of the sequences `known`, with up to three residues more before it."""
    key, size = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")

    def piece(j: int):
        more = F.concat(_pick(CHAIN, F.floor(key / (j + 1)) + size * j), F.lit("("), _pick(BONDS, key + size * j + j), F.lit(")"))
        return F.when(F.lit(j) < size % 4, more).otherwise(F.lit(""))

    return F.concat(*map(piece, range(3)), _pick(known, F.floor(key / 4)))


def _sequence_sql(known: list[str]) -> str:
    more = f"{_at(CHAIN, 'p_partkey // (j + 1) + p_size * j')} || '(' || {_at(BONDS, 'p_partkey + p_size * j + j')} || ')'"
    return f"array_to_string(list_transform(range(0, p_size % 4), lambda j: {more}), '') || {_at(known, 'p_partkey // 4')}"


def branched(spark: SparkSession, sf_dir: str, known: list[str]) -> DataFrame:
    """(glycan): the parts' sequences, each text once."""
    return table(spark, sf_dir, "part").select(_sequence(known).alias("glycan")).distinct()


def branched_sql(known: list[str]) -> str:
    """gl(glycan), as `branched` makes it."""
    return f"gl AS (SELECT DISTINCT {_sequence_sql(known)} AS glycan FROM part)"


def sequence_abundance(spark: SparkSession, sf_dir: str, known: list[str]) -> DataFrame:
    """(feature, sample, grp, value): revenue by the parts' sequences and supplier class; two groups of five samples."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") % 10).alias("k"), "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", _sequence(known).alias("feature"))
    d = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("feature", "k").agg(money("l_extendedprice").alias("value"))
    return d.select("feature", F.concat(F.lit("s"), "k").alias("sample"), (F.col("k") % 2).cast("int").alias("grp"), "value")


def sequence_abundance_sql(known: list[str]) -> str:
    return f"""sa AS (SELECT feature, 's' || (l_suppkey % 10) AS sample, CAST((l_suppkey % 10) % 2 AS INTEGER) AS grp, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM lineitem JOIN (SELECT p_partkey, {_sequence_sql(known)} AS feature FROM part) ON l_partkey = p_partkey GROUP BY ALL)"""


def dealt(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """One of `rows` (a short list of cases) for each part, by its key: what is called on it runs as often as there are parts."""
    cases = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") % len(rows)).cast("int").alias("_i"))
    return part.join(F.broadcast(cases), "_i").drop("_i")


def answers(columns: str, rows: list[tuple], each: bool = True) -> str:
    """SQL of a table of answers: one for each part, as `dealt` gives the cases, or (each: false) every one once."""

    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)

    values = ", ".join("(" + ", ".join(map(lit, (i, *r))) + ")" for i, r in enumerate(rows))
    of = f" JOIN part ON p_partkey % {len(rows)} = _i" if each else ""
    return f"SELECT {columns} FROM (VALUES {values}) t(_i, {columns}){of}"
