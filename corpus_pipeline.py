"""A training corpus in five stages: quality, toxicity, near-duplicates, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

In every stage a null text counts as empty, texts of any length are read whole, repeated rows are rows of their own (but for
near-duplicates, of which one stays), ties go to the smaller doc_id or do not matter, an empty table gives an empty one, and
further columns pass through, whatever their names. Bytes that are not UTF-8 (a text cut inside a character) pass through as they are; where
characters count, in toxicity and packing, they are U+FFFD. Null doc_ids are allowed. Labels of null value or without a document do not count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarbeam.llm import dedup, mixing, packing, quality, toxicity
from sugarbeam.llm.queries import tokenizer_path
from sugarbeam.llm.util import guarded, read, stored

#: A document is rejected below this quality, or from this toxicity on.
THRESHOLD = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches THRESHOLD. The rules are fitted on the labelled documents of `documents`. Empty texts have a score
    like any other; without labels of both kinds all documents have one score, and stay if it reaches THRESHOLD."""
    model = quality.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    docs, named = guarded(docs)
    return named(quality.score(docs, model, docs.dtypes).where(F.col("score") >= THRESHOLD))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below THRESHOLD. An empty text has the score of the bias alone; without labels of both kinds all
    documents have the share of toxic ones, and go if it reaches THRESHOLD."""
    model = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    docs, named = guarded(docs)
    return named(toxicity.score(docs, model, docs.dtypes).where(F.col("score") < THRESHOLD))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity of 0.8 or more): the one with the smallest doc_id.
    Null, empty and blank texts are nobody's duplicates."""
    return dedup.one_of_each(docs, dedup.MinMax(words=5))


#: How often the mixing stage repeats a document at most, on average. Where a language is so rare that its target would take more, it stays below
#: its target, and a warning tells by how much.
MOST_RATE = 16.0


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at the rates, from 1 to MOST_RATE, that bring the expected tokens of each language to its target weight.
    Documents without words have no tokens and rates by the priors; documents of other or null languages count by their text alone."""
    return mixing.mixed(docs, docs.select("doc_id", F.col("lang").alias("domain")), least=1.0, most=MOST_RATE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens. An empty text is one piece of its final id."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has no form of the fitted classifiers, the rates and the packing; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
