"""A training corpus from documents: language, exact copies, near copies, benchmark passages, tokens.

Each stage takes what the one before it kept; all but the last return the columns of ``documents``, whatever they are called
and whatever other columns there are. A null text counts as an empty one; it has no letters, so the first stage drops it. Null
and repeated ids are rows like others: a group of equal texts keeps its longest text, then its smallest id; a group of near
copies its smallest id, of rows that share it all; null is the largest id. An empty table stays empty. Texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import bpe, decontamination, exact_dedup, language_id, ngram_join
from corpuslab.llm.common import as_table, cut


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without letters and ambiguous ones go."""
    return language_id.keep_identified(docs, language_id.train(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones."""
    return ngram_join.keep_smallest(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.remove_contaminated(docs, as_table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    return bpe.encode_decode(docs, keep=("ids",), remembered=80_000, chars=1_000_000, lasting=False)


STAGES = [
    ("language ID", identified),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", tokenized),
]

#: Language prediction and BPE can't be stated in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is materialised in the shared checkpoint folder."""
    docs = as_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
