"""A corpus from raw documents to packed sequences, in stages that each write a table for the next.

Every stage works on all rows that the one before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import jaccard_join, language_id, mixing, packing, toxicity
from strandline.llm.common import materialise, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by a lexicon learnt from ``labels``."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents' own marks name; other languages and letter junk go."""
    return language_id.keep_known(docs, language_id.learn(docs))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by 0.8 of their shingles of five words."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which sources are interleaved to their target weights."""
    return mixing.interleave(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens, which follow the order of the mix."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), in_order=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("jaccard_join", jaccard_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# A learnt lexicon, ranked profiles and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
