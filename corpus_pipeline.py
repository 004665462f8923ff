"""Corpus pipeline: language ID, exact dedup, near dedup, source mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``, which the
stage before it has kept. All stages but the last return the columns of ``documents``.

Defined cases: an empty table gives an empty result of every stage; a null text has no
letter, so the first stage drops it, and is empty text to the others; of rows that repeat
one is left after exact dedup; ties go to the smallest id, a null id being the largest;
texts of any length are read whole; extra columns, of any name, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segmentry.llm.common import documents, materialize
from segmentry.llm.exact_dedup import drop_exact_copies
from segmentry.llm.language_id import fit, keep_identified
from segmentry.llm.minhash_dedup import drop_near_copies
from segmentry.llm.mixing import apply_mix
from segmentry.llm.packing import pack_documents

#: Target of the mix: 97 % of the greatest entropy, at most four epochs of a source, and
#: as many tokens in all as the documents have.
MIX = {"entropy_share": 0.97, "max_epochs": 4.0}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled texts; documents that the model rejects go.

    Those are texts without a letter, and texts that score below 0.25, which is what two
    equal duels give, one of families and one of languages.
    """
    return keep_identified(docs, fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the smallest id."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest id."""
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return apply_mix(docs, **MIX)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: The trained models and the tokenizer have no SQL form; the tests compare each stage
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
