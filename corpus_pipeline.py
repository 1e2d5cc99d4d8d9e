"""A pipeline from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import jaccard, langid, mixing, packing
from lodestone.llm.scratch import scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; null texts and those without letters go.  Null ids and repeated rows are kept; an empty table gives none."""
    return langid.accepted(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join stays: five words and 0.8, op9's three words and 0.9 are its own contract.  Texts without words, and null ids, are alone in their class and stay; of repeated rows one stays."""
    return jaccard.one_of_each(docs, size=5, num=80, den=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the sources' target weights, in a global random order.  A null source is a source of its own; one of 0 bytes keeps its rows once."""
    return mixing.mix(docs).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents' ids in sequences of at most 2048.  A null or empty text is the end id alone; every copy is a document of its own (row_id)."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packed", packed),
]

#: A learned classifier and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is deleted at the end."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark, "pipeline") as own:
        for name, stage in STAGES:
            made = stage(spark, docs, sf_dir)
            docs = own.keep(made, name) if name == STAGES[-1][0] else own.put(made, name)
    return docs
