"""A corpus from raw documents: quality rules, near-duplicates, private data, packing. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspan.llm import near, packing, pii, quality
from veilspan.llm.common import cut_lineage, read
from veilspan.llm.encoding import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs, quality.fit(docs, read(spark, folder, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return near.one_of_each(docs)


def without_private_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pseudonyms in place of validated numbers, dates, addresses and keys."""
    return pii.pseudonymise(docs, pii.key_of(spark))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of training sequences with their ids."""
    return packing.pieces(spark, packing.pack(docs, vocabulary(spark, packing.TOKENIZER)), ids=True)


STAGES = [("quality rules", keep_good), ("near-duplicates", one_of_each), ("private data", without_private_data), ("packing", packed)]
#: The scores need floating-point logarithms, hashes and token ids that SQL does not share; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, folder), name.replace(" ", "-"))
    return docs
