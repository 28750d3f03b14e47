"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents, and
extra columns pass through them. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanframe.llm import exact_dedup, langid, mixing, packing, simhash
from scanframe.llm.common import materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: null texts, texts without letters and texts that no learned
    language explains go; rows that repeat stay. An empty table stays empty."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts without white space (null counts as empty): that with the most
    code points, then the smallest doc_id, null last. Of rows that repeat both, one stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts whose five-word shingles are similar by 0.8 or more:
    that with the smallest doc_id, null last. Long texts are compared whole."""
    return simhash.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated 0, 1 or 2 times, so that the sources come near their target weights;
    null is a source, and texts without words stay once."""
    return mixing.resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences of 1024 tokens; null texts are an end token
    alone, and rows that repeat are packed each on their own."""
    return packing.best_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: SQL can express neither language ID nor SimHash; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after another."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
