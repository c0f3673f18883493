"""From raw documents to sampled pieces: four stages, each over all that the one before kept.

``run(spark, sf_dir)`` applies ``STAGES`` to ``documents``; every stage's rows are written
as Parquet to the shared folder and read again by the next, so a lost executor costs one
stage at most.

Defined cases: null columns stay as they are; a document whose text is null or has no
letter goes in the first stage; extra columns are carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import decontaminate, language, ngram_join, sentence_pieces
from passagemill.llm.common import cut_lineage, read
from passagemill.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model, fitted to those with a known language, does not reject."""
    ship(spark)
    return language.keep_identified(docs, language.fit(docs, F.lit(True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that links of 0.8 or more join."""
    ship(spark)
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship(spark)
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled pieces of each document, with its language and source, and whether they decode to its text."""
    ship(spark)
    return sentence_pieces.round_trip(docs, carry=("lang", "source"), slice_bytes=1 << 20)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentence_pieces", encode_pieces),
]

#: Fitted centroids and sampled pieces have no form in SQL; no plain version of the whole pipeline is tested yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
