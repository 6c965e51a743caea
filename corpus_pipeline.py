"""From documents to training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) with docs in the columns of `documents` and, but for the last, gives such rows. An
empty table gives an empty one. Columns beyond those of `documents` are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.llm import exact_dedup, language, mixing, near_dedup, packing
from inkfathom.llm.common import dropped, written
from inkfathom.llm.queries import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (null or empty text, no letter) go; a null lang is filled in, others stay.
    Repeated rows and null identifiers are rows like others."""
    told = language.predict(docs, language.train(docs)).filter(F.col("lang_pred") != language.UNDETERMINED)
    return told.select(*[F.coalesce("lang", "lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the one with the smallest doc_id stays, once where rows repeat; a null doc_id loses to
    any other, and of several with a null doc_id one stays."""
    return exact_dedup.unique_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays, ties in
    similarity or not. Texts without words and rows with a null doc_id are linked with nothing and stay."""
    return near_dedup.distinct_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target weight asks for; one document of a source may come in part. A null
    source is a source. Texts without words (null, empty, blank) have no mass and go. Of rows alike in identifier, source
    and size as many come as are taken."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences; a null or empty text is its end id alone, repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has no trained models, MinHash links or tokenizers; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        dropped(*[before] * (before is not None))
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
