"""A training corpus from raw documents: filter, drop near copies, hide personal data, mix, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run`
writes each result as Parquet to the shared folder and reads it again as the
next stage's documents; tables that a stage made for itself, and results that
the next stage has read, are removed.  All stages but the last keep the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tendermill.llm import bpe, mixing, near_copies, pii, quality_rules
from tendermill.llm.common import documents, materialise, new_path, remove, scratch
from tendermill.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or are more likely bad than good go."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Near copies are texts with a five-word overlap of 0.8 or more, counted exactly.
    SimHash anchors propose the closest pairs; pairs at 0.8 are out of their reach,
    as the README says, so bands of HyperMinHash registers do most of the work.
    NULL ids stay, texts without words are copies of each other.
    """
    return near_copies.drop(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced within its format."""
    return pii.pseudonymise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in tempered proportions; small sources may repeat, large ones are thinned."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each placed document."""
    import public_tokenizers

    return bpe.encoded(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("personal data", pseudonyms), ("mixing", mix), ("encoding", encode)]

#: SQL has no byte-level BPE; tests/llm compares the pipeline with a brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        with scratch():
            docs = materialise(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(before)
        before = path
    return docs
