"""Near copies for the pipeline: texts whose five-word shingles overlap by 0.8 or more.

A link is a pair of texts with a Jaccard similarity of ``PERCENT`` or more,
counted exactly over the whole sets.  Candidates come from two sides.

The SimHash operator, over five-word shingles here, joins texts whose
fingerprints differ in at most four bits by way of its covering code.  At 0.8 two
fingerprints of 64 bits differ in some ten bits, and anchors for ten bits would
meet a constant part of all texts, so this side finds the closest copies only.

The others are found by the registers and bands of the HyperMinHash operator,
which lose a pair at 0.8 with a chance of (1 - 0.8 ** 4) ** 32 = 5e-8, a closer
pair more rarely; that operator also verifies the pairs of both sides.

Defined results: texts without words (NULL, empty, blank) are copies of each
other; a text under five words is one shingle; rows with one id are copies too
and the smallest row stays; rows with a NULL id stay; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.llm import hyperminhash, simhash
from tendermill.llm.common import one_row_each

PERCENT = 80


def close_prints(reps: DataFrame) -> DataFrame:
    """``u, v``: sets with one fingerprint, and those that the SimHash operator links."""
    prints = reps.groupBy("fp").agg(F.min("rep").alias("first"), F.count("*").alias("members"))
    same = reps.select("fp", "rep").join(prints.where("members > 1"), "fp").where("rep != first")
    near = simhash.links(prints.select("fp", F.col("first").alias("rep")))
    return same.select(F.col("first").alias("u"), F.col("rep").alias("v")).unionByName(near.select("u", "v"))


def groups(docs: DataFrame, block: int = hyperminhash.BLOCK) -> DataFrame:
    """``doc_id, component_id`` of each row."""
    found = hyperminhash.components(docs.select("doc_id", "text"), PERCENT, block, close_prints, empty_alike=True)
    return found.select("doc_id", "component_id")


def drop(docs: DataFrame, block: int = hyperminhash.BLOCK) -> DataFrame:
    """One document of each group that links join, the one with the smallest id; NULL ids stay."""
    return one_row_each(docs, groups(docs, block).where("doc_id = component_id").select("doc_id").distinct())
