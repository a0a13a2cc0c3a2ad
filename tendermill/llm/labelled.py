"""Bounded samples of labelled documents for the classifiers that are trained here."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermill.llm.common import materialise


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; NULL ids fall in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def fold_of(doc_id: int, of: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % of


@dataclass
class Sample:
    """Features, label and language of each row."""

    x: list[np.ndarray]
    y: np.ndarray
    lang: list[str | None]


def _sizes(features: Callable[[bytes], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len(features(raw.as_py())) for raw in batch["raw"]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], sizes], names=["doc_id", "h", "n"])

    return run


def _featured(features: Callable[[bytes], np.ndarray], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(raw.as_py()) for raw in batch["raw"]], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch["place"], batch["y"], batch["lang"], x], names=["place", "y", "lang", "x"])

    return run


def sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, features: Callable[[bytes], np.ndarray], kind: str, values: int
) -> Sample:
    """At most ``most`` rows where ``train`` holds, by a hash of the id, with at most ``values`` features in all.

    The bounds keep the model's fit, which runs on the driver, at one size
    whatever the corpus; scoring covers every document.  A row with more than
    an eighth of ``values`` is left out, so that no text crowds out the others.
    The chosen ids, at most ``most``, go to the documents, which are not
    shuffled.  The texts' numbers of features are taken first and the rows chosen
    by them, so that no task of the choice holds features; these are made of the
    chosen rows' whole texts, where they lie.  Conflicting labels of one id count
    as the greater one; equal rows of one id count once.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.where(train).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"), lang.alias("lang")).withColumn("h", F.xxhash64("raw"))
    sized = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "h", "raw").mapInArrow(_sizes(features), "doc_id long, h long, n long")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("h")]
    fitting = sized.where(F.col("n") <= max(1, values // 8)).distinct().orderBy(*order).limit(most)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fitting = fitting.withColumns({"held": F.sum("n").over(before), "place": F.row_number().over(before)}).where(F.col("held") <= values)
    fitting = materialise(fitting.join(F.broadcast(chosen), "doc_id").select("doc_id", "h", "place", "y"), "labelled")
    rows = texts.join(F.broadcast(fitting), ["doc_id", "h"]).select("place", "y", "lang", "raw")
    arrow = {"bigint": pa.int64(), "double": pa.float64()}[kind]
    table = rows.mapInArrow(_featured(features, arrow), f"place int, y int, lang string, x array<{kind}>").toArrow().sort_by("place")
    place = table["place"].to_numpy()
    table = table.filter(pa.array(np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)))
    x = [row.values.to_numpy() for chunk in table["x"].chunks for row in chunk]
    return Sample(x, np.array(table["y"].to_pylist(), np.float64), table["lang"].to_pylist())
