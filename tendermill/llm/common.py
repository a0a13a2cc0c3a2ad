"""Shared helpers: words, the shared folder and intermediate tables."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks.  On UTF-8
#: bytes ``bytes.split()`` cuts at exactly these blanks.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; NULL and blank texts give an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return F.filter(parts, lambda w: w != "")


def text_bytes(df: DataFrame, *cols: str) -> DataFrame:
    """``cols`` and the UTF-8 bytes of ``text`` (NULL: empty), for Arrow tasks."""
    return df.select(*cols, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))


@lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-tendermill-")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only a local master, where one process does all the work, may go without
    the setting and gets a folder of its own; on a cluster it is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


#: Paths made within each open :func:`scratch`.
_MADE: list[list[str]] = []


@contextmanager
def scratch():
    """Tables and files that are made inside go at the end; write what is to stay to a path of its own."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            remove(path)


def remove(path: str) -> None:
    fs, at = pa.fs.FileSystem.from_uri(as_uri(path))
    if fs.get_file_info(at).type == pa.fs.FileType.Directory:
        fs.delete_dir(at)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def as_uri(path: str) -> str:
    """``path`` as a URI for ``pyarrow.fs``; plain paths are those of the file system that all executors share."""
    if "://" in path:
        return path
    return f"file://{path.removeprefix('file:')}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays as one file; it is moved into place whole, so a repeated task replaces its own."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}"
    held = io.BytesIO()
    np.savez(held, **arrays)
    with fs.open_output_stream(attempt) as f:
        f.write(held.getbuffer())
    fs.move(attempt, path)


def get_arrays(uri: str) -> dict[str, np.ndarray]:
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return dict(np.load(io.BytesIO(f.read())))


def numbered(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Add ``number``, from 1, to the rows of each group of ``keys``, in any order.

    Rows are counted by group and partition, so no task holds a whole group.
    """
    rows = materialise(df.withColumn("_part", F.spark_partition_id()), name)
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    sizes = sizes.withColumnsRenamed({k: f"_{k}" for k in keys} | {"_part": "_of"})
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    own = Window.partitionBy(*keys, "_part").orderBy(F.lit(0))
    met = rows.join(sizes, same).withColumn("number", F.col("_base") + F.row_number().over(own))
    return met.select(*df.columns, "number")


#: Rows of a key that count as very many, at least, and such keys at most: what they meet is broadcast.
MANY_ROWS, MANY_KEYS = 500, 1_000_000


def join_counted(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, one row a key, whose ``members`` counts the key's rows in ``rows``.

    Keys of very many rows meet theirs by broadcast where the rows lie, the
    others by a shuffle; with all rows counted there are no more such keys than
    ``MANY_KEYS``.
    """
    total = table.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    often = F.broadcast(table.where(F.col("members") > max(MANY_ROWS, total // MANY_KEYS)).drop("members"))
    others = rows.join(often.select(*keys), [*keys], "left_anti").join(table.drop("members"), [*keys])
    return rows.join(often, [*keys]).unionByName(others)


def one_row_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the ``chosen(doc_id)``, of repeated ids the smallest one, and all rows with a NULL id.

    Only rows of repeated ids are grouped; maps, which have no order, do not decide.
    """
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("size"))
    kept = rows.join(chosen.join(sizes, "doc_id"), "doc_id")
    ordered = F.struct(*[F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    many = kept.where("size > 1").groupBy("doc_id").agg(F.min_by("row", ordered).alias("row"))
    return kept.where("size = 1").select("row").unionByName(many.select("row")).unionByName(rows.where("doc_id is null").select("row")).select("row.*")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
