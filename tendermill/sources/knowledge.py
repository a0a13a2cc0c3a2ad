"""Knowledge files in Markdown: whole files, sections and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendermill.functions.text import markdown_section, without_front_matter


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of the ``SKILL.md`` files in the folders under ``path``, without front matter; the folder is the name."""
    files = spark.read.text(f"{path}/*/SKILL.md", wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select(F.element_at(F.split("file", "/"), -2).alias("name"), without_front_matter(F.col("value")).alias("text"))


def section(files: DataFrame, header: str) -> DataFrame:
    """``name, text`` of the section under ``header`` in each file that has it."""
    found = files.select("name", markdown_section(F.col("text"), header).alias("text"))
    return found.where("text <> ''")


def bundle(files: DataFrame, names: list[str]) -> DataFrame:
    """One text of the named files, in the order of the names; the list of names bounds the group."""
    wanted = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    blocks = files.where(F.col("name").isin(*names) & (F.col("text") != "")).select(wanted.alias("n"), F.concat(F.lit("━━━ RÉFÉRENTIEL : "), "name", F.lit(" ━━━\n"), "text").alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct("n", "b")))
    return blocks.agg(F.array_join(ordered["b"], "\n\n").alias("text"))
