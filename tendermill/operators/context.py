"""Texts that fit into fixed budgets: which documents, how much of each, in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermill.functions.classify import concerns_lot, normal_lot
from tendermill.functions.text import labelled_block
from tendermill.operators.lots import PLACEHOLDER
from tendermill.operators.relational import distinct_texts

# Types of documents in the two passes of an analysis, with the characters taken of each.
FIRST_PASS = (("rc", 50_000), ("ccap", 30_000), ("acte_engagement", 10_000))
SECOND_PASS = (("cctp", 30_000), ("dpgf", 10_000))
#: Of a proposal's context: types in order of priority, characters of each and of all.
PRIORITY, CAPS, OTHER_CAP, BUDGET = ("cctp", "rc", "acte_engagement", "dpgf", "plan"), {"rc": 8_000, "cctp": 55_000}, 5_000, 90_000
COMPLIANCE_LINES, HEAVY = 80, 40


def _mapped(kind: Column, names, default) -> Column:
    out = F
    for name, value in names:
        out = out.when(kind == name, value)
    return out.otherwise(default)


def analysis_blocks(documents: DataFrame, lot: str | None) -> DataFrame:
    """``project_id, pass, place, block``: documents of the lot, each text once, cut by type and labelled.

    ``documents(project_id, id, type, file_name, text, tags)``, and ``sheet_text``
    if price books have a sheet of the lot, which then takes the text's place.
    Placeholders, empty texts and other types are left out.
    """
    usable = documents.where(concerns_lot(F.col("tags"), lot) & ~F.coalesce("text", F.lit("")).startswith(PLACEHOLDER))
    once = distinct_texts(usable, "text", F.col("id"), keys=["project_id"])
    kind, caps = F.col("type"), dict(FIRST_PASS + SECOND_PASS)
    once = once.where(kind.isin(*caps)).withColumn("most", _mapped(kind, caps.items(), None))
    block = labelled_block(kind, F.col("file_name"), F.left("text", F.col("most")))
    if lot and "sheet_text" in documents.columns:
        name = F.concat(F.col("file_name"), F.lit(" (onglet Lot "), normal_lot(F.lit(lot)), F.lit(")"))
        sheet = labelled_block(kind, name, F.left("sheet_text", F.col("most")))
        block = F.when((kind == "dpgf") & (F.coalesce("sheet_text", F.lit("")) != ""), sheet).otherwise(block)
    number = F.when(kind.isin(*dict(FIRST_PASS)), 1).otherwise(2)
    once = once.withColumn("pass", number)
    place = F.row_number().over(Window.partitionBy("project_id", "pass").orderBy("id"))
    return once.select("project_id", "pass", place.alias("place"), block.alias("block"))


def joined_blocks(blocks: DataFrame) -> DataFrame:
    """One text a project and pass; the caps by type bound a block, and a project's documents their number."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "block")))
    return blocks.groupBy("project_id", "pass").agg(F.array_join(ordered["block"], "\n\n").alias("context"))


def generation_takes(documents: DataFrame) -> DataFrame:
    """Add ``take``: characters of each document until the project's budget is used up, the technical clauses first."""
    kind = F.col("type")
    rank, cap = _mapped(kind, [(n, i) for i, n in enumerate(PRIORITY)], len(PRIORITY)), _mapped(kind, CAPS.items(), OTHER_CAP)
    want = F.least(F.char_length("text"), cap)
    w = Window.partitionBy("project_id").orderBy(rank, "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(want).over(w), F.lit(0))
    return documents.withColumn("take", F.greatest(F.lit(0), F.least(want, F.lit(BUDGET) - before)).cast("int"))


def compliance_block(items: DataFrame) -> DataFrame:
    """``project_id, block``: the first eighty requirements of a project as lines; the others do not reach the shuffle."""
    first = items.withColumn("_n", F.row_number().over(Window.partitionBy("project_id").orderBy("seq"))).where(F.col("_n") <= COMPLIANCE_LINES)
    line = F.concat(F.lit("- ["), F.upper("category"), F.lit("] "), F.col("exigence"))
    lines = F.array_sort(F.collect_list(F.struct("_n", line.alias("l"))))
    return first.groupBy("project_id").agg(F.array_join(lines["l"], "\n").alias("block"))


def heaviest_part(criteria: Column) -> Column:
    """Of the first criterion of weight forty or more that has parts, the heaviest part, the first of equals; NULL if there is none."""
    first = F.get(F.filter(criteria, lambda c: (c["poids"] >= HEAVY) & (F.size(c["sous_criteres"]) > 0)), F.lit(0))
    ranked = F.transform(first["sous_criteres"], lambda s, i: F.struct(s["poids"].alias("poids"), (-i).alias("i"), s["nom"].alias("nom")))
    return F.array_max(ranked)["nom"]


def price_weight(criteria: Column) -> tuple[Column, Column]:
    """Weight of the first criterion that speaks of the price, and of all others together."""
    price = F.get(F.filter(criteria, lambda c: F.lower(c["nom"]).contains("prix")), F.lit(0))["poids"]
    others = F.aggregate(F.filter(criteria, lambda c: ~F.lower(c["nom"]).contains("prix")), F.lit(0), lambda s, c: s + c["poids"])
    return F.coalesce(price, F.lit(0)), others


def criteria_block(criteria: Column) -> Column:
    """The criteria and their parts as lines, and the part to insist on."""
    line = lambda c: F.concat(
        F.lit("- "), c["nom"], F.lit(" : "), c["poids"].cast("string"), F.lit("%"),
        F.array_join(F.transform(c["sous_criteres"], lambda s: F.concat(F.lit("\n    • "), s["nom"], F.lit(" : "), s["poids"].cast("string"), F.lit("%"))), ""),
    )
    head = F.lit("CRITÈRES D'ÉVALUATION DES OFFRES (pondérations réelles du RC) :\n")
    return F.when(F.size(criteria) > 0, F.concat(head, F.array_join(F.transform(criteria, line), "\n"))).otherwise("")
