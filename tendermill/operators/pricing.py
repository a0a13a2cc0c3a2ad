"""Verification of filled price sheets, from cells to a verdict a workbook.

``cells(book, sheet, row, col, value)`` holds the text of each cell, and may
hold ``is_text``, which tells text cells from numbers; without it, cells that
read as numbers are numbers.  The first row of the first fifteen with a
price-like heading is the header; its amount column is the rightmost price
heading of those rows.  Cells are dealt by workbook and sheet once: the header
is found by a window, and rows and sheets are grouped where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermill.functions.text import is_summary_row, to_number

# Headings of price columns, rows searched, allowed difference and number of warnings.
PRICE_HEADING = r"(?i)montant|total|prix\s*(unitaire|u\.?p\.?|ht|ttc)?|p\.?u\.?\s*(ht)?|sous.?total|ht|amount"
HEADER_ROWS = 15
TOLERANCE = 1.0
MOST_WARNINGS = 20
NO_HEADER = "En-têtes de prix non détectés — vérification partielle"


def sheet_rows(cells: DataFrame) -> DataFrame:
    """One line a row after the header: its label and amount, or for sheets without a header its largest number."""
    # Ordered by row, so that the grouping by row after it finds its order and sorts no more; the frame is the whole sheet.
    one = Window.partitionBy("book", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.withColumns({"t": F.trim("value"), "number": to_number(F.col("value"))})
    is_text = F.col("is_text") if "is_text" in cells.columns else F.col("number").isNull()
    cells = cells.withColumn("named", is_text & (F.col("t") != ""))
    heading = F.col("named") & (F.col("row") < HEADER_ROWS) & F.col("t").rlike(PRICE_HEADING)
    cells = cells.withColumn("heading", heading)
    cells = cells.withColumn("header", F.min(F.when(F.col("heading"), F.col("row"))).over(one))
    cells = cells.withColumn("amount_col", F.max(F.when(F.col("heading"), F.col("col"))).over(one))
    return cells.groupBy("book", "sheet", "row").agg(
        F.first("header").alias("header"),
        F.min(F.when(F.col("named"), F.struct("col", "t")))["t"].alias("label"),
        F.max(F.when(F.col("col") == F.col("amount_col"), F.col("number"))).alias("amount"),
        F.max("number").alias("largest"),
        F.count(F.when(F.col("t") != "", 1)).alias("filled"),
    )


def check_sheets(cells: DataFrame) -> DataFrame:
    """Counts, total, displayed total, warnings and verdict of each sheet; a sheet of headers alone has no lines."""
    rows = sheet_rows(cells)
    header, label, amount = F.col("header"), F.col("label"), F.col("amount")
    body = (F.col("filled") > 0) & (header.isNull() | (F.col("row") > header))
    summary = F.coalesce(is_summary_row(label), F.lit(False))
    line = body & label.isNotNull() & (header.isNull() | ~summary)
    value = F.when(header.isNull(), F.col("largest")).otherwise(amount)
    shown = F.when(body & header.isNotNull() & summary & amount.isNotNull(), F.struct("row", "amount"))
    prefix = F.when(F.col("sheet") != "", F.concat(F.lit("["), F.col("sheet"), F.lit("] "))).otherwise("")
    told = F.concat(prefix, F.lit("Ligne "), (F.col("row") + 1).cast("string"), F.lit(" : montant vide ("), F.left(label, F.lit(50)), F.lit(")"))
    out = rows.groupBy("book", "sheet").agg(
        F.max(header.isNotNull()).alias("has_header"), F.count(F.when(line, 1)).alias("lines"), F.count(F.when(line & value.isNotNull(), 1)).alias("filled"),
        F.bround(F.sum(F.when(line, value)), 2).alias("total"), F.max(shown)["amount"].alias("shown"),
        F.slice(F.array_sort(F.collect_list(F.when(line & header.isNotNull() & value.isNull(), F.struct("row", told.alias("w"))))), 1, MOST_WARNINGS).alias("gaps"),
    )
    gap = F.abs(F.col("shown") - F.col("total"))
    wrong = F.coalesce(gap > TOLERANCE, F.lit(False))
    total = F.format_string("Total incohérent : somme des lignes = %.2f €, total affiché = %.2f € (écart de %.2f €)", F.col("total"), F.col("shown"), gap)
    warnings = F.concat(F.col("gaps.w"), F.when(wrong, F.array(total)).otherwise(F.array().cast("array<string>")))
    warnings = F.when(F.col("has_header"), F.slice(warnings, 1, MOST_WARNINGS)).when(F.col("lines") > 0, F.array(F.lit(NO_HEADER)))
    warnings = F.coalesce(warnings, F.array().cast("array<string>"))
    out = out.withColumn("empty", F.col("lines") - F.col("filled")).withColumns({"mismatch": wrong, "warnings": warnings})
    return out.withColumn("valid", ~F.col("has_header") | ((F.col("empty") == 0) & ~wrong)).drop("gaps")


def merge_books(sheets: DataFrame) -> DataFrame:
    """Sums over a workbook's sheets; one sheet keeps its own verdict."""
    out = sheets.groupBy("book").agg(
        F.count("*").alias("sheets"), F.sum("lines").alias("lines"), F.sum("filled").alias("filled"), F.sum("empty").alias("empty"),
        F.bround(F.sum("total"), 2).alias("total"), F.bool_and("valid").alias("all_valid"), F.bool_or("mismatch").alias("mismatch"),
        F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "warnings"))), lambda x: x["warnings"])), 1, MOST_WARNINGS).alias("warnings"),
    )
    valid = F.when(F.col("sheets") == 1, F.col("all_valid")).otherwise((F.col("empty") == 0) & ~F.col("mismatch") & (F.col("lines") > 0))
    return out.withColumn("valid", valid).drop("all_valid", "mismatch")


def lot_sheet_text(cells: DataFrame, matches: Column) -> DataFrame:
    """``book, text``: the sheets where ``matches`` holds, each under its name, rows with cells joined by `` | ``."""
    filled = cells.where(matches & (F.trim("value") != ""))
    lines = filled.groupBy("book", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", F.trim("value").alias("v")))).alias("x"))
    lines = lines.select("book", "sheet", F.struct("row", F.array_join(F.col("x.v"), " | ").alias("v")).alias("l"))
    sheets = lines.groupBy("book", "sheet").agg(F.array_sort(F.collect_list("l")).alias("l"))
    text = F.concat(F.lit("[Onglet : "), F.col("sheet"), F.lit("]\n"), F.array_join(F.col("l.v"), "\n"))
    return sheets.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", text.alias("v")))), lambda x: x["v"]), "\n").alias("text"))
