"""Queries of lot detection and merge, on samples with results worked out by hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tendermill.functions import classify
from tendermill.operators import lots, pricing
from tendermill.plans.base import c, dealt, expected, query, spread, t

_SHEETS = ["Lot 05 - Peinture", "Sommaire", "Gros œuvre", "Électricité", "LOT n°3B : Façade ITE", "Feuil1", "abc", "1234", "Peinture int", "Lot 7"]


@query(expected("id, nom, confidence", [
    ("lot5", "Lot 05 — Peinture", 85), (None, None, None), ("lot_sheet_gros_uvre", "Gros œuvre", 40), ("lot5", "Lot 5 — Électricité", 70),
    ("lot3B", "Lot 3B — Façade ITE", 85), (None, None, None), (None, None, None), (None, None, None), ("lot10", "Lot 10 — Peinture int", 70), ("lot7", "Lot 7", 85),
]))
def lot_sheets(spark, sf_dir):
    return spread(dealt(spark, sf_dir, _SHEETS), "p_partkey").withColumn("d", lots.in_sheet_name(c("x0"))).select("p_partkey", "d.id", "d.nom", "d.confidence")


_FILES = ["CCTP_Lot05.pdf", "lot-A.docx", "plan lots.pdf", "DPGF_Lot2.xlsx", "rc.pdf", "Lot n 4.pdf"]


@query(expected("id, nom, id_sheet", [
    ("lot5", "Lot 05", "lot5"), ("lot1", "Lot A", "lot1"), (None, None, None), ("lot2", "Lot 2", "lot2"), (None, None, None), (None, None, None),
]))
def lot_files(spark, sf_dir):
    found = dealt(spark, sf_dir, _FILES).withColumns({"d": lots.in_file_name(c("x0")), "e": lots.in_file_name(c("x0"), "excel", 75)})
    return found.select("p_partkey", "d.id", "d.nom", c("e.id").alias("id_sheet"))


_LONG = "d" * 130
_TEXTS = [
    "Désignation des lots\n1  Gros œuvre\n\nx\n2  Peinture\na\nb\nc\n3  Sols\n",
    "Le marché comprend le Lot 3 : Plomberie.\nsuite du texte\n\nautre",
    "Lot 1 Gros œuvre, Lot 2 Peinture",
    "rien ici\nni là",
    f"liste des lots\nA  Maçonnerie -\n{_LONG}\n{_LONG}\nfin\n\nB   Toiture\n01 Voirie\n",
    "tranche 2 : Réseaux\nfin",
    None,
]


@query(expected("lots", [
    ("lot1|Lot 1 — Gros œuvre|90|x;lot2|Lot 2 — Peinture|90|a b c",), ("lot3|Lot 3 — Plomberie|80|suite du texte",), ("lot1|Lot 1 — Gros œuvre, Peinture|80|",), ("",),
    (f"lot1|Lot A — Maçonnerie|90|{_LONG} {'d' * 116}…",), ("lot2|Lot 2 — Réseaux|80|fin",), ("",),
]))
def lot_texts(spark, sf_dir):
    found = lots.in_text(dealt(spark, sf_dir, _TEXTS), "x0")
    told = F.transform("found", lambda d: F.concat_ws("|", d["id"], d["nom"], d["confidence"].cast("string"), d["description"]))
    return found.select("p_partkey", F.array_join(told, ";").alias("lots"))


def _cells(spark, sf_dir):
    """Two kinds of workbooks, by the key of a supplier."""
    cell = lambda no, sheet, row, col, value: F.struct(*[F.lit(x).alias(n) for n, x in zip(("sheet_no", "sheet", "row", "col", "value"), (no, sheet, row, col, value))])
    one = [
        cell(0, "Bordereau", 0, 0, "Lot 9"), cell(1, "Devis", 0, 0, "Tranche ferme"), cell(1, "Devis", 1, 1, "Option"), cell(1, "Devis", 1, 2, "tranche optionnelle 2"),
        cell(1, "Devis", 4, 0, "Lot n°2 - Sols"), cell(1, "Devis", 5, 0, "Lot 2 encore"), cell(1, "Devis", 6, 7, "Lot 8"), cell(1, "Devis", 600, 0, "Lot 6"),
    ]
    two = [cell(0, "Lot 1", 0, 0, "Lot 4"), cell(1, "Lot 2", 0, 0, "x"), cell(2, "Lot 3 - Toiture", 0, 0, "y")]
    rows = F.when(c("s_suppkey") % 2 == 0, F.array(*one)).otherwise(F.array(*two))
    return t(spark, sf_dir, "supplier").select(c("s_suppkey").alias("book"), F.inline(rows))


@query("""
SELECT s_suppkey AS book, unnest(CASE WHEN s_suppkey % 2 = 0
  THEN ['lot2|Lot 2 — Sols|65|Tranche ferme,tranche optionnelle 2', 'lot_sheet_devis|Devis|40|Tranche ferme,tranche optionnelle 2']
  ELSE ['lot1|Lot 1|85|', 'lot2|Lot 2|85|', 'lot3|Lot 3 — Toiture|85|'] END) AS lot FROM supplier""")
def lot_cells(spark, sf_dir):
    told = F.concat_ws("|", "d.id", "d.nom", c("d.confidence").cast("string"), F.array_join("d.tranches", ","))
    return lots.in_books(_cells(spark, sf_dir)).select("book", told.alias("lot"))


_FOUND = """<
  (1, 'lot5', 'Lot 05 — Peinture', 85, 'excel', '', 'T1'), (2, 'lot5', 'Lot 5 — Peinture et revêtements', 90, 'rc_text', 'long', ''), (3, 'lot5', 'Lot 05', 55, 'filename', '', ''),
  (1, 'lot10', 'Lot 10 — Sols', 85, 'excel', 'ab', 'T1'), (2, 'lot10', 'Lot 10 : Murs', 80, 'rc_text', 'c', 'T2'), (2, 'lot2', 'Lot 2', 80, 'rc_text', '', ''),
  (1, 'lot1A', 'Lot 1A', 75, 'excel', '', ''), (2, 'lot1A', 'Lot 1a', 90, 'rc_text', '', ''), (3, 'lot_sheet_x', 'x', 40, 'excel', '', '')>"""


def _found(spark, sf_dir):
    import ast

    rows = ast.literal_eval("[" + _FOUND.strip("<>\n ") + "]")
    one = lambda r: F.struct(
        F.lit(r[0]).alias("seq"),
        F.struct(F.lit(r[1]).alias("id"), F.lit(r[2]).alias("nom"), F.lit(r[3]).alias("confidence"), F.array(F.lit(r[4])).alias("sources"),
                 (F.array(F.lit(r[6])) if r[6] else F.array().cast("array<string>")).alias("tranches"), F.lit(r[5]).alias("description")).cast(lots.DETECTION).alias("d"),
    )
    return t(spark, sf_dir, "supplier").select(c("s_suppkey").alias("project"), F.inline(F.array(*map(one, rows))))


@query("""
SELECT s_suppkey AS project, place::INTEGER AS place, v.id, v.nom, confidence::INTEGER AS confidence, sources, tranches, description FROM supplier, (VALUES
  (1, 'lot1A', 'Lot 1A', 90, 'excel,rc_text', '', ''), (2, 'lot2', 'Lot 2', 80, 'rc_text', '', ''),
  (3, 'lot5', 'Lot 5 — Peinture et revêtements', 100, 'excel,rc_text,filename', 'T1', 'long'),
  (4, 'lot10', 'Lot 10 — Sols', 100, 'excel,rc_text', 'T1,T2', 'ab')) v(place, id, nom, confidence, sources, tranches, description)""")
def lot_merge(spark, sf_dir):
    merged = lots.merged(_found(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("project").orderBy(*lots.lot_order(c("id")), "id"))
    join = lambda x: F.array_join(x, ",").alias(x)
    return merged.select("project", place.alias("place"), "id", "nom", "confidence", join("sources"), join("tranches"), "description")


@query("""
SELECT s_suppkey AS project, unnest(['lot1|Lot 1 — Gros œuvre|100|rc_text,filename', 'lot2|Lot 2 — Peinture|100|excel,rc_text,filename', 'lot3|Lot 3 — Toiture|85|excel']) AS lot FROM supplier""")
def lot_detect(spark, sf_dir):
    key = c("s_suppkey")
    doc = lambda n, name, kind, text: F.struct((key * 10 + n).alias("doc_id"), F.lit(name).alias("file_name"), F.lit(kind).alias("kind"), F.lit(text).alias("text"))
    table = "Liste des lots\n1  Gros œuvre\n2  Peinture\n"
    docs = [
        doc(0, "DPGF_Lot2.xlsx", "dpgf_template", ""), doc(1, "RC.pdf", "rc", table), doc(2, "CCTP_Lot01.pdf", "cctp", "Lot 9 : Non lu"), doc(3, "gros.pdf", "autre", lots.PLACEHOLDER + " Lot 8]"),
        doc(4, "annexe.pdf", "plan", "rien"),
    ]
    suppliers = spread(t(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    documents = suppliers.select(key.alias("project"), F.inline(F.array(*docs)))
    cell = F.struct(F.lit(0).alias("sheet_no"), F.lit("Lot 3 - Toiture").alias("sheet"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("x").alias("value"))
    cells = suppliers.select((key * 10).alias("book"), F.inline(F.array(cell)))
    told = F.concat_ws("|", "id", "nom", c("confidence").cast("string"), F.array_join("sources", ","))
    return lots.detect(documents, cells).select("project", told.alias("lot"))


_PDFS = ["RC.pdf|rc|x", "plan.pdf|plan|x", "Annexe 1.pdf|plan|x", "a.PDF||x", "b.pdf|autre|[document volumineux - b.pdf]", "c.docx|rc|x"]


@query(expected("wanted", [(True,), (False,), (True,), (True,), (False,), (False,)]))
def pdf_wanted(spark, sf_dir):
    part = lambda i: F.get(F.split("x0", r"\|"), F.lit(i))
    return dealt(spark, sf_dir, _PDFS).select("p_partkey", lots.wanted_pdf(part(0), F.nullif(part(1), F.lit("")), part(2)).alias("wanted"))


_LOT_SHEETS = ["Lot 05", "lot n°1A", "LOT_5 bis", "Lot 15", "Total"]


@query(expected("for_5, for_1a", [(True, False), (False, False), (True, False), (False, False), (False, False)]))
def sheet_match(spark, sf_dir):
    rows = dealt(spark, sf_dir, _LOT_SHEETS)
    return rows.select("p_partkey", classify.sheet_of_lot(c("x0"), "lot 05").alias("for_5"), classify.sheet_of_lot(c("x0"), "1A").alias("for_1a"))


@query("SELECT s_suppkey AS book, '[Onglet : Lot 3 - Toiture]' || chr(10) || 'y' AS text FROM supplier WHERE s_suppkey % 2 = 1")
def sheet_text(spark, sf_dir):
    return pricing.lot_sheet_text(_cells(spark, sf_dir), classify.sheet_of_lot(c("sheet"), "3"))
