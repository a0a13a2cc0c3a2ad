"""Archives and office files as rows.

Files are read with Spark's ``binaryFile`` source, so listing and reading are
distributed; each task unpacks the files of its partition and yields rows one by
one.  Unreadable files give an empty text and no cells.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendermill.operators.lots import detection
from tendermill.sources import xls
from tendermill.sources.pdf import pages_of

# Suffixes that are taken in, formats that only warn, and nesting depth.
ALLOWED = (".pdf", ".docx", ".doc", ".xlsx", ".xlsm", ".xls", ".ods", ".txt", ".zip")
WARNED = (".rar", ".7z")
DEPTH = 2
ODS = "{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}%s"


def controls(text: str) -> int:
    return sum((ord(c) < 32 and c not in "\t\n\r") or 127 <= ord(c) < 160 for c in text)


def decoded_name(name: str, utf8: bool) -> str:
    """File name of an archive member without folders.

    Without the UTF-8 flag the bytes are read again in four encodings; the one
    with the fewest control characters wins, of equals the longest, then the first.
    """
    if not utf8:
        raw, tried = name.encode("cp437", "replace"), []
        for encoding in ("cp850", "cp1252", "latin-1", "utf-8"):
            try:
                tried.append(raw.decode(encoding))
            except UnicodeDecodeError:
                continue
        name = min(tried, key=lambda x: (controls(x), -len(x)))
    base = re.split(r"[/\\]", name)[-1]
    base = re.sub(r'[<>:"|?*\x00-\x1f]', "_", base)
    return re.sub("_+", "_", base).strip("_. ") or "fichier_sans_nom"


def is_hidden(path: str) -> bool:
    parts = [p for p in re.split(r"[/\\]", path) if p]
    return any(p.startswith("__MACOSX") or (p.startswith(".") and p not in (".", "..")) for p in parts)


def _texts(element, tag: str) -> str:
    return "".join(x.text or "" for x in element.iter(tag))


def docx_text(content: bytes, tables: bool = False) -> str:
    """Non-blank paragraphs by line; with ``tables`` also table rows, cells two blanks apart."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    lines = [_texts(p, f"{w}t") for p in body.findall(f"{w}p")]
    if tables:
        for row in body.iter(f"{w}tr"):
            lines.append("  ".join(_texts(cell, f"{w}t").strip() for cell in row.findall(f"{w}tc")))
    return "\n".join(x for x in lines if x.strip())


def xlsx_cells(content: bytes) -> Iterator[tuple[str, int, int, str, bool]]:
    """``sheet, row, column, value, is_text`` of the filled cells of a workbook."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = [_texts(x, f"{m}t") for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{m}si")]
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    rid = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{m}sheet"):
        target = rels[sheet.get(rid)].lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        for n, row in enumerate(ElementTree.fromstring(book.read(path)).iter(f"{m}row")):
            for k, cell in enumerate(row.findall(f"{m}c")):
                ref = re.match(r"([A-Z]+)(\d+)", cell.get("r") or "")
                col = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(ref[1]))) - 1 if ref else k
                value, kind = cell.find(f"{m}v"), cell.get("t")
                text = _texts(cell, f"{m}t") if kind == "inlineStr" else (value.text or "" if value is not None else "")
                text = shared[int(text)] if kind == "s" and text else text
                if text:
                    yield sheet.get("name"), int(ref[2]) - 1 if ref else n, col, text, kind in ("s", "str", "inlineStr")


def _number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def ods_cells(content: bytes) -> Iterator[tuple[str, int, int, str, bool]]:
    """As for the other format; texts that read as numbers count as numbers."""
    tag = lambda space, name: ODS % (space, name)
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("content.xml"))
    for table in root.iter(tag("table", "table")):
        n = 0
        for row in table.iter(tag("table", "table-row")):
            k = 0
            for cell in row.findall(tag("table", "table-cell")):
                text = cell.get(tag("office", "value")) or "\n".join("".join(p.itertext()) for p in cell.findall(tag("text", "p")))
                times = int(cell.get(tag("table", "number-columns-repeated")) or 1)
                for i in range(times if text else 0):
                    yield table.get(tag("table", "name")), n, k + i, text, not _number(text)
                k += times
            n += int(row.get(tag("table", "number-rows-repeated")) or 1)


def cells_of(name: str, content: bytes) -> Iterator[tuple[str, int, int, str, bool]]:
    low = name.lower()
    read = ods_cells if low.endswith(".ods") else xlsx_cells if low.endswith((".xlsx", ".xlsm")) else xls.cells if low.endswith(".xls") else None
    if read:
        # Files named after another format than their own are read as what they are.
        if read in (xls.cells, xlsx_cells):
            read = xls.cells if content.startswith(xls.MAGIC) else xlsx_cells
        try:
            yield from list(read(content))
        except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError, xls.Damaged, struct.error):
            return


def text_of(name: str, content: bytes, most_pages: int | None = None) -> tuple[str, int | None]:
    """Text of a file by its suffix, and the number of pages of a PDF; unsupported or unreadable files give an empty text."""
    low = name.lower()
    if low.endswith(".txt"):
        return content.decode("utf-8", "replace"), None
    if low.endswith(".pdf"):
        try:
            pages = pages_of(content, most_pages)
        except (ValueError, IndexError, TypeError, KeyError, AttributeError, RecursionError, struct.error):
            return "", None
        return "\n\n".join(x for x in pages if x), len(pages) or None
    if low.endswith(".docx"):
        try:
            return docx_text(content), None
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return "", None
    rows: dict[tuple[str, int], list[str]] = {}
    for sheet, row, _, value, _ in cells_of(name, content):
        rows.setdefault((sheet, row), []).append(value)
    return "\n".join("\t".join(x) for x in rows.values()), None


def read_archives(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """``archive, depth, name, size, text, page_count, warning`` of the files in the ZIP archives under ``path``."""
    from tendermill.sources import zip_ranges  # which reads texts as this module does

    return zip_ranges.read(spark, path, most_bytes)


def read_texts(spark: SparkSession, path: str, most_pages: int | None = None) -> DataFrame:
    """``path, text, page_count`` of the files under ``path``, of PDF files the first ``most_pages`` pages."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                yield pd.DataFrame([(name, *text_of(name, bytes(content), most_pages))], columns=["path", "text", "page_count"]).astype({"page_count": "Int32"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, text string, page_count int")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``book, sheet, row, col, value, is_text`` of the spreadsheets under ``path``."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for book, content in zip(frame["path"], frame["content"]):
                found = [(book, *x) for x in cells_of(book, bytes(content))]
                yield pd.DataFrame(found, columns=["book", "sheet", "row", "col", "value", "is_text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,xlsm,xls,ods}").load(path)
    return files.select("path", "content").mapInPandas(unpack, "book string, sheet string, row int, col int, value string, is_text boolean")


def locked_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``book, d``: the pseudo-lot that stands for a workbook under a password.

    A task opens the files of its rows and reads their first sectors.
    """

    def tell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[_is_locked(book) for book in frame["book"]]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,xlsm,xls}").load(path)
    locked = files.select(F.col("path").alias("book")).mapInPandas(tell, "book string")
    told = F.lit("Fichier Excel protégé — ouvrez-le et renvoyez-le sans protection")
    return locked.select("book", detection(F.lit("!!"), told, 0, "error").alias("d"))


def _is_locked(path: str) -> bool:
    fs, at = pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    with fs.open_input_file(at) as f:
        # A workbook of the newer format in such a container is an encrypted one, whatever else it holds.
        return f.read(8) == xls.MAGIC and (not path.lower().endswith(".xls") or xls.is_locked(f))
