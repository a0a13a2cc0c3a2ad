"""Files out of rows: objects under content keys, Word documents and export bundles.

Each task writes the files of its rows through ``pyarrow.fs``.  A key is made of
the content, so a repeated task writes the same object again, and a reader never
sees a part: files are moved into place whole.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.operators.reports import FOLDERS

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)
#: Moment stamped on members of archives, so that equal content gives equal bytes.
_MOMENT = (1980, 1, 1, 0, 0, 0)


def put(root: str, key: str, content: bytes) -> None:
    fs, base = pyarrow.fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    path = f"{base.rstrip('/')}/{key}"
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{path}.part") as f:
        f.write(content)
    fs.move(f"{path}.part", path)


def write_objects(files: DataFrame, root: str, prefix: str) -> DataFrame:
    """``name, key, size`` of ``files(name, content)``, written under ``root``; a key is ``prefix/<digest>-name``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, content in zip(frame["name"], frame["content"]):
                key = f"{prefix}/{hashlib.sha256(name.encode() + bytes(content)).hexdigest()[:32]}-{name}"
                put(root, key, bytes(content))
                out.append((name, key, len(content)))
            yield pd.DataFrame(out, columns=["name", "key", "size"])

    return files.select("name", "content").mapInPandas(run, "name string, key string, size long")


def _zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name, _MOMENT), data)
    return out.getvalue()


def _paragraph(text: str, style: str = "") -> str:
    """A paragraph with its ``**bold**`` runs."""
    runs = []
    for part in re.split(r"(\*\*.*?\*\*)", text):
        bold = part.startswith("**") and part.endswith("**") and len(part) > 4
        if part:
            runs.append(f'<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(part[2:-2] if bold else part)}</w:t></w:r>')
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{head}{''.join(runs)}</w:p>"


def docx(title: str, parts: list[tuple[str, list[tuple[str, str]]]]) -> bytes:
    """A document with a cover title, a first heading a part, and a second heading and the lines of each section that is not blank."""
    body = [_paragraph(title, "Title")]
    for heading, sections in parts:
        body.append(_paragraph(heading, "Heading1"))
        for name, text in sections:
            lines = [x.rstrip() for x in text.split("\n") if x.strip()]
            if lines:
                body.append(_paragraph(name, "Heading2"))
            for line in lines:
                bullet = re.match(r"[-*]\s+", line)
                body.append(_paragraph(line[bullet.end() :], "ListBullet") if bullet else _paragraph(line))
    document = f"<?xml version=\"1.0\" encoding=\"UTF-8\"?><w:document {_W}><w:body>{''.join(body)}</w:body></w:document>"
    return _zipped({"[Content_Types].xml": _TYPES.encode(), "_rels/.rels": _RELS.encode(), "word/document.xml": document.encode()})


def render_documents(rows: DataFrame) -> DataFrame:
    """``project_id, name, content``: a Word document of each row of ``project_id, title, parts``.

    ``parts`` is an array of ``heading`` and ``sections``, these of ``name`` and ``text``, in order.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [docx(t, [(p["heading"], [(s["name"], s["text"] or "") for s in p["sections"]]) for p in parts]) for t, parts in zip(frame["title"], frame["parts"])]
            yield pd.DataFrame({"project_id": frame["project_id"], "name": "Memoire_technique.docx", "content": made})

    return rows.select("project_id", "title", "parts").mapInPandas(run, "project_id long, name string, content binary")


def write_bundles(files: DataFrame, projects: DataFrame, root: str) -> DataFrame:
    """``project_id, key, files, warnings`` of one ZIP archive a project under ``root``.

    ``files(project_id, folder, unique_name, content)`` are a project's planned
    files, which an offer bounds; ``projects(project_id, root_folder, warnings)``
    has a row for each archive.  All three folders exist, empty ones too.
    """

    def run(here: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"project_id": [], "key": [], "files": [], "warnings": []})
        project, top, warnings = own.iloc[0][["project_id", "root_folder", "warnings"]]
        members = {f"{top}/{f}/": b"" for f in FOLDERS}
        for folder, name, content in here.sort_values(["folder", "unique_name"])[["folder", "unique_name", "content"]].itertuples(index=False):
            members[f"{top}/{folder}/{name}"] = bytes(content)
        key = f"{project}/{top}.zip"
        put(root, key, _zipped(members))
        return pd.DataFrame([(project, key, len(here), list(warnings))], columns=["project_id", "key", "files", "warnings"])

    by = lambda df: df.groupBy("project_id")
    return by(files.select("project_id", "folder", "unique_name", "content")).cogroup(by(projects)).applyInPandas(run, "project_id long, key string, files long, warnings array<string>")


def write_json(df: DataFrame, path: str, *columns: str) -> None:
    """Rows as typed JSON lines with the chosen columns only."""
    df.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)
