import io
import zipfile

from tendermill.sources import archives, knowledge
from tendermill.sources.pdf import pages_of


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def workbook(rows):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + k)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return zipped(
        {
            "xl/workbook.xml": f'<workbook {m} xmlns:r="{r}"><sheets><sheet name="Lot 1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f"<worksheet {m}><sheetData>{body}</sheetData></worksheet>",
        }
    )


def document(lines):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    return zipped({"word/document.xml": f"<w:document {w}><w:body>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines) + "</w:body></w:document>"})


def test_archives(spark, tmp_path):
    inner = zipped({"deep.txt": "au fond", "deepest.zip": zipped({"x.txt": "x"})})
    whole = zipped({"a/RC.txt": "règles", "__MACOSX/b.txt": "no", ".hidden/c.txt": "no", "d.docx": document(["un", "", "deux"]), "e.rar": "x", "f.png": "x", "g.zip": inner, "h.txt": ""})
    (tmp_path / "one.zip").write_bytes(whole)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    rows = {(r.depth, r.name): (r.text, bool(r.warning)) for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert rows == {(0, "RC.txt"): ("règles", False), (0, "d.docx"): ("un\ndeux", False), (0, "e.rar"): ("", True), (1, "deep.txt"): ("au fond", False), (2, "x.txt"): ("x", False), (0, ""): ("", True)}


def test_archives_over_the_limit_are_told(spark, tmp_path):
    (tmp_path / "one.zip").write_bytes(zipped({"a.txt": "x" * 50}))
    rows = archives.read_archives(spark, str(tmp_path), most_bytes=20).collect()
    assert [(r.name, r.size > 20, r.warning) for r in rows] == [("", True, "archive is over the size limit")]


def test_member_names():
    assert archives.decoded_name("CARNET DE DÉTAIL.pdf", True) == "CARNET DE DÉTAIL.pdf"
    assert archives.decoded_name("../../../etc/passwd", True) == "passwd"
    assert not set(archives.decoded_name("weird<file>:name|.pdf", True)) & set('<>:"|?*')
    assert archives.decoded_name("", True) == "fichier_sans_nom"
    assert not any(127 <= ord(c) < 160 for c in archives.decoded_name("D\u0090TAIL.pdf", False))
    # As written by French systems: bytes of code page 850, read as 437.
    for name in ("CARNET DE DÉTAIL.pdf", "RÈGLEMENT À LIRE.pdf"):
        assert archives.decoded_name(name.encode("cp850").decode("cp437"), False) == name


def test_workbooks(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook([["N°", "Montant HT"], ["1", "12,5"]]))
    rows = {(r.sheet, r.row, r.col): r.value for r in archives.read_workbooks(spark, str(tmp_path)).collect()}
    assert rows == {("Lot 1", 0, 0): "N°", ("Lot 1", 0, 1): "Montant HT", ("Lot 1", 1, 0): "1", ("Lot 1", 1, 1): "12,5"}


def pdf(pages, compress=True):
    """A small file as office programs write it: compressed pages, one font with its own codes."""
    import zlib

    out = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{10 + 2 * i} 0 R' for i in range(len(pages)))}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>"]
    objects = {1: out[0].encode(), 2: out[1].encode(), 3: b"<< /Type /Font /Subtype /Type1 >>", 4: b"<< /Type /Font /ToUnicode 5 0 R >>"}
    objects[5] = b"<< >>\nstream\n1 beginbfchar <0001> <00C9> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange\nendstream"
    for i, content in enumerate(pages):
        raw = zlib.compress(content) if compress else content
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(raw), b" /Filter /FlateDecode" if compress else b"", raw)
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % x for x in objects.items()) + b"\ntrailer << /Root 1 0 R >>"


def test_pdf_texts(spark, tmp_path):
    first = b"BT /F1 12 Tf 72 700 Td (R\\350glement \\(RC\\)) Tj T* [(de la) -250 (con) 20 (sultation)] TJ ET"
    second = b"BT /F2 9 Tf 1 0 0 1 0 0 Tm <000100020003> Tj ET"
    for compress in (True, False):
        assert pages_of(pdf([first, second], compress)) == ["Règlement (RC)\nde la consultation", "Éab"]
    (tmp_path / "a.pdf").write_bytes(pdf([first, second, first]))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF nothing")
    rows = {r.path.rsplit("/", 1)[1]: (r.text, r.page_count) for r in archives.read_texts(spark, str(tmp_path), most_pages=2).collect()}
    assert rows == {"a.pdf": ("Règlement (RC)\nde la consultation\n\nÉab", 2), "bad.pdf": ("", None)}


def test_locked_workbooks(spark, tmp_path):
    (tmp_path / "locked.xlsx").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"rest")
    (tmp_path / "open.xlsx").write_bytes(workbook([["1"]]))
    rows = archives.locked_workbooks(spark, str(tmp_path)).collect()
    assert [(r.book.rsplit("/", 1)[1], r.d.id, r.d.confidence, r.d.sources) for r in rows] == [("locked.xlsx", "!!", 0, ["error"])]


def test_knowledge_files(spark, tmp_path):
    for name, text in (("dtu", "---\nx: 1\n---\n\n# DTU\n## Sols\na\n## Murs\nb"), ("autre", "# Rien")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text(text)
    files = knowledge.read_knowledge(spark, str(tmp_path))
    assert {r.name: r.text for r in files.collect()} == {"dtu": "# DTU\n## Sols\na\n## Murs\nb", "autre": "# Rien"}
    assert [tuple(r) for r in knowledge.section(files, "sols").collect()] == [("dtu", "## Sols\na")]
    assert knowledge.bundle(files, ["autre", "absent"]).first().text == "━━━ RÉFÉRENTIEL : autre ━━━\n# Rien"
