import io
import zipfile

from pyspark.sql import functions as F

from tendermill.operators import reports
from tendermill.sources import archives, sinks


def test_objects_keep_their_content(spark, tmp_path):
    files = spark.createDataFrame([("a b.txt", bytearray(b"one")), ("c.txt", bytearray(b""))], "name string, content binary")
    rows = sinks.write_objects(files, str(tmp_path), "projects/7").collect()
    assert {r.name: (tmp_path / r.key).read_bytes() for r in rows} == {"a b.txt": b"one", "c.txt": b""}
    assert {r.key for r in sinks.write_objects(files, str(tmp_path), "projects/7").collect()} == {r.key for r in rows}


def test_documents_hold_headings_bullets_and_bold(spark):
    schema = "project_id long, title string, parts array<struct<heading:string,sections:array<struct<name:string,text:string>>>>"
    parts = [("Partie A", [("Moyens", "un **gras**\n\n- puce & co"), ("Vide", " \n"), ("Rien", None)])]
    row = sinks.render_documents(spark.createDataFrame([(1, "Mémoire", parts)], schema)).first()
    assert archives.docx_text(bytes(row.content)) == "Mémoire\nPartie A\nMoyens\nun gras\npuce & co"
    xml = zipfile.ZipFile(io.BytesIO(bytes(row.content))).read("word/document.xml").decode()
    assert xml.count("<w:b/>") == 1 and xml.count("ListBullet") == 1


def test_bundles_have_three_folders(spark, tmp_path):
    files = spark.createDataFrame([(1, "01_Candidature", "Kbis.pdf", bytearray(b"k")), (1, "02_Offre", "DPGF.xlsx", bytearray(b"d"))], "project_id long, folder string, unique_name string, content binary")
    projects = spark.createDataFrame([(1, "École", None, ["x"]), (2, "b", "Lot 1", [])], "project_id long, name string, lot string, warnings array<string>")
    projects = projects.select("project_id", reports.root_folder(F.col("name"), F.col("lot"), F.lit("2024-02-29").cast("date")).alias("root_folder"), "warnings")
    rows = {r.project_id: r for r in sinks.write_bundles(files, projects, str(tmp_path)).collect()}
    names = set(zipfile.ZipFile(tmp_path / rows[1].key).namelist())
    top = "Reponse_AO_Ecole_20240229"
    assert names == {f"{top}/01_Candidature/", f"{top}/02_Offre/", f"{top}/03_Technique/", f"{top}/01_Candidature/Kbis.pdf", f"{top}/02_Offre/DPGF.xlsx"}
    assert rows[1].warnings == ["x"] and rows[2].files == 0 and rows[2].key == "2/Reponse_AO_b_Lot_1_20240229.zip"
