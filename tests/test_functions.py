import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tendermill.functions import classify, text

DOC_TYPES = {
    "dc1_template": ["DC1.pdf", "DC 1.pdf", "DC-1.pdf", "Lettre_de_candidature.docx", "AE_DC1_combine.pdf"],
    "dc2_template": ["DC2.pdf", "DC2_declaration_candidat.pdf", "Declaration_du_candidat.docx"],
    "acte_engagement_template": ["AE.pdf", "Acte_d_engagement.pdf", "AE_signe_final.pdf", "2829 - AE.pdf", "DCE_AE.pdf"],
    "diagnostic": ["DIAG AMIANTE 1.pdf", "CREP_plomb.pdf", "Rapport_SOCOTEC.pdf", "I-25-03-66-G2PRO_etude.pdf", "Diagnostic_termites.pdf"],
    "notice": ["EQ2402-NOTICE_ACCESSIBILITE.pdf", "Notice PC.pdf"],
    "dt": ["DT ENEDIS.pdf", "DT_SIEM.pdf", "DT-FREE.pdf"],
    "pgc_sps": ["PGC SPS.pdf", "PGCSPS_2024.pdf", "Plan_general_coordination.pdf"],
    "planning": ["Planning previsionnel.pdf", "Planning_DCE.pdf"],
    "cctp": ["CCTP_Lot01.pdf", "lot 01 Demolition-GO_DCE.pdf", "Carnet_detail_facade.pdf", "DCE-GO01.pdf", "DCE-MEN03.docx"],
    "rc": ["RDC.pdf", "RC.pdf", "Reglement_de_la_consultation.pdf"],
    "plan": ["Plan_RDC.dwg", "RDC_coupe.pdf", "ARCH 02 - RDC.pdf", "Plan_facade.pdf"],
    "dpgf_template": ["DPGF.xlsx", "Decomposition_prix_global.xls", "DPGF.ods", "DPGF_BPU_combine.xlsx"],
    "bpu_template": ["BPU.pdf", "Bordereau_prix_unitaire.xlsx", "BPU_DQE.xlsx"],
    "dqe_template": ["DQE.xlsx", "Detail_quantitatif.xlsx"],
    "cadre_reponse": ["Cadre_de_reponse.docx", "Cadre-réponse.docx"],
    "attestation_visite_template": ["Attestation_visite.pdf", "Visite_de_site.pdf"],
    "ccap": ["CCAP.pdf", "Cahier_administratif.pdf"],
    "autre": ["", "DC14.pdf", "phase_AE_dossier.pdf", "Plomberie_lot.pdf", "DTU 13.3 fondations.pdf", "DCE-XYZABC123.pdf", "image.png"],
}


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_document_types(spark):
    pairs = [(name, kind) for kind, names in DOC_TYPES.items() for name in names]
    found = column(spark, [n for n, _ in pairs], lambda x: classify.doc_type(x, F.lit("autre")))
    assert [(n, f) for (n, _), f in zip(pairs, found)] == pairs


def test_given_types_pass_and_unknown_ones_do_not(spark):
    df = spark.createDataFrame([("random.pdf", "rc"), ("DC1.pdf", "ccap"), ("BPU.xlsx", "dpgf"), ("x.pdf", None)], "n string, f string")
    assert [r[0] for r in df.select(classify.doc_type(F.col("n"), F.col("f"))).collect()] == ["rc", "ccap", "bpu_template", "autre"]


def test_vault_types(spark):
    texts = ["Fournir un Kbis", "Attestation de vigilance URSSAF", "Attestation d'assurance décennale", "Attestation Pro BTP", "RIB au nom", "rien", None]
    assert column(spark, texts, classify.vault_type) == ["kbis", "urssaf", "decennale", "pro_btp", "rib", None, None]


def test_tags_and_lot_filter(spark):
    df = spark.createDataFrame(
        [("RC.pdf", "rc"), ("x.pdf", "plan"), ("CCTP_Lot05.pdf", "cctp"), ("DCE_lot 1A.pdf", "cctp"), ("Planning.pdf", "planning"), ("DPGF_Lot2.xlsx", "dpgf_template")], "n string, k string"
    )
    assert [r[0] for r in df.select(classify.lot_tags(F.col("n"), F.col("k"))).collect()] == [["all"], ["info"], ["5"], ["1A"], ["all"], ["2"]]
    tags = [["all"], ["info"], ["5"], ["5", "13"], None, []]
    kept = lambda lot: [n for n, k in zip("abcdef", column(spark, tags, lambda x: classify.concerns_lot(x, lot), "array<string>")) if k]
    assert kept("lot05") == list("acde")
    assert kept(None) == list("acdef")


def test_lots(spark):
    assert column(spark, ["05", "1A", "C", "x", "123"], classify.canonical_lot) == ["lot5", "lot1A", "lot3", None, None]
    assert column(spark, ["Lot 05", "1A", "lot_012"], classify.normal_lot) == ["5", "1a", "12"]


def test_normalise_drops_ligatures(spark):
    assert column(spark, ["Gros  œuvre", "Électricité ", None, ""], text.normalise) == ["gros uvre", "electricite", None, ""]


def test_numbers(spark):
    spelt = ["1 200,50 €", "1.200,50", "", "1_000", "12d", "1 200", "-3", ".5", "nan"]
    assert column(spark, spelt, text.to_number) == [1200.5, None, None, 1000.0, None, None, -3.0, 0.5, None]


def test_expiry(spark):
    asof = F.lit("2024-01-31").cast("date")
    days = [None, dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 3, 1), dt.date(2024, 3, 2)]
    expected = ["valid", "expired", "expiring_soon", "expiring_soon", "valid"]
    assert column(spark, days, lambda x: classify.expiry_status(x, asof), "date") == expected


def test_excerpt(spark):
    lines = [["head", "", "x", "y ", "", "z"], ["head"], ["head", "a" * 300, "b"]]
    assert column(spark, lines, lambda x: text.excerpt(x, F.lit(1)), "array<string>") == ["x y", "", "a" * 300]


def test_haversine(spark):
    from tendermill.operators.scoring import haversine_km

    km = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert math.isclose(km, 111.195, abs_tol=1e-3)


@pytest.mark.parametrize("name, expected", [("a b.PDF", "a_b.PDF"), ("é??à.txt", "e_a.txt"), ("__", "document")])
def test_safe_names(spark, name, expected):
    assert column(spark, [name], text.safe_name) == [expected]
