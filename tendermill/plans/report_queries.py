"""Queries of summaries, exports, completion, orders and mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermill.functions import classify
from tendermill.operators import relational, reports, scoring
from tendermill.plans.base import ORDERS_ASOF, c, dealt, expected, query, t


@query(f"""
SELECT count_if(d < 0)::BIGINT AS expired, count_if(d BETWEEN 0 AND 30)::BIGINT AS expiring
FROM (SELECT date_diff('day', DATE '{ORDERS_ASOF}', o_orderdate::DATE + 60) AS d FROM orders)""")
def vault_counters(spark, sf_dir):
    status = classify.expiry_status(F.date_add(c("o_orderdate").cast("date"), 60), F.lit(ORDERS_ASOF).cast("date"))
    return t(spark, sf_dir, "orders").select(status.alias("s")).agg(scoring.count_where(c("s") == "expired").alias("expired"), scoring.count_where(c("s") == "expiring_soon").alias("expiring"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def category_counts(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_returnflag, list(l_linenumber ORDER BY l_linenumber) AS lines FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber FROM lineitem) GROUP BY ALL")
def category_groups(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber").distinct()
    return rows.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))


def _export(spark, sf_dir):
    """Projects are orders; requirements and checklist items are line items by their flag, documents parts of a line."""
    lines = t(spark, sf_dir, "lineitem").withColumn("project_id", c("l_orderkey"))
    compliance = lines.where("l_returnflag = 'N'").select("project_id", F.when(c("l_quantity") > 10, "couvert").otherwise("partiel").alias("status"))
    checklist = lines.where("l_returnflag <> 'N'").select("project_id", F.when(c("l_quantity") > 25, "present").otherwise("manquant").alias("status"))
    memoires = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("project_id"))
    documents = lines.select("project_id", c("l_linenumber").alias("id"), F.when(c("l_linestatus") == "O", "dpgf_template").otherwise("rc").alias("type"), F.concat(F.lit("f"), c("l_linenumber").cast("string")).alias("file_name"))
    return compliance, checklist, memoires, documents


_SUMMARY_SQL = """
SELECT coalesce(l.p, o.p) AS project_id, coalesce(ct, 0)::BIGINT AS compliance_total, coalesce(cc, 0)::BIGINT AS compliance_covered, coalesce(kt, 0)::BIGINT AS checklist_total, coalesce(kp, 0)::BIGINT AS checklist_present,
  o.p IS NOT NULL AS has_memoire, coalesce(dpgf, false) AS has_dpgf, dpgf_name
FROM (SELECT l_orderkey AS p, count_if(l_returnflag = 'N') AS ct, count_if(l_returnflag = 'N' AND l_quantity > 10) AS cc, count_if(l_returnflag <> 'N') AS kt, count_if(l_returnflag <> 'N' AND l_quantity > 25) AS kp,
    bool_or(l_linestatus = 'O') AS dpgf, 'f' || min(l_linenumber) FILTER (WHERE l_linestatus = 'O') AS dpgf_name FROM lineitem GROUP BY l_orderkey) l
FULL JOIN (SELECT o_orderkey AS p FROM orders WHERE o_orderstatus = 'F') o ON l.p = o.p"""


@query(_SUMMARY_SQL)
def export_summary(spark, sf_dir):
    return reports.export_summary(*_export(spark, sf_dir))


@query(f"""
SELECT project_id, ((NOT (compliance_total > 0 AND compliance_total = compliance_covered))::INTEGER + (NOT (checklist_total > 0 AND checklist_total = checklist_present))::INTEGER
  + (NOT has_memoire)::INTEGER + (NOT (has_dpgf AND project_id % 2 = 0))::INTEGER) AS alerts FROM ({_SUMMARY_SQL})""")
def export_alerts(spark, sf_dir):
    summary = reports.export_summary(*_export(spark, sf_dir))
    return summary.select("project_id", reports.export_alerts(summary, c("project_id") % 2 == 0).cast("int").alias("alerts"))


def _bundle(spark, sf_dir):
    o = c("o_orderkey")
    projects = t(spark, sf_dir, "orders").select(o.alias("project_id"), (c("o_orderstatus") == "F").alias("has_memoire"), F.when(o % 3 == 0, "chiffré (v2).xlsx").alias("dpgf_name"))
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus").distinct()
    items = lines.where("l_linenumber <= 4").select(c("l_orderkey").alias("project_id"), (c("l_linenumber") * 1_000_000 + c("l_partkey")).cast("long").alias("item_id"), (c("l_partkey") % 5).alias("linked_document_id"))
    vault = t(spark, sf_dir, "region").select(c("r_regionkey").cast("long").alias("id"), F.element_at(F.array(*map(F.lit, ("Kbis.pdf", "Kbis.pdf", "Attestation d'été.pdf", "RIB", "été/hiver.pdf"))), c("r_regionkey") + 1).alias("file_name"))
    k = c("l_linenumber")
    documents = lines.where("l_linenumber > 2").select(
        c("l_orderkey").alias("project_id"), (k * 1_000_000 + c("l_partkey")).cast("long").alias("id"), F.when(k == 3, "acte_engagement_template").when(k == 4, "dpgf_template").otherwise("dc1_template").alias("type"),
        F.concat(F.lit("doc"), (k % 2).cast("string"), F.lit(".pdf")).alias("file_name"), (c("l_linestatus") == "O").alias("is_user_completed"),
    )
    return projects, items, vault, documents


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_linestatus FROM lineitem),
f AS (SELECT l_orderkey AS project_id, '01_Candidature' AS folder, 0 AS part, l_linenumber * 1000000 + l_partkey AS seq, ['Kbis.pdf', 'Kbis.pdf', 'Attestation_d_ete.pdf', 'RIB', 'ete_hiver.pdf'][(l_partkey % 5)::INTEGER + 1] AS name, (l_partkey % 5)::VARCHAR AS file_id FROM l WHERE l_linenumber <= 4
  UNION ALL SELECT l_orderkey, CASE WHEN l_linenumber IN (3, 4) THEN '02_Offre' ELSE '01_Candidature' END, 1, l_linenumber * 1000000 + l_partkey, 'doc' || l_linenumber % 2 || '.pdf', (l_linenumber * 1000000 + l_partkey)::VARCHAR FROM l WHERE l_linenumber > 2 AND l_linestatus = 'O'
  UNION ALL SELECT o_orderkey, '02_Offre', 2, 0, 'Memoire_technique.docx', 'memoire' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, '02_Offre', 3, 0, 'DPGF_remplie_chiffre_v2_.xlsx', 'dpgf' FROM orders WHERE o_orderkey % 3 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY project_id, folder, name ORDER BY part, seq) AS k FROM f)
SELECT project_id, folder, CASE WHEN k = 1 THEN name WHEN contains(name, '.') THEN regexp_replace(name, '\\.[^.]*$', '') || '_' || k || regexp_extract(name, '\\.[^.]*$') ELSE name || '_' || k END AS unique_name, file_id FROM n""")
def export_manifest(spark, sf_dir):
    return reports.export_manifest(*_bundle(spark, sf_dir))


@query("""
SELECT o_orderkey AS project_id, list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'Mémoire technique non généré' END, CASE WHEN o_orderkey % 3 <> 0 AND sheet THEN 'DPGF non remplie' END,
  CASE WHEN act AND NOT signed THEN 'Acte d''engagement non signé' END], lambda w: w IS NOT NULL) AS warnings
FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_linenumber = 4) AS sheet, bool_or(l_linenumber = 3) AS act, bool_or(l_linenumber = 3 AND l_linestatus = 'O') AS signed FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def export_warnings(spark, sf_dir):
    projects, _, _, documents = _bundle(spark, sf_dir)
    return reports.export_warnings(projects, documents)


@query("SELECT s_suppkey, 'Reponse_AO_Ecole_no_' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '_Lot_5_Facade' ELSE '' END || '_20010630' AS root FROM supplier")
def export_root(spark, sf_dir):
    name = F.concat(F.lit("École: no "), c("s_suppkey").cast("string"))
    lot = F.when(c("s_suppkey") % 2 == 0, "Lot 5 — Façade")
    return t(spark, sf_dir, "supplier").select("s_suppkey", reports.root_folder(name, lot, F.lit(ORDERS_ASOF).cast("date")).alias("root"))


_FILE_NAMES = ["a.pdf", "a_2.pdf", "a.pdf", "A.pdf", "b", "b", "a.pdf"]


@query("""
SELECT s_suppkey AS project_id, k AS seq, v.name, free_name FROM supplier, (VALUES (0, 'a.pdf', 'a.pdf'), (1, 'a_2.pdf', 'a_2.pdf'), (2, 'a.pdf', 'a_3.pdf'), (3, 'A.pdf', 'A.pdf'), (4, 'b', 'b'), (5, 'b', 'b_2'), (6, 'a.pdf', 'a_4.pdf')) v(k, name, free_name)""")
def import_names(spark, sf_dir):
    files = t(spark, sf_dir, "supplier").select(c("s_suppkey").alias("project_id"), F.posexplode(F.array(*map(F.lit, _FILE_NAMES))).alias("seq", "name"))
    return reports.free_names(files.withColumn("seq", c("seq").cast("long")))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 2 END AS sections, CASE p_partkey % 3 WHEN 0 THEN 3 ELSE 1 END AS pages FROM part")
def memoire_size(spark, sf_dir):
    part = lambda *x: F.create_map(*[y for i, v in enumerate(x) for y in (F.lit(f"s{i}"), v)])
    k, words = c("p_partkey") % 3, F.repeat(F.lit("mot "), 800)
    full = F.create_map(F.lit("a"), part(words, F.lit("x")), F.lit("b"), part(words, F.lit("")), F.lit("c"), part(F.lit("y")))
    content = F.when(k == 0, full).when(k == 1, F.create_map(F.lit("a"), part(F.lit("")))).otherwise(F.create_map(F.lit("a"), part(F.lit("seul"))))
    sections, pages = reports.memoire_size(content)
    return t(spark, sf_dir, "part").select("p_partkey", sections.alias("sections"), pages.alias("pages"))


@query("SELECT l_orderkey, floor(100 * count_if(l_linenumber % 3 <> 0) / count(*) + 0.5)::INTEGER AS percent FROM lineitem GROUP BY l_orderkey")
def section_completion(spark, sf_dir):
    text = F.when(c("l_linenumber") % 3 == 0, "  court     ").otherwise("un texte assez long")
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(text).alias("s"))
    return rows.select("l_orderkey", reports.section_percent(c("s")).alias("percent"))


@query("""
SELECT c_custkey, 1 + (c_custkey % 2 = 0)::INTEGER + (c_custkey % 3 = 0)::INTEGER + (c_custkey % 5 = 0)::INTEGER AS filled, 1 + (c_custkey % 2 = 0)::INTEGER + (c_custkey % 3 <> 1)::INTEGER AS imported FROM customer""")
def config_counts(spark, sf_dir):
    k = c("c_custkey")
    note = F.when(k % 2 == 0, "oui")
    turnover = F.when(k % 3 != 1, F.array(F.struct(F.when(k % 3 == 0, 2020).alias("annee"), F.lit(None).cast("double").alias("montant"))))
    posts = F.array(F.struct(F.when(k % 5 == 0, "chef").otherwise("").alias("nom")))
    return t(spark, sf_dir, "customer").select(
        k, reports.filled_fields([c("c_name"), note], turnover, posts).alias("filled"), reports.imported_fields([c("c_name"), note], [turnover]).alias("imported")
    )


@query("""
SELECT l_shipdate::DATE AS day, sum(l_quantity * 1e7)::DOUBLE AS total, max(l_quantity * 1e7)::DOUBLE AS most,
  CASE WHEN sum(l_quantity * 1e7) > 1073741824 THEN 'over_1gb' WHEN sum(l_quantity * 1e7) > 524288000 THEN 'over_500mb' WHEN sum(l_quantity * 1e7) > 104857600 THEN 'over_100mb' ELSE 'small' END AS band
FROM lineitem GROUP BY ALL""")
def size_stats(spark, sf_dir):
    size = c("l_quantity") * 1e7
    sums = t(spark, sf_dir, "lineitem").groupBy(c("l_shipdate").cast("date").alias("day")).agg(F.sum(size).alias("total"), F.max(size).alias("most"))
    return sums.withColumn("band", classify.size_band(c("total")))


@query("""
SELECT o_orderkey, (CASE WHEN o_orderkey % 4 = 0 THEN 6 WHEN o_orderkey % 4 = 1 THEN least(2, 6) WHEN o_orderkey % 4 = 2 THEN least(o_orderkey % 9 - 1, 6) ELSE 0 END)::INTEGER AS done FROM orders""")
def done_steps(spark, sf_dir):
    k = c("o_orderkey") % 4
    status = F.when(k == 0, "gagné").otherwise("en_cours")
    marks = F.create_map(F.lit("1"), F.lit(True), F.lit("2"), F.lit(False), F.lit("3"), F.lit(True))
    completed = F.when(k == 1, marks).when(k == 3, F.create_map().cast("map<string,boolean>"))
    current = F.when(k == 2, c("o_orderkey") % 9).otherwise(4)
    return t(spark, sf_dir, "orders").select("o_orderkey", reports.done_steps(status, completed, current).cast("int").alias("done"))


@query("""
SELECT o_orderkey, list_sort(list_distinct(['1', (o_orderkey % 5)::VARCHAR])) AS steps, CASE WHEN 3 <= o_orderkey % 5 THEN o_orderkey % 5 + 1 ELSE 3 END AS current_step FROM orders""")
def step_map_update(spark, sf_dir):
    marks = F.when(c("o_orderkey") % 2 == 0, F.create_map(F.lit("1"), F.lit(True))).otherwise(F.create_map(F.lit("1"), F.lit(True)))
    projects = t(spark, sf_dir, "orders").select("o_orderkey", marks.alias("completed_steps"), F.lit(3).cast("long").alias("current_step"), (c("o_orderkey") % 5).alias("step"))
    return reports.step_done(projects, "step").select("o_orderkey", F.array_sort(F.map_keys("completed_steps")).alias("steps"), "current_step")


_PROCESSING = [("uploading", 1), ("extracting_text", 47), ("detecting_lots", 0), (None, None), ("odd", 9)]


@query(expected("label, percent", [("Upload des fichiers", 5), ("Extraction des documents", 17), ("Détection des lots", 30), ("Prêt", 0), ("odd", 0)]))
def legacy_status(spark, sf_dir):
    label, percent = reports.legacy_status(c("x0"), c("x1"))
    return dealt(spark, sf_dir, [s for s, _ in _PROCESSING], [p for _, p in _PROCESSING]).select("p_partkey", label.alias("label"), percent.alias("percent"))


@query("""
SELECT project_id, count(*) AS n, bool_or(partial) AS partial, count(*) BETWEEN 1 AND 14 AS few FROM (
  SELECT l_suppkey AS project_id, l_tax > 0.07 AS partial FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_suppkey, l_tax > 0.07 FROM lineitem WHERE l_returnflag = 'R') GROUP BY project_id""")
def two_pass_merge(spark, sf_dir):
    rows = lambda flag: t(spark, sf_dir, "lineitem").where(c("l_returnflag") == flag).select(c("l_suppkey").alias("project_id"), c("l_partkey").alias("exigence"), (c("l_tax") > 0.07).alias("partial"))
    return reports.merged_passes(rows("A"), rows("R"))


_GROUP_TYPES = ["decennale", "kbis", "rib", "no such type", "autre", "urssaf", "pouvoir"]


@query("""
SELECT c_custkey % 10 AS organization_id, place, ['Assurances', 'Social', 'Fiscal', 'Juridique', 'Qualifications', 'Formulaires', 'Entreprise', 'Autres'][place + 1] AS label, list(c_custkey ORDER BY c_custkey) AS ids
FROM (SELECT c_custkey, [0, 3, 5, NULL, 7, 1, 3][(c_custkey % 7)::INTEGER + 1] AS place FROM customer) WHERE place IS NOT NULL GROUP BY ALL""")
def vault_groups(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _GROUP_TYPES)), (c("c_custkey") % 7 + 1).cast("int"))
    return reports.vault_groups(t(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), (c("c_custkey") % 10).alias("organization_id"), kind.alias("type")))


@query("SELECT count(*) AS projects FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def deletion_report(spark, sf_dir):
    gone = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("o_custkey"))
    return t(spark, sf_dir, "orders").join(gone, "o_custkey", "left_semi").agg(F.count("*").alias("projects"))


# Orders


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_shipdate NULLS LAST, l_linenumber, l_partkey)::INTEGER AS place FROM lineitem""")
def rank_sort_enum(spark, sf_dir):
    rows = reports.placed(t(spark, sf_dir, "lineitem"), ["l_orderkey"], reports.enum_rank(c("l_returnflag"), ("R", "A")), c("l_shipdate").asc_nulls_last(), c("l_linenumber"), c("l_partkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("""
SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 7 END DESC NULLS FIRST, c_custkey)::INTEGER AS by_year,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 9 END NULLS LAST, c_custkey)::INTEGER AS by_expiry FROM customer""")
def null_placement(spark, sf_dir):
    k = c("c_custkey")
    rows = t(spark, sf_dir, "customer").select("c_nationkey", k, F.when(k % 3 != 0, k % 7).alias("year"), F.when(k % 4 != 0, k % 9).alias("expiry"))
    rows = reports.placed(rows, ["c_nationkey"], c("year").desc_nulls_first(), k).withColumnRenamed("place", "by_year")
    return reports.placed(rows, ["c_nationkey"], c("expiry").asc_nulls_last(), k).withColumnRenamed("place", "by_expiry").drop("year", "expiry")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INTEGER AS place FROM orders")
def latest_first(spark, sf_dir):
    rows = reports.placed(t(spark, sf_dir, "orders"), ["o_custkey"], c("o_orderdate").desc_nulls_last(), c("o_orderkey").desc())
    return rows.select("o_custkey", "o_orderkey", "place")


@query(f"""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 9999 ELSE date_diff('day', DATE '{ORDERS_ASOF}', o_orderdate::DATE) END, o_orderkey)::INTEGER AS by_deadline,
  row_number() OVER (PARTITION BY o_custkey ORDER BY ['École', 'ecole', 'Élan', 'Ecole', 'zoo', 'été', 'école', 'Zoo'][(o_orderkey // 3 % 8)::INTEGER + 1] COLLATE fr, o_orderkey)::INTEGER AS by_name FROM orders""")
def project_sorts(spark, sf_dir):
    days = F.coalesce(F.when(c("o_orderstatus") != "P", F.datediff(c("o_orderdate").cast("date"), F.lit(ORDERS_ASOF).cast("date"))), F.lit(9999))
    name = F.element_at(F.array(*map(F.lit, ("École", "ecole", "Élan", "Ecole", "zoo", "été", "école", "Zoo"))), (F.floor(c("o_orderkey") / 3) % 8 + 1).cast("int"))
    rows = reports.placed(t(spark, sf_dir, "orders"), ["o_custkey"], days, c("o_orderkey")).withColumnRenamed("place", "by_deadline")
    return reports.placed(rows, ["o_custkey"], reports.french_key(name), c("o_orderkey")).withColumnRenamed("place", "by_name").select("o_custkey", "o_orderkey", "by_deadline", "by_name")


@query("""
SELECT p_partkey FROM part ORDER BY CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, p_partkey LIMIT 3""")
def tips_topk(spark, sf_dir):
    level = F.when(c("p_size") % 3 == 0, "high").when(c("p_size") % 3 == 1, "medium").otherwise("low")
    return t(spark, sf_dir, "part").orderBy(reports.enum_rank(level, ("high", "medium", "low")), "p_partkey").limit(3).select("p_partkey")


# Filters


@query("""
SELECT p_partkey, id = '!!' OR p_size % 5 = 0 AS failed, id <> '!!' AND p_size % 5 <> 0 AND coalesce(conf, 100) < 50 AS unsure
FROM (SELECT *, CASE WHEN p_size % 7 = 0 THEN '!!' ELSE 'lot1' END AS id, CASE WHEN p_size % 3 = 0 THEN p_size * 2 END AS conf FROM part)""")
def detection_split(spark, sf_dir):
    size = c("p_size")
    rows = t(spark, sf_dir, "part").select(
        "p_partkey", F.when(size % 7 == 0, "!!").otherwise("lot1").alias("id"), F.when(size % 3 == 0, size * 2).alias("confidence"), F.when(size % 5 == 0, F.array(F.lit("excel"), F.lit("error"))).otherwise(F.array(F.lit("excel"))).alias("sources")
    )
    failed = classify.failed_detection(c("id"), c("sources"))
    return rows.select("p_partkey", failed.alias("failed"), (~failed & classify.unsure(c("confidence"))).alias("unsure"))


@query(f"SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND date_diff('day', DATE '{ORDERS_ASOF}', o_orderdate::DATE + 60) <= 30")
def expiring_vault(spark, sf_dir):
    day = F.when(c("o_orderkey") % 3 != 0, F.date_add(c("o_orderdate").cast("date"), 60))
    rows = t(spark, sf_dir, "orders").select("o_orderkey", day.alias("expiry_date")).withColumn("status", classify.expiry_status(c("expiry_date"), F.lit(ORDERS_ASOF).cast("date")))
    return rows.where(c("status").isin("expired", "expiring_soon") & c("expiry_date").isNotNull()).select("o_orderkey")


@query("""
SELECT p_partkey, kept FROM (SELECT p_partkey, tags IS NULL OR list_contains(tags, 'all') OR list_contains(tags, '5') AS kept
FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN ['all'] WHEN 1 THEN ['info'] WHEN 2 THEN ['5'] WHEN 3 THEN ['5', '13'] WHEN 4 THEN NULL ELSE [] END AS tags FROM part))""")
def tag_partition(spark, sf_dir):
    from tendermill.plans.tender_queries import _tagged

    kept, other = classify.by_lot(_tagged(spark, sf_dir), "tags", "Lot 05")
    return kept.select("p_partkey", F.lit(True).alias("kept")).unionByName(other.select("p_partkey", F.lit(False).alias("kept")))


_UUID = "12345678-1234-1234-1234-123456789abc"
_PATHS = ["projects/7/a.pdf", "projects/8/a.pdf", "projects", "organizations/3/x", "organizations/4/x", f"{_UUID}/completed/y", "etc/passwd", "projects\\7\\b"]


@query(expected("access", [("ok",), ("not_found",), ("refused",), ("ok",), ("not_found",), ("ok",), ("refused",), ("ok",)]))
def path_access(spark, sf_dir):
    files = dealt(spark, sf_dir, _PATHS).select("p_partkey", c("x0").alias("path"), F.lit("3").alias("organization_id"))
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(o).alias("organization_id")) for i, o in (("7", "3"), ("8", "4"), (_UUID, "3"))])
    projects = t(spark, sf_dir, "region").where("r_regionkey = 0").select(F.inline(known))
    return reports.allowed_path(files, projects).select("p_partkey", "access")


_ROUTES = {"/": "Accueil", "/projects": "Projets", "/projects/new": "Nouveau", "/vault": "Coffre"}


@query(expected("label", [("Accueil",), ("Projets",), ("Nouveau",), ("Coffre",), (None,)]))
def route_prefix(spark, sf_dir):
    return dealt(spark, sf_dir, ["/home", "/projects/7", "/projects/newest", "/vault?x", "none"]).select("p_partkey", reports.longest_prefix(c("x0"), _ROUTES).alias("label"))


# Look-ups


@query("""
SELECT p_partkey, f.family FROM part, (VALUES (1, 'green'), (2, 'steel'), (3, 'blue'), (9, '')) f(family, word) WHERE family = 9 OR contains(p_name, word)
UNION ALL SELECT p_partkey, 0 FROM part WHERE NOT (contains(p_name, 'green') OR contains(p_name, 'steel') OR contains(p_name, 'blue'))""")
def keyword_sections(spark, sf_dir):
    rows = relational.keyword_sections(t(spark, sf_dir, "part"), c("p_name"), ((1, ("green",)), (2, ("steel",)), (3, ("blue",)), (1, ("green",))), always=9, fallback=0)
    return rows.select("p_partkey", c("section").alias("family"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'pro' WHEN 1 THEN 'business' END AS plan FROM part")
def plan_lookup(spark, sf_dir):
    product = F.concat(F.lit("prod_"), (c("p_size") % 3).cast("string"))
    return t(spark, sf_dir, "part").select("p_partkey", relational.looked_up(product, {"prod_0": "pro", "prod_1": "business"}).alias("plan"))


@query("SELECT l_orderkey, l_linenumber, coalesce(o_orderstatus, 'autre') AS type FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P'")
def template_type(spark, sf_dir):
    templates = t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus")
    both = t(spark, sf_dir, "lineitem").join(templates, c("l_orderkey") == c("o_orderkey"), "left")
    return both.select("l_orderkey", "l_linenumber", F.coalesce("o_orderstatus", F.lit("autre")).alias("type"))


@query("""
SELECT p_partkey, len(kept) AS n, list_aggregate(list_transform(kept, lambda r: r.x), 'sum') AS xs FROM (SELECT p_partkey,
  CASE WHEN p_size % 2 = 0 THEN [{'x': 0.0, 'y': 0.0}, {'x': 5.0, 'y': 0.0}, {'x': 2.5, 'y': 0.5}] ELSE [{'x': 0.0, 'y': 0.0}, {'x': 1.0, 'y': 5.0}, {'x': 2.0, 'y': 0.0}] END AS kept FROM part)""")
def dedup_rects(spark, sf_dir):
    rect = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    even = F.array(rect(0.0, 0.0), rect(1.9, 1.9), rect(5.0, 0.0), rect(4.0, 1.0), rect(2.5, 0.5))
    odd = F.array(rect(0.0, 0.0), rect(1.0, 5.0), rect(2.0, 0.0), rect(0.5, 6.9))
    kept = reports.distinct_rects(F.when(c("p_size") % 2 == 0, even).otherwise(odd))
    out = t(spark, sf_dir, "part").select("p_partkey", kept.alias("k"))
    return out.select("p_partkey", F.size("k").cast("long").alias("n"), F.aggregate("k", F.lit(0.0), lambda s, r: s + r["x"]).alias("xs"))


# Mutations


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2000-01-01 00:00:00' WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2001-06-30 00:00:00' END AS deleted_at FROM orders""")
def soft_delete_restore(spark, sf_dir):
    k = c("o_orderkey")
    rows = t(spark, sf_dir, "orders").select(k, F.when(k % 3 == 0, F.lit("2000-01-01").cast("timestamp_ntz")).alias("deleted_at"))
    return reports.restored(rows, k % 2 == 0, k % 5 == 0, "2001-06-30 00:00:00")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def value_rename(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", reports.renamed_values(c("o_orderstatus"), {"F": "won", "O": "open"}).alias("status"))


@query(f"""
SELECT o_orderkey, new AS status FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'valid' ELSE 'expired' END AS old,
  CASE WHEN d < 0 THEN 'expired' WHEN d <= 30 THEN 'expiring_soon' ELSE 'valid' END AS new FROM (SELECT *, date_diff('day', DATE '{ORDERS_ASOF}', o_orderdate::DATE + 60) AS d FROM orders)) WHERE old <> new""")
def status_refresh(spark, sf_dir):
    day = F.date_add(c("o_orderdate").cast("date"), 60)
    rows = t(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), F.when(c("o_orderstatus") == "F", "valid").otherwise("expired").alias("status"))
    return reports.changed_status(rows, classify.expiry_status(c("day"), F.lit(ORDERS_ASOF).cast("date"))).select("o_orderkey", "status")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE 'acheteur' END AS buyer, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'analyzed' ELSE c_mktsegment END AS status FROM customer")
def fill_if_empty(spark, sf_dir):
    k, segment = c("c_custkey") % 3, c("c_mktsegment")
    buyer = reports.filled_if_empty(F.when(k == 0, c("c_name")).when(k == 1, ""), F.lit("acheteur"))
    return t(spark, sf_dir, "customer").select("c_custkey", buyer.alias("buyer"), F.when(segment.isin("BUILDING", "MACHINERY"), "analyzed").otherwise(segment).alias("status"))


@query("SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%brass%' THEN 'dc1_template' ELSE 'autre' END AS new, CASE p_size % 2 WHEN 0 THEN 'autre' ELSE 'dc1_template' END AS old FROM part WHERE (lower(p_type) LIKE '%brass%') <> (p_size % 2 = 1)")
def reclassify(spark, sf_dir):
    name = F.when(F.lower("p_type").contains("brass"), "DC1.pdf").otherwise("photo.png")
    rows = t(spark, sf_dir, "part").select("p_partkey", name.alias("file_name"), F.when(c("p_size") % 2 == 0, "autre").otherwise("dc1_template").alias("old"))
    new = classify.doc_type(c("file_name"), F.lit("autre"))
    return rows.withColumn("new", new).where(c("new") != c("old")).select("p_partkey", "new", "old")
