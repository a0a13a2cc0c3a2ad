"""Queries of requirements and checklists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermill.functions import classify
from tendermill.operators import checklist
from tendermill.plans.base import c, dealt, expected, query, t

_KINDS, _TEMPLATES = ["vault", "dce_template", "odd", None], ["dc1_template", "unknown", None]
_CATEGORIES, _PRIORITIES = ["candidature", "offre", "odd", "technique", None], ["obligatoire", "souhaitée", "odd", None]


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _pick_sql(values, key):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][({key} % {len(values)})::INTEGER + 1]"


def _raw(spark, sf_dir):
    k = c("p_partkey")
    return t(spark, sf_dir, "part").select(
        k, F.when(k % 7 != 0, F.concat(F.lit("pièce "), k.cast("string"))).alias("exigence"), _pick(_CATEGORIES, k).alias("category"), _pick(_PRIORITIES, k).alias("priority"),
        _pick(_KINDS, k).alias("source_kind"), _pick(_TEMPLATES, k).alias("expected_template_type"), F.when(k % 3 != 1, (k % 3).cast("int")).alias("source_page"),
    )


_RAW_SQL = f"""(SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN 'pièce ' || p_partkey END AS exigence, {_pick_sql(_CATEGORIES, 'p_partkey')} AS category,
  {_pick_sql(_PRIORITIES, 'p_partkey')} AS priority, {_pick_sql(_KINDS, 'p_partkey')} AS source_kind, {_pick_sql(_TEMPLATES, 'p_partkey')} AS template,
  CASE WHEN p_partkey % 3 <> 1 THEN (p_partkey % 3)::INTEGER END AS page FROM part)"""


@query(f"""
SELECT p_partkey, exigence, category, coalesce(priority, 'obligatoire') AS priority, CASE WHEN source_kind = 'dce_template' THEN source_kind ELSE 'vault' END AS source_kind,
  CASE WHEN source_kind = 'dce_template' AND template = 'dc1_template' THEN template END AS expected_template_type
FROM {_RAW_SQL} WHERE exigence IS NOT NULL AND category IN ('candidature', 'offre', 'technique') AND coalesce(priority, 'obligatoire') <> 'odd'""")
def requirement_validation(spark, sf_dir):
    return checklist.validated(_raw(spark, sf_dir))[0].drop("source_page")


@query(f"SELECT p_partkey FROM {_RAW_SQL} WHERE exigence IS NULL OR category IS NULL OR category = 'odd' OR priority = 'odd'")
def requirement_rejects(spark, sf_dir):
    return checklist.validated(_raw(spark, sf_dir))[1].select("p_partkey")


@query(f"""
SELECT p_partkey, CASE WHEN category IN ('candidature', 'offre', 'technique') THEN category ELSE 'offre' END AS category,
  CASE WHEN priority IN ('obligatoire', 'souhaitée') THEN priority ELSE 'obligatoire' END AS priority, CASE WHEN coalesce(page, 0) = 0 THEN 1 ELSE page END AS source_page FROM {_RAW_SQL}""")
def enum_sanitise(spark, sf_dir):
    return checklist.sanitised(_raw(spark, sf_dir)).select("p_partkey", "category", "priority", "source_page")


_ASKED = ["Fournir un Kbis de moins de 3 mois", "Attestation de vigilance URSSAF", "Quelque chose de complètement aléatoire", "Relevé: RIB"]
_ASKED_TYPES = ["kbis", "urssaf", None, "rib"]


def _tables(spark, sf_dir):
    """Requirements from parts (20 a project), documents from orders (keys by 300), company documents from customers (150 a company)."""
    k = c("p_partkey")
    asked = t(spark, sf_dir, "part").select(
        k, F.floor(k / 20).alias("project_id"), F.floor(k / 200).alias("organization_id"), _pick(_ASKED, k).alias("exigence"), _pick(["candidature", "offre", "technique"], k).alias("category"),
        F.when(k % 2 == 1, "dce_template").otherwise("vault").alias("source_kind"), F.when(k % 5 != 0, _pick(["dc1_template", "dc2_template"], F.floor(k / 100))).alias("expected_template_type"),
    )
    o = c("o_orderkey")
    documents = t(spark, sf_dir, "orders").select(
        o.alias("id"), F.floor(o / 300).alias("project_id"), F.when(o % 2 == 0, "dc1_template").otherwise("dc2_template").alias("type"), F.concat(F.lit("f"), o.cast("string")).alias("file_name"),
        (c("o_orderstatus") == "F").alias("is_user_completed"),
    )
    v = c("c_custkey")
    vault = t(spark, sf_dir, "customer").select(
        v.alias("id"), F.floor(v / 150).alias("organization_id"), F.when(v % 3 == 0, "Kbis").when(v % 3 == 1, "urssaf").alias("type"), _pick(["valid", "expired", "expiring_soon"], v).alias("status"),
        F.when(v % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (v % 9).cast("int"))).alias("expiry_date"), F.when(v % 11 == 0, F.lit("2020-01-01").cast("timestamp_ntz")).alias("deleted_at"),
    )
    return asked, documents, vault


_BUILD_SQL = f"""
WITH a AS (SELECT p_partkey, p_partkey // 20 AS project_id, p_partkey // 200 AS org, {_pick_sql(_ASKED, 'p_partkey')} AS exigence, p_partkey % 2 = 1 AS tpl,
    CASE WHEN p_partkey % 5 <> 0 THEN {_pick_sql(['dc1_template', 'dc2_template'], '(p_partkey // 100)')} END AS want, {_pick_sql(_ASKED_TYPES, 'p_partkey')} AS vtype
  FROM part WHERE p_partkey % 3 <> 2),
d AS (SELECT o_orderkey // 300 AS project_id, CASE WHEN o_orderkey % 2 = 0 THEN 'dc1_template' ELSE 'dc2_template' END AS type,
    min(o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS blank, min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY ALL),
v AS (SELECT * FROM (SELECT c_custkey AS id, c_custkey // 150 AS org, coalesce(['kbis', 'urssaf', 'autre'][(c_custkey % 3)::INTEGER + 1], 'autre') AS type,
    ['valid', 'expired', 'expiring_soon'][(c_custkey % 3)::INTEGER + 1] AS status, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 9 END AS expiry
  FROM customer WHERE c_custkey % 11 <> 0)
  QUALIFY row_number() OVER (PARTITION BY org, type ORDER BY status = 'expired', expiry DESC NULLS FIRST, id) = 1)
SELECT p_partkey // 20 AS project_id, exigence, CASE WHEN tpl THEN coalesce(want, 'autre') ELSE coalesce(vtype, 'autre') END AS document_type_required,
  CASE WHEN tpl THEN 'dce_template' ELSE 'vault' END AS source_kind, v.id AS linked_document_id, blank AS template_project_doc_id, CASE WHEN blank IS NOT NULL THEN done END AS completed_project_doc_id,
  CASE WHEN blank IS NOT NULL AND done IS NOT NULL THEN 'present' WHEN v.id IS NULL THEN 'manquant' WHEN status = 'expired' THEN 'expire' WHEN status = 'expiring_soon' THEN 'expiration_proche' ELSE 'present' END AS status,
  CASE WHEN NOT tpl THEN exigence WHEN want IS NULL THEN exigence || ' — type de template DCE non précisé par l''IA.'
    WHEN blank IS NOT NULL AND done IS NOT NULL THEN 'Template ' || want || ' complété (f' || done || ').'
    WHEN blank IS NOT NULL THEN 'Template ' || want || ' fourni dans le DCE (f' || blank || ') — à compléter par l''utilisateur.'
    ELSE 'Template ' || want || ' non trouvé dans le DCE — vérifier l''upload ou demander la pièce au maître d''ouvrage.' END AS details
FROM a LEFT JOIN d ON tpl AND a.want = d.type AND a.project_id = d.project_id LEFT JOIN v ON NOT tpl AND v.type = a.vtype AND v.org = a.org"""


@query(_BUILD_SQL)
def checklist_build(spark, sf_dir):
    return checklist.build(*_tables(spark, sf_dir))


@query("""
SELECT c_custkey // 150 AS organization_id, coalesce(['kbis', 'urssaf', 'autre'][(c_custkey % 3)::INTEGER + 1], 'autre') AS type, list(c_custkey ORDER BY c_custkey) AS ids
FROM customer GROUP BY ALL""")
def vault_index(spark, sf_dir):
    return checklist.vault_index(_tables(spark, sf_dir)[2])


def _items(spark, sf_dir):
    n = c("l_linenumber")
    return t(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("project_id"), n.alias("n"), _pick(["vault", "dce_template"], n).alias("source_kind"), _pick(list(checklist.STATUSES), n).alias("status"), F.lit("old").alias("details"),
        c("l_partkey").alias("linked_document_id"), c("l_suppkey").alias("completed_project_doc_id"), (c("l_orderkey") % 10).alias("organization_id"),
    )


_STATUS_SQL = _pick_sql(list(checklist.STATUSES), "l_linenumber")


@query(f"""
SELECT project_id, count_if(l_linenumber % 2 = 0)::BIGINT AS vault, count_if(l_linenumber % 2 = 1)::BIGINT AS templates, count_if(status = 'present')::BIGINT AS present,
  count_if(status = 'manquant')::BIGINT AS missing, floor(100 * count_if(status = 'present') / count(*) + 0.5)::INTEGER AS percent
FROM (SELECT l_orderkey AS project_id, l_linenumber, {_STATUS_SQL} AS status FROM lineitem) GROUP BY project_id""")
def checklist_progress(spark, sf_dir):
    return checklist.progress(_items(spark, sf_dir))


@query(f"""
SELECT l_orderkey AS project_id, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 AND s = 'present' THEN 'manquant' ELSE s END AS status, CASE WHEN l_linenumber % 2 = 0 THEN repeat('é', 500) ELSE 'old' END AS details,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey END AS linked_document_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_suppkey END AS completed_project_doc_id
FROM (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'non_applicable' WHEN 1 THEN 'present' ELSE {_STATUS_SQL} END AS s FROM lineitem)""")
def checklist_patch(spark, sf_dir):
    n = c("n")
    asked = _items(spark, sf_dir).withColumns({
        "new_status": F.when(n % 4 == 0, "non_applicable").when(n % 4 == 1, "present").when(n % 4 == 2, "no such status"),
        "new_details": F.when(n % 2 == 0, F.repeat(F.lit("é"), 700)), "unlink": F.when(n % 3 != 1, n % 3 == 0),
    })
    return checklist.patched_item(asked).drop("source_kind", "organization_id")


@query(f"""
SELECT l_orderkey AS project_id, l_linenumber AS n, coalesce(id, l_partkey) AS linked_document_id,
  CASE WHEN id IS NULL THEN {_STATUS_SQL} WHEN status = 'expired' THEN 'expire' WHEN status = 'expiring_soon' THEN 'expiration_proche' ELSE 'present' END AS status
FROM lineitem LEFT JOIN (SELECT c_custkey AS id, c_custkey // 150 AS org, ['valid', 'expired', 'expiring_soon'][(c_custkey % 3)::INTEGER + 1] AS status FROM customer)
ON l_linenumber % 2 = 0 AND id = l_partkey AND org = l_orderkey % 10""")
def checklist_link(spark, sf_dir):
    asked = _items(spark, sf_dir).withColumn("link_to", c("linked_document_id"))
    return checklist.linked_item(asked, _tables(spark, sf_dir)[2]).select("project_id", "n", "linked_document_id", "status")


_LABELS = ["RC p. 4", "Cahier CCAP", "ccap", "AE", "unknown", None, "cadre de réponse p.2", "notes"]
_NAMED = [(0, "a_rc.pdf", "rc"), (1, "DCE CCAP v2.pdf", "ccap"), (2, "Cadre.docx", "cadre_reponse"), (3, "ATTRI1.pdf", "acte"), (4, "notes de calcul.pdf", "autre")]


@query(expected("document_id", [(0,), (0,), (1,), (3,), (0,), (0,), (2,), (4,)]))
def source_document(spark, sf_dir):
    asked = dealt(spark, sf_dir, _LABELS).select(c("p_partkey").alias("requirement_id"), (c("p_partkey") % 50).alias("project_id"), c("x0").alias("source_document"))
    row = lambda d: F.struct(F.lit(d[0]).alias("id"), F.lit(d[1]).alias("file_name"), F.lit(d[2]).alias("type"))
    documents = t(spark, sf_dir, "supplier").select((c("s_suppkey") % 50).alias("project_id")).distinct().select("project_id", F.inline(F.array(*map(row, _NAMED))))
    return checklist.source_document(asked, documents).select(c("requirement_id").alias("p_partkey"), "document_id")


_DETAILS = ["decennale|", "autre|Bilan des CA", "qualibat|", "kbis|extrait", "autre|Attestation TRC", "autre|liste de chantiers"]


@query(expected("category", [("assurances",), ("financier",), ("technique",), ("administratif",), ("assurances",), ("technique",)]))
def checklist_category(spark, sf_dir):
    part = lambda i: F.get(F.split("x0", r"\|"), F.lit(i))
    return dealt(spark, sf_dir, _DETAILS).select("p_partkey", classify.checklist_category(part(0), part(1)).alias("category"))


@query(f"""
WITH v AS (SELECT c_custkey AS id, coalesce(['kbis', 'urssaf', 'autre'][(c_custkey % 3)::INTEGER + 1], 'autre') AS type FROM customer)
SELECT s_suppkey, sum((type = want OR want IN ('autre', ''))::INTEGER)::BIGINT AS candidates, sum((type <> want)::INTEGER)::BIGINT AS others
FROM (SELECT s_suppkey, ['kbis', 'autre', ''][(s_suppkey % 3)::INTEGER + 1] AS want FROM supplier), v WHERE contains(v.id::VARCHAR, '1') GROUP BY s_suppkey""")
def vault_picker(spark, sf_dir):
    vault = t(spark, sf_dir, "customer").select(F.when(c("c_custkey") % 3 == 0, "kbis").when(c("c_custkey") % 3 == 1, "urssaf").otherwise("autre").alias("type"), c("c_custkey").cast("string").alias("file_name"))
    asked = t(spark, sf_dir, "supplier").select("s_suppkey", _pick(["kbis", "autre", ""], c("s_suppkey")).alias("want"))
    return checklist.picker(vault, asked, "want", "1").groupBy("s_suppkey").agg(F.sum("candidates").alias("candidates"), F.sum("others").alias("others"))
