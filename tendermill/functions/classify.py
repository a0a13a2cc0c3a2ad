"""Ordered rule cascades: the first pattern that matches names the class.

A cascade is data; :func:`cascade` turns it into one CASE expression that stays
inside generated code, and the same data gives the SQL of the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermill.functions.text import normalise


# Document types, in the order in which their patterns are tried on
# the normalised file name.
DOC_TYPES = (
    "rc", "ccap", "cctp", "dpgf_template", "bpu_template", "dqe_template", "acte_engagement_template", "dc1_template", "dc2_template",
    "cadre_reponse", "attestation_visite_template", "pgc_sps", "diagnostic", "notice", "dt", "planning", "plan", "autre",
)
PLAN_MARK = r"(?<![a-z0-9])arch\s*\d|coupe|niveau|zoom|etage|r\+\d|(?<![a-z0-9])el\d|(?<![a-z0-9])plan\b|\.dwg$|\.dwf$|\.dxf$"
ANNEX_MARK = r"annexe|nommage|liste|modele"
RULES_MARK = (
    r"reglement|r[eè]gl[\._\s]?consul|(?<![a-z0-9])rc(?![a-z0-9])|(?<![a-z0-9])rce(?![a-z0-9])|"
    r"reglement.{0,4}consultation|r[eè]glement.{0,4}la.{0,4}consultation"
)
GROUND_FLOOR = r"(?<![a-z0-9])rdc(?![a-z0-9])"
# A rule holds under its guard only: of spreadsheets of one kind, or of names that speak of no annex.
BEFORE_RULES = (
    (r"(?<![a-z0-9])dc[\s_\-]?1(?![a-z0-9])|lettre.{0,8}candidature", "dc1_template", None),
    (r"(?<![a-z0-9])dc[\s_\-]?2(?![a-z0-9])|declaration.{0,8}candidat", "dc2_template", None),
    (
        r"acte.{0,6}engagement|^ae(?![a-z0-9])|(?<![a-z0-9])ae(?=\.[a-z]{2,5}$)|"
        r"(?<![a-z0-9])ae[\s_.\-](?:signe|rempli|vierge|template|complete|final)|(?<![a-z0-9])attri\d+",
        "acte_engagement_template", None,
    ),
    (r"dpgf|prix|bordereau|decomposition", "dpgf_template", "ods"),
    (r"(?<![a-z0-9])dpgf(?![a-z0-9])|d[eé]composition.{0,12}prix|prix.{0,6}global|prix.{0,6}forfaitaire", "dpgf_template", None),
    (r"(?<![a-z0-9])bpu(?![a-z0-9])|bordereau.{0,6}prix|prix.{0,6}unitaire", "bpu_template", None),
    (r"(?<![a-z0-9])dqe(?![a-z0-9])|d[eé]tail.{0,6}quantitatif|quantitatif.{0,6}estimatif", "dqe_template", None),
    (r"cadre.{0,8}r[eé]ponse|cadre.{0,8}memoire", "cadre_reponse", None),
    (r"attestation.{0,8}visite|visite.{0,8}obligatoire|visite.{0,8}site", "attestation_visite_template", None),
    (r"(?<![a-z0-9])pgc[\s_.\-]?sps(?![a-z0-9])|plan.{0,8}general.{0,8}coordination|coordination.{0,8}sps", "pgc_sps", None),
    (
        r"diagnos|(?<![a-z0-9])diag(?![a-z0-9])|(?<![a-z0-9])dat(?![a-z0-9])|(?<![a-z0-9])crep(?![a-z0-9])|(?<![a-z0-9])raat(?![a-z0-9])|"
        r"apave|socotec|qualiconsult|veritas|bureau.{0,4}controle|controle.{0,4}technique|"
        r"(?<![a-z0-9])g2[\s_.\-]?(?:pro|avp|aps|g[12])?(?![a-z0-9])|etude.{0,4}structure|etude.{0,4}geotechnique|"
        r"(?<![a-z0-9])amiante(?![a-z0-9])|(?<![a-z0-9])plomb(?![a-z0-9])",
        "diagnostic", None,
    ),
    (r"(?<![a-z0-9])notice(?![a-z0-9])", "notice", None),
    (r"^dt[\s_.\-][a-z]{3,}", "dt", None),
    (r"(?<![a-z0-9])planning(?![a-z0-9])", "planning", None),
)
AFTER_RULES = (
    (r"(?<![a-z0-9])ccap(?![a-z0-9])|clauses.{0,6}admin|cahier.{0,6}admin", "ccap", None),
    (r"(?<![a-z0-9])cctp(?![a-z0-9])|clauses.{0,6}tech|cahier.{0,6}technique|descriptif.{0,6}tech", "cctp", None),
    (r"carnet.{0,4}(?:de.{0,4})?(?:detail|menuiserie|plan)", "cctp", None),
    (r"lot[\s_-]*\d{1,2}.*_dce\.pdf$", "cctp", "no annex"),
    (r"^dce-[a-z]{2,4}\d{0,3}\.(pdf|docx)$", "cctp", None),
    (PLAN_MARK, "plan", None),
    (r"(?<![a-z0-9])plans?(?![a-z0-9])|coupe|facade|niveau|rez.{0,4}de.{0,4}chaussee", "plan", None),
)

# Keywords of company documents, tried in this order as substrings.
VAULT_KEYWORDS = (
    (("kbis", "extrait kbis", "registre du commerce"), "kbis"),
    (("urssaf", "attestation de vigilance"), "urssaf"),
    (("fiscale", "fiscal", "dgfip", "impôts", "regularité fiscale", "régularité fiscale"), "fiscal"),
    (("décennale", "assurance décennale"), "decennale"),
    (("responsabilité civile", "rc pro", "rc professionnelle", "assurance rc"), "rc_civile"),
    (("trc", "tous risques chantier"), "trc"),
    (("dommages-ouvrage", "dommages ouvrage"), "dommages_ouvrage"),
    (("pro btp", "pro-btp"), "pro_btp"),
    (("cibtp", "ci-btp", "congés payés btp"), "cibtp"),
    (("qualibat",), "qualibat"),
    (("rge", "reconnu garant de l'environnement"), "rge"),
    (("caces",), "caces"),
    (("amiante ss4", "ss4 amiante", "amiante sous-section 4"), "amiante_ss4"),
    (("chiffre d'affaires", "ca des", "bilan", "capacité financière"), "chiffre_affaires"),
    (("effectifs", "déclaration d'effectif", "déclaration des effectifs"), "effectifs"),
    (("organigramme",), "organigramme_doc"),
    (("références chantiers", "références travaux", "liste des travaux", "attestations de bonne exécution", "attestation de bonne exécution"), "attestation_travaux"),
    (("dume",), "dume"),
    (("pouvoir", "habilitation à signer", "habilité à signer"), "pouvoir"),
    (("rib", "relevé d'identité bancaire"), "rib"),
    (("déclaration sur l'honneur",), "declaration_honneur"),
)

# File names of informative documents and of drawings, and types that concern every lot.
INFO_NAME = (
    r"(?i)diagno|amiante|plomb|crep\b|crep_|\bdat\b|dat_|carrez|energetique|geotechni|pgc\b|pgc_|ppsps|rict\b|rict_|icpe\b|"
    r"acousti|vibra|rapport.{0,8}sol|sondage|notice.{0,8}secu"
)
DRAWING_NAME = (
    r"(?i)\.dwg$|\.dwf$|\.dxf$|(?<![a-z0-9])plans?(?![a-z])|coupe(?![a-z])|facade|niveau(?![a-z])|rez.{0,4}de.{0,4}chaussee|"
    r"elevation(?![a-z])|implantation(?![a-z])"
)
ALL_LOTS_TYPES = ("rc", "ccap", "acte_engagement")
LOT_IN_NAME = r"(?i)lot[\s_\-]*[n°]*[\s_\-]*(\d{1,2}[a-z]?)"


def cascade(text: Column, rules, start: Column | None = None, guards: dict[str, Column] | None = None) -> Column:
    out = F if start is None else start
    for pattern, name, *guard in rules:
        test = text.rlike(pattern)
        out = out.when(test & guards[guard[0]] if guard and guard[0] else test, name)
    return out


def doc_type(file_name: Column, form_type: Column) -> Column:
    """Type of a tender document by its name, unless a valid type was given."""
    name = normalise(file_name)
    guards = {"ods": F.lower(file_name).endswith(".ods"), "no annex": ~name.rlike(ANNEX_MARK)}
    out = F.when(form_type.isin(*[t for t in DOC_TYPES if t != "autre"]), form_type)
    out = cascade(name, BEFORE_RULES, out, guards)
    rules = name.rlike(RULES_MARK) | (~name.rlike(PLAN_MARK) & name.rlike(GROUND_FLOOR))
    out = out.when(rules & guards["no annex"], "rc")
    return cascade(name, AFTER_RULES, out, guards).otherwise("autre")


def vault_type(text: Column) -> Column:
    """Type of the company document that a requirement asks for; NULL if none."""
    low, out = F.lower(text), F
    for words, name in VAULT_KEYWORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, name)
    return out.otherwise(F.lit(None).cast("string"))


def lot_in_name(file_name: Column) -> Column:
    """Lot number of a file name without leading zeros; NULL if there is none."""
    raw = F.regexp_extract(file_name, LOT_IN_NAME, 1)
    return F.when(raw == "", None).when(raw.rlike(r"^\d+$"), raw.cast("int").cast("string")).otherwise(raw)


def lot_tags(file_name: Column, kind: Column) -> Column:
    """Array of the lots that a document concerns: ``all``, ``info`` or one number."""
    lot = lot_in_name(file_name)
    return (
        F.when(kind.isin(*ALL_LOTS_TYPES), F.array(F.lit("all")))
        .when((kind == "plan") | file_name.rlike(DRAWING_NAME) | file_name.rlike(INFO_NAME), F.array(F.lit("info")))
        .when(lot.isNotNull(), F.array(lot))
        .otherwise(F.array(F.lit("all")))
    )


def normal_lot(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^lot[\s_\-]*", "")
    return F.coalesce(F.nullif(F.regexp_replace(bare, "^0+", ""), F.lit("")), bare)


def sheet_of_lot(sheet: Column, lot: str) -> Column:
    """Whether a sheet's name holds the lot's number; a letter after it keeps its case, while the lot's is small."""
    raw = F.regexp_extract(sheet, r"(?i)lot[\s_\-]*[nN°]*[\s_\-]*(\d{1,2}[A-Za-z]?)", 1)
    number = F.when(raw.rlike(r"^\d+$"), raw.cast("int").cast("string")).otherwise(raw)
    return (raw != "") & (number == normal_lot(F.lit(lot)))


def canonical_lot(raw: Column) -> Column:
    """``lotN`` of a number with an optional letter; a capital counts from A = 1; else NULL."""
    text = F.trim(raw)
    number = F.coalesce(F.nullif(F.regexp_replace(text, "^0+", ""), F.lit("")), F.lit("0"))
    return (
        F.when(text.rlike(r"^\d{1,2}[A-Za-z]?$"), F.concat(F.lit("lot"), number))
        .when(text.rlike("^[A-Z]$"), F.concat(F.lit("lot"), (F.ascii(text) - 64).cast("string")))
    )


def concerns_lot(tags: Column, lot: str | None) -> Column:
    """Whether a document's tags keep it for the chosen lot (none or ``all``: every lot)."""
    info = F.forall(tags, lambda t: t == "info")
    if lot is None or lot.lower() in ("", "all"):
        return tags.isNull() | (F.size(tags) == 0) | ~info
    target = normal_lot(F.lit(lot))
    hit = F.exists(tags, lambda t: (t != "info") & (normal_lot(t) == target))
    return tags.isNull() | F.array_contains(tags, "all") | hit


def expiry_status(day: Column, asof: Column, horizon: int = 30) -> Column:
    left = F.datediff(day, asof)
    return F.when(day.isNull(), "valid").when(left < 0, "expired").when(left <= horizon, "expiring_soon").otherwise("valid")


def link_status(status: Column) -> Column:
    return F.when(status == "expired", "expire").when(status == "expiring_soon", "expiration_proche").otherwise("present")


# Groups of company documents as the checklist shows them, tried in this order.
CHECKLIST_GROUPS = (
    (r"assurance|décennale|decennale|rc[_ ]?(civile|professionnelle)|trc|dommages", "assurances"),
    (r"chiffre|ca\b|bilan|financ|effectif", "financier"),
    (r"qualibat|certificat|référence|reference|qualification|caces|amiante|chantier", "technique"),
)


def checklist_category(kind: Column, details: Column) -> Column:
    return cascade(F.lower(F.concat(kind, F.lit(" "), F.coalesce(details, F.lit("")))), CHECKLIST_GROUPS, F.when(F.lit(False), "")).otherwise("administratif")


def size_band(size: Column) -> Column:
    """Band of an upload's size in bytes."""
    out = F
    for limit, name in ((1024, "over_1gb"), (500, "over_500mb"), (100, "over_100mb")):
        out = out.when(size > limit << 20, name)
    return out.otherwise("small")


def failed_detection(id_: Column, sources: Column) -> Column:
    """A workbook that could not be read stands as a lot named ``!!`` or with the source ``error``."""
    return (id_ == "!!") | F.array_contains(sources, "error")


def unsure(confidence: Column) -> Column:
    return F.coalesce(confidence, F.lit(100)) < 50


def by_lot(df: DataFrame, tags: str, lot: str | None) -> tuple[DataFrame, DataFrame]:
    """Documents that concern the lot, and all others."""
    kept = F.coalesce(concerns_lot(F.col(tags), lot), F.lit(False))
    return df.where(kept), df.where(~kept)


def alert_band(days: Column) -> Column:
    return F.when(days < 0, "expired").when(days <= 7, "urgent").when(days <= 30, "soon")
