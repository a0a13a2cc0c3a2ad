"""Summaries, export plans, completion rates, orders and small mutations of tender tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermill.functions.text import safe_name
from tendermill.operators.relational import numbered_names

# Folders and types of the export bundle, groups of company documents, status labels and size bands.
FOLDERS = ("01_Candidature", "02_Offre", "03_Technique")
OFFER_TYPES = ("dpgf_template", "acte_engagement_template")
VAULT_GROUPS = (
    ("Assurances", ("decennale", "rc_civile")), ("Social", ("urssaf", "pro_btp", "cibtp")), ("Fiscal", ("fiscal",)), ("Juridique", ("kbis", "declaration_honneur", "pouvoir")),
    ("Qualifications", ("qualibat", "caces", "amiante_ss4")), ("Formulaires", ("dc1", "dc2", "rib")), ("Entreprise", ("organigramme_doc", "chiffre_affaires", "effectifs")), ("Autres", ("autre",)),
)
STEP_LABELS = (
    ("uploading", "Upload des fichiers", 5), ("extracting_zip", "Extraction de l'archive", 15), ("extracting_text", "Extraction des documents", None),
    ("detecting_lots", "Détection des lots", 30), ("ready", "Prêt", 0), ("error", "Erreur", 0),
)
TERMINAL, TOTAL_STEPS = ("soumis", "gagné", "perdu"), 6


def half_up(x: Column) -> Column:
    """Rounding of the browser: halves go up."""
    return F.floor(x + 0.5)


def export_summary(compliance: DataFrame, checklist: DataFrame, memoires: DataFrame, documents: DataFrame) -> DataFrame:
    """Per project: requirements and covered ones, checklist items and present ones, and what exists; each table is reduced first."""
    of = lambda df, status, n, m: df.groupBy("project_id").agg(F.count("*").alias(n), F.count_if(F.col("status") == status).alias(m))
    flags = documents.groupBy("project_id").agg(
        F.bool_or(F.col("type") == "dpgf_template").alias("has_dpgf"), F.min_by("file_name", F.when(F.col("type") == "dpgf_template", F.col("id"))).alias("dpgf_name")
    )
    out = of(compliance, "couvert", "compliance_total", "compliance_covered").join(of(checklist, "present", "checklist_total", "checklist_present"), "project_id", "full")
    written = memoires.select("project_id", F.lit(True).alias("has_memoire")).distinct()
    out = out.join(written, "project_id", "full").join(flags, "project_id", "full")
    counts = ("compliance_total", "compliance_covered", "checklist_total", "checklist_present")
    flag = {c: F.coalesce(c, F.lit(False)) for c in ("has_memoire", "has_dpgf")}
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | flag)


def export_alerts(summary: DataFrame, sheet_valid: Column) -> Column:
    """How many of the four parts of an offer are not complete."""
    full = lambda done, all_: (F.col(all_) > 0) & (F.col(done) == F.col(all_))
    good = [full("compliance_covered", "compliance_total"), full("checklist_present", "checklist_total"), F.col("has_memoire"), F.col("has_dpgf") & F.coalesce(sheet_valid, F.lit(False))]
    return sum(((~g).cast("int") for g in good), F.lit(0))


def memoire_size(content: Column) -> tuple[Column, Column]:
    """Sections (the preamble and filled parts) and pages (500 words each) of a map of parts."""
    parts = F.flatten(F.transform(F.map_values(content), lambda p: F.map_values(p)))
    filled = F.filter(parts, lambda v: F.coalesce(v, F.lit("")) != "")
    words = F.size(F.filter(F.split(F.array_join(parts, " "), r"\s+"), lambda w: w != ""))
    return 1 + F.size(filled), F.greatest(F.lit(1), F.floor(words / 500)).cast("int")


def root_folder(name: Column, lot: Column, day: Column) -> Column:
    suffix = F.when(F.coalesce(lot, F.lit("")) != "", F.concat(F.lit("_"), safe_name(lot))).otherwise("")
    return F.concat(F.lit("Reponse_AO_"), safe_name(name), suffix, F.lit("_"), F.date_format(day, "yyyyMMdd"))


def export_manifest(projects: DataFrame, items: DataFrame, vault: DataFrame, documents: DataFrame) -> DataFrame:
    """``project_id, folder, unique_name, file_id`` of the bundle's files.

    Company documents that the checklist links come first, in its order, then
    completed documents, then the memoire and the filled price sheet.  Names are
    made safe and numbered within their folder.
    """
    v = vault.select(F.col("id").alias("linked_document_id"), F.col("file_name").alias("name"))
    linked = items.join(v, "linked_document_id").select("project_id", F.lit(FOLDERS[0]).alias("folder"), F.lit(0).alias("part"), F.col("item_id").alias("seq"), "name", F.col("linked_document_id").cast("string").alias("file_id"))
    offer = F.coalesce(F.col("type"), F.lit("autre")).isin(*OFFER_TYPES)
    own = documents.where("is_user_completed").select(
        "project_id", F.when(offer, FOLDERS[1]).otherwise(FOLDERS[0]).alias("folder"), F.lit(1).alias("part"), F.col("id").alias("seq"), F.col("file_name").alias("name"), F.col("id").cast("string").alias("file_id")
    )
    memoire = projects.where("has_memoire").select("project_id", F.lit(FOLDERS[1]).alias("folder"), F.lit(2).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit("Memoire_technique.docx").alias("name"), F.lit("memoire").alias("file_id"))
    sheet = projects.where("dpgf_name is not null").select(
        "project_id", F.lit(FOLDERS[1]).alias("folder"), F.lit(3).alias("part"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("DPGF_remplie_"), "dpgf_name").alias("name"), F.lit("dpgf").alias("file_id")
    )
    rows = linked.unionByName(own).unionByName(memoire).unionByName(sheet).withColumn("name", safe_name(F.col("name")))
    return numbered_names(rows, ["project_id", "folder"], "name", F.col("part"), F.col("seq")).select("project_id", "folder", "unique_name", "file_id")


def export_warnings(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """``project_id, warnings``: what the bundle lacks."""
    kind, done = F.col("type"), F.col("is_user_completed")
    act = kind == "acte_engagement_template"
    seen = documents.groupBy("project_id").agg(F.bool_or(kind == "dpgf_template").alias("sheet"), F.bool_or(act).alias("act"), F.bool_or(act & done).alias("signed"))
    both = projects.join(seen, "project_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    told = [
        F.when(~F.col("has_memoire"), "Mémoire technique non généré"), F.when(F.col("dpgf_name").isNull() & yes("sheet"), "DPGF non remplie"),
        F.when(yes("act") & ~yes("signed"), "Acte d'engagement non signé"),
    ]
    return both.select("project_id", F.filter(F.array(*told), lambda w: w.isNotNull()).alias("warnings"))


def free_names(files: DataFrame) -> DataFrame:
    """``project_id, seq, name`` with ``free_name``: the first of ``name``, ``name_2``, ``name_3`` that no earlier file of the project has.

    The taken names of a project are a state of its files in order; an upload bounds them.
    """
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for name in frame.sort_values("seq")["name"]:
            stem, dot, suffix = name.rpartition(".") if "." in name else (name, "", "")
            new, n = name, 2
            while new in taken:
                new, n = f"{stem}_{n}{dot}{suffix}", n + 1
            taken.add(new)
            out.append(new)
        return frame.sort_values("seq").assign(free_name=out)

    return files.select("project_id", "seq", "name").groupBy("project_id").applyInPandas(run, "project_id long, seq long, name string, free_name string")


def section_percent(sections: Column) -> Column:
    """Sections with more than ten characters, in per cent."""
    filled = F.size(F.filter(sections, lambda v: F.char_length(F.trim(v)) > 10))
    return F.when(F.size(sections) > 0, half_up(100 * filled / F.size(sections))).otherwise(0).cast("int")


def filled_fields(texts: list[Column], turnover: Column, posts: Column) -> Column:
    """Filled fields of a company's profile: texts that are not blank, a turnover with a year or an amount, a post with a name."""
    some = lambda arr, test: F.coalesce(F.exists(arr, test), F.lit(False)).cast("int")
    given = lambda x: F.coalesce(x.cast("string"), F.lit("")) != ""
    plain = sum(((F.trim(F.coalesce(x, F.lit(""))) != "").cast("int") for x in texts), F.lit(0))
    return plain + some(turnover, lambda e: given(e["annee"]) | given(e["montant"])) + some(posts, lambda e: given(e["nom"]))


def imported_fields(columns: list[Column], lists: list[Column]) -> Column:
    given = [F.coalesce(x.cast("string"), F.lit("")) != "" for x in columns] + [F.coalesce(F.size(x), F.lit(0)) > 0 for x in lists]
    return sum((g.cast("int") for g in given), F.lit(0))


def done_steps(status: Column, completed: Column, current: Column) -> Column:
    """Steps done: all of a terminal project, else those marked, or without marks those before the current one."""
    marked = F.size(F.filter(F.map_values(completed), lambda x: F.coalesce(x, F.lit(False))))
    return F.when(status.isin(*TERMINAL), TOTAL_STEPS).otherwise(F.least(F.when(completed.isNotNull(), marked).otherwise(current - 1), F.lit(TOTAL_STEPS)))


def step_done(projects: DataFrame, step: str) -> DataFrame:
    """Mark a step of each project as done; the current step moves on if it was not past it."""
    kept = F.map_filter(F.coalesce("completed_steps", F.create_map().cast("map<string,boolean>")), lambda k, _: k != F.col(step).cast("string"))
    now = F.map_concat(kept, F.create_map(F.col(step).cast("string"), F.lit(True)))
    return projects.withColumns({"completed_steps": now, "current_step": F.when(F.col("current_step") <= F.col(step), F.col(step) + 1).otherwise(F.col("current_step"))})


def legacy_status(status: Column, progress: Column) -> tuple[Column, Column]:
    """Label and per cent of the stored processing status; unknown ones show themselves."""
    status, label, percent = F.coalesce(status, F.lit("ready")), F, F
    for name, text, at in STEP_LABELS:
        label = label.when(status == name, text)
        percent = percent.when(status == name, at if at is not None else 10 + F.floor(F.coalesce(progress, F.lit(0)) * 0.15))
    return label.otherwise(status), percent.otherwise(0).cast("int")


def merged_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Requirements of two passes by project: their number, whether either pass is partial, and whether there are few (1 to 14)."""
    rows = first.unionByName(second)
    out = rows.groupBy("project_id").agg(F.count("exigence").alias("n"), F.bool_or("partial").alias("partial"))
    return out.withColumn("few", F.col("n").between(1, 14))


def vault_groups(vault: DataFrame) -> DataFrame:
    """``organization_id, label, ids`` of the groups in their order; types of no group are left out, empty groups too."""
    number = F
    for i, (_, types) in enumerate(VAULT_GROUPS):
        number = number.when(F.col("type").isin(*types), i)
    grouped = vault.withColumn("place", number.otherwise(F.lit(None).cast("int"))).where("place is not null")
    label = F.element_at(F.array(*[F.lit(g[0]) for g in VAULT_GROUPS]), F.col("place") + 1)
    return grouped.groupBy("organization_id", "place").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("organization_id", "place", label.alias("label"), "ids")


def enum_rank(value: Column, names) -> Column:
    """Place of a value in an enumeration's order; unknown ones come last."""
    out = F
    for i, name in enumerate(names):
        out = out.when(value == name, i)
    return out.otherwise(len(names))


def french_key(name: Column) -> Column:
    """French names in the order of a French dictionary: letters first, then accents, then small before capital letters."""
    return F.collate(name, "fr")


def placed(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Add ``place`` within each key; every order says where NULLs go."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def filled_if_empty(value: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), other)


def restored(df: DataFrame, delete: Column, restore: Column, at: str) -> DataFrame:
    """Soft deletion and its reversal; a row that is deleted already keeps its time."""
    gone = F.coalesce("deleted_at", F.lit(at).cast("timestamp_ntz"))
    return df.withColumn("deleted_at", F.when(restore, F.lit(None).cast("timestamp_ntz")).when(delete, gone).otherwise(F.col("deleted_at")))


def renamed_values(value: Column, names: dict[str, str]) -> Column:
    out = F.coalesce(*[F.when(value == old, new) for old, new in names.items()])
    return F.coalesce(out, value)


def changed_status(df: DataFrame, fresh: Column) -> DataFrame:
    """Rows whose status is out of date, with the new one; the others are not written again."""
    return df.withColumn("_new", fresh).where(~F.col("_new").eqNullSafe(F.col("status"))).withColumn("status", F.col("_new")).drop("_new")


def distinct_rects(rects: Column, near: float = 2.0) -> Column:
    """Rectangles ``(x, y)`` that are not within ``near`` of an earlier one that stays, in order."""

    def step(kept: Column, r: Column) -> Column:
        close = F.exists(kept, lambda u: (F.abs(u["x"] - r["x"]) < near) & (F.abs(u["y"] - r["y"]) < near))
        return F.when(close, kept).otherwise(F.concat(kept, F.array(r)))

    return F.aggregate(rects, F.slice(rects, 1, 0), step)


def longest_prefix(path: Column, routes: dict[str, str]) -> Column:
    """Label of the longest route that begins the path."""
    out = F
    for route in sorted(routes, key=lambda r: (-len(r), r)):
        out = out.when(path.startswith(route), routes[route])
    return out.otherwise(F.lit(None).cast("string"))


def allowed_path(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Add ``access`` (``ok``, ``not_found`` or ``refused``) of ``path`` for ``organization_id``.

    Known heads are ``projects/<id>``, ``organizations/<id>`` and a project's
    id alone if it is a UUID; projects must be of the organisation.
    """
    parts = F.split(F.translate("path", "\\", "/"), "/")
    head, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    uuid = head.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    asked = files.withColumn("_project", F.when(head == "projects", second).when(uuid, head))
    known = projects.select(F.col("id").alias("_id"), F.col("organization_id").alias("_org"))
    both = asked.join(known, (F.col("_project") == F.col("_id")) & (F.col("organization_id") == F.col("_org")), "left")
    by_project = F.when(F.col("_id").isNotNull(), "ok").otherwise("not_found")
    own = F.when(second == F.col("organization_id"), "ok").otherwise("not_found")
    access = F.when(head.isin("projects", "organizations") & second.isNull(), "refused").when(F.col("_project").isNotNull(), by_project).when(head == "organizations", own).otherwise("refused")
    return both.withColumn("access", access).drop("_project", "_id", "_org")
