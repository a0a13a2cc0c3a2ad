"""Counters, completion rates and the go / no-go score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermill.operators.relational import keyword_all, keyword_rank

# Keywords of the trades, tried in this order.
TRADES = (
    (1, ("façade", "facade", "ite", "ravalement", "bardage", "enduit ext", "isolation ext")),
    (2, ("gros œuvre", "gros oeuvre", "maçonnerie", "maconnerie", "béton", "beton", "fondation", "structure")),
    (3, ("peinture", "revêtement", "revetement", "sol souple", "papier peint", "enduit int")),
    (4, ("électricité", "electricite", "electricité", "electrique", "électrique", "courant", "cfo", "cfa")),
    (5, ("vrd", "voirie", "assainissement", "réseaux divers", "enrobé", "enrobe", "terrassement")),
    (6, ("plomberie", "cvc", "chauffage", "ventilation", "climatisation", "sanitaire", "ecs")),
    (7, ("étanchéité", "etancheite", "couverture", "toiture", "terrasse", "charpente")),
    (8, ("menuiserie", "fenêtre", "fenetre", "porte ext", "baie", "volet", "fermeture")),
)


def count_where(test: Column) -> Column:
    return F.coalesce(F.count_if(test), F.lit(0)).cast("long")


def percent_half_even(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(part / whole * 100)).otherwise(0).cast("int")


def completion(fields: list[Column]) -> Column:
    """How many of the fields are neither NULL nor empty text."""
    return sum((F.when(F.coalesce(f.cast("string"), F.lit("")) != "", 1).otherwise(0) for f in fields), F.lit(0))


def activity_score(rate: Column, won: Column, submitted: Column) -> Column:
    return F.least(F.lit(100), F.floor(40 + 0.3 * rate + 5 * won + 3 * submitted + 0.5)).cast("int")


def time_points(days: Column) -> Column:
    points = F.when(days.isNull(), 15)
    for limit, value in ((-1, 0), (3, 5), (7, 12), (14, 20)):
        points = points.when(days <= limit, value)
    return points.otherwise(25)


def checklist_points(done: Column, total: Column) -> Column:
    return F.when(total == 0, 5).otherwise(F.bround(25 * done / total)).cast("int")


def reference_points(lot: Column, references: Column, matched: Column) -> Column:
    return F.when(references == 0, 0).when(lot.isNotNull(), F.least(F.lit(20), 5 * matched)).otherwise(10)


def sheet_points(present: Column, valid: Column) -> Column:
    return F.when(~present, 0).when(valid, 15).otherwise(8)


def memoire_points(present: Column) -> Column:
    return F.when(present, 15).otherwise(0)


def matched_references(references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of each organisation, and those of each trade, by the keywords in their lot and title."""
    usable = references.where(F.col("deleted_at").isNull() & F.col("is_reference"))
    text = F.lower(F.concat_ws(" ", F.coalesce("lot", F.lit("")), F.coalesce("intitule", F.lit(""))))
    trades = usable.select("organization_id", F.explode(keyword_all(text, TRADES)).alias("trade")).groupBy("organization_id", "trade").agg(F.count("*").alias("matched"))
    return usable.groupBy("organization_id").agg(F.count("*").alias("refs")), trades


def go_no_go(projects: DataFrame, items: DataFrame, references: DataFrame, memoires: DataFrame, asof: Column) -> DataFrame:
    """Five parts, score and verdict of each project.

    ``projects(id, organization_id, deadline, selected_lot_name, sheet_url, sheet_valid)``.
    Items, references and memoires are reduced to one row a key before they meet the projects.
    """
    done = items.groupBy("project_id").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("present", "non_applicable")).alias("done"))
    written = memoires.select("project_id").distinct().withColumn("has_memoire", F.lit(True))
    refs, trades = matched_references(references)
    lot = F.nullif("selected_lot_name", F.lit(""))
    rows = projects.withColumns({"trade": keyword_rank(F.lower(lot), TRADES), "project_id": F.col("id")})
    rows = rows.join(done, "project_id", "left").join(written, "project_id", "left").join(refs, "organization_id", "left").join(trades, ["organization_id", "trade"], "left")
    rows = rows.fillna(0, ["n", "done", "refs", "matched"])
    parts = {
        "temps": time_points(F.datediff("deadline", asof)), "checklist": checklist_points(F.col("done"), F.col("n")), "references": reference_points(lot, F.col("refs"), F.col("matched")).cast("int"),
        "memoire": memoire_points(F.coalesce("has_memoire", F.lit(False))), "dpgf": sheet_points(F.col("sheet_url").isNotNull(), F.coalesce("sheet_valid", F.lit(False))),
    }
    out = rows.select("id", *[p.alias(n) for n, p in parts.items()])
    score = sum((F.col(n) for n in parts), F.lit(0))
    return out.withColumn("score", score.cast("int")).withColumn("verdict", verdict(F.col("score")))


def verdict(score: Column) -> Column:
    out = F
    for limit, name in ((80, "GO"), (60, "GO modéré"), (40, "À RISQUE")):
        out = out.when(score >= limit, name)
    return out.otherwise("NO-GO")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
