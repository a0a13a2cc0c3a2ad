"""Queries of text functions and of contexts packed from texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermill.functions import classify, text
from tendermill.operators import context, relational, reports, scoring
from tendermill.plans.base import c, dealt, expected, query, spread, t
from tendermill.streaming import events

_SEARCHED = [
    "trop court", "exactement quinze", "Le titulaire remet un mémoire technique détaillé avant le démarrage du chantier", "a" * 50 + " " + "b" * 20, "  " + "mot " * 12, None,
]


@query(expected("pieces, pairs", [
    ("", ""), ("exactement quinze", "exactement quinze"), ("Le titulaire remet un mémoire technique|détaillé avant le démarrage du chantier",
     "titulaire remet|remet mémoire|mémoire technique|technique détaillé|détaillé avant"),
    ("a" * 45 + "|" + "aaaaa " + "b" * 20, "a" * 50 + " " + "b" * 20), (("mot " * 11).strip(), ""), ("", None),
]))
def segment_text(spark, sf_dir):
    rows = dealt(spark, sf_dir, _SEARCHED)
    return rows.select("p_partkey", F.array_join(text.segments(c("x0")), "|").alias("pieces"), F.array_join(text.fallback_pairs(c("x0")), "|").alias("pairs"))


@query(expected("page", [(2,), (3,), (None,), (1,)]))
def locate_page(spark, sf_dir):
    pages = F.array(F.lit("un début"), F.lit("deux"), F.lit("Un TEXTE cherché ici"))
    rows = dealt(spark, sf_dir, [2, 9, 0, 1], ["x", "texte cherché", "absent", "texte"])
    return rows.select("p_partkey", text.page_of(pages, c("x0"), c("x1")).alias("page"))


@query(expected("clean, name, band, amount, minutes", [
    ("ab", "Jo Do", None, "1 234 568 €", 32), ("x", "jo.do", "expired", "0 €", 0), ("", "Jo", "urgent", "-12 €", 2), ("é", "x", "soon", "999 €", 2),
]))
def small_scalars(spark, sf_dir):
    rows = dealt(spark, sf_dir, ["a\u0000b", "x", "", "é"], ["Jo", "", "Jo", None], ["Do", None, "", ""], ["j@x.fr", "jo.do@x.fr", "q@x", "x@y"], [None, -1, 7, 8], [1234567.6, 0.2, -12.4, 999.4], [31.7, 0.4, 1.5, 2.5])
    return rows.select(
        "p_partkey", text.without_nul(c("x0")).alias("clean"), text.default_name(c("x1"), c("x2"), c("x3")).alias("name"), classify.alert_band(c("x4")).alias("band"),
        text.euros(c("x5")).alias("amount"), text.travel_minutes(c("x6")).alias("minutes"),
    )


@query(expected("parsed", [
    ("p:Voici |b:gras| fin;b:- un |b:deux",), ("",), ("b:- x;p:y",),
]))
def bullet_markup(spark, sf_dir):
    lines = text.bullets(c("x0"))
    runs = lambda x: F.array_join(F.transform(x["runs"], lambda r: F.concat(F.when(r["bold"], "b:").otherwise(""), r["text"])), "|")
    told = F.transform(lines, lambda x: F.concat(F.when(x["bullet"], "b:- ").otherwise("p:"), runs(x)))
    return dealt(spark, sf_dir, ["Voici **gras** fin\n\n- un **deux**", "\n  \n", "* x\ny  "]).select("p_partkey", F.array_join(told, ";").alias("parsed"))


@query(expected("section", [("## Façades\ntexte\n### Enduit\nsuite",), ("",), ("# Façades et ITE\n## x",)]))
def markdown_sections(spark, sf_dir):
    texts = ["---\na: façades\n---\n\n# Normes\nintro\n## Façades\ntexte\n### Enduit\nsuite\n## Sols\nautre", "aucun titre façades", "# Façades et ITE\n## x\n# y"]
    return dealt(spark, sf_dir, texts).select("p_partkey", text.markdown_section(c("x0"), "façades").alias("section"))


@query(expected("header", [("inline; filename=\"a b.pdf\"; filename*=UTF-8''a%20b.pdf",), ("inline; filename=\"?t?.pdf\"; filename*=UTF-8''%C3%A9t%C3%A9.pdf",)]))
def disposition(spark, sf_dir):
    return dealt(spark, sf_dir, ["a b.pdf", "été.pdf"]).select("p_partkey", text.disposition(c("x0")).alias("header"))


@query("""
SELECT event_id, props AS whole, CAST(json_extract_string(props, '$.k') AS INTEGER) AS cut_off, 'x' || event_id AS unclosed FROM events""")
def json_first_object(spark, sf_dir):
    """Objects within a text, and objects cut off before a bracket or within a string."""
    props = c("props")
    whole = text.lenient_json(F.concat(F.lit("Voici : "), props, F.lit(' et {"c": 1}')), "{}")
    cut_off = text.lenient_json(F.concat(F.lit("Voici : "), F.left(props, F.char_length(props) - 1)), "{}")
    unclosed = text.lenient_json(F.concat(F.left(props, F.char_length(props) - 1), F.lit(', "s": "x'), c("event_id").cast("string")), "{}")
    return spread(t(spark, sf_dir, "events").select("event_id", "props"), "event_id").select(
        "event_id", whole.alias("whole"), F.get_json_object(cut_off, "$.k").cast("int").alias("cut_off"), F.get_json_object(unclosed, "$.s").alias("unclosed")
    )


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN c_name ELSE 'défaut' END AS historique, CASE c_custkey % 3 WHEN 0 THEN 'intro' || chr(10) || chr(10) || 'a2' ELSE 'b1' END AS flat FROM customer")
def profile_coalesce(spark, sf_dir):
    k = c("c_custkey") % 3
    own = F.when(k == 0, "").when(k == 2, c("c_name"))
    parts = F.when(k == 0, F.array(F.lit("intro"), F.lit(""), F.lit("a2"))).otherwise(F.array(F.lit(None).cast("string"), F.lit("b1")))
    flat = F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")
    return t(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.nullif(own, F.lit("")), F.lit("défaut")).alias("historique"), flat.alias("flat"))


def _documents(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("rc", "ccap", "cctp", "dpgf", "plan"))), (c("doc_id") % 5 + 1).cast("int"))
    tags = F.when(c("doc_id") % 7 == 0, F.array(F.lit("info"))).when(c("doc_id") % 7 == 1, F.array(F.lit("6")))
    return t(spark, sf_dir, "documents").select((c("doc_id") % 97).alias("project_id"), c("doc_id").alias("id"), kind.alias("type"), F.concat(F.lit("f"), c("doc_id").cast("string")).alias("file_name"), "text", tags.alias("tags"))


_DOCS_SQL = "(SELECT doc_id % 97 AS project_id, doc_id AS id, ['rc', 'ccap', 'cctp', 'dpgf', 'plan'][(doc_id % 5)::INTEGER + 1] AS type, 'f' || doc_id AS file_name, text, doc_id % 7 > 1 AS kept FROM documents)"


@query(f"""
WITH d AS (SELECT * FROM {_DOCS_SQL} WHERE kept AND trim(coalesce(text, '')) <> '' QUALIFY row_number() OVER (PARTITION BY project_id, md5(text) ORDER BY id) = 1)
SELECT project_id, CASE WHEN type IN ('rc', 'ccap') THEN 1 ELSE 2 END AS pass, md5(string_agg('=== ' || upper(type) || ' — ' || file_name || ' ===' || chr(10) || left(text, CASE type WHEN 'rc' THEN 50000 WHEN 'dpgf' THEN 10000 ELSE 30000 END), chr(10) || chr(10) ORDER BY id)) AS context
FROM d WHERE type <> 'plan' GROUP BY ALL""")
def analysis_context(spark, sf_dir):
    out = context.joined_blocks(context.analysis_blocks(_documents(spark, sf_dir), "lot 5"))
    return out.withColumn("context", F.md5("context"))


@query(f"""
SELECT id, greatest(0, least(want, 90000 - before))::INTEGER AS take FROM (SELECT id, want, coalesce(sum(want) OVER (PARTITION BY project_id ORDER BY CASE type WHEN 'cctp' THEN 0 WHEN 'rc' THEN 1 WHEN 'dpgf' THEN 3 WHEN 'plan' THEN 4 ELSE 5 END, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, least(length(text), CASE type WHEN 'cctp' THEN 55000 WHEN 'rc' THEN 8000 ELSE 5000 END) AS want FROM {_DOCS_SQL}))""")
def generation_context(spark, sf_dir):
    return context.generation_takes(_documents(spark, sf_dir)).select("id", "take")


@query("""
SELECT l_suppkey AS project_id, md5(string_agg('- [' || CASE l_returnflag WHEN 'N' THEN 'OFFRE' ELSE 'TECHNIQUE' END || '] ' || l_partkey, chr(10) ORDER BY seq)) AS block
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS seq FROM lineitem) WHERE seq <= 80 GROUP BY l_suppkey""")
def compliance_block(spark, sf_dir):
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq")
    items = t(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("project_id"), seq, F.when(c("l_returnflag") == "N", "offre").otherwise("technique").alias("category"), c("l_partkey").cast("string").alias("exigence"))
    return context.compliance_block(items).withColumn("block", F.md5("block"))


def _criteria(rows):
    part = lambda n, w: F.struct(F.lit(n).alias("nom"), F.lit(w).alias("poids"))
    none = F.array().cast("array<struct<nom:string,poids:int>>")
    made = lambda n, w, parts: F.struct(F.lit(n).alias("nom"), F.lit(w).alias("poids"), (F.array(*[part(*p) for p in parts]) if parts else none).alias("sous_criteres"))
    return F.array(*[made(*r) for r in rows])


@query(expected("price, others, top", [(40, 60, "Méthode"), (0, 100, None), (60, 40, None)]))
def criteria_parts(spark, sf_dir):
    sets = [
        [("Prix des prestations", 40, []), ("Valeur technique", 60, [("Moyens", 20), ("Méthode", 30), ("Délais", 30)])],
        [("Qualité", 70, []), ("Délai", 30, [("x", 30)])], [("Prix", 60, []), ("Prix bis", 5, []), ("Autre", 40, [])],
    ]
    k = c("p_partkey") % 3
    criteria = F.when(k == 0, _criteria(sets[0])).when(k == 1, _criteria(sets[1])).otherwise(_criteria(sets[2]))
    price, others = context.price_weight(criteria)
    return t(spark, sf_dir, "part").select("p_partkey", price.alias("price"), others.alias("others"), context.heaviest_part(criteria).alias("top"))


_TAGGED = [("RC.pdf", "rc"), ("x.pdf", "plan"), ("DIAG_amiante.pdf", "diagnostic"), ("CCTP_Lot05.pdf", "cctp"), ("DCE_lot 1A.pdf", "cctp"), ("Planning.pdf", "planning"), ("DPGF_Lot2.xlsx", "dpgf_template"), ("DPGF.xlsx", "dpgf_template")]


@query(expected("tag", [("all",), ("info",), ("info",), ("5",), ("1A",), ("all",), ("2",), ("all",)]))
def lot_tags(spark, sf_dir):
    rows = dealt(spark, sf_dir, [n for n, _ in _TAGGED], [k for _, k in _TAGGED])
    return rows.select("p_partkey", F.array_join(classify.lot_tags(c("x0"), c("x1")), ",").alias("tag"))


@query(expected("suffix, clean, initials, linked, summary, block", [
    (".pdf", "a_b", "JD", "expire", True, "=== RC — A.PDF ===\nx"), ("", "x", "É", "expiration_proche", False, "=== CCAP — noext ===\nx"), (".gz", "é", "AB", "present", True, "=== AUTRE — t.tar.GZ ===\nx"),
]))
def more_scalars(spark, sf_dir):
    rows = dealt(spark, sf_dir, ["A.PDF", "noext", "t.tar.GZ"], ["a\u0001\u0090b", "\tx\n", "é"], ["Jo Do", "élan", "a b c"], ["expired", "expiring_soon", "valid"], ["Total HT", "Béton", "  récapitulatif"], ["rc", "ccap", "autre"])
    return rows.select(
        "p_partkey", text.extension(c("x0")).alias("suffix"), text.without_controls(c("x1")).alias("clean"), text.initials(c("x2")).alias("initials"), classify.link_status(c("x3")).alias("linked"),
        text.is_summary_row(c("x4")).alias("summary"), text.labelled_block(c("x5"), c("x0"), F.lit("x")).alias("block"),
    )


@query("SELECT c_custkey, least(100, floor(40 + 0.3 * (c_custkey % 100) + 5 * (c_custkey % 7) + 3 * (c_custkey % 5) + 0.5))::INTEGER AS score FROM customer")
def activity_score(spark, sf_dir):
    k = c("c_custkey")
    return t(spark, sf_dir, "customer").select(k, scoring.activity_score(k % 100, k % 7, k % 5).alias("score"))


@query("""
SELECT event_id, trunc(epoch_us(ts - TIMESTAMP '2024-01-15 12:00:00') / 86400e6)::INTEGER AS whole_days, date_diff('day', DATE '2024-01-15', ts::DATE)::INTEGER AS dates FROM (
  SELECT event_id, ts FROM events)""")
def days_until(spark, sf_dir):
    """Days as the browser counts them, cut toward zero, and as dates differ."""
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return t(spark, sf_dir, "events").select("event_id", text.whole_days(c("ts"), now).alias("whole_days"), F.datediff(c("ts").cast("date"), now.cast("date")).alias("dates"))


@query("""
SELECT o_custkey, o_orderkey, d AS days_left, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS place
FROM (SELECT *, date_diff('day', DATE '2001-06-30', o_orderdate::DATE)::INTEGER AS d FROM orders) WHERE d <= 365""")
def expiry_horizon(spark, sf_dir):
    """Expired and soon expiring documents, the oldest first; a horizon of 900 days is cut to a year."""
    rows = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", c("o_orderdate").cast("date").alias("day"), "o_orderdate")
    near = relational.expiring(rows, "day", F.lit("2001-06-30").cast("date"), 900)
    return reports.placed(near, ["o_custkey"], c("o_orderdate").asc_nulls_last(), c("o_orderkey")).select("o_custkey", "o_orderkey", "days_left", "place")


@query("SELECT event_id, event_type AS kind, event_id::VARCHAR AS data FROM events UNION ALL SELECT event_id, 'message', 'x' || chr(10) || 'y' FROM events")
def sse_blocks(spark, sf_dir):
    """Messages out of the stream's text, as a client parses them."""
    raw = F.concat(F.lit(": a comment\nevent: "), "event_type", F.lit("\ndata: "), c("event_id").cast("string"), F.lit("\n\ndata: x\ndata: y\n\n\n\n"))
    return t(spark, sf_dir, "events").select("event_id", F.inline(events.parsed(raw)))


@query("SELECT event_id, least(0.99, value / 57344)::DOUBLE AS ratio FROM events")
def stream_ratio(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", events.stream_ratio(c("value")).alias("ratio"))
