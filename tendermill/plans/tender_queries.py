"""Queries of the tender operators on the driver's tables, each beside its SQL.

The tables are a trading schema, so each operator runs on a structural analogue:
orders stand for projects, line items for price lines, parts for documents,
customers for companies and events for progress.  Dates are literals.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tendermill.functions import classify, text
from tendermill.operators import lots, pricing, relational, scoring
from tendermill.plans.base import EVENTS_ASOF, ORDERS_ASOF, c, query, t

#: Keyword families over part names, tried in this order.
PART_FAMILIES = ((1, ("green", "olive", "lime")), (2, ("steel", "metal")), (3, ("blue", "navy")), (4, ("red", "rose", "tomato")))


def _contains_sql(column: str, words) -> str:
    quoted = (w.replace("'", "''") for w in words)
    return " OR ".join(f"contains({column}, '{w}')" for w in quoted)


def _plain_sql(column: str) -> str:
    return f"regexp_replace(translate({column}, '{text.ACCENTED}', '{text.PLAIN}'), '[^\\x00-\\x7F]', '', 'g')"


def _normal_sql(column: str) -> str:
    return f"trim(regexp_replace(lower({_plain_sql(column)}), '\\s+', ' ', 'g'))"


# Counters and filters


@query(f"""
SELECT count_if(o_orderstatus = 'P')::BIGINT AS open_projects, count_if(o_orderstatus = 'F')::BIGINT AS won,
  count_if(o_orderstatus IN ('F', 'O'))::BIGINT AS decided,
  count_if(o_orderstatus = 'O' AND o_orderdate >= date_trunc('month', DATE '{ORDERS_ASOF}'))::BIGINT AS submitted_this_month,
  CASE WHEN count_if(o_orderstatus IN ('F', 'O')) > 0
    THEN round_even(count_if(o_orderstatus = 'F') / count_if(o_orderstatus IN ('F', 'O')) * 100, 0)::INTEGER ELSE 0 END AS success_rate
FROM orders""")
def dashboard_counters(spark, sf_dir):
    status = c("o_orderstatus")
    month = F.trunc(F.lit(ORDERS_ASOF).cast("date"), "MM")
    out = t(spark, sf_dir, "orders").agg(
        scoring.count_where(status == "P").alias("open_projects"), scoring.count_where(status == "F").alias("won"),
        scoring.count_where(status.isin("F", "O")).alias("decided"),
        scoring.count_where((status == "O") & (c("o_orderdate") >= month)).alias("submitted_this_month"),
    )
    return out.withColumn("success_rate", scoring.percent_half_even(c("won"), c("decided")))


@query(f"""
SELECT event_type, count(*) AS total, count_if(ts >= TIMESTAMP '{EVENTS_ASOF}' - INTERVAL 24 HOUR)::BIGINT AS last_day
FROM events GROUP BY event_type""")
def ops_metrics_24h(spark, sf_dir):
    recent = c("ts") >= F.expr(f"TIMESTAMP_NTZ '{EVENTS_ASOF}' - INTERVAL 24 HOURS")
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total"), scoring.count_where(recent).alias("last_day"))


@query("""
SELECT source, count(*) AS total, count(quality) AS extracted, count(quality) >= count(*) AS ready
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def extraction_progress(spark, sf_dir):
    both = t(spark, sf_dir, "documents").select("doc_id", "source").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    out = both.groupBy("source").agg(F.count("*").alias("total"), F.count("quality").alias("extracted"))
    return out.withColumn("ready", c("extracted") >= c("total"))


_DAYS = f"date_diff('day', DATE '{ORDERS_ASOF}', o_orderdate::DATE + 60)"


@query(f"""
SELECT o_orderkey, {_DAYS} AS days_left,
  CASE WHEN {_DAYS} < 0 THEN 'expired' WHEN {_DAYS} <= 30 THEN 'expiring_soon' ELSE 'valid' END AS status
FROM orders""")
def expiry_status(spark, sf_dir):
    asof, day = F.lit(ORDERS_ASOF).cast("date"), F.date_add(c("o_orderdate").cast("date"), 60)
    return t(spark, sf_dir, "orders").select("o_orderkey", F.datediff(day, asof).cast("long").alias("days_left"), classify.expiry_status(day, asof).alias("status"))


@query(f"SELECT o_orderkey, {_DAYS} AS days_left FROM orders WHERE {_DAYS} <= 45 AND o_orderstatus <> 'F'")
def expiring_within(spark, sf_dir):
    left = F.datediff(F.date_add(c("o_orderdate").cast("date"), 60), F.lit(ORDERS_ASOF).cast("date"))
    days = F.greatest(F.lit(1), F.least(F.lit(45), F.lit(365)))
    out = t(spark, sf_dir, "orders").where(c("o_orderstatus") != "F").select("o_orderkey", left.cast("long").alias("days_left"))
    return out.where(c("days_left") <= days)


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND NOT c_acctbal < 0")
def soft_delete_scope(spark, sf_dir):
    df = t(spark, sf_dir, "customer").withColumn("deleted_at", F.when(c("c_acctbal") < 0, F.lit("2020-01-01")))
    return relational.scoped(df, c("c_nationkey") == 7).select("c_custkey", "c_name")


@query("""
SELECT p_partkey FROM part
WHERE contains(lower(coalesce(p_name, '')), 'st') OR contains(lower(coalesce(p_type, '')), 'brass') OR contains(lower(coalesce(p_brand, '')), '#3')""")
def text_search(spark, sf_dir):
    has = lambda col, q: F.lower(F.coalesce(c(col), F.lit(""))).contains(q)
    return t(spark, sf_dir, "part").where(has("p_name", "st") | has("p_type", "brass") | has("p_brand", "#3")).select("p_partkey")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('P', 'O') THEN 'active' ELSE 'done' END AS bucket,
  o_orderstatus <> 'F' AND date_diff('day', DATE '2001-06-30', o_orderdate::DATE) <= 7 AS urgent
FROM orders""")
def status_buckets(spark, sf_dir):
    days = F.datediff(c("o_orderdate").cast("date"), F.lit(ORDERS_ASOF).cast("date"))
    bucket = F.when(c("o_orderstatus").isin("P", "O"), "active").otherwise("done")
    return t(spark, sf_dir, "orders").select("o_orderkey", bucket.alias("bucket"), ((c("o_orderstatus") != "F") & (days <= 7)).alias("urgent"))


@query("""
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= DATE '1995-06-01' - 1
ORDER BY o_orderdate, o_orderkey LIMIT 5""")
def topk_deadlines(spark, sf_dir):
    near = (c("o_orderstatus") == "P") & (c("o_orderdate") >= F.lit("1995-05-31").cast("date"))
    return t(spark, sf_dir, "orders").where(near).orderBy("o_orderdate", "o_orderkey").limit(5).select("o_orderkey", "o_orderdate")


# Classifiers and text


@query(f"SELECT doc_id, {_normal_sql('text')} AS plain FROM documents")
def normalise_text(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.normalise(c("text")).alias("plain"))


_EDGE = lambda p: p.replace("(?<![a-z0-9])", "(?:^|[^a-z0-9])").replace("(?![a-z0-9])", "(?:$|[^a-z0-9])").replace(r"(?=\.[a-z]{2,5}$)", r"\.[a-z]{2,5}$")


def _cascade_sql() -> str:
    m = lambda p: f"regexp_matches(name, '{_EDGE(p)}')"
    guards = {None: "", "ods": " AND ends_with(name, '.ods')", "no annex": f" AND NOT {m(classify.ANNEX_MARK)}"}
    branches = lambda rules: " ".join(f"WHEN ({m(p)}){guards[g]} THEN '{k}'" for p, k, g in rules)
    rules = f"({m(classify.RULES_MARK)} OR (NOT {m(classify.PLAN_MARK)} AND {m(classify.GROUND_FLOOR)})) AND NOT {m(classify.ANNEX_MARK)}"
    return f"CASE {branches(classify.BEFORE_RULES)} WHEN {rules} THEN 'rc' {branches(classify.AFTER_RULES)} ELSE 'autre' END"


#: File names made of a part's key, so that every branch of the cascade occurs.
_NAMES = (
    "DC1_lettre.pdf", "declaration du candidat.docx", "2829 - AE.pdf", "DPGF_Lot1.xlsx", "Bordereau.ods", "BPU_Lot3.xlsx", "DQE.xlsx",
    "Cadre de réponse.docx", "Attestation_visite.pdf", "PGC SPS.pdf", "DIAG PLOMB.pdf", "Notice_acoustique.pdf", "DT ENEDIS.pdf", "Planning DCE.pdf",
    "RDC.pdf", "Plan_RDC.dwg", "Règlement de la consultation.pdf", "CCAP.pdf", "CCTP_Lot05.pdf", "carnet de détail.pdf", "lot 01 GO_DCE.pdf",
    "DCE-CVC.pdf", "Plan_facade.pdf", "image.png", "annexe rc.pdf", "DTU 13.3.pdf",
)
_NAME_SQL = "[" + ", ".join(f"'{n}'" for n in _NAMES) + f"][(p_partkey % {len(_NAMES)})::INTEGER + 1]"


def _named_parts(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (c("p_partkey") % len(_NAMES) + 1).cast("int"))
    return t(spark, sf_dir, "part").select("p_partkey", name.alias("file_name"))


@query(f"SELECT p_partkey, {_cascade_sql()} AS kind FROM (SELECT p_partkey, {_normal_sql(_NAME_SQL)} AS name FROM part)")
def classify_cascade(spark, sf_dir):
    return _named_parts(spark, sf_dir).select("p_partkey", classify.doc_type(c("file_name"), F.lit("autre")).alias("kind"))


_VAULT_SQL = "CASE " + " ".join(f"WHEN {_contains_sql('lower(text)', w)} THEN '{k}'" for w, k in classify.VAULT_KEYWORDS) + " END"


@query(f"SELECT kind, count(*) AS n FROM (SELECT {_VAULT_SQL} AS kind FROM documents) GROUP BY kind")
def classify_keywords(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy(classify.vault_type(c("text")).alias("kind")).agg(F.count("*").alias("n"))


_LOT_SQL = f"regexp_extract({_NAME_SQL}, '{classify.LOT_IN_NAME}', 1)"


@query(f"SELECT p_partkey, CASE WHEN raw = '' THEN NULL WHEN regexp_matches(raw, '^\\d+$') THEN raw::INTEGER::VARCHAR ELSE raw END AS lot FROM (SELECT p_partkey, {_LOT_SQL} AS raw FROM part)")
def lot_number_extract(spark, sf_dir):
    return _named_parts(spark, sf_dir).select("p_partkey", classify.lot_in_name(c("file_name")).alias("lot"))


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(raw, '^\\d{1,2}[A-Za-z]?$') THEN 'lot' || ltrim(raw, '0') WHEN regexp_matches(raw, '^[A-Z]$') THEN 'lot' || (ascii(raw) - 64) END AS lot_id
FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN chr(65 + p_size % 26) ELSE substr(p_brand, 7) END AS raw FROM part)""")
def lot_canonical(spark, sf_dir):
    raw = F.when(c("p_size") % 3 == 0, F.char(65 + c("p_size") % 26)).otherwise(F.substring("p_brand", 7, 10))
    return t(spark, sf_dir, "part").select("p_partkey", classify.canonical_lot(raw).alias("lot_id"))


_TAGS_SQL = "CASE p_size % 6 WHEN 0 THEN ['all'] WHEN 1 THEN ['info'] WHEN 2 THEN ['5'] WHEN 3 THEN ['5', '13'] WHEN 4 THEN NULL ELSE [] END"


def _tagged(spark, sf_dir):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    k = c("p_size") % 6
    tags = F.when(k == 0, arr("all")).when(k == 1, arr("info")).when(k == 2, arr("5")).when(k == 3, arr("5", "13")).when(k == 5, arr())
    return t(spark, sf_dir, "part").select("p_partkey", tags.alias("tags"))


@query(f"""
SELECT p_partkey, tags IS NULL OR list_contains(tags, 'all') OR list_contains(tags, '5') AS for_lot,
  tags IS NULL OR len(tags) = 0 OR len(list_filter(tags, lambda x: x <> 'info')) > 0 AS for_all
FROM (SELECT p_partkey, {_TAGS_SQL} AS tags FROM part)""")
def tag_filter(spark, sf_dir):
    return _tagged(spark, sf_dir).select("p_partkey", classify.concerns_lot(c("tags"), "lot05").alias("for_lot"), classify.concerns_lot(c("tags"), None).alias("for_all"))


@query("SELECT doc_id, floor(length(text) / 4)::BIGINT AS tokens, md5(CASE WHEN length(text) > 800 THEN left(text, 800) || '[cut]' ELSE text END) AS guarded FROM documents")
def token_guard(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.token_estimate(c("text")).alias("tokens"), F.md5(text.guarded(c("text"), 200, "[cut]")).alias("guarded"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE round(l_extendedprice, 2) END AS amount FROM lineitem""")
def to_number(spark, sf_dir):
    money = F.regexp_replace(F.format_string("%.2f", c("l_extendedprice")), r"\.", ",")
    k = c("l_linenumber") % 4
    spelt = F.when(k == 0, money).when(k == 1, F.concat(money, F.lit(" €"))).when(k == 2, F.concat(F.lit(" "), money)).otherwise(F.concat(F.lit("1.2"), money))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.to_number(spelt).alias("amount"))


@query(f"""
SELECT doc_id, coalesce(nullif(regexp_replace(s, '^_+|_+$', '', 'g'), ''), 'document') AS name
FROM (SELECT doc_id, regexp_replace(regexp_replace({_plain_sql('text')}, '[^A-Za-z0-9.\\-]', '_', 'g'), '_+', '_', 'g') AS s FROM documents)""")
def safe_names(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.safe_name(c("text")).alias("name"))


@query("""
SELECT doc_id, line, word FROM (
  SELECT doc_id, line, unnest(regexp_extract_all(x, '\\bth[a-z]{4,8}\\b')) AS word
  FROM (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS line FROM (
    SELECT doc_id, CASE WHEN lang = 'en' THEN string_split(text, chr(10)) [:500] ELSE string_split(text, chr(10)) [:200] END AS l FROM documents)))""")
def inline_mentions(spark, sf_dir):
    """Lines searched are bounded by the kind of document, here its language."""
    most = F.when(c("lang") == "en", 500).otherwise(200)
    lines = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), F.lit(1), most)).alias("i", "x"))
    found = F.explode(F.regexp_extract_all("x", F.lit(r"\bth[a-z]{4,8}\b"), F.lit(0)))
    return lines.select("doc_id", (c("i") + 1).cast("long").alias("line"), found.alias("word"))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
h AS (SELECT doc_id, x, unnest(list_filter(range(1, len(x) + 1), lambda i: regexp_matches(x[i], '[0-9]'))) AS hit FROM l),
n AS (SELECT doc_id, hit, trim(x[i]) AS s, i FROM (SELECT doc_id, x, hit, unnest(range(hit + 1, least(len(x), hit + 11) + 1)) AS i FROM h)),
b AS (SELECT *, sum(CASE WHEN s <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, hit ORDER BY i) AS k FROM n),
f AS (SELECT *, min(CASE WHEN k > 0 AND s = '' THEN i END) OVER (PARTITION BY doc_id, hit) AS stop,
  coalesce(sum(length(s)) OVER (PARTITION BY doc_id, hit ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
g AS (SELECT doc_id, hit, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (WHERE s <> '' AND (stop IS NULL OR i < stop) AND before < 220), '') AS e FROM (SELECT h.doc_id, h.hit, f.s, f.i, f.stop, f.before FROM h LEFT JOIN f USING (doc_id, hit)) GROUP BY doc_id, hit)
SELECT doc_id, hit AS line, md5(CASE WHEN length(e) > 250 THEN rtrim(left(e, 247)) || '…' ELSE e END) AS excerpt FROM g""")
def lookahead_excerpt(spark, sf_dir):
    """An excerpt after every line with a digit."""
    rows = t(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    rows = rows.select("doc_id", "l", F.posexplode("l").alias("i", "x")).where(c("x").rlike("[0-9]"))
    return rows.select("doc_id", (c("i") + 1).cast("long").alias("line"), F.md5(lots.excerpt_after(c("l"), c("i"))).alias("excerpt"))


# Joins


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000")
def left_lookup(spark, sf_dir):
    rich = t(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey", "c_name")
    return t(spark, sf_dir, "orders").join(rich, c("o_custkey") == c("c_custkey"), "left").select("o_orderkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_linked(spark, sf_dir):
    linked = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").select("c_custkey").join(linked, "c_custkey", "left_semi")


@query("""
SELECT p_partkey FROM part WHERE lower(trim(p_name)) || ' ' || p_size NOT IN (SELECT lower(trim(p_name)) || ' ' || p_size FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 49)""")
def anti_new(spark, sf_dir):
    """Files whose name no known file has, without regard to case and blanks at the ends."""
    key = F.concat_ws(" ", F.lower(F.trim("p_name")), c("p_size").cast("string")).alias("key")
    parts = t(spark, sf_dir, "part").select("p_partkey", key)
    known = parts.join(t(spark, sf_dir, "lineitem").where("l_quantity > 49").select(c("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("key")
    return parts.join(known, "key", "left_anti").select("p_partkey")


_FAMILY_SQL = "CASE " + " ".join(f"WHEN {_contains_sql('p_name', w)} THEN {n}" for n, w in PART_FAMILIES) + " END"


@query(f"SELECT p_partkey, {_FAMILY_SQL} AS family FROM part")
def keyword_theta_first(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", relational.keyword_rank(c("p_name"), PART_FAMILIES).alias("family"))


@query(" UNION ALL ".join(f"SELECT p_partkey, {n} AS family FROM part WHERE {_contains_sql('p_name', w)}" for n, w in PART_FAMILIES))
def keyword_theta_all(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.explode(relational.keyword_all(c("p_name"), PART_FAMILIES)).alias("family"))


@query("""
WITH s AS (SELECT user_id, min(epoch_ms(ts) // 1000)::BIGINT AS start, max(epoch_ms(ts) // 1000)::BIGINT AS "end" FROM events GROUP BY user_id, ts::DATE),
r AS (SELECT user_id, epoch_ms(ts) // 1000 - 1800 AS r_start, epoch_ms(ts) // 1000 + 1800 AS r_end FROM events WHERE event_type = 'purchase')
SELECT user_id, count(*) AS n FROM s JOIN r USING (user_id) WHERE start < r_end AND "end" > r_start GROUP BY user_id""")
def interval_overlap(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("s", F.unix_timestamp(c("ts").cast("timestamp")))
    spans = e.groupBy("user_id", c("ts").cast("date").alias("d")).agg(F.min("s").alias("start"), F.max("s").alias("end"))
    ranges = e.where("event_type = 'purchase'").select("user_id", (c("s") - 1800).alias("r_start"), (c("s") + 1800).alias("r_end"))
    return relational.overlapping(spans, ranges, "user_id", 6 * 3600).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, s_suppkey FROM customer LEFT JOIN (
  SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal < 0, s_acctbal DESC, s_suppkey) = 1)
ON c_nationkey = s_nationkey""")
def best_candidate(spark, sf_dir):
    best = relational.first_per_key(t(spark, sf_dir, "supplier"), ["s_nationkey"], c("s_acctbal") < 0, c("s_acctbal").desc(), c("s_suppkey"))
    return t(spark, sf_dir, "customer").join(best, c("c_nationkey") == c("s_nationkey"), "left").select("c_custkey", "s_suppkey")


@query("""
SELECT c_custkey, blank, done, CASE WHEN blank IS NULL THEN 'manquant' WHEN done IS NULL THEN 'manquant' ELSE 'present' END AS status
FROM customer LEFT JOIN (SELECT o_custkey, min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS blank,
  min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS done FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def template_match(spark, sf_dir):
    of = lambda s, name: F.min(F.when(c("o_orderstatus") == s, c("o_orderkey"))).alias(name)
    found = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(of("O", "blank"), of("F", "done"))
    status = F.when(c("blank").isNull() | c("done").isNull(), "manquant").otherwise("present")
    return t(spark, sf_dir, "customer").join(found, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "blank", "done", status.alias("status"))


@query("""
SELECT c_custkey, coalesce(a.s_suppkey, b.s_suppkey) AS linked, CASE WHEN a.s_suppkey IS NOT NULL THEN 'key' WHEN b.s_suppkey IS NOT NULL THEN 'nation' ELSE 'new' END AS how
FROM customer LEFT JOIN supplier a ON a.s_suppkey = c_custkey
LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey) b ON b.s_nationkey = c_nationkey""")
def identity_link(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    by_key = s.select(c("s_suppkey").alias("a"))
    by_nation = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("b"))
    both = t(spark, sf_dir, "customer").join(by_key, c("c_custkey") == c("a"), "left").join(by_nation, c("c_nationkey") == c("s_nationkey"), "left")
    return both.select("c_custkey", F.coalesce("a", "b").alias("linked"), F.when(c("a").isNotNull(), "key").when(c("b").isNotNull(), "nation").otherwise("new").alias("how"))


# Windows, sorts and sets


@query("""
SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents WHERE coalesce(trim(text), '') <> '' GROUP BY md5(text)""")
def dedup_md5(spark, sf_dir):
    return relational.distinct_texts(t(spark, sf_dir, "documents"), "text", c("doc_id")).select("text_md5", "doc_id")


@query("""
SELECT doc_id, source, greatest(0, least(want, 90000 - before))::BIGINT AS take FROM (
  SELECT doc_id, source, want, coalesce(sum(want) OVER (PARTITION BY source ORDER BY pri, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT doc_id, source, CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS pri,
    least(length(text), CASE lang WHEN 'fr' THEN 55000 WHEN 'de' THEN 8000 ELSE 5000 END) AS want FROM documents))""")
def context_budget(spark, sf_dir):
    pri = F.when(c("lang") == "fr", 0).when(c("lang") == "de", 1).otherwise(2)
    cap = F.when(c("lang") == "fr", 55000).when(c("lang") == "de", 8000).otherwise(5000)
    sized = t(spark, sf_dir, "documents").select("doc_id", "source", pri.alias("pri"), cap.alias("cap"), F.char_length("text").alias("size"))
    steps = [c("pri"), F.floor(c("doc_id") / 4096)]
    return relational.within_budget(sized, ["source"], c("size"), c("cap"), 90_000, c("pri"), c("doc_id"), coarse=steps).select("doc_id", "source", "take")


@query("""
SELECT p_partkey, tier, row_number() OVER (ORDER BY tier, p_size DESC, p_retailprice DESC, p_partkey)::INTEGER AS place FROM (
  SELECT *, CASE WHEN contains(lower(p_name), 'green') THEN 1 WHEN contains(lower(p_type), 'green') OR contains(lower(p_type), 'brass') THEN 2 ELSE 3 END AS tier FROM part)
QUALIFY row_number() OVER (ORDER BY tier, p_size DESC, p_retailprice DESC, p_partkey) <= 35""")
def tier_ranking(spark, sf_dir):
    kind = F.lower("p_type")
    tier = F.when(F.lower("p_name").contains("green"), 1).when(kind.contains("green") | kind.contains("brass"), 2).otherwise(3)
    order = [c("tier"), F.coalesce("p_size", F.lit(0)).desc(), F.coalesce("p_retailprice", F.lit(0.0)).desc(), c("p_partkey")]
    top = t(spark, sf_dir, "part").withColumn("tier", tier).orderBy(*order).limit(35)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("p_partkey", "tier", "place")


@query("""
SELECT p_partkey, regexp_extract(p_brand, '(\\d+)', 1)::INTEGER AS num, dense_rank() OVER (ORDER BY regexp_extract(p_brand, '(\\d+)', 1)::INTEGER)::INTEGER AS place FROM part""")
def natural_sort(spark, sf_dir):
    num = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    brands = t(spark, sf_dir, "part").select(num.alias("num")).distinct()
    places = brands.withColumn("place", F.dense_rank().over(Window.orderBy("num")))
    return t(spark, sf_dir, "part").select("p_partkey", num.alias("num")).join(places, "num").select("p_partkey", "num", "place")


@query("""
SELECT event_id, user_id FROM (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE before = 0""")
def until_terminal(spark, sf_dir):
    return relational.until_terminal(t(spark, sf_dir, "events"), "user_id", c("event_type") == "error", c("ts"), c("event_id")).select("event_id", "user_id")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_event(spark, sf_dir):
    at = F.struct("ts", "event_id")
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", at).alias("event_id"), F.max_by("event_type", at).alias("event_type"))


@query("""
WITH b AS (SELECT *, event_type IN ('view', 'click') AS hit, count(*) FILTER (WHERE event_type IN ('view', 'click')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
m AS (SELECT *, count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS misses FROM b),
s AS (SELECT *, max(CASE WHEN misses >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stop FROM m)
SELECT user_id, event_id FROM s WHERE hit AND stop = 0""")
def tabular_run(spark, sf_dir):
    hits = c("event_type").isin("view", "click")
    return relational.runs_of_hits(t(spark, sf_dir, "events"), "user_id", hits, 3, c("ts"), c("event_id")).select("user_id", "event_id")


@query("""
SELECT doc_id, CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '\\.pdf$', '') || '_' || n || '.pdf' END AS unique_name
FROM (SELECT doc_id, source || '.pdf' AS name, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)""")
def dup_suffix(spark, sf_dir):
    named = t(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("source", F.lit(".pdf")).alias("name"))
    return relational.numbered_names(named, ["lang"], "name", c("doc_id"), coarse=[F.floor(c("doc_id") / 4096)]).select("doc_id", "unique_name")


# Aggregates


@query("SELECT event_type, count(*) AS n, count_if(value > 50)::BIGINT AS covered FROM events GROUP BY event_type")
def category_coverage(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), scoring.count_where(c("value") > 50).alias("covered"))


@query("""
SELECT c_custkey, ((c_name IS NOT NULL AND c_name <> '')::INTEGER + (c_acctbal IS NOT NULL)::INTEGER + (CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END <> '')::INTEGER) AS filled FROM customer""")
def profile_completion(spark, sf_dir):
    segment = F.when(c("c_custkey") % 3 == 0, "").otherwise(c("c_mktsegment"))
    return t(spark, sf_dir, "customer").select("c_custkey", scoring.completion([c("c_name"), c("c_acctbal"), segment]).cast("int").alias("filled"))


@query("""
SELECT l_orderkey, round(sum(l_quantity) FILTER (WHERE l_linenumber > 1), 2) AS others, max_by(l_partkey, (l_quantity, -l_linenumber, l_partkey)) AS heaviest FROM lineitem GROUP BY l_orderkey""")
def criteria_weights(spark, sf_dir):
    heavy = F.max_by("l_partkey", F.struct(c("l_quantity"), -c("l_linenumber"), c("l_partkey")))
    others = F.round(F.sum(F.when(c("l_linenumber") > 1, c("l_quantity"))), 2)
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(others.alias("others"), heavy.alias("heaviest"))


@query("""
SELECT o_orderstatus AS old, CASE WHEN o_totalprice > 100000 THEN 'F' ELSE 'O' END AS new, count(*) AS n FROM orders GROUP BY ALL""")
def transitions(spark, sf_dir):
    new = F.when(c("o_totalprice") > 100_000, "F").otherwise("O")
    return t(spark, sf_dir, "orders").groupBy(c("o_orderstatus").alias("old"), new.alias("new")).agg(F.count("*").alias("n"))


def _sheet_cells(spark, sf_dir, two=False):
    """Orders as workbooks: a heading, a row a line item and a displayed total; on one sheet, or on one for odd and one for even lines.

    Line items and orders are dealt by order once, as narrow rows, and become
    cells where they lie; what groups cells by workbook needs no further exchange.
    """
    price = c("l_extendedprice")
    lines = t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("book"), c("l_linenumber").alias("no"), "l_partkey", "l_suppkey", price.alias("price"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("no", "int"), ("l_partkey", "long"), ("l_suppkey", "long"))]
    orders = t(spark, sf_dir, "orders").select(c("o_orderkey").alias("book"), *none, c("o_totalprice").alias("price"))
    both = lines.withColumn("item", F.lit(True)).unionByName(orders.withColumn("item", F.lit(False)))
    # A fixed number: joined by their narrow bytes, few tasks would make and sort all the cells.
    both = both.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "book")
    order = Window.partitionBy("book", "item").orderBy("no", "l_partkey", "l_suppkey", "price")
    both = both.withColumn("n", F.row_number().over(order))
    sheet = F.when(c("no") % 2 == 0, "s2").otherwise("s1") if two else F.lit("s1")
    shown = F.format_string("%.2f", c("price"))
    amount = F.when(c("no") % 5 == 4, "").otherwise(F.replace(shown, F.lit("."), F.lit(",")))
    cell = lambda sheet, row, col, value: F.struct(sheet.alias("sheet"), row.cast("int").alias("row"), F.lit(col).alias("col"), value.alias("value"))
    head = lambda sheet: [cell(F.lit(sheet), F.lit(0), 0, F.lit("Désignation")), cell(F.lit(sheet), F.lit(0), 1, F.lit("Montant HT"))]
    ends = [*head("s1"), cell(F.lit("s1"), F.lit(99), 0, F.lit("Total HT")), cell(F.lit("s1"), F.lit(99), 1, shown), *(head("s2") if two else [])]
    body = [cell(sheet, c("n"), 0, F.concat(F.lit("poste "), c("l_partkey").cast("string"))), cell(sheet, c("n"), 1, amount)]
    return both.select("book", F.inline(F.when(c("item"), F.array(*body)).otherwise(F.array(*ends))))


_SHEET_SQL = """
SELECT o_orderkey AS book, count(l_orderkey) AS lines, count(a) AS filled, count(l_orderkey) - count(a) AS empty,
  round_even(sum(a), 2) AS total,
  count(l_orderkey) = count(a) AND NOT coalesce(abs(round_even(sum(a), 2) - any_value(round(o_totalprice, 2))) > 1, false) AS valid
FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN l_linenumber % 5 <> 4 THEN round(l_extendedprice, 2) END AS a FROM lineitem) ON l_orderkey = o_orderkey
GROUP BY o_orderkey"""


@query(_SHEET_SQL)
def price_sheet_check(spark, sf_dir):
    return pricing.check_sheets(_sheet_cells(spark, sf_dir)).select("book", "lines", "filled", "empty", "total", "valid")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber % 2 AS sheet, CASE WHEN l_linenumber % 5 <> 4 THEN round(l_extendedprice, 2) END AS a FROM lineitem),
b AS (SELECT o_orderkey, count(l_orderkey) AS lines, count(a) AS filled, sum(a) FILTER (WHERE sheet = 1) AS s1, sum(a) FILTER (WHERE sheet = 0) AS s2, any_value(round(o_totalprice, 2)) AS shown FROM orders LEFT JOIN a ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT o_orderkey AS book, 2::BIGINT AS sheets, lines, filled, lines - filled AS empty, CASE WHEN s1 IS NOT NULL OR s2 IS NOT NULL THEN round_even(coalesce(round_even(s1, 2), 0) + coalesce(round_even(s2, 2), 0), 2) END AS total,
  lines = filled AND NOT coalesce(abs(round_even(s1, 2) - shown) > 1, false) AND lines > 0 AS valid, lines - filled + coalesce(abs(round_even(s1, 2) - shown) > 1, false)::INTEGER AS warnings
FROM b""")
def price_sheet_rollup(spark, sf_dir):
    """Workbooks of two sheets: odd lines with the displayed total, even lines without."""
    books = pricing.merge_books(pricing.check_sheets(_sheet_cells(spark, sf_dir, two=True)))
    return books.select("book", "sheets", "lines", "filled", "empty", "total", "valid", F.size("warnings").cast("long").alias("warnings"))


@query("""
WITH s AS (SELECT p_partkey AS k, 1 AS seq, 'excel' AS src, 85 AS conf, 'Lot' AS nom FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT l_partkey, 2, 'rc_text', 90, 'Lot ' || repeat('x', (l_partkey % 5)::INTEGER) FROM (SELECT DISTINCT l_partkey FROM lineitem)
  UNION ALL SELECT s_suppkey, 3, 'filename', 55, 'Lot xx' FROM supplier)
SELECT k, least(100, min_by(conf, seq) + 15 * (count(DISTINCT src) - 1))::INTEGER AS confidence, list(src ORDER BY seq) AS sources,
  arg_max(nom, (length(nom), -seq)) AS nom FROM s GROUP BY k""")
def multi_source_merge(spark, sf_dir):
    row = lambda key, seq, src, conf, nom: [key.alias("k"), F.lit(seq).alias("seq"), F.lit(src).alias("src"), F.lit(conf).alias("conf"), nom.alias("nom")]
    sheets = t(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(*row(c("p_partkey"), 1, "excel", 85, F.lit("Lot")))
    seen = t(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    texts = seen.select(*row(c("l_partkey"), 2, "rc_text", 90, F.concat(F.lit("Lot "), F.repeat(F.lit("x"), (c("l_partkey") % 5).cast("int")))))
    names = t(spark, sf_dir, "supplier").select(*row(c("s_suppkey"), 3, "filename", 55, F.lit("Lot xx")))
    found = F.array_sort(F.collect_list(F.struct("seq", "src", "conf", "nom")))
    merged = sheets.unionByName(texts).unionByName(names).groupBy("k").agg(found.alias("d"))
    sources = F.array_distinct(c("d.src"))
    start = F.struct(F.get("d", F.lit(0))["nom"].alias("nom"))
    longest = F.aggregate("d", start, lambda s, x: F.when(F.char_length(x["nom"]) > F.char_length(s["nom"]), F.struct(x["nom"].alias("nom"))).otherwise(s), lambda s: s["nom"])
    confidence = F.least(F.lit(100), F.get("d", F.lit(0))["conf"] + 15 * (F.size(sources) - 1))
    return merged.select("k", confidence.cast("int").alias("confidence"), sources.alias("sources"), longest.alias("nom"))


#: Lots of projects and of references, dealt by key.
_PROJECT_LOTS = ["Lot 5 — Façade ITE", "Gros œuvre", None, "Lot 13 Plomberie", "", "Divers"]
_REF_LOTS = ["façade et bardage", "Plomberie sanitaire", None, "béton", "Site pilote"]


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _pick_sql(values, key):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][({key} % {len(values)})::INTEGER + 1]"


def _go_no_go_sql() -> str:
    has = lambda column, words: "(" + _contains_sql(column, words) + ")"
    trade = "CASE " + " ".join(f"WHEN {has('lower(lot_name)', w)} THEN {n}" for n, w in scoring.TRADES) + " END"
    refs = " UNION ALL ".join(f"SELECT org, {n} AS trade FROM r WHERE {has('txt', w)}" for n, w in scoring.TRADES)
    return f"""
WITH r AS (SELECT s_nationkey AS org, lower(coalesce({_pick_sql(_REF_LOTS, 's_suppkey')}, '') || ' ' || s_name) AS txt FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 7 <> 0),
m AS (SELECT org, trade, count(*) AS matched FROM ({refs}) GROUP BY ALL), a AS (SELECT org, count(*) AS refs FROM r GROUP BY org),
p AS (SELECT o_orderkey, o_custkey % 25 AS org, o_orderstatus, CASE WHEN o_orderkey % 10 <> 0 THEN date_diff('day', DATE '1998-06-30', o_orderdate::DATE) END AS d, {_pick_sql(_PROJECT_LOTS, 'o_orderkey')} AS lot_name FROM orders),
q AS (SELECT *, {trade} AS trade FROM p),
s AS (SELECT o_orderkey, CASE WHEN d IS NULL THEN 15 WHEN d <= -1 THEN 0 WHEN d <= 3 THEN 5 WHEN d <= 7 THEN 12 WHEN d <= 14 THEN 20 ELSE 25 END AS temps,
    CASE WHEN coalesce(n, 0) = 0 THEN 5 ELSE round_even(25 * done / n, 0)::INTEGER END AS checklist,
    CASE WHEN coalesce(refs, 0) = 0 THEN 0 WHEN coalesce(lot_name, '') <> '' THEN least(20, 5 * coalesce(matched, 0))::INTEGER ELSE 10 END AS "references",
    CASE WHEN memoire THEN 15 ELSE 0 END AS memoire, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderstatus = 'F' THEN 15 ELSE 8 END AS dpgf
  FROM q LEFT JOIN (SELECT l_orderkey, count(*) AS n, count_if(l_returnflag <> 'N') AS done, bool_or(l_linenumber = 5) AS memoire FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
  LEFT JOIN a USING (org) LEFT JOIN m USING (org, trade))
SELECT o_orderkey AS id, temps, checklist, "references", memoire, dpgf, (temps + checklist + "references" + memoire + dpgf)::INTEGER AS score,
  CASE WHEN temps + checklist + "references" + memoire + dpgf >= 80 THEN 'GO' WHEN temps + checklist + "references" + memoire + dpgf >= 60 THEN 'GO modéré' WHEN temps + checklist + "references" + memoire + dpgf >= 40 THEN 'À RISQUE' ELSE 'NO-GO' END AS verdict FROM s"""


@query(_go_no_go_sql())
def go_no_go(spark, sf_dir):
    o = c("o_orderkey")
    projects = t(spark, sf_dir, "orders").select(
        o.alias("id"), (c("o_custkey") % 25).alias("organization_id"), F.when(o % 10 != 0, c("o_orderdate").cast("date")).alias("deadline"), _pick(_PROJECT_LOTS, o).alias("selected_lot_name"),
        F.when(o % 3 != 0, "file").alias("sheet_url"), (c("o_orderstatus") == "F").alias("sheet_valid"),
    )
    lines = t(spark, sf_dir, "lineitem")
    items = lines.select(c("l_orderkey").alias("project_id"), F.when(c("l_returnflag") != "N", "present").otherwise("manquant").alias("status"))
    references = t(spark, sf_dir, "supplier").select(
        c("s_nationkey").cast("long").alias("organization_id"), _pick(_REF_LOTS, c("s_suppkey")).alias("lot"), c("s_name").alias("intitule"),
        F.when(c("s_suppkey") % 7 == 0, F.lit("2020-01-01").cast("timestamp_ntz")).alias("deleted_at"), (c("s_acctbal") > 0).alias("is_reference"),
    )
    memoires = lines.where("l_linenumber = 5").select(c("l_orderkey").alias("project_id"))
    return scoring.go_no_go(projects, items, references, memoires, F.lit("1998-06-30").cast("date"))


@query("""
SELECT s_suppkey, round(2 * 6371 * atan2(sqrt(a), sqrt(1 - a)), 4) AS km FROM (SELECT s_suppkey,
  pow(sin(radians((s_suppkey % 5)::DOUBLE) / 2), 2) + cos(radians(45.0)) * cos(radians(45.0 + s_suppkey % 5)) * pow(sin(radians((s_suppkey % 7)::DOUBLE) / 2), 2) AS a FROM supplier)""")
def haversine(spark, sf_dir):
    km = scoring.haversine_km(F.lit(45.0), F.lit(2.0), 45.0 + c("s_suppkey") % 5, 2.0 + c("s_suppkey") % 7)
    return t(spark, sf_dir, "supplier").select("s_suppkey", F.round(km, 4).alias("km"))


# Mutations


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 = 0 THEN 'patched' END, c_name) AS c_name FROM customer")
def patch_nonnull(spark, sf_dir):
    base = t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    patch = base.where("c_custkey % 2 = 0").select("c_custkey", F.when(c("c_custkey") % 4 == 0, "patched").alias("c_name"))
    return relational.patched(base, patch, "c_custkey")


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus = 'P'""")
def replace_partition(spark, sf_dir):
    new = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(c("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"))
    return relational.replaced(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), new, "l_orderkey")


@query("""
SELECT coalesce(o_custkey, c_custkey) AS c_custkey, coalesce(v, c_acctbal) AS c_acctbal, CASE WHEN o_custkey IS NULL THEN 1 ELSE coalesce(ver, 0) + 1 END::INTEGER AS version
FROM (SELECT c_custkey, c_acctbal, 1 AS ver FROM customer WHERE c_custkey % 3 <> 0)
FULL JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def upsert_version(spark, sf_dir):
    base = t(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_acctbal", F.lit(1).alias("version"))
    new = t(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return relational.upserted(base, new, "c_custkey", "c_acctbal", "version")


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING')""")
def cascade_delete(spark, sf_dir):
    gone = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("o_custkey"))
    projects = t(spark, sf_dir, "orders").join(gone, "o_custkey", "left_semi").select(c("o_orderkey").alias("l_orderkey"))
    return t(spark, sf_dir, "lineitem").join(projects, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("""
SELECT o_orderkey, list('lot' || l_linenumber || CASE WHEN l_linenumber = 2 THEN ':renamed' ELSE '' END ORDER BY l_linenumber) AS lots
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def lot_rename(spark, sf_dir):
    lots = t(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(c("l_linenumber").alias("id"), F.lit("").alias("label")))).alias("x"))
    named = F.transform("x", lambda e: F.when(e["id"] == 2, F.struct(e["id"].alias("id"), F.lit(":renamed").alias("label"))).otherwise(e))
    spelt = F.transform(named, lambda e: F.concat(F.lit("lot"), e["id"].cast("string"), e["label"]))
    return lots.join(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", spelt.alias("lots"))


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, list_contains(json_keys(props), 'k') AS complete FROM events""")
def json_lenient(spark, sf_dir):
    keys = F.json_object_keys("props")
    k = F.get_json_object("props", "$.k").cast("int")
    return t(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(F.array_contains(keys, "k"), F.lit(False)).alias("complete"))


@query("""
SELECT doc_id // 20 AS project, md5(string_agg(upper(lang) || ':' || doc_id, chr(10) || chr(10) ORDER BY doc_id)) AS block FROM documents GROUP BY ALL""")
def string_blocks(spark, sf_dir):
    """Blocks of a project's documents, which are few, in one text."""
    part = F.struct("doc_id", F.concat(F.upper("lang"), F.lit(":"), c("doc_id").cast("string")).alias("s"))
    rows = t(spark, sf_dir, "documents").groupBy(F.floor(c("doc_id") / 20).alias("project")).agg(F.array_sort(F.collect_list(part)).alias("x"))
    return rows.select("project", F.md5(F.array_join(c("x.s"), "\n\n")).alias("block"))
