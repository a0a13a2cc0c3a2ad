"""Queries of progress and event streams, as batches over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermill.plans.base import EVENTS_ASOF, c, query, t
from tendermill.streaming import events, progress


def _events(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.select(c("user_id").alias("project"), c("event_id").alias("seq"), F.unix_timestamp(c("ts").cast("timestamp")).alias("at"), c("event_type").alias("kind"))


_SQL = "(SELECT user_id AS project, event_id AS seq, (epoch_us(ts) // 1000000)::BIGINT AS \"at\", event_type AS kind FROM events)"


@query(f"""
SELECT project, "at" + 7200 * i AS "at" FROM (SELECT project, "at", unnest(range(1, (gap - 1) // 7200 + 1)) AS i
  FROM (SELECT project, "at", lead("at") OVER (PARTITION BY project ORDER BY "at", seq) - "at" AS gap FROM {_SQL}) WHERE gap > 7200)""")
def heartbeats(spark, sf_dir):
    return events.heartbeats(_events(spark, sf_dir), 7200)


@query(f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY "at", seq) AS n FROM {_SQL}),
w AS (SELECT project, n, seq, "at", "at" AS last, true AS sent FROM o WHERE n = 1
  UNION ALL SELECT o.project, o.n, o.seq, o."at", CASE WHEN o."at" - w.last >= 86400 THEN o."at" ELSE w.last END, o."at" - w.last >= 86400 FROM w JOIN o ON o.project = w.project AND o.n = w.n + 1)
SELECT project, seq, "at" FROM w WHERE sent""")
def throttle(spark, sf_dir):
    return events.throttled(_events(spark, sf_dir), 86400)


@query(f"""
SELECT project, seq, kind FROM {_SQL} WHERE "at" > epoch_ms(TIMESTAMP '{EVENTS_ASOF}') // 1000 - 86400
UNION ALL SELECT project, max_by(seq, ("at", seq)) FILTER (WHERE "at" <= epoch_ms(TIMESTAMP '{EVENTS_ASOF}') // 1000 - 86400), 'init' FROM {_SQL} GROUP BY project""")
def catch_up(spark, sf_dir):
    asof = F.unix_timestamp(F.lit(EVENTS_ASOF).cast("timestamp")) - 86400
    return events.caught_up(_events(spark, sf_dir), asof).select("project", "seq", "kind")


@query(f"""
SELECT project AS organization_id, CASE max_by(kind, ("at", seq)) WHEN 'purchase' THEN 'pro' WHEN 'signup' THEN 'business' ELSE 'free' END AS plan,
  CASE WHEN max_by(kind, ("at", seq)) = 'error' THEN NULL ELSE 's' || max_by(seq, ("at", seq)) END AS subscription FROM {_SQL} WHERE kind IN ('purchase', 'signup', 'error') GROUP BY project""")
def billing_upserts(spark, sf_dir):
    kind = F.when(c("kind") == "purchase", "checkout.session.completed").when(c("kind") == "signup", "customer.subscription.updated").when(c("kind") == "error", "customer.subscription.deleted").otherwise("invoice.paid")
    rows = _events(spark, sf_dir).select(c("project").alias("organization_id"), "at", "seq", kind.alias("type"), F.when(c("kind") == "purchase", "pro").otherwise("business").alias("plan"), F.concat(F.lit("s"), c("seq").cast("string")).alias("subscription"))
    return events.billing(rows)


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size % 5 <> 0 AND p_size * 20000 > 512000 THEN 2 ELSE 1 END AS phase, CASE WHEN p_partkey % 2 = 0 AND p_size % 5 <> 0 AND p_size * 20000 > 512000 THEN '[document volumineux - f' || p_partkey || '.pdf]' END AS placeholder FROM part""")
def extraction_phases(spark, sf_dir):
    k = c("p_partkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 2 == 0, ".pdf").otherwise(".docx"))
    rows = t(spark, sf_dir, "part").select(k, name.alias("file_name"), F.when(c("p_size") % 5 == 0, "rc").otherwise("plan").alias("type"), (c("p_size") * 20000).alias("size"))
    return events.extraction_phases(rows).select("p_partkey", "phase", "placeholder")


_SIGNALS = [("start", "memoire", 0.0), ("step", "preparing", 0.0), ("done", "preparing", 3.0), ("step", "generating", 3.0), ("ratio", 0.5, 10.0), ("ratio", 1.5, 20.0), ("step", "finalizing", 90.0), ("error", "panne", 95.0)]


@query("""
SELECT s_suppkey AS project, k AS seq, v.status, v.step, v.progress, v.remaining FROM supplier, (VALUES
  (0, 'running', 'Préparation des données', 0, 128), (1, 'preparing', 'Préparation des données', 0, 128), (2, 'running', 'Rédaction du mémoire', 10, 125), (3, 'generating', 'Rédaction du mémoire', 10, 125),
  (4, 'generating', 'Rédaction du mémoire', 47, 118), (5, 'generating', 'Rédaction du mémoire', 84, 108), (6, 'generating', 'Rédaction du mémoire', 84, 38), (7, 'generating', 'panne', 84, 28)) v(k, status, step, progress, remaining)""")
def pipeline_fsm(spark, sf_dir):
    row = lambda i, s: F.struct(F.lit(i).cast("long").alias("seq"), F.lit(s[2]).alias("at"), F.lit(s[0]).alias("kind"), F.lit(s[1] if isinstance(s[1], str) else None).cast("string").alias("step"), F.lit(s[1] if isinstance(s[1], float) else None).cast("double").alias("ratio"))
    rows = t(spark, sf_dir, "supplier").select(c("s_suppkey").cast("string").alias("project"), F.inline(F.array(*[row(i, s) for i, s in enumerate(_SIGNALS)])))
    out = progress.track_batch(rows)
    return out.select(c("project").cast("long").alias("project"), "seq", "status", "step", "progress", "remaining")


@query("SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {\"seq\":' || event_id || ',\"user\":' || user_id || '}' || chr(10) || chr(10) AS message FROM events")
def sse_messages(spark, sf_dir):
    data = F.to_json(F.struct(c("event_id").alias("seq"), c("user_id").alias("user")))
    return t(spark, sf_dir, "events").select("event_id", events.message(c("event_type"), data).alias("message"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"_truncated\":true,\"_keys\":[\"k\"]}' WHEN event_id % 3 = 1 THEN '{\"_serialization_error\":true}' ELSE props END AS extra FROM events")
def audit_extra(spark, sf_dir):
    k = c("event_id") % 3
    long = F.concat(F.lit('{"k": "'), F.repeat(F.lit("x"), 11_000), F.lit('"}'))
    return t(spark, sf_dir, "events").select("event_id", progress.bounded_extra(F.when(k == 0, long).when(k == 1, "no json").otherwise(c("props"))).alias("extra"))
