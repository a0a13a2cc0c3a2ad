from tendermill.streaming import events, progress

SIGNALS = [
    ("p", 1, 0.0, "start", "memoire", None), ("p", 2, 0.0, "step", "preparing", None), ("p", 3, 1.0, "done", "preparing", None), ("p", 4, 1.0, "step", "generating", None),
    ("p", 5, 2.0, "ratio", None, 0.5), ("p", 6, 3.0, "ratio", None, 1.5), ("p", 7, 4.0, "done", "generating", None), ("p", 8, 9.0, "complete", None, None), ("p", 9, 9.5, "ratio", None, 0.1),
    ("q", 1, 0.0, "ratio", None, 0.5), ("q", 2, 0.0, "start", "lot_detection", None), ("q", 3, 1.0, "step", "detecting_lots", None), ("q", 4, 16.0, "note", None, None),
    ("r", 1, 0.0, "start", "no such pipeline", None), ("r", 2, 1.0, "error", "panne", None),
]
SCHEMA = "project string, seq long, at double, kind string, step string, ratio double"
EXPECTED = {
    ("p", 1): 0, ("p", 2): 0, ("p", 3): 10, ("p", 4): 10, ("p", 5): 47, ("p", 6): 84, ("p", 7): 85, ("p", 8): 100, ("p", 9): 100, ("q", 2): 0, ("q", 3): 0, ("q", 4): 50, ("r", 1): 0, ("r", 2): 0,
}


def test_batch(spark):
    rows = progress.track_batch(spark.createDataFrame(SIGNALS, SCHEMA)).collect()
    assert {(r.project, r.seq): r.progress for r in rows} == EXPECTED
    told = {(r.project, r.seq): (r.status, r.step, r.remaining) for r in rows}
    assert told["p", 5] == ("generating", "Rédaction du mémoire", 124) and told["p", 8] == ("completed", "Terminé", 0) and told["r", 2] == ("error", "panne", 107)


def test_stream_gives_the_batch_result(spark, tmp_path):
    source = str(tmp_path / "signals")
    for part in (SIGNALS[:4], SIGNALS[4:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    run = progress.track_stream(stream).writeStream.format("memory").queryName("snapshots").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.project, r.seq): r.progress for r in spark.table("snapshots").collect()} == EXPECTED


def test_audit_extra(spark):
    from pyspark.sql import functions as F

    long = '{"a": "' + "x" * 11_000 + '"}'
    rows = spark.createDataFrame([("{}",), (long,), (None,)], "extra string").select(progress.bounded_extra(F.col("extra"))).collect()
    assert [r[0] for r in rows] == ["{}", '{"_truncated":true,"_keys":["a"]}', None]


def run_stream(spark, path, rows, schema, made, name):
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    made(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name).collect()


def test_throttled_stream_keeps_the_last_time(spark, tmp_path):
    schema = "project string, seq long, at double"
    rows = [[("a", 1, 0.0), ("a", 2, 0.2), ("a", 3, 0.3)], [("a", 4, 0.5), ("a", 5, 0.7), ("b", 6, 0.1)]]
    found = run_stream(spark, str(tmp_path / "t"), rows, schema, events.throttled_stream, "spaced")
    assert {(r.project, r.seq) for r in found} == {("a", 1), ("a", 3), ("a", 5), ("b", 6)}
    assert {(r.project, r.seq) for r in events.throttled(spark.createDataFrame(rows[0] + rows[1], schema)).collect()} == {("a", 1), ("a", 3), ("a", 5), ("b", 6)}


def test_events_pass_the_heartbeat_stream(spark, tmp_path):
    found = run_stream(spark, str(tmp_path / "h"), [[("a", "progress"), ("b", "complete")]], "project string, kind string", events.heartbeat_stream, "alive")
    assert {(r.project, r.kind) for r in found} >= {("a", "progress"), ("b", "complete")}


def test_billing_stream_replaces_plans(spark, tmp_path):
    schema = "organization_id string, at long, seq long, type string, plan string, subscription string"
    done, gone = "checkout.session.completed", "customer.subscription.deleted"
    for n, part in enumerate([[("a", 1, 1, done, "pro", "s1"), ("b", 1, 2, done, "pro", "s2")], [("a", 2, 3, gone, None, None), ("c", 2, 4, "invoice.paid", "pro", "x")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events.billing_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "version=1")).collect()} == {("a", "free", None), ("b", "pro", "s2")}
