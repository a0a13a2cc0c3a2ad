"""The stateful tracker: snapshots, timers, restarts and the end of its state."""

import time

from tendermill.streaming import progress, tracker
from test_streaming import SCHEMA, SIGNALS

LIVE = [s for s in SIGNALS if (s[0], s[1]) != ("p", 9)]


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def start(spark, tmp_path, name, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = tracker.track(stream, **options)
    writer = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).queryName(name).outputMode("append")
    return writer.trigger(processingTime="200 milliseconds").start()


def rows_kept(spark, tmp_path):
    """Rows of the last checkpointed state."""
    held = lambda name: spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "ck"))
    return held("pipeline").count(), held("steps").count()


def written(spark, tmp_path):
    return spark.read.schema(tracker.SNAPSHOT).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []


def wait(query, condition):
    """A query with timers never runs out of batches, so it is stopped once it has done what it should."""
    for _ in range(200):
        if query.exception():
            raise query.exception()
        if condition():
            return
        time.sleep(0.25)
    raise AssertionError(query.lastProgress)


def test_snapshots_are_those_of_the_batch_and_state_goes_at_the_end(spark, tmp_path):
    """Run, stop, go on from the checkpoint: no snapshot is lost or doubled, and ended projects leave no state."""
    for part in (LIVE[:4], LIVE[4:7]):
        put(spark, tmp_path / "in", part)
    told = lambda: [r for r in written(spark, tmp_path) if not r.live]
    query = start(spark, tmp_path, "first", every=3600)
    wait(query, lambda: len(told()) == 7)
    query.stop()
    assert rows_kept(spark, tmp_path)[0] == 1
    more = [("q", 5, 20.0, "done", "detecting_lots", None), ("q", 6, 21.0, "complete", None, None), ("q", 7, 22.0, "ratio", None, 0.2), ("q", 4, 16.0, "note", None, None)]
    for part in (LIVE[7:], more):
        put(spark, tmp_path / "in", part)
    want = progress.track_batch(spark.createDataFrame([*LIVE, *more[:2]], SCHEMA)).collect()
    query = start(spark, tmp_path, "second", every=3600)
    wait(query, lambda: len(told()) >= len(want))
    query.stop()
    assert rows_kept(spark, tmp_path) == (0, 0)
    assert sorted(tuple(r)[:6] for r in told()) == sorted(map(tuple, want))


def test_timers_tell_the_progress_between_signals(spark, tmp_path):
    put(spark, tmp_path / "in", [("t", 1, 100.0, "start", "lot_detection", None), ("t", 2, 100.0, "step", "detecting_lots", None)])
    query = start(spark, tmp_path, "timers", every=0.5)
    live = lambda: sorted((r.progress, r.remaining, r.seq, r.status) for r in written(spark, tmp_path) if r.live)
    wait(query, lambda: len(live()) >= 3)
    found = live()
    assert {(x[2], x[3]) for x in found} == {(2, "detecting_lots")} and (found[-1][0] > found[0][0] or found[-1][1] < found[0][1])
    put(spark, tmp_path / "in", [("t", 3, 130.0, "complete", None, None)])
    wait(query, lambda: any(r.progress == 100 and not r.live for r in written(spark, tmp_path)))
    query.stop()
    assert rows_kept(spark, tmp_path) == (0, 0)


def test_steps_of_a_pipeline():
    assert tracker.steps_of("memoire") == ["preparing", "generating", "finalizing"] and tracker.steps_of("no such") == tracker.steps_of("analysis")
