"""Progress in batches: many projects pass one task without a frame for each."""

import math

from pyspark.sql import functions as F

from tendermill.streaming import progress

SCHEMA = "project string, seq long, at double, kind string, step string, ratio double"


def test_projects_split_over_batches_equal_the_fold(spark):
    import pandas as pd

    one = [(1, 0.0, "ratio", None, 0.5), (2, 0.0, "start", "memoire", None), (3, 1.0, "step", "preparing", None), (4, 2.0, "done", "preparing", None), (5, 3.0, "step", "generating", None), (6, 4.0, "ratio", None, math.nan), (7, 5.0, "ratio", None, 0.4), (8, 9.0, "error", "panne", None)]
    rows = [(None if p == 0 else f"p{p}", *s[: 1], s[1] + p, *s[2:]) for p in range(60) for s in reversed(one)]
    signals = spark.createDataFrame(rows, SCHEMA)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = sorted(map(tuple, progress.track_batch(signals).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    frame = pd.DataFrame(rows, columns=["project", "seq", "at", "kind", "step", "ratio"])
    want = [x for name, own in frame.groupby("project", dropna=False) for x in progress._fold(None if name != name else name, None, own)[1]]
    assert got == sorted(want, key=str) and len(got) == 60 * 7


def test_no_frame_for_each_project(spark):
    plan = progress.track_batch(spark.createDataFrame([("p", 1, 0.0, "start", "memoire", None)], SCHEMA).withColumn("more", F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
