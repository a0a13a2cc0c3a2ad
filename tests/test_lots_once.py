"""Detections of lots are made once a row: work that each keyword or test repeats shows in the plan."""

import random
import re

from pyspark.sql import functions as F

from tendermill.operators import lots


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_sheet_name_is_normalised_once(spark):
    plan = _plan(spark.createDataFrame([("Lot 1",)], "name string").select(lots.in_sheet_name(F.col("name")).alias("d")))
    assert plan.count("translate(") == 1


def test_detections_of_a_project_are_made_once(spark):
    documents = spark.createDataFrame([(1, 10, "Lot 2.xlsx", "dpgf", "")], "project long, doc_id long, file_name string, kind string, text string")
    cells = spark.createDataFrame([(10, 0, "Peinture", 0, 0, "x")], "book long, sheet_no int, sheet string, row int, col int, value string")
    filters = [line for line in _plan(lots.detect(documents, cells)).splitlines() if "Filter" in line]
    assert not [line for line in filters if "lot[" in line and "regexp_extract" in line]


def test_first_detections_among_many(spark):
    draw = random.Random(5)
    rows = [(i, [f"lot{draw.randrange(30)}" for _ in range(draw.randrange(200))]) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, ids array<string>")
    found = lots._firsts(F.transform("ids", lambda x, k: F.struct(x.alias("id"), k.alias("k"))))
    got = {r.i: [(x["id"], x["k"]) for x in r.f] for r in df.select("i", found.alias("f")).collect()}
    assert got == {i: sorted(((x, ids.index(x)) for x in set(ids)), key=lambda p: p[1]) for i, ids in rows}
    plan = _plan(df.select(found.alias("f")))
    assert len(re.findall(r"transform\(ids", plan)) == 1
