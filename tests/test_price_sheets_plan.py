"""Price sheets: cells are exchanged once, as the narrow rows that they are made of, and sorted for the sheets and rows at once."""

import re
from itertools import chain

from pyspark.sql import functions as F

from tendermill.functions import text
from tendermill.plans import registry


def test_one_exchange(spark):
    import __spark_entry__

    plan = registry.QUERIES["price_sheet_rollup"](spark, __spark_entry__.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_digits_of_numbers(spark):
    marks = [" ", "\u00a0", "€", ",", ".", "_", "-", "1", "é"]
    texts = ["".join(x) for x in chain.from_iterable(((a,), (a, b), (a, b, "2")) for a in marks for b in marks)]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", text.number_text(F.col("t")).alias("n")).collect()
    assert all(r.n == re.sub("[ \u00a0€]", "", r.t).replace(",", ".") for r in rows)
