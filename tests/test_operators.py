from pyspark.sql import functions as F

from tendermill.operators import pricing, relational, scoring


def cells(book, sheet, rows):
    return [(book, sheet, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None]


HEAD = ("N°", "Désignation", "Montant HT")
S1 = [HEAD, ("1", "Terrassement", "1 200,50"), ("2", "Béton", "800"), ("", "Total HT", "2000.5")]
S2 = [HEAD, ("1", "Peinture", None), ("2", "Sol", "100.0"), (None, "Total", "150.0")]


def test_price_sheets(spark):
    rows = [*cells("one", "S1", S1), *cells("two", "S1", S1), *cells("two", "S2", S2), *cells("bare", "S", [("a", "3", "7"), ("b", None, None)])]
    sheets = pricing.check_sheets(spark.createDataFrame(rows, "book string, sheet string, row int, col int, value string"))
    found = {(r.book, r.sheet): (r.lines, r.filled, r.empty, r.total, r.valid) for r in sheets.collect()}
    assert found[("one", "S1")] == (2, 2, 0, 2000.5, True)
    assert found[("two", "S2")] == (2, 1, 1, 100.0, False)
    assert found[("bare", "S")] == (2, 1, 1, 7.0, True)
    books = {r.book: (r.lines, r.filled, r.empty, r.total, r.valid) for r in pricing.merge_books(sheets).collect()}
    assert books == {"one": (2, 2, 0, 2000.5, True), "two": (4, 3, 1, 2100.5, False), "bare": (2, 1, 1, 7.0, True)}


def test_budget(spark):
    docs = [(1, "cctp", 60_000), (2, "rc", 20_000), *((i, "autre", 6_000) for i in range(3, 10))]
    df = spark.createDataFrame(docs, "i int, kind string, size int").withColumn("p", F.lit("p"))
    cap = F.when(F.col("kind") == "rc", 8000).when(F.col("kind") == "cctp", 55_000).otherwise(5000)
    taken = relational.within_budget(df, ["p"], F.col("size"), cap, 90_000, F.col("i")).orderBy("i").collect()
    assert [r["take"] for r in taken] == [55_000, 8000, 5000, 5000, 5000, 5000, 5000, 2000, 0]


def test_names_and_runs(spark):
    df = spark.createDataFrame([(1, "Kbis.pdf"), (2, "Kbis.pdf"), (3, "a.txt")], "i int, name string").withColumn("f", F.lit(1))
    assert [r.unique_name for r in relational.numbered_names(df, ["f"], "name", F.col("i")).orderBy("i").collect()] == ["Kbis.pdf", "Kbis_2.pdf", "a.txt"]
    hits = spark.createDataFrame([(i, h) for i, h in enumerate([1, 0, 1, 0, 0, 0, 1])], "i int, h int").withColumn("k", F.lit(1))
    assert [r.i for r in relational.runs_of_hits(hits, "k", F.col("h") == 1, 3, F.col("i")).orderBy("i").collect()] == [0, 2]


def test_scores(spark):
    row = spark.range(1).select(
        scoring.percent_half_even(F.lit(1), F.lit(8)), scoring.checklist_points(F.lit(1), F.lit(2)), scoring.time_points(F.lit(None).cast("int")),
        scoring.verdict(F.lit(100)), scoring.verdict(F.lit(30)), scoring.reference_points(F.lit("lot"), F.lit(4), F.lit(4)),
    ).first()
    assert tuple(row) == (12, 12, 15, "GO", "NO-GO", 20)


def test_mutations(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 3)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in relational.upserted(base, new, "k", "v", "n").collect()} == {(1, "a", 1), (2, "c", 4), (3, "d", 1)}
    assert {tuple(r) for r in relational.replaced(base.select("k", "v"), new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_overlap_counts_each_pair_once(spark):
    spans = spark.createDataFrame([(1, 0, 100), (1, 95, 400)], "k int, start long, end long")
    ranges = spark.createDataFrame([(1, 90, 350), (1, 400, 500)], "k int, r_start long, r_end long")
    assert {(r.start, r.r_start) for r in relational.overlapping(spans, ranges, "k", 50).collect()} == {(0, 90), (95, 90)}
    assert relational.overlapping(spans, ranges, "k", 50).count() == 2
