"""Mixing sources to target weights by temperature.

Shares of the sources' tokens are raised to an exponent and normalised.  The
exponent starts at 1 (the corpus as it is) and is bisected down to the largest
value whose weights reach a target entropy, and then up again, if need be, to
the smallest value at which no source is repeated more than a limit allows.
The weights are realised as block permutations: each source is cut into blocks
by a keyed hash, an epoch of a source is a keyed permutation of its blocks and
of the documents in each, and epochs follow one another until the source's
budget of tokens is filled.  A prefix sum over block totals says which blocks
an epoch takes whole; only the block in which the budget ends is ordered
document by document, so a source with a third of all rows is as many small
groups as any other.

The control values (shares, exponent, weights) are one row a source; the rows
never leave Spark.

Defined results: tokens are words; a NULL source is a source of its own;
documents without words weigh nothing and are placed in every epoch whose
block they belong to; NULL ids are placed like any others; repeated rows follow
one another in the stream, and where the budget ends among them, as many as begin
before its end are placed (which of them is open); extra columns pass through
:func:`mix`; an empty table gives an empty plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermill.llm.common import WORD, materialise, numbered

STEPS = 40
#: Target entropy as a part of the highest possible, ln(number of sources).
EVENNESS = 0.98
MAX_EPOCHS = 4.0
BLOCK_ROWS = 2000
SEED = "mix"
#: Copies of one row that a task writes out at most.
COPIES = 100_000


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def weights(totals: DataFrame, budget: Column, evenness: float = EVENNESS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``weight`` to ``totals(src, tokens, rows)``, one row a source.

    All sources' totals meet in one array, in which each step of the bisection
    is an expression.  The number of sources must fit in a row; the number of
    documents does not matter.
    """
    listed = totals.where("tokens > 0").agg(F.array_sort(F.collect_list(F.struct("src", "tokens"))).alias("s"), budget.alias("budget"))
    all_ = F.aggregate("s", F.lit(0.0), lambda t, x: t + x["tokens"])
    listed = listed.withColumn("p", F.transform("s", lambda x: x["tokens"] / all_))

    def at(alpha: Column) -> Column:
        raised = F.transform("p", lambda p: F.pow(p, alpha))
        return F.transform(raised, lambda w: w / F.aggregate(raised, F.lit(0.0), lambda t, x: t + x))

    def entropy(alpha: Column) -> Column:
        return F.aggregate(at(alpha), F.lit(0.0), lambda t, w: t - w * F.log(w))

    def epochs(alpha: Column) -> Column:
        pairs = F.arrays_zip(at(alpha).alias("w"), F.col("s"))
        return F.aggregate(pairs, F.lit(0.0), lambda t, x: F.greatest(t, x["w"] * F.col("budget") / x["s"]["tokens"]))

    def bisect(low: Column, good_is_low, good) -> Column:
        """Between ``low`` and 1, the last value on the good side."""
        pair = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))

        def step(r: Column, _: Column) -> Column:
            mid = (r["lo"] + r["hi"]) / 2
            to_low, to_high = pair(r["lo"], mid), pair(mid, r["hi"])
            return F.when(good(mid), to_high if good_is_low else to_low).otherwise(to_low if good_is_low else to_high)

        out = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), pair(low, F.lit(1.0)), step)
        return out["lo"] if good_is_low else out["hi"]

    target = evenness * F.log(F.size("s"))
    even = F.when(entropy(F.lit(1.0)) >= target, F.lit(1.0)).otherwise(bisect(F.lit(0.0), True, lambda a: entropy(a) >= target))
    listed = listed.withColumn("even", even)
    fits = lambda a: epochs(a) <= max_epochs
    listed = listed.withColumn("alpha", F.when(fits(F.col("even")), F.col("even")).otherwise(bisect(F.col("even"), False, fits)))
    found = listed.select("alpha", "budget", F.explode(F.arrays_zip(at(F.col("alpha")).alias("weight"), F.col("s"))).alias("x"))
    found = found.select(F.col("x.s.src").alias("src"), "alpha", F.col("x.weight").alias("weight"), (F.col("x.weight") * F.col("budget")).alias("quota"))
    return totals.join(found, totals["src"].eqNullSafe(found["src"]), "left").drop(found["src"])


def _hashed(docs: DataFrame, sources: DataFrame, block_rows: int, seed: str) -> DataFrame:
    """Add ``h``, the hash of a row, and ``block``; a block holds about ``block_rows`` rows or, in large sources, sqrt(rows)."""
    size = F.greatest(F.lit(float(block_rows)), F.sqrt("rows"))
    cut = sources.select(F.col("src").alias("s_src"), F.greatest(F.lit(1), F.ceil(F.col("rows") / size)).cast("long").alias("n_blocks"))
    h = _digest(F.lit(seed), F.col("src"), F.col("doc_id"), F.col("key"))
    dealt = docs.join(cut, F.col("src").eqNullSafe(F.col("s_src"))).withColumn("h", h)
    return dealt.withColumn("block", F.pmod(_number(F.col("h")), F.col("n_blocks"))).drop("s_src", "n_blocks")


def _within(seed: str) -> Column:
    return _digest(F.lit(seed), F.col("epoch"), F.col("h"))


def _key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def _schedule(docs: DataFrame, budget: int | None, evenness: float, max_epochs: float, block_rows: int, seed: str):
    """Rows without texts, the sources with their weights, and the blocks that each epoch takes.

    ``cut`` is NULL for a block taken whole, else the last ``within`` taken;
    ``cut_copies`` says how many of its equal rows are, if not all.
    """
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = materialise(docs.select("doc_id", F.col("source").alias("src"), n.alias("n_tokens"), _key().alias("key")), "mix-rows")
    totals = rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    target = F.sum("tokens") if budget is None else F.lit(budget)
    sources = materialise(weights(totals, target.cast("double"), evenness, max_epochs).coalesce(1), "mix-sources")
    dealt = _hashed(rows, sources, block_rows, seed)

    sums = dealt.groupBy("src", "block").agg(F.sum("n_tokens").alias("b_tokens"))
    quota = sources.select(F.col("src").alias("q_src"), "tokens", F.coalesce(F.floor("quota"), F.lit(0)).cast("long").alias("quota"))
    blocks = sums.join(quota, F.col("src").eqNullSafe(F.col("q_src"))).drop("q_src")
    last = F.when(F.col("tokens") > 0, F.floor((F.col("quota") - 1) / F.col("tokens"))).otherwise(-1).cast("int")
    blocks = blocks.where(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    blocks = blocks.withColumn("order", _digest(F.lit(seed), F.col("epoch"), F.col("src"), F.col("block")))
    before = Window.partitionBy("src", "epoch").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    run = F.col("epoch") * F.col("tokens") + F.coalesce(F.sum("b_tokens").over(before), F.lit(0))
    blocks = blocks.withColumn("b_start", run).where("b_start < quota").drop("tokens", "order")

    ends = _placed(dealt, blocks.where("b_start + b_tokens > quota"), seed)
    ends = ends.groupBy("src", "block", "epoch").agg(F.max(F.struct("within", "taken", "copies")).alias("last"))
    ends = ends.withColumns({"cut": F.col("last.within"), "cut_copies": F.when(F.col("last.taken") < F.col("last.copies"), F.col("last.taken"))})
    ends = ends.select(F.col("src").alias("e_src"), F.col("block").alias("e_block"), F.col("epoch").alias("e_epoch"), "cut", "cut_copies")
    same = F.col("src").eqNullSafe(F.col("e_src")) & (F.col("block") == F.col("e_block")) & (F.col("epoch") == F.col("e_epoch"))
    blocks = blocks.join(ends, same, "left").drop("e_src", "e_block", "e_epoch")
    return dealt, sources, materialise(blocks, "mix-blocks")


def _meet(dealt: DataFrame, blocks: DataFrame) -> DataFrame:
    b = blocks.withColumnsRenamed({"src": "b_src", "block": "b_block"})
    return dealt.join(b, F.col("src").eqNullSafe(F.col("b_src")) & (F.col("block") == F.col("b_block"))).drop("b_src", "b_block")


def _placed(dealt: DataFrame, blocks: DataFrame, seed: str) -> DataFrame:
    """Units of equal rows that lie before the quota, with their ``start`` in the stream of their source.

    Equal rows (source, id and text) are one unit of ``copies``, which follow
    one another in the stream; ``taken`` of them begin before the quota.
    """
    units = dealt.groupBy("src", "block", "h").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.count("*").alias("copies"))
    ahead = Window.partitionBy("src", "block", "epoch").orderBy("within", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("b_start") + F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")).over(ahead), F.lit(0))
    out = _meet(units, blocks).withColumn("within", _within(seed)).withColumn("start", start).where("start < quota")
    room = F.ceil((F.col("quota") - F.col("start")) / F.col("n_tokens"))
    return out.withColumn("taken", F.when(F.col("n_tokens") == 0, F.col("copies")).otherwise(F.least("copies", room)).cast("long"))


def _unfolded(units: DataFrame) -> DataFrame:
    """One row a taken copy; units of very many copies are dealt out in pieces first."""
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / COPIES).cast("long")))
    few = units.where(F.col("taken") <= COPIES).withColumn("piece", F.lit(0).cast("long"))
    many = units.where(F.col("taken") > COPIES).withColumn("piece", pieces).repartition("h", "epoch", "piece")
    first = F.col("piece") * COPIES
    both = few.unionByName(many).withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES, "taken") - 1)))
    return both.withColumn("start", F.col("start") + F.col("copy") * F.col("n_tokens"))


def plan(
    docs: DataFrame,
    budget: int | None = None,
    evenness: float = EVENNESS,
    max_epochs: float = MAX_EPOCHS,
    block_rows: int = BLOCK_ROWS,
    seed: str = SEED,
) -> DataFrame:
    """Placements ``doc_id, source, epoch, block, n_tokens, start``.

    ``start`` counts the tokens of the source's stream before the document.
    The budget is all tokens of ``docs`` unless given.
    """
    dealt, _, blocks = _schedule(docs, budget, evenness, max_epochs, block_rows, seed)
    return _unfolded(_placed(dealt, blocks, seed)).select("doc_id", F.col("src").alias("source"), "epoch", "block", "n_tokens", "start")


def mix(
    docs: DataFrame,
    budget: int | None = None,
    evenness: float = EVENNESS,
    max_epochs: float = MAX_EPOCHS,
    block_rows: int = BLOCK_ROWS,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` in the target proportions: some rows left out, some repeated.

    Texts meet the table of blocks, which Spark broadcasts if it is small
    enough; the documents themselves are not ordered again.
    """
    cols = docs.columns
    _, sources, blocks = _schedule(docs, budget, evenness, max_epochs, block_rows, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")
    here = docs.select(row, "doc_id", F.col("source").alias("src"), _key().alias("key"))
    met = _meet(_hashed(here, sources, block_rows, seed), blocks).withColumn("within", _within(seed))
    parted = F.coalesce((F.col("within") == F.col("cut")) & F.col("cut_copies").isNotNull(), F.lit(False))
    whole = met.where("cut is null or within <= cut").where(~parted).select("row.*")
    # Of the equal rows in which a source's budget ends, as many as fit; there is one such unit a source at most.
    some = numbered(met.where(parted).select("row", "src", "block", "epoch", "cut_copies"), "mix-cut", "src", "block", "epoch")
    return whole.unionByName(some.where("number <= cut_copies").select("row.*"))
