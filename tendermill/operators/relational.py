"""Filters, joins, windows and set operations over tender tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(df: DataFrame, tenant: Column, deleted_at: str = "deleted_at", include_deleted: bool = False) -> DataFrame:
    """Rows of one tenant that are not deleted; both predicates reach the scan."""
    kept = df.where(tenant)
    return kept if include_deleted else kept.where(F.col(deleted_at).isNull())


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; Spark limits each map task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def distinct_texts(df: DataFrame, text: str, *order: Column, keys: list[str] | None = None) -> DataFrame:
    """One row of each non-empty text (of each key), by digest."""
    known = df.where(F.coalesce(F.trim(text), F.lit("")) != "").withColumn("text_md5", F.md5(text))
    return first_per_key(known, [*(keys or []), "text_md5"], *order)


def running_before(df: DataFrame, keys: list[str], value: Column, name: str, coarse: list[Column], *order: Column) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of a key that come before in ``order``.

    ``coarse`` are steps of the order (rows of an earlier step come earlier): sums
    are made within steps and over the totals of steps, so a key with a third of
    all rows is as many tasks as it has steps.
    """
    steps = [f"_s{i}" for i in range(len(coarse))]
    df = df.withColumns(dict(zip(steps, coarse)) | {"_v": value})
    totals = df.groupBy(*keys, *steps).agg(F.sum("_v").alias("_t"))
    ahead = Window.partitionBy(*keys).orderBy(*steps).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(ahead), F.lit(0))).drop("_t")
    here = Window.partitionBy(*keys, *steps).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("_inside", F.coalesce(F.sum("_v").over(here), F.lit(0)))
    renamed = totals.withColumnsRenamed({c: f"_r{c}" for c in [*keys, *steps]})
    same = F.lit(True)
    for c in [*keys, *steps]:
        same = same & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    out = inside.join(renamed, same).withColumn(name, F.col("_base") + F.col("_inside"))
    return out.drop("_v", "_base", "_inside", *steps, *[f"_r{c}" for c in [*keys, *steps]])


def within_budget(df: DataFrame, keys: list[str], size: Column, cap: Column, budget: int, *order: Column, coarse: list[Column] | None = None) -> DataFrame:
    """Add ``take``: characters that each row gets until the budget of its key is used up.

    With ``coarse`` steps of the order, a key that very many rows share is dealt over tasks.
    """
    out = df.withColumn("_want", F.least(size, cap))
    if coarse:
        out = running_before(out, keys, F.col("_want"), "_before", coarse, *order)
    else:
        ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_before", F.coalesce(F.sum("_want").over(ahead), F.lit(0)))
    return out.withColumn("take", F.greatest(F.lit(0), F.least(F.col("_want"), F.lit(budget) - F.col("_before"))).cast("long")).drop("_want", "_before")


def overlapping(spans: DataFrame, ranges: DataFrame, key: str, bucket: int) -> DataFrame:
    """Pairs of one key with ``start < r_end`` and ``end > r_start``.

    Both sides are cut into buckets and joined by (key, bucket); a pair counts
    in the bucket where the later of the two starts.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    left = spans.withColumn("_b", cells("start", "end"))
    right = ranges.withColumn("_b", cells("r_start", "r_end"))
    met = left.join(right, [key, "_b"]).where("start < r_end and end > r_start")
    return met.where(F.col("_b") == F.floor(F.greatest("start", "r_start") / bucket)).drop("_b")


def keyword_rank(text: Column, families) -> Column:
    """Number of the first family with a keyword in ``text``; NULL if none."""
    out = F
    for number, words in families:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = out.when(hit, number)
    return out.otherwise(F.lit(None).cast("int"))


def keyword_all(text: Column, families) -> Column:
    """Array of the numbers of all families with a keyword in ``text``."""
    found = []
    for number, words in families:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        found.append(F.when(hit, number))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def numbered_names(df: DataFrame, keys: list[str], name: str, *order: Column, coarse: list[Column] | None = None) -> DataFrame:
    """Add ``unique_name``: later rows of one name get ``_2``, ``_3`` before the suffix.

    With ``coarse`` steps of the order, a name that very many rows share is dealt over tasks.
    """
    if coarse:
        df = running_before(df, [*keys, name], F.lit(1), "_n", coarse, *order).withColumn("_n", F.col("_n") + 1)
    else:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order)))
    n = F.col("_n")
    suffix = F.regexp_extract(name, r"\.[^.]*$", 0)
    stem = F.substring(F.col(name), F.lit(1), F.char_length(name) - F.char_length(suffix))
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), suffix))).drop("_n")


def until_terminal(events: DataFrame, key: str, terminal: Column, *order: Column) -> DataFrame:
    """Events of each key up to and with the first terminal one."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.when(terminal, 1).otherwise(0)).over(w), F.lit(0))
    return events.withColumn("_e", ended).where("_e = 0").drop("_e")


def runs_of_hits(df: DataFrame, key: str, hit: Column, misses: int, *order: Column) -> DataFrame:
    """Hits of each key before the ``misses``-th miss in a row."""
    w = Window.partitionBy(key).orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    block = df.withColumn("_hit", hit).withColumn("_g", F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(up_to))
    missed = F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(Window.partitionBy(key, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    stopped = block.withColumn("_m", missed).withColumn("_stop", F.max(F.when(F.col("_m") >= misses, 1).otherwise(0)).over(up_to))
    return stopped.where("_hit and _stop = 0").drop("_hit", "_g", "_m", "_stop")


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """``base`` with the non-NULL fields of ``patch``."""
    fields = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    both = base.join(p, key, "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


def replaced(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``base`` with all rows of the keys in ``new`` replaced by ``new``."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upserted(base: DataFrame, new: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """New values raise the version of known keys and start at 1 for others."""
    n = new.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    both = base.join(n, F.col(key) == F.col("_k"), "full")
    count = F.when(F.col("_k").isNull(), F.col(version)).otherwise(F.coalesce(version, F.lit(0)) + 1)
    return both.select(F.coalesce(key, "_k").alias(key), F.coalesce("_v", value).alias(value), count.cast("int").alias(version))


def keyword_sections(df: DataFrame, text: Column, families, always: int, fallback: int) -> DataFrame:
    """One row a section that a keyword in ``text`` asks for, once each, and the one that is always there; ``fallback`` first if none was asked for."""
    asked = F.array_distinct(keyword_all(F.lower(text), families))
    both = F.when(F.size(asked) == 0, F.array(F.lit(fallback))).otherwise(asked)
    return df.withColumn("section", F.explode(F.concat(both, F.array(F.lit(always)))))


def looked_up(value: Column, names: dict[str, str], default: str | None = None) -> Column:
    """``names[value]``, else the default."""
    return F.coalesce(*[F.when(value == k, v) for k, v in names.items()], F.lit(default).cast("string"))


def expiring(df: DataFrame, day: str, asof: Column, horizon: int) -> DataFrame:
    """Rows with a day that is past or at most ``horizon`` days off, which is kept between 1 and 365, and their ``days_left``."""
    left = F.datediff(F.col(day), asof)
    return df.where(F.col(day).isNotNull()).withColumn("days_left", left).where(F.col("days_left") <= max(1, min(horizon, 365)))
