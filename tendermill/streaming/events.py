"""Event streams of projects: catching up, silence, throttling, billing events and the order of extraction.

Batch forms take a table of events; the ``_stream`` forms keep the same state
in Spark's state store, by project.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Seconds of silence before a sign of life, least seconds between signals, key types and size of deferred files.
SILENCE, LEAST_GAP = 25, 0.3
KEY_TYPES = ("rc", "ccap", "cctp", "dpgf", "acte_engagement")
DEFERRED_BYTES = 500 * 1024


def message(kind: Column, data: Column) -> Column:
    """An event in the wire format of server-sent events."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), data, F.lit("\n\n"))


def heartbeats(events: DataFrame, silence: int = SILENCE) -> DataFrame:
    """``project, at``: signs of life after each ``silence`` seconds without an event, up to the next event."""
    after = F.lead("at").over(Window.partitionBy("project").orderBy("at", "seq")) - F.col("at")
    gaps = events.withColumn("_gap", after).where(F.col("_gap") > silence)
    times = F.sequence(F.lit(1), F.floor((F.col("_gap") - 1) / silence))
    return gaps.select("project", "at", F.explode(times).alias("_i")).select("project", (F.col("at") + F.col("_i") * silence).alias("at"))


def heartbeat_stream(events: DataFrame, silence: int = SILENCE) -> DataFrame:
    """``project, kind``: the events, and a ``heartbeat`` whenever the clock runs out before the next one."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds = ["heartbeat"] if state.hasTimedOut else [k for f in frames for k in f["kind"]]
        state.update((len(kinds),))
        state.setTimeoutDuration(silence * 1000)
        yield pd.DataFrame({"project": [key[0]] * len(kinds), "kind": kinds})

    return events.groupBy("project").applyInPandasWithState(run, "project string, kind string", "n int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _spaced(times: list[float], last: float | None, gap: float) -> tuple[list[bool], float | None]:
    sent = []
    for at in times:
        sent.append(last is None or at - last >= gap)
        last = at if sent[-1] else last
    return sent, last


def throttled(events: DataFrame, gap: float = LEAST_GAP) -> DataFrame:
    """Events at least ``gap`` seconds after the last one kept; a group is one project's signals, which its pipeline bounds."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "seq"])
        return frame[_spaced(frame["at"].tolist(), None, gap)[0]]

    return events.select("project", "seq", "at").groupBy("project").applyInPandas(run, events.select("project", "seq", "at").schema)


def throttled_stream(events: DataFrame, gap: float = LEAST_GAP) -> DataFrame:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values(["at", "seq"])
            sent, last = _spaced(frame["at"].tolist(), last, gap)
            yield frame[sent]
        if last is not None:
            state.update((float(last),))

    kept = events.select("project", "seq", "at")
    return kept.groupBy("project").applyInPandasWithState(run, kept.schema, "last double", "append", GroupStateTimeout.NoTimeout)


def caught_up(events: DataFrame, asof: Column) -> DataFrame:
    """What a reader who comes at ``asof`` gets: the last event of each project as ``init`` (without one, ``seq`` is NULL), then all later ones."""
    known = F.col("at") <= asof
    first = events.groupBy("project").agg(F.max_by("seq", F.when(known, F.struct("at", "seq"))).alias("seq"), F.max(F.when(known, F.col("at"))).alias("at"))
    return first.withColumn("kind", F.lit("init")).select("project", "seq", "at", "kind").unionByName(events.where(~known).select("project", "seq", "at", "kind"))


def billing(events: DataFrame) -> DataFrame:
    """``organization_id, plan, subscription`` after the last event that changes them."""
    gone = F.col("type") == "customer.subscription.deleted"
    known = events.where(F.col("type").isin("checkout.session.completed", "customer.subscription.updated", "customer.subscription.deleted") & (gone | F.col("plan").isNotNull()))
    new = F.struct(F.when(gone, "free").otherwise(F.col("plan")).alias("plan"), F.when(~gone, F.col("subscription")).alias("subscription"))
    last = known.groupBy("organization_id").agg(F.max_by(new, F.struct("at", "seq")).alias("x"))
    return last.select("organization_id", "x.plan", "x.subscription")


def billing_stream(events: DataFrame, path: str, checkpoint: str):
    """Keep the table of plans under ``path`` up to date: each batch's last events replace the rows of their organisations.

    A batch writes a version of its own, so that one repeated after a loss does no harm.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        new = billing(batch)
        if number:
            old = batch.sparkSession.read.parquet(f"{path}/version={number - 1}")
            new = old.join(new.select("organization_id"), "organization_id", "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{path}/version={number}")

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def extraction_phases(files: DataFrame) -> DataFrame:
    """Add ``phase`` (1 now, 2 in the background) and ``placeholder``: large PDF files of no key type wait."""
    late = F.lower("file_name").endswith(".pdf") & ~F.coalesce(F.col("type").isin(*KEY_TYPES), F.lit(False)) & (F.col("size") > DEFERRED_BYTES)
    told = F.concat(F.lit("[document volumineux - "), F.col("file_name"), F.lit("]"))
    return files.withColumns({"phase": F.when(late, 2).otherwise(1), "placeholder": F.when(late, told)})


def parsed(text: Column) -> Column:
    """``kind, data`` of the blocks of a stream's text; lines of data are joined, comments and blocks without data are left out."""

    def one(block: Column) -> Column:
        lines = F.split(block, "\n")
        field = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.ltrim(F.substring(x, len(name) + 2, 1 << 30)))
        return F.struct(F.coalesce(F.get(field("event"), F.lit(0)), F.lit("message")).alias("kind"), F.when(F.size(field("data")) > 0, F.array_join(field("data"), "\n")).alias("data"))

    return F.filter(F.transform(F.split(text, "\n\n"), one), lambda x: x["data"].isNotNull())


def stream_ratio(chars: Column, tokens: int = 16_384, per_token: float = 3.5) -> Column:
    """Progress of an answer by its characters so far, never all of it."""
    return F.least(F.lit(0.99), chars / (tokens * per_token))
