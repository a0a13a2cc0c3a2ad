"""Progress of pipelines as a stateful stream, with a batch twin.

A signal is ``project, seq, at, kind, step, ratio``: pipelines start, steps
start, advance and complete, pipelines complete or fail.  One pure function
makes the next state; the stream keeps it in Spark's state store by project and
the batch twin folds a project's signals in order.  The clock is a column, so
results repeat.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Steps of each pipeline with their labels, first and last per cent and the seconds that they take.
PIPELINES = {
    "analysis": (
        ("preparation", "Lecture des documents", 0, 5, 2), ("analyzing_pass1", "Analyse des exigences administratives", 5, 50, 50),
        ("analyzing_pass2", "Analyse des exigences techniques", 50, 95, 50), ("finalizing", "Finalisation", 95, 100, 5),
    ),
    "memoire": (("preparing", "Préparation des données", 0, 10, 3), ("generating", "Rédaction du mémoire", 10, 85, 120), ("finalizing", "Finalisation du mémoire", 85, 100, 5)),
    "lot_detection": (("detecting_lots", "Détection des lots", 0, 100, 30),),
    "upload": (("uploading", "Transfert du dossier", 0, 30, 30), ("extracting_zip", "Extraction du ZIP", 30, 40, 5), ("extracting_text", "Indexation des documents", 40, 100, 60)),
}
SIGNAL_LIMIT, TIME_LIMIT = 0.99, 0.95
SNAPSHOT = "project string, seq long, status string, step string, progress int, remaining int"


def begin(pipeline: str) -> dict:
    """Unknown pipelines are analyses."""
    name = pipeline if pipeline in PIPELINES else "analysis"
    return {"pipeline": name, "status": "running", "error": "", "steps": {s[0]: {"status": "pending", "since": None, "ratio": None} for s in PIPELINES[name]}}


def _changed(state: dict, step: str, **new) -> dict:
    return state | {"steps": state["steps"] | {step: state["steps"][step] | new}}


def advance(state: dict | None, signal: dict) -> dict | None:
    """The state after a signal; signals that do not fit change nothing."""
    kind, step = signal["kind"], signal["step"]
    if kind == "start":
        return begin(step)
    if state is None:
        return None
    if kind == "step" and step in state["steps"]:
        return _changed(state, step, status="in_progress", since=signal["at"], ratio=None)
    if kind == "done" and step in state["steps"]:
        return _changed(state, step, status="completed", ratio=None)
    if kind == "ratio" and signal["ratio"] is not None:
        running = next((s for s, x in state["steps"].items() if x["status"] == "in_progress"), None)
        return _changed(state, running, ratio=max(0.0, min(SIGNAL_LIMIT, signal["ratio"]))) if running else state
    if kind == "complete":
        return state | {"status": "completed", "steps": {s: x | {"status": "completed"} for s, x in state["steps"].items()}}
    if kind == "error":
        return state | {"status": "error", "error": step or ""}
    return state


def progress(state: dict, now: float) -> tuple[str, str, int, int]:
    """Status (the running step's name, if any), label, per cent and seconds that remain."""
    label, percent, remaining, found, active = "", 0, 0.0, False, None
    for name, text, low, high, seconds in PIPELINES[state["pipeline"]]:
        step = state["steps"][name]
        elapsed = now - step["since"] if step["since"] is not None else 0.0
        if step["status"] == "in_progress":
            active = active or name
            remaining += max(seconds - elapsed, 0)
        elif step["status"] == "pending":
            remaining += seconds
        if found:
            continue
        if step["status"] == "completed":
            percent = high
        else:
            found, label, percent = True, text, low
            if step["status"] == "in_progress":
                ratio = step["ratio"] if step["ratio"] is not None else min(elapsed / max(seconds, 1), TIME_LIMIT)
                percent = low + int((high - low) * ratio)
    if state["status"] == "completed":
        label, percent = "Terminé", 100
    elif state["status"] == "error":
        label = state["error"] or "Erreur"
    return active or state["status"], label, min(percent, 100), round(remaining)


def _step(state: dict | None, signal: dict) -> tuple[dict | None, tuple | None]:
    """The state after a signal, and the snapshot; missing numbers are no values."""
    state = advance(state, {k: None if v != v else v for k, v in signal.items()})
    return state, None if state is None else progress(state, math.nan if signal["at"] is None else signal["at"])


def _fold(project: str, state: dict | None, signals: pd.DataFrame) -> tuple[dict | None, list]:
    out = []
    for s in signals.sort_values("seq").to_dict("records"):
        state, shown = _step(state, {k: None if pd.isna(v) else v for k, v in s.items()})
        if shown is not None:
            out.append((project, s["seq"], *shown))
    return state, out


_COLUMNS = ["project", "seq", "status", "step", "progress", "remaining"]
_SCHEMA = pa.schema([("project", pa.string()), ("seq", pa.int64()), ("status", pa.string()), ("step", pa.string()), ("progress", pa.int32()), ("remaining", pa.int32())])
_USED = ("project", "seq", "at", "kind", "step", "ratio")


def track_batch(signals: DataFrame) -> DataFrame:
    """A snapshot after each signal.

    Signals of a project lie together and in order, and pass by in batches: a
    task holds the state of one project and one batch, whatever their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(_USED)))):
                if not begun or row[0] != project:
                    project, state, begun = row[0], None, True
                state, shown = _step(state, dict(zip(_USED[1:], row[1:])))
                if shown is not None:
                    out.append((project, row[1], *shown))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    typed = signals.select(F.col("project").cast("string").alias("project"), F.col("seq").cast("long").alias("seq"), *_USED[2:])
    dealt = typed.repartition("project").sortWithinPartitions("project", F.col("seq").asc_nulls_last())
    return dealt.mapInArrow(run, SNAPSHOT)


def track_stream(signals: DataFrame) -> DataFrame:
    """The same snapshots from a stream; state survives restarts through the checkpoint."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else None
        now, out = _fold(key[0], now, pd.concat(list(frames)))
        if now is not None:
            state.update((json.dumps(now),))
        yield pd.DataFrame(out, columns=_COLUMNS)

    return signals.groupBy("project").applyInPandasWithState(run, SNAPSHOT, "state string", "append", GroupStateTimeout.NoTimeout)


def latest(signals: DataFrame) -> DataFrame:
    """Last signal of each project, as a batch or as a stream in update mode."""
    return signals.groupBy("project").agg(F.max_by("kind", F.struct("at", "seq")).alias("kind"), F.max("at").alias("at"))


def bounded_extra(extra: Column) -> Column:
    """Audit details over 10 KB keep only their first twenty keys; what is no JSON says so."""
    keys = F.slice(F.coalesce(F.json_object_keys(extra), F.array().cast("array<string>")), 1, 20)
    short = F.to_json(F.struct(F.lit(True).alias("_truncated"), keys.alias("_keys")))
    wrong = extra.isNotNull() & F.try_parse_json(extra).isNull()
    return F.when(wrong, F.lit('{"_serialization_error":true}')).when(F.octet_length(extra) > 10_240, short).otherwise(extra)


def write_audit(actions: DataFrame, path: str, checkpoint: str):
    """Append a stream of audit rows to a table."""
    kept = actions.withColumn("extra", bounded_extra(F.col("extra")))
    return kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
