"""Progress of pipelines as a stateful processor with timers.

The state of a project is one row for its pipeline and a map of its steps, so
that a signal writes the step that it changes and no more.  While a step runs, a
timer tells the progress between signals, interpolated by the step's usual
seconds.  A pipeline that completes or fails drops its state at once; one that
falls silent loses it after ``keep`` seconds.

Signals are those of :mod:`tendermill.streaming.progress`, whose functions make
every next state and snapshot; ``track_batch`` there gives the same snapshots.

Defined results: signals without a pipeline change nothing and give no row, so
do those after its end until it starts again; signals of one batch count in the
order of ``seq``, one that is not above the last is a repetition and is left out;
``live`` tells the timer's rows, which bear the last signal's ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tendermill.streaming.progress import PIPELINES, advance, begin, progress

SNAPSHOT = "project string, seq long, status string, step string, progress int, remaining int, live boolean"
_COLUMNS = [x.split()[0] for x in SNAPSHOT.split(", ")]
ENDED = ("completed", "error")
#: Seconds between two rows of the timer, and of silence after which a project's state goes.
EVERY, KEEP = 1.0, 24 * 3600
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Tracker(StatefulProcessor):
    """Snapshots of projects; the clock of timers is that of the signals' ``at``, in seconds, shifted by ``shift``."""

    def __init__(self, every: float = EVERY, keep: float = KEEP):
        self.every, self.keep = every, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        life = int(self.keep * 1000)
        self.handle = handle
        self.pipeline = handle.getValueState("pipeline", "pipeline string, status string, error string, seq long, at double, seen double", life)
        self.steps = handle.getMapState("steps", "step string", "status string, since double, ratio double", life)

    def _known(self) -> tuple[dict | None, tuple]:
        """The state as :func:`advance` has it, and the last signal's number and time and when it came."""
        if not self.pipeline.exists():
            return None, (-1, 0.0, 0.0)
        name, status, error, *last = self.pipeline.get()
        state = begin(name) | {"status": status, "error": error}
        for (step,), (at, since, ratio) in self.steps.iterator():
            state["steps"][step] = {"status": at, "since": since, "ratio": ratio}
        return state, tuple(last)

    def _keep(self, state: dict, before: dict | None, last: tuple) -> None:
        """Write the pipeline's row and the steps that have changed."""
        self.pipeline.update((state["pipeline"], state["status"], state["error"], *last))
        if before is None or before["pipeline"] != state["pipeline"]:
            self.steps.clear()
            before = begin(state["pipeline"])
        for step, x in state["steps"].items():
            if x != before["steps"].get(step):
                self.steps.updateValue((step,), (x["status"], x["since"], x["ratio"]))

    def _drop(self) -> None:
        self.pipeline.clear()
        self.steps.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, last = self._known()
        state, out, ended = before, [], False
        now = timerValues.getCurrentProcessingTimeInMs() / 1000
        for s in pd.concat(list(rows)).sort_values("seq").to_dict("records"):
            signal = {k: None if pd.isna(v) else v for k, v in s.items()}
            if state is not None and signal["seq"] <= last[0]:
                continue
            if ended and signal["kind"] != "start":
                continue
            after = advance(None if signal["kind"] == "start" else state, signal)
            if after is None:
                continue
            state, last, ended = after, (signal["seq"], signal["at"], now), after["status"] in ENDED
            out.append((key[0], signal["seq"], *progress(state, signal["at"]), False))
        if state is not None and state is not before:
            if ended:
                self._drop()
            else:
                self._keep(state, before, last)
                self._wind(state, now)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def _wind(self, state: dict, now: float) -> None:
        """One timer ahead while a step runs, none otherwise."""
        ahead = list(self.handle.listTimers())
        runs = any(x["status"] == "in_progress" for x in state["steps"].values())
        if runs and not ahead:
            self.handle.registerTimer(int((now + self.every) * 1000))
        elif not runs:
            for at in ahead:
                self.handle.deleteTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, (seq, at, seen) = self._known()
        out = []
        if state is not None:
            now = timerValues.getCurrentProcessingTimeInMs() / 1000
            # The signals' clock goes on from the last one by as much as the timers' clock has since.
            out.append((key[0], seq, *progress(state, at + max(0.0, now - seen)), True))
            if any(x["status"] == "in_progress" for x in state["steps"].values()):
                self.handle.registerTimer(int((now + self.every) * 1000))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        """Nothing is held outside the state."""


def use_store(spark: SparkSession) -> None:
    """Maps, timers and lifetimes need the RocksDB store; set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def track(signals: DataFrame, every: float = EVERY, keep: float = KEEP) -> DataFrame:
    """A snapshot after each signal of a stream, and one each ``every`` seconds while a step runs."""
    use_store(signals.sparkSession)
    return signals.groupBy("project").transformWithStateInPandas(Tracker(every, keep), SNAPSHOT, "Append", "ProcessingTime")


def steps_of(pipeline: str) -> list[str]:
    return [s[0] for s in PIPELINES[begin(pipeline)["pipeline"]]]
