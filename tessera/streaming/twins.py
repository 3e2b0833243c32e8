"""Streaming twins of the run and gap operators. On ordered input they give the batch result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import images


def gap_sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of rows at most `gap` apart (inclusive), with bounds and counts; rows later than `late` are dropped."""
    own = events.withWatermark(ts, late)
    return own.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("w")


def windowed_counts(events: DataFrame, ts: str, width: str, step: str, late: str, *by: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, step).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def label_runs(events: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Closed runs of equal labels: (key, run_id, label, length, first, last).

    State for a key is its open run, four values; a row that comes before the last one of its key is
    an error row (run_id -1), not a silent change of what was already emitted.
    """
    kind = events.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, run_id long, label string, length long, first long, last long"

    def step(name: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, cur, n, first, last = state.get if state.exists else (0, None, 0, 0, None)
        rows = []
        for part in parts:
            for at, value in sorted(zip(part[order].tolist(), part[label].tolist())):
                if last is not None and at < last:
                    rows.append((name[0], -1, value, 1, at, at))
                    continue
                if value != cur or n == 0:
                    if n:
                        rows.append((name[0], run, cur, n, first, last))
                    run, cur, n, first = run + 1, value, 0, at
                n, last = n + 1, at
        state.update((run, cur, n, first, last))
        yield pd.DataFrame(rows, columns=[key, "run_id", "label", "length", "first", "last"])

    return events.select(key, order, label).groupBy(key).applyInPandasWithState(step, out, "run long, cur string, n long, first long, last long", "append", GroupStateTimeout.NoTimeout)


# ---- stability with a look-ahead timer ---------------------------------------------------

SETTLED = "sample_index long, t_us long, score double, reason string"
#: State of a source: active, still steps, peak, last time and index (-1 before the first row).
OPEN = (False, 0, 0.0, -1, -1)


def settle(state: tuple, rows: list[tuple[int, int, float]], trigger: float, quiet: float, hold: int) -> tuple[tuple, list[tuple]]:
    """Rows (t_us, sample_index, change) in time order through the machine: the new state, and the
    samples at which a picture that had changed has been still for `hold` steps. A row before the
    last one is told as out_of_order and changes nothing."""
    active, still, peak, last, index = state
    out = []
    for t, i, change in rows:
        if t < last:
            out.append((i, t, change, "out_of_order"))
            continue
        last, index = t, i
        if change >= trigger:
            active, peak = True, max(peak, change)
        if not active:
            continue
        still = still + 1 if change <= quiet else 0
        if still >= hold:
            out.append((i, t, max(0.4, peak), "settled_after_change"))
            active, still, peak = False, 0, 0.0
    return (active, still, peak, last, index), out


def ended(state: tuple) -> list[tuple]:
    """What a source that is over leaves: its last sample, if a change has not come to rest."""
    active, _, peak, last, index = state
    return [(index, last, max(0.3, peak), "segment_end_after_change")] if active else []


def settled_batch(samples: DataFrame, key: str, trigger: float = 0.014, quiet: float = 0.006, hold: int = 4) -> DataFrame:
    """settled_stream over a whole table: samples(key, ts, t_us, sample_index, change_score)."""
    kind = samples.schema[key].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(part["t_us"].tolist(), part["sample_index"].tolist(), part["change_score"].tolist()))
        state, out = settle(OPEN, rows, trigger, quiet, hold)
        return pd.DataFrame([(part[key].iloc[0], *r) for r in out + ended(state)], columns=[key, *(c.split()[0] for c in SETTLED.split(", "))])

    return samples.groupBy(key).applyInPandas(run, f"`{key}` {kind}, {SETTLED}")


def settled_stream(samples: DataFrame, key: str, ts: str, late: str, lookahead_ms: int, trigger: float = 0.014, quiet: float = 0.006, hold: int = 4) -> DataFrame:
    """The same machine over a stream. State for a source is five values. A timer in event time ends a
    source whose watermark is `lookahead_ms` beyond its last sample; a change that has not come to
    rest by then is told, as at the end of a batch. Rows later than `late` are dropped by the
    watermark; a row that is out of order within it is told and changes nothing."""
    kind = samples.schema[key].dataType.simpleString()
    columns = [key, *(c.split()[0] for c in SETTLED.split(", "))]

    def step(name: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = state.get if state.exists else OPEN
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(name[0], *r) for r in ended(own)], columns=columns)
            return
        rows = sorted(x for part in parts for x in zip(part["t_us"].tolist(), part["sample_index"].tolist(), part["change_score"].tolist()))
        own, out = settle(own, rows, trigger, quiet, hold)
        state.update(own)
        state.setTimeoutTimestamp(max(own[3] // 1000, state.getCurrentWatermarkMs() + 1) + lookahead_ms)
        yield pd.DataFrame([(name[0], *r) for r in out], columns=columns)

    own = samples.withWatermark(ts, late).select(key, ts, "t_us", "sample_index", "change_score")
    return own.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, {SETTLED}", "active boolean, still long, peak double, last long, index long", "append", GroupStateTimeout.EventTimeTimeout)


# ---- frames as a stream, and progress ----------------------------------------------------

def frame_stream(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """Frames of a folder as they arrive, at most `files` a batch: the rows of images.read_frames."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").option("maxFilesPerTrigger", files).load(path)
    return images.decoded(raw)


class Progress(StreamingQueryListener):
    """Tells a callback of each batch, and of the end, of the queries of a session."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"state": "started", "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"state": "running", "name": p.name, "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell({"state": "error" if event.exception else "ended", "error": event.exception})
