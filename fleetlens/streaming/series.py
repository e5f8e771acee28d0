"""Time series over streams: fills, segments and sliding windows with keyed state, the same rows as in batch.

A series' rows wait in its state until the watermark has passed them, and are then taken in the order of time, so files may arrive in any order
within the lateness that is allowed; rows later than that are left out. What a series remembers is small: its last value, its
open segment, its last rows. Timers wake a series that gets no rows any more. State survives a restart in the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "memory string, at array<bigint>, held array<double>"


def in_order(
    df: DataFrame, advance: Callable[[object, int, float | None], tuple[object, tuple | None]], columns: str, key: str = "service", ts: str = "ts", value: str = "value", lateness: str = "10 minutes"
) -> DataFrame:
    """(key, ts, ``columns``): what ``advance`` makes of a series' memory and each of its rows (time in microseconds, value) in turn.

    It returns the new memory (anything that JSON has; null first) and the row's columns, or None for no row.
    """

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, at, held = state.get if state.exists else (None, [], [])
        rows = list(zip(at, held))
        for frame in frames:
            rows += zip(frame[ts].astype("datetime64[us]").astype("int64").tolist(), frame[value].astype("float64").tolist())
        watermark = state.getCurrentWatermarkMs()
        ready, left = sorted(r for r in rows if r[0] <= watermark * 1000), [r for r in rows if r[0] > watermark * 1000]
        memory, out = json.loads(memory or "null"), []
        for t, v in ready:
            memory, made = advance(memory, t, None if v != v else v)
            if made is not None:
                out.append((*name, pd.Timestamp(t, unit="us"), *made))
        state.update((json.dumps(memory), [t for t, _ in left], [v for _, v in left]))
        if left:
            state.setTimeoutTimestamp(max(watermark + 1, -(-min(t for t, _ in left) // 1000) - 1))
        yield pd.DataFrame(out, columns=[key, ts, *(c.split()[0] for c in columns.split(", "))])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ts, value).withWatermark(ts, lateness).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} timestamp, {columns}", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def fill(df: DataFrame, limit: int | None = 10, **how) -> DataFrame:
    """E1, E1b. (key, ts, value): nulls take the last value of at most ``limit`` rows before."""

    def advance(memory, _t, v):
        last, age = memory or (None, 0)
        last, age = (v, 0) if v is not None else (last, age + 1)
        return (last, age), (last if limit is None or age <= limit else None,)

    return in_order(df, advance, "value double", **how)


def segments(df: DataFrame, step_ms: int = 30_000, factor: int = 3, **how) -> DataFrame:
    """E3 for each series. (key, ts, segment from 0): a new segment where the step is longer than ``factor`` steps."""

    def advance(memory, t, _v):
        before, segment = memory or (t, 0)
        segment += t - before > factor * step_ms * 1000
        return (t, segment), (segment,)

    return in_order(df, advance, "segment bigint", **how)


def windows(df: DataFrame, w: int = 10, step_ms: int = 30_000, factor: int = 3, **how) -> DataFrame:
    """E4 for each series. (key, ts, segment, steps): the last ``w`` values at each row that has as many in its segment."""

    def advance(memory, t, v):
        before, segment, ring = memory or (t, 0, [])
        if t - before > factor * step_ms * 1000:
            segment, ring = segment + 1, []
        ring = [*ring, v][-w:]
        return (t, segment, ring), (segment, ring) if len(ring) == w else None

    return in_order(df, advance, "segment bigint, steps array<double>", **how)
