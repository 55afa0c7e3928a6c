"""Structured Streaming forms of the event log: counts in windows, latest records, and the state of units."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.queue import TRANSITIONS


def window_counts(events: DataFrame, ts: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, kind, n: events in tumbling windows; later than ``late`` they are dropped once their window closed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def session_counts(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user, session_start, session_end, n: events of a user without a pause of ``gap``."""
    s = F.session_window(ts, gap).alias("w")
    return events.withWatermark(ts, late).groupBy(s, user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once_each(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Events without those delivered again within ``late``."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def unit_states(events: DataFrame, unit: str, ts: str, event: str) -> DataFrame:
    """unit, status, applied: the state of each unit after its events so far, as an update stream.

    Events of one micro-batch are applied in order of time; the transitions are those of the batch fold.
    """
    kind = events.schema[unit].dataType.simpleString()

    def apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, applied = state.get if state.exists else ("PENDING", 0)
        rows = pd.concat(list(frames)).sort_values([ts, event], kind="stable")
        for name in rows[event]:
            sources, target = TRANSITIONS.get(name, ((), status))
            if status in sources:
                status, applied = target, applied + 1
        state.update((status, applied))
        yield pd.DataFrame({unit: [key[0]], "status": [status], "applied": [applied]})

    return events.select(unit, ts, event).groupBy(unit).applyInPandasWithState(
        apply, f"{unit} {kind}, status string, applied int", "status string, applied int", "update", GroupStateTimeout.NoTimeout
    )
