"""Structured Streaming: windowed statistics with late data, sessions, and the latest sample of each station."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_stats(stream: DataFrame, at: str, by: str, value: str, window: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """count, mean, min and max per window and group; rows later than `late` are left out."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return stream.withWatermark(at, late).groupBy(w, by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")).select(F.col("window.start").alias("start"), by, "n", "mean", "min", "max")


def sessions(stream: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of events of a group without a gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def latest_per_station(stream: DataFrame, station: str, at: str, value: str) -> DataFrame:
    """After every batch, the newest value of each station that had rows; state is one row per station."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (None, None)
        for f in frames:
            row = f.sort_values(at).iloc[-1]
            when = int(row[at].value)
            if best[0] is None or when >= best[0]:
                best = (when, float(row[value]))
        state.update(best)
        yield pd.DataFrame({"station": [str(key[0])], "at_ns": [best[0]], "value": [best[1]]})

    return stream.groupBy(station).applyInPandasWithState(step, "station string, at_ns long, value double", "at_ns long, value double", "update", GroupStateTimeout.NoTimeout)
