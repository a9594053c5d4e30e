"""Additions for streams: windowed latency, deduplication within a watermark, a session's shared prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latency_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", budget: float = 16.0) -> DataFrame:
    """Per window and kind of event: number, maximum, share over a budget. The same for a stream and a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = events.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"), (F.count_if(F.col("value") > budget) / F.count("*")).alias("over"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "most", F.round("over", 9).alias("over"))


def latency_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Per user and session, which a gap ends: start, number of events, sum of values."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select("user_id", F.col("session_window.start").alias("start"), "n", "total")


def keep_first_stream(lines: DataFrame, content: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first of equal contents that come within a watermark of each other."""
    return lines.withWatermark(time, late).dropDuplicatesWithinWatermark([content])


def shared_prefixes(keys: DataFrame, session: str, order: str, text: str, timeout_ms: int | None = 60_000) -> DataFrame:
    """For each keystroke of a session how many characters of its text the one before had already: what a cache keeps.
    The state is the last text; it is dropped when a session is idle for ``timeout_ms``, with None never."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for at, t in zip(rows[order], rows[text], strict=True):
            n = next((i for i, (a, b) in enumerate(zip(t, last, strict=False)) if a != b), min(len(t), len(last)))
            out.append((key[0], at, n))
            last = t
        state.update((last,))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=[session, order, "shared"])

    kinds = {f.name: f.dataType.simpleString() for f in keys.schema}
    return keys.select(session, order, text).groupBy(session).applyInPandasWithState(update, f"{session} {kinds[session]}, {order} {kinds[order]}, shared int", "last string", "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
