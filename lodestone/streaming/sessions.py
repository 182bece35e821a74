"""An extension: conversation slots kept over a stream of messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SLOTS = "session_id string, seq bigint, gas string, capacity double"


def carry_forward(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each message (session_id, seq, ts, gas, capacity, full) with slots filled from earlier ones of its session.

    State is one row a session and leaves when the watermark has passed its last message by an hour."""

    def fold(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        gas, capacity = state.get if state.exists else (None, None)
        out, last = [], 0
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if r.full is True:
                gas, capacity = None, None
            gas = r.gas if isinstance(r.gas, str) else gas
            capacity = r.capacity if pd.notna(r.capacity) else capacity
            out.append((key[0], r.seq, gas, capacity))
            last = max(last, int(r.ts.timestamp() * 1000))
        state.update((gas, capacity))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame(out, columns=["session_id", "seq", "gas", "capacity"])

    grouped = messages.withWatermark("ts", late).groupBy("session_id")
    return grouped.applyInPandasWithState(fold, SLOTS, "gas string, capacity double", "append", GroupStateTimeout.EventTimeTimeout)


def turns_by_window(messages: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, role, messages, sessions): messages by event-time window, late ones within the watermark included."""
    window = F.window("ts", width)
    counted = messages.withWatermark("ts", late).groupBy(window, "role")
    return counted.agg(F.count("*").alias("messages"), F.approx_count_distinct("session_id").alias("sessions")).select("window.start", "role", "messages", "sessions")
