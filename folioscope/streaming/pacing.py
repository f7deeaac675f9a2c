"""Pacing as a stream: a token bucket for each key, kept in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key long, event_id long, granted boolean, tokens double"


def bucket_fold(key: int, rows: pd.DataFrame, tokens: float, last: float, rate: float, capacity: float) -> tuple[pd.DataFrame, float, float]:
    """Grants for rows (t in seconds, event_id) in order of time: each takes a token of a bucket that fills at `rate` up to `capacity`."""
    out = []
    for t, e in sorted(zip(rows["t"], rows["event_id"], strict=True)):
        tokens = min(capacity, tokens + max(0.0, t - last) * rate)
        last = max(last, t)
        granted = tokens >= 1
        tokens -= granted
        out.append((key, e, bool(granted), round(tokens, 6)))
    return pd.DataFrame(out, columns=["key", "event_id", "granted", "tokens"]), tokens, last


def token_bucket(events: DataFrame, rate: float, capacity: float) -> DataFrame:
    """A stream (key, t, event_id) to its grants. State for a key: tokens left and the time of the last event."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, 0.0)
        rows = pd.concat(list(batches))
        out, tokens, last = bucket_fold(key[0], rows, tokens, last, rate, capacity)
        state.update((float(tokens), float(last)))
        yield out

    return events.groupBy("key").applyInPandasWithState(step, OUTPUT, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def token_bucket_batch(events: DataFrame, rate: float, capacity: float) -> DataFrame:
    """The same over a finished ledger. A key's events go to one task, in its order: give keys fine enough for that."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return bucket_fold(key[0], rows, capacity, 0.0, rate, capacity)[0]

    return events.groupBy("key").applyInPandas(fold, OUTPUT)
