"""Streaming forms: first sight of postings, and application state event by event."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import fixed

OUTCOME = "key string, status string, followups int, last_activity string, resolved string"
_STATE = "status string, status_seq long, followups int, last_activity string, resolved string"


def first_sight(stream: DataFrame, key: str = "job_key", event_time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Each key once, when first seen; with an event time, state is kept for ``delay`` only."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def _fold(key: tuple, batches: Iterator, state) -> Iterator:
    import pandas as pd

    status, status_seq, followups, last, resolved = state.get if state.exists else (None, None, 0, None, None)
    for rows in batches:
        for now, seq, day, followup in zip(rows["status"], rows["seq"], rows["day"], rows["followup"], strict=True):
            followups += int(bool(followup))
            last = day if last is None or isinstance(day, str) and day > last else last
            if isinstance(now, str) and (status_seq is None or seq >= status_seq):
                status, status_seq, resolved = now, int(seq), day if now in fixed.FINAL_STATES else None
    state.update((status, status_seq, followups, last, resolved))
    yield pd.DataFrame([(key[0], status, followups, last, resolved)], columns=["key", "status", "followups", "last_activity", "resolved"])


def outcome_stream(events: DataFrame) -> DataFrame:
    """State of every application touched in a batch, from events (key, status, seq, day, followup).

    As in the batch form, the status is that of the largest seq and the activity that
    of the latest day, in whatever order and batches the events arrive.
    """
    return events.groupBy("key").applyInPandasWithState(_fold, OUTCOME, _STATE, "update", GroupStateTimeout.NoTimeout)
