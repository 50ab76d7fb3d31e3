"""Landed calls as a stream: each call once, when it is whole or its deadline has passed.

Time is that of the files: the newest one, less ``delay``, is the present. A folder in which
nothing lands stands still, so a run that only waits for deadlines lands a tick (any file).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.landing import DEADLINE, KINDS, TICK, TIMED_OUT, TIMEOUT

CALL = "call_id string, portal string, ordinal int, exit_code int, stdout string, stderr string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PART = "struct<body: string, at: double>"
_HELD = "plan string, " + ", ".join(f"{k} {_PART}" for k in KINDS) + ", told boolean"


def use_timers(spark: SparkSession) -> None:
    """State with timers needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _told(status: str | None) -> dict:
    """What a status states; nothing if it is broken."""
    try:
        told = json.loads(status or "")
    except ValueError:
        return {}
    return {k: v for k, v in told.items() if isinstance(v, int) and not isinstance(v, bool)} if isinstance(told, dict) else {}


class CallParts(StatefulProcessor):
    """Holds a call's parts until it is whole or overdue; what comes after that is passed over while the call is remembered."""

    def __init__(self, deadline: float, remember: float) -> None:
        self.deadline, self.remember = deadline, remember

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)

    def _timer(self, at: float) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(1000 * at))

    def _settled(self, key: tuple, plan: str | None, parts: dict, now: float) -> Row:
        told = json.loads(plan) if plan else {}
        self.held.update((plan, None, None, None, True))
        self._timer(now + self.remember)
        body = lambda k: parts[k][0] if parts[k] else None
        late = parts["status"] is None
        return Row(call_id=key[0], portal=told.get("portal"), ordinal=told.get("ordinal"), exit_code=TIMED_OUT if late else _told(body("status")).get("exit_code", 1), stdout=body("stdout"), stderr=TIMEOUT if late else body("stderr"))

    def _in_time(self, plan: str | None, parts: dict) -> dict:
        end = json.loads(plan)["planned_at"] + self.deadline if plan else None
        good = {k: p if p is not None and (end is None or p[1] <= end) else None for k, p in parts.items()}
        told = _told(good["status"][0]) if good["status"] else {}
        return {k: ("", 0.0) if p is None and told.get(f"{k}_bytes") == 0 else p for k, p in good.items()}

    def _state(self) -> tuple[str | None, dict, bool]:
        plan, *parts, told = self.held.get() if self.held.exists() else (None, None, None, None, False)
        return plan, {k: None if p is None else (p[0], p[1]) for k, p in zip(KINDS, parts, strict=True)}, bool(told)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        plan, parts, told = self._state()
        if told:
            return
        if key[0].startswith(TICK):
            return
        newest = 0.0
        for r in rows:
            newest = max(newest, r["at"])
            if r["kind"] == "plan":
                plan = r["body"]
            elif parts[r["kind"]] is None or r["at"] >= parts[r["kind"]][1]:
                parts[r["kind"]] = (r["body"], r["at"])
        good = self._in_time(plan, parts)
        now = max(newest, timerValues.getCurrentWatermarkInMs() / 1000)
        if plan and all(good.values()):
            yield self._settled(key, plan, good, now)
            return
        self.held.update((plan, *parts.values(), False))
        # Parts of a call that nobody planned wait for their plan as long as a call may take.
        self._timer((json.loads(plan)["planned_at"] if plan else now) + self.deadline)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        plan, parts, told = self._state()
        if told:
            self.held.clear()
        else:
            yield self._settled(key, plan, self._in_time(plan, parts), timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def call_stream(parts: DataFrame, deadline: float = DEADLINE, remember: float = 86_400, delay: str = "10 seconds") -> DataFrame:
    """Settled calls (see CALL) from streamed parts, each once while it is remembered (seconds). Files that come more than ``delay`` out of order are passed over."""
    use_timers(parts.sparkSession)
    rows = parts.select("kind", "call_id", "body", "at", F.timestamp_seconds("at").alias("clock")).withWatermark("clock", delay)
    return rows.groupBy("call_id").transformWithState(CallParts(deadline, remember), CALL, "append", "eventTime")
