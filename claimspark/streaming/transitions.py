"""The upload queue as a guarded state machine per claim, with a timer for uploads that got stuck."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the library

# The state that an action leads to from each state it is allowed in. A failed upload waits
# for its next attempt like a pending one; rejected claims may be queued again with new evidence.
ALLOWED = {
    "queued": {None: "pending", "rejected": "pending"},
    "retried": {"failed": "pending"},
    "started": {"pending": "processing", "failed": "processing"},
    "uploaded": {"processing": "done"},
    "invalid": {"processing": "rejected"},
    "failed": {"processing": "failed"},
}
STUCK = "processing"


class Guard(StatefulProcessor):
    def __init__(self, stuck_ms: int):
        self.stuck_ms = stuck_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, last_seq bigint, since bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, last, since = self.now.get() or (None, None, 0)
        # the order of one claim's actions matters, and a micro-batch bounds how many there are
        for r in sorted(rows, key=lambda r: (r.event_seq, r.action)):
            stale = last is not None and r.event_seq <= last
            to = None if stale else ALLOWED.get(r.action, {}).get(state)
            verdict = "stale" if stale else "illegal" if to is None else "applied"
            yield Row(claim_id=key[0], event_seq=r.event_seq, event_ts=r.event_ts, action=r.action, from_state=state,
                      to_state=state if to is None else to, verdict=verdict)
            if to is not None:
                state, last, since = to, r.event_seq, int(r.event_ts.timestamp() * 1000)
        self.keep(state, last, since, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, last, since = self.now.get() or (None, None, 0)
        if state != STUCK:
            return
        at = since + self.stuck_ms
        yield Row(claim_id=key[0], event_seq=last, event_ts=dt.datetime.fromtimestamp(at / 1000), action="recovered", from_state=state,
                  to_state="pending", verdict="applied")
        self.keep("pending", last, at, timerValues)

    def keep(self, state: str | None, last: int | None, since: int, timerValues) -> None:
        if last is not None:
            self.now.update((state, last, since))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state == STUCK:
            self.handle.registerTimer(max(since, timerValues.getCurrentWatermarkInMs()) + self.stuck_ms)

    def close(self) -> None:
        pass


def transitions(events: DataFrame, delay: str = "10 minutes", stuck_s: int = 1800) -> DataFrame:
    """Every action of a stream with what it did: ``claim_id, event_seq, event_ts, action, from_state, to_state, verdict``.

    Reads ``claim_id, event_seq, event_ts, action``. Actions are taken in order of ``event_seq`` within a micro-batch; one that its
    claim's state does not allow is ``illegal`` and changes nothing, one that comes after a later one was applied
    is ``stale``. A claim still in processing when the watermark has moved ``stuck_s`` past its start goes back to
    pending (action ``recovered``). Rows without claim, number or time take no part.
    """
    out = StructType([events.schema["claim_id"], StructField("event_seq", LongType()), StructField("event_ts", TimestampType()), StructField("action", StringType()),
                      StructField("from_state", StringType()), StructField("to_state", StringType()), StructField("verdict", StringType())])
    rows = (events.select("claim_id", F.col("event_seq").cast("long").alias("event_seq"), F.col("event_ts").cast("timestamp").alias("event_ts"), F.coalesce("action", F.lit("")).alias("action"))
            .where("claim_id is not null and event_seq is not null and event_ts is not null"))
    return (rows.withWatermark("event_ts", delay).groupBy("claim_id")
            .transformWithState(Guard(stuck_s * 1000), out, "Append", "EventTime"))
