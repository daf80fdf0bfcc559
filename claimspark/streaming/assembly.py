"""Claims whose frames arrive in pieces: held as state until complete, then released at once."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the library

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocks_db(spark: SparkSession, start):
    """Start a query whose operators keep several states; it keeps the provider from its start."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        return start()
    finally:
        spark.conf.set(PROVIDER, before)


class Assembler(StatefulProcessor):
    """Frames of one claim: a map by frame index, so a frame that is sent twice counts once (the first stays)."""

    def __init__(self, hashes: list[str], hold_ms: int, remember_ms: int):
        self.hashes, self.hold_ms, self.remember_ms = hashes, hold_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "frame_index int", ", ".join(f"{h} string" for h in self.hashes))
        self.facts = handle.getValueState("facts", "seen int, expected int, released boolean, latest bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen, expected, released, latest = self.facts.get() or (0, None, False, 0)
        new = not self.facts.exists()
        for r in rows:
            latest = max(latest, int(r.event_ts.timestamp() * 1000))
            if released:
                yield self.row(key, r.frame_index, tuple(r[h] for h in self.hashes), "late")
                continue
            expected = r.n_frames if expected is None else max(expected, r.n_frames or 0)
            if not self.frames.containsKey((r.frame_index,)):
                self.frames.updateValue((r.frame_index,), tuple(r[h] for h in self.hashes))
                seen += 1
        self.facts.update((seen, expected, released, latest))
        if released:
            return
        if expected is not None and seen >= expected:
            yield from self.release(key, "complete", timerValues)
        elif new:
            self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.hold_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.facts.exists() and not self.facts.get()[2]:
            yield from self.release(key, "expired", timerValues)
        else:
            self.facts.clear()

    def release(self, key, status: str, timerValues) -> Iterator[Row]:
        for index, values in self.frames.iterator():
            yield self.row(key, index[0], values, status)
        seen, expected, _, latest = self.facts.get()
        self.frames.clear()
        self.facts.update((seen, expected, True, latest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.remember_ms)

    def row(self, key, index: int, values: tuple, status: str) -> Row:
        return Row(claim_id=key[0], frame_index=index, **dict(zip(self.hashes, values)), status=status)

    def close(self) -> None:
        pass


def assembled(frames: DataFrame, hashes: list[str], delay: str = "10 minutes", hold_s: int = 3600, remember_s: int = 7 * 86400) -> DataFrame:
    """Frames of a stream, all of a claim together: ``claim_id, frame_index, hashes, status``.

    Reads ``claim_id, frame_index, n_frames, event_ts`` and the hash columns. A claim is released in the batch in which it
    has ``n_frames`` frames (``complete``), or when the watermark passes the first frames by ``hold_s``
    (``expired``; also claims that never say how many frames they have). Frames of a claim that was released
    come out at once (``late``) until the watermark has moved ``remember_s`` further. Rows without claim, index
    or time take no part.
    """
    out = StructType([frames.schema["claim_id"], StructField("frame_index", IntegerType()),
                      *[StructField(h, StringType()) for h in hashes], StructField("status", StringType())])
    rows = frames.select("claim_id", *[F.col(c).cast("int").alias(c) for c in ("frame_index", "n_frames")], "event_ts", *hashes).where("claim_id is not null and frame_index is not null and event_ts is not null")
    return (rows.withWatermark("event_ts", delay).groupBy("claim_id")
            .transformWithState(Assembler(hashes, hold_s * 1000, remember_s * 1000), out, "Append", "EventTime"))

