"""Answers that arrive step by step: held by request until complete, then told once.

Events come in any order, late and repeated. Each request's steps are kept in a keyed map state; a request is complete
when its last step is known and none before it is missing, and then gives one row and its steps are dropped. What is
left is a mark, so that repeated steps don't open the request again. An event-time timer ends both: once the watermark
is ``hold`` past a request's first step to arrive, an incomplete request gives what it has up to the first gap, marked
as incomplete, and a mark goes. Steps older than the watermark are dropped by the engine, so state stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "request_id string, step int, piece string, is_last boolean, at timestamp"
ANSWERS = "request_id string, text string, n_steps int, is_complete boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Assembler(StatefulProcessor):
    def __init__(self, hold_ms: int) -> None:
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "step int", "piece string")
        self.end = handle.getValueState("end", "last int")  # the last step, -1 while it is not known
        self.told = handle.getValueState("told", "yes boolean")

    def whole(self, key: str, last: int | None) -> tuple[list[str], bool]:
        """The pieces up to the first gap, and whether they end with the last step."""
        found: list[str] = []
        while self.pieces.containsKey((len(found),)):
            found.append(self.pieces.getValue((len(found),))[0])
            if last is not None and len(found) > last:
                return found, True
        return found, False

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.told.exists():
            return
        fresh, last = not self.end.exists(), None
        if not fresh:
            last = self.end.get()[0]
            last = None if last < 0 else last
        begun = None
        for r in rows:
            begun = r.at if begun is None else min(begun, r.at)
            if r.step is None or r.step < 0:
                continue
            if not self.pieces.containsKey((r.step,)):  # the first of repeated steps counts
                self.pieces.updateValue((r.step,), (r.piece or "",))
            if r.is_last:
                last = r.step if last is None else min(last, r.step)
        self.end.update((-1 if last is None else last,))
        if fresh:
            self.handle.registerTimer(int(begun.timestamp() * 1000) + self.hold_ms)
        found, done = self.whole(key[0], last)
        if done:
            self.pieces.clear()
            self.told.update((True,))
            yield Row(request_id=key[0], text="".join(found), n_steps=len(found), is_complete=True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.told.exists():
            found, _ = self.whole(key[0], None)
            yield Row(request_id=key[0], text="".join(found), n_steps=len(found), is_complete=False)
        self.pieces.clear()
        self.end.clear()
        self.told.clear()

    def close(self) -> None:
        pass


def arriving(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).json(path)


def assembled(events: DataFrame, hold_ms: int = 60_000, late: str = "1 minute") -> DataFrame:
    """events: request_id, step (from 0), piece, is_last, at. One row a request, when it is complete or its time is up."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    named = events.where("request_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return named.groupBy("request_id").transformWithState(statefulProcessor=Assembler(hold_ms), outputStructType=ANSWERS, outputMode="Append", timeMode="EventTime")
